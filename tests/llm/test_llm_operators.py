"""Small cases of every corpus operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmament.llm import decontaminate as dc
from firmament.llm import exact_dedup as ed
from firmament.llm import html_wrapper as hw
from firmament.llm import language_id as li
from firmament.llm import license_scan as ls
from firmament.llm import lm_scoring as lm
from firmament.llm import ngram_join as nj
from firmament.llm import sentencepiece as sp
from firmament.llm import token_counts as tc
from firmament.llm import url_filter as uf
from firmament.llm.common import shingle_sets, words
from firmament.llm.registry import load
from tests.compare import compare, duck

QUERIES, ORACLES = load()
GAPS = "[\x20\x09-\x0d]+"
#: Columns named like results must neither break an operator nor leak into it.
CLASH = "doc_id long, text string, lang string, kept boolean, score double, ids string, length long, _id string, _text string, id string, n long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, True, 1.0, "x", 7, "y", "z", "w", 3) for i, t, g in rows], CLASH)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf, key):
    ok, n, _, _, note = compare(spark, con, key, QUERIES[key], ORACLES[key], sf)
    assert ok and n > 0, note


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


# 1. Token counts

def test_token_counts(spark, sf):
    import tiktoken

    texts = [None, "", "one two", "one two", "x" * 5000, "Ünï çode 一二三 \n\n tabs\t" * 40]
    enc: tiktoken.Encoding = tc.encoding(f"{tc.TOKENIZERS}/byte_bpe_50k.tiktoken", tc.SPLIT)
    n = [len(enc.encode_ordinary(t or "")) for t in texts]
    docs = docs_of(spark, [(i, t, None) for i, t in enumerate(texts)])
    rows = {r.length: r for r in tc.suffix_sums(tc.length_histogram(tc.encoded_lengths(docs)), block=2).collect()}
    assert {k: r.n_docs for k, r in rows.items()} == collections.Counter(n)
    for k, r in rows.items():
        assert r.docs_over == sum(x > k for x in n) and r.tokens_over == sum(x for x in n if x > k)
        assert r.tokens_kept == sum(min(x, k) for x in n) and r.quantile == pytest.approx(sum(x <= k for x in n) / len(n))
    limits = [0, 1, 2, 3, 50, 10**6]
    at = {r.context_limit: r for r in tc.at_limits(tc.suffix_sums(tc.length_histogram(tc.encoded_lengths(docs))), limits).collect()}
    for k in limits:
        assert (at[k].docs_over, at[k].tokens_kept) == (sum(x > k for x in n), sum(min(x, k) for x in n))
    none = tc.suffix_sums(tc.length_histogram(tc.encoded_lengths(docs.limit(0))))
    assert none.count() == 0 and tc.at_limits(none, limits).count() == 0 and tc.at_limits(none, []).count() == 0


# 2. Exact dedup

def test_exact_dedup_cases(spark):
    rows = [(5, "a  b", None), (3, "a\tb", None), (9, None, None), (8, "", None), (7, " ", None), (1, "a b c", None), (1, "a b c", None),
            (2, "q" * 100 + "1", None), (4, "q" * 100 + "2", None), (6, "q" * 100 + "1", None)]
    got = sorted(tuple(r) for r in ed.exact_dedup(docs_of(spark, rows), filter_bits=16).collect())
    want = []
    norm = {k: re.sub(GAPS, " ", t or "") for k, (_, t, _) in enumerate(rows)}
    for k, (i, _, _) in enumerate(rows):
        same = [rows[j][0] for j in norm if norm[j] == norm[k]]
        want.append((i, min(same), len(same), i == min(same)))
    assert got == sorted(want)
    assert ed.exact_dedup(docs_of(spark, rows).limit(0)).count() == 0
    plan = ed.exact_dedup(docs_of(spark, rows), digest=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 3. SentencePiece

@pytest.fixture(scope="module")
def unigram():
    """The library's own lattice search for the best sum of scores over the same pieces, as an independent answer."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(sp.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def ids_of(raw):
    return np.frombuffer(raw, np.int32).tolist()


def test_words_equal_the_library(unigram):
    p = sp.pieces(sp.MODEL)
    for word in "the hello wörld Tokenization x1234 überall naïveté ing".split():
        mine, theirs = ids_of(p.encode(" " + word)), unigram.nbest_encode_as_ids(word, 2)[0]
        assert mine == theirs or p.value(mine) == p.value(theirs), word


@pytest.mark.parametrize("text", ["plain words " * 40, "nospacesatall" * 50, "  two   spaces \n\t and ▁ marks " * 20, "一二三四🙂" * 60, "a" * 700])
def test_chunks_equal_one_pass(text):
    """Transfer matrices and per-chunk backtracing give the score of one sequential search, for any chunk size."""
    p = sp.pieces(sp.MODEL)
    spaced = " " + text
    best, back = p.forward(spaced, 0, len(spaced))
    for chunk in (17, 64, 250):
        cuts = list(range(0, len(spaced), chunk))
        parts = [(spaced[c:c + chunk + p.longest - 1], min(chunk, len(spaced) - c)) for c in cuts]
        matrices, orders = (np.stack(x) for x in zip(*(p.transfer(t, n) for t, n in parts)))
        states = sp.boundary_states(matrices, orders)
        assert sp.scan(matrices)[-1][0, 0] == pytest.approx(best[-1])
        ids = [i for (t, n), a, b in zip(parts, states, states[1:]) for i in ids_of(p.backtrace(t, n, int(a), int(b)))]
        assert b"".join(p.raw[i] for i in ids).decode() == spaced
        assert p.value(ids) == pytest.approx(best[-1])
    assert p.value(ids_of(p.encode(spaced))) == p.value(p.trace(spaced, back, 0, len(spaced))) == pytest.approx(best[-1])


def test_max_plus_is_associative():
    draw = np.random.default_rng(1)
    a, b, c = draw.integers(-9, 9, (3, 4, 4)).astype(float)
    assert (sp.compose(sp.compose(a, b), c) == sp.compose(a, sp.compose(b, c))).all()
    many = draw.integers(-9, 9, (11, 4, 4)).astype(float)
    whole, one = many[0], sp.scan(many)
    for k in range(1, 11):
        whole = sp.compose(whole, many[k])
        assert (one[k] == whole).all()


def test_encode_decode_round_trip(spark):
    texts = [None, "", " ", "  lead and trail  ", "▁ marker ▁▁", "giant words " * 300, "giantword" * 400, "tab\tnew\nline 一🙂\x00", "giant words " * 300]
    docs = docs_of(spark, [(i, t, None) for i, t in enumerate(texts)])
    tokens = sp.encode(docs, chunk=500)
    assert tokens.columns == ["doc_id", "ids"]
    got = {r.doc_id: r.text for r in sp.decode(tokens).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    small = {r.doc_id: r.ids for r in sp.encode(docs, chunk=10**6).collect()}
    p = sp.pieces(sp.MODEL)
    for r in tokens.collect():
        assert p.value(r.ids) == pytest.approx(p.value(small[r.doc_id]))
    assert sp.encode(docs.limit(0)).count() == 0
    assert {r.doc_id: r.ids for r in tokens.collect()} == small
    odd = spark.createDataFrame([(1, None), (2, [p.byte[0xC3]]), (3, [p.ids["x"], p.ids[" a"]]), (4, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sp.decode(odd).collect()} == {1: "", 2: "\ufffd", 3: "x a", 4: ""}


def test_ids_do_not_depend_on_the_chunk():
    """Ties at chunk borders too: chunks give the ids of the whole text, and those of the stated rule by plain search."""
    p = sp.pieces(sp.MODEL)
    draw = random.Random(9)
    kinds = ["ab", "aab ", "the  cat ", "xyzzy -=", "aaaa", "一é🙂 a", "=-_ .,", "nananas "]
    ties = 0
    for _ in range(100):
        text = " " + "".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randint(18, 400)))
        want = p.encode(text)
        _, back = p.forward(text, 0, len(text))
        assert p.trace(text, back, 0, len(text)) == np.frombuffer(want, np.int32).tolist()
        for chunk in (17, 37, 64, 250):
            starts = range(0, len(text), chunk)
            sizes = [min(chunk, len(text) - a) for a in starts]
            parts = [text[a:a + chunk + p.longest - 1] for a in starts]
            matrices, orders = (np.stack(x) for x in zip(*map(p.transfer, parts, sizes)))
            s = sp.boundary_states(matrices, orders)
            ties += any(((t := sp.scan(matrices)[i - 1, 0] + matrices[i][:, s[i + 1]]) == t.max()).sum() > 1 for i in range(1, len(parts)))
            assert b"".join(map(p.backtrace, parts, sizes, s[:-1].tolist(), s[1:].tolist())) == want, (text, chunk)
    assert ties > 20


# 4. N-gram Jaccard join

def groups_by_hand(rows):
    sets = {}
    for i, t, _ in rows:
        w = [x for x in re.split(GAPS, low(t)) if x]
        sets.setdefault(i, []).append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in sets}, {i: [len(s) for s in x] for i, x in sets.items()}


def test_ngram_join_equals_brute_force(spark):
    draw = random.Random(3)
    vocabulary = ["w%d" % k for k in range(60)]
    passage = [draw.choice(vocabulary) for _ in range(30)]
    rows = [(900, None, None), (901, "", None), (902, " \n", None), (903, "one two", None), (904, "One  two", None), (905, "one two three", None)]
    for g in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(20, 80))]
        for v in range(6):
            text = list(base)
            for _ in range(draw.randint(0, 3)):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            rows.append((draw.randrange(10**6), " ".join(text + (passage if v % 3 == 0 else [])), None))
    rows += [(10**6 + k, " ".join(passage + [draw.choice(vocabulary) for _ in range(6)]), None) for k in range(40)]
    rows += [(10**7 + k, "very " * 9 + "same text for all of these copies here", None) for k in range(30)]
    rows.append(rows[20])
    got = nj.similar_groups(docs_of(spark, rows)).collect()
    want, sizes = groups_by_hand(rows)
    assert len(got) == len(rows)
    assert [(r.doc_id, r.component_id) for r in got if r.component_id != want[r.doc_id]] == []
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)
    assert nj.similar_groups(docs_of(spark, rows).limit(0)).count() == 0


def test_ngram_join_forms_no_pairs_within_a_group(spark):
    """A group of near copies costs links to its centre, not its square."""
    draw = random.Random(5)
    base = ["t%d" % k for k in range(120)]
    rows = []
    for k in range(300):
        text = list(base)
        if k:
            text[draw.randrange(120)] = "edit%d" % k
        rows.append((k, " ".join(text), None))
    src = nj._sources(docs_of(spark, rows), "doc_id", "text")
    full = nj.profiles(src, 5)
    classes = full.groupBy("n", "d1", "d2").agg(F.min("id").alias("id"))
    lists = nj.short_lists(src, classes, nj.list_lengths(src, 5), 5)
    links = nj.star_links(lists, src, 5)
    assert links.count() <= 300
    assert nj.candidates(lists, nj._labels(links)).count() < 300
    assert {r.component_id for r in nj.similar_groups(docs_of(spark, rows)).collect()} == {0}


def test_word_hashes_follow_words():
    column = pa.array(["Ab  cd\nef", None, "", "ab cd", "\x0bEF\x0c", "é É"])
    h, b = words(column)
    assert b.tolist() == [0, 3, 3, 3, 5, 6, 8]
    assert h[0] == h[3] and h[1] == h[4] and h[2] == h[5] and h[6] != h[7]
    assert [len(s) for s in shingle_sets(column, 5)] == [1, 0, 0, 1, 1, 1]


# 5. LM scoring

def test_lm_scoring(spark):
    good = ["the cat sat on the mat"] * 20
    other = ["zz yy xx ww vv"] * 20
    rows = [(i, t, None) for i, t in enumerate(good + other + ["", None, "the cat sat", "zz yy xx", "never seen words"])]
    docs = docs_of(spark, rows).withColumns({c: F.lit("clash") for c in ("n_tokens", "loss_target", "chunk", "corpus", "_target")})
    marked = lm.flagged(docs, docs.where("doc_id < 20").select("doc_id"))
    assert marked.where("_target").count() == 20
    got = {r.doc_id: r for r in lm.score_all(marked, target_col="_target").collect()}
    assert len(got) == len(rows) and got[42].loss_difference < 0 < got[43].loss_difference
    assert got[40].n_tokens == got[41].n_tokens == 0 and got[40].loss_difference is None
    assert got[0].loss_difference == got[1].loss_difference < 0
    alone = {r.doc_id: r for r in lm.score_all(lm.flagged(docs, docs.where("doc_id = 44").select("doc_id")), target_col="_target").collect()}
    assert alone[44].loss_target == pytest.approx(np.log(13 + 3))  # its own counts do not speak for it: 13 words, and nothing counted


def lm_by_hand(texts, good, strength=64.0, left_out=True):
    """(loss_target, loss_background) of every text that has words, by counting everything; good texts without themselves in the first."""
    runs = [["<s>", *low(t).split(), "</s>"] for t in texts]
    vocabulary = {w for r in runs for w in r[1:-1]}
    out = [[] for _ in runs]
    for corpus in (list(good), range(len(runs))):
        for k, r in enumerate(runs):
            own = [runs[j] for j in corpus if len(runs[j]) > 2 and not (left_out and len(corpus) < len(runs) and j == k)]
            pairs = collections.Counter(p for r in own for p in zip(r, r[1:]))
            said, after = collections.Counter(w for r in own for w in r[1:]), collections.Counter(w for r in own for w in r[:-1])
            whole = sum(said.values()) + len(vocabulary) + 3
            p = [(pairs[h, w] + strength * (said[w] + 1) / whole) / (after[h] + strength) for h, w in zip(r, r[1:])]
            out[k].append(-sum(np.log(p)) / len(p))
    return out


@pytest.mark.parametrize("held", [40, 1 << 20])
def test_lm_whole_models_equal_counting_by_hand(spark, held):
    draw = random.Random(9)
    texts = [" ".join(draw.choice("aBcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(1, 30))) for _ in range(60)] + [None, "", " \n"]
    docs = docs_of(spark, [(k, t, None) for k, t in enumerate(texts)] + [(0, texts[0], None)])
    got = lm.score_all(docs, docs.where("doc_id between 10 and 29"), held=held).collect()
    every = [t or "" for t in [*texts, texts[0]]]
    want = lm_by_hand(every, range(10, 30), left_out=False)
    assert len(got) == len(texts) + 1 and sum(r.doc_id == 0 for r in got) == 2
    for r in got:
        n = len((texts[r.doc_id] or "").split())
        assert r.n_tokens == n and (r.loss_difference is None) == (n == 0)
        if n:
            assert [r.loss_target, r.loss_background] == pytest.approx(want[r.doc_id])
    marked = lm.flagged(docs, docs.where("doc_id between 10 and 29 or doc_id is null").select("doc_id"))
    once = {r.doc_id: r for r in lm.score_all(marked, held=held, target_col="_target").collect()}
    assert len(once) == len(texts)
    want = lm_by_hand(every, range(10, 30))
    for r in got:
        if r.n_tokens:
            assert [once[r.doc_id].loss_target, once[r.doc_id].loss_background] == pytest.approx(want[r.doc_id])
    assert lm.score_all(docs.limit(0), docs.limit(0)).count() == 0
    none = lm.score_all(docs, docs.limit(0)).where("doc_id = 5").first()
    assert none.loss_target == pytest.approx(np.log(len({w for t in texts for w in low(t).split()}) + 3))


def test_lm_query_keeps_rare_words(spark, tmp_path):
    """Words that are less than a hundred thousandth of the corpus, which relative floors made one unknown word."""
    texts = ["many common words here " * 5000 for _ in range(20)] + ["rarex raree", "rarex raree", "rarey raref", "rarey raref"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in (0, 20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_lm_scoring"](spark, str(tmp_path)).collect()}
    want = lm_by_hand(texts, [0, 20])
    assert got[21].loss_difference < got[22].loss_difference
    for k in got:
        assert [got[k].loss_target, got[k].loss_background] == pytest.approx(want[k])


# 6. Licences

def test_license_cases(spark):
    mit = "Released under the MIT License."
    rows = [(1, f"text\n{mit}\nmore", None), (1, f"text\n{mit}\nmore", None), (2, None, None), (3, "", None), (4, "released UNDER, the  mit license", None),
            (5, ls.TEMPLATES[-3][1].replace(", ", ",\n"), None), (6, "word " * 5000, None), (7, "the the the the", None)]
    got = [(r.doc_id, r.unit, r.unit_no, r.license) for r in ls.scan_licenses(docs_of(spark, rows)).collect()]
    assert got.count((1, "line", 1, "MIT")) == 2 and (4, "line", 0, "MIT") in got and (5, "paragraph", 0, "MIT") in got
    assert {g[0] for g in got} == {1, 4, 5}
    assert ls.scan_licenses(docs_of(spark, rows).limit(0)).count() == 0
    plan = ls.scan_licenses(docs_of(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_size_bounds_lose_nothing():
    for least in (0.5, 0.75, 0.9):
        for size in range(1, 60):
            for n in range(1, 120):
                reach = 2 * min(n, size) / (n + size) >= least
                lo, hi = size * least / (2 - least), size * (2 - least) / least
                assert reach == (np.ceil(lo - 1e-9) <= n <= np.floor(hi + 1e-9))


# 7. URLs

def test_url_rules_and_link_graph(spark):
    link = '<a href="http://{}/x">'
    rows = [(0, None, None), (1, "nothing", link.format("evil.net")), (2, "http://Example.COM/en/a", None), (3, "http://www.example.com/en/a?q#f", None),
            (4, "http://a.net/fr/", None), (5, "http://a.net/de/", link.format("b.org")), (6, "http://b.org/p", link.format("A.net") * 2),
            (7, "http://c.org/p", '<a href="/local"><a href=//good.com/x>'), (8, "http://good.com/x", link.format("d.org")), (9, "http://d.org/", ""),
            (10, "http://good.com", None), (11, "http://notnet/fr/", None), (12, "x://y.net/es/?://z", None), (12, "x://y.net/es/?://z", None)]
    pages = spark.createDataFrame([(*r, "v", 1.0) for r in rows], "page_id long, url string, html string, verdict string, rank double")
    got = {r.page_id: r for r in uf.judge_urls(pages).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("", "", None, "allow") and got[1].verdict == "allow"
    assert (got[2].host, got[2].rule, got[2].verdict) == ("example.com", "example.com/en/", "block")
    assert (got[3].path, got[3].rule, got[3].verdict) == ("/en/a", "www.example.com/en/", "allow")
    assert got[4].rule == "net/fr/" and got[5].verdict == "block"        # same host as a blocked url
    assert got[6].verdict == "block" and got[7].verdict == "allow"       # links to a blocked host; links to an allowed one only
    assert got[9].verdict == "allow" and got[9].trust > 0 == got[9].distrust
    assert got[10].rule is None and got[11].rule is None and got[12].rule == "net/es/"
    assert len(uf.judge_urls(pages).collect()) == len(rows) and uf.judge_urls(pages.limit(0)).count() == 0


def linked_pages():
    """Hosts whose links cross: rows (page_id, url, html)."""
    link = '<a href="http://{}/x">'
    return [(1, "http://good.com/a", link.format("x.org") * 3), (2, "http://x.org/a", link.format("bad.net")), (3, "http://bad.net/es/", None),
            (4, "http://y.org/a", link.format("bad.net") + link.format("good.com")), (5, "http://z.org/a", link.format("x.org")),
            (6, "http://bad.net/de/", link.format("w.org")), (7, "http://w.org/", link.format("y.org")), (8, "http://good.com/b", link.format("z.org")),
            (9, "http://q.org/", link.format("bad.net"))]


def test_url_verdicts_do_not_depend_on_unrelated_hosts(spark):
    schema = "page_id long, url string, html string"
    alone = {r.page_id: r for r in uf.judge_urls(spark.createDataFrame(linked_pages(), schema)).collect()}
    assert {r.verdict for r in alone.values() if r.rule is None} == {"allow", "block"}
    apart = [(100 + k, f"http://s{k}.com/", None) for k in range(9)] + [(200 + k, f"http://t{k}.net/fr/", f'<a href="//s{k}.com/">') for k in range(4)]
    more = {r.page_id: r for r in uf.judge_urls(spark.createDataFrame(linked_pages() + apart, schema)).collect()}
    assert all((more[k].verdict, more[k].trust, more[k].distrust) == (r.verdict, r.trust, r.distrust) for k, r in alone.items())


def test_url_sql_on_links_across_hosts(spark, tmp_path):
    """The given pages hold no link to another host; here the check SQL itself meets edges."""
    spark.createDataFrame(linked_pages(), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["op7_url_filter"](spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert sorted(con.execute(uf.SQL).fetchall()) == got


def test_pagerank_equals_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3)]
    got = {r.host: r["rank"] for r in uf.personalised_pagerank(spark.createDataFrame(edges, "src string, dst string, n long"),
                                                              spark.createDataFrame([("a", 1.0)], "host string, weight double"), rounds=8).collect()}
    seed, rank = {"a": 1.0}, {"a": 1.0}
    total = collections.Counter()
    for s, _, n in edges:
        total[s] += n
    for _ in range(8):
        new = collections.Counter({k: 0.15 * v for k, v in seed.items()})
        for s, d, n in edges:
            new[d] += 0.85 * rank.get(s, 0) * n / total[s]
        rank = new
    assert got == pytest.approx({k: v for k, v in rank.items() if k in got})


# 8. Languages

def test_codewords_lie_apart():
    for n in (1, 2, 4, 7, 12, 40):
        code = li.codewords(n)
        assert code.shape[0] == n and len({tuple(c) for c in code}) == n
    code = li.codewords(40)
    assert min((code[a] != code[b]).sum() for a in range(40) for b in range(a)) >= code.shape[1] // 4


def test_language_id_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op8_language_id"](spark, sf).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_id_cases(spark):
    rows = [(k, "the quick brown fox and the lazy dog " * 3, "en") for k in range(8)] + [(k + 50, "der schnelle braune Fuchs und der faule Hund " * 3, "de")
                                                                                        for k in range(8)]
    odd = [(100, None, None), (101, "", "en"), (102, "123 !!", None), (103, "12 und der", None), (104, "Д", None)]
    docs = docs_of(spark, rows + odd)
    model = li.fit(docs)
    out = li.identify_languages(docs, model)
    assert out.columns[-3:] == ["lang_pred", "score", "ambiguous"] and out.columns.count("score") == 1
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows)
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0 and got[100].ambiguous
    assert got[103].lang_pred == "de" and got[104].lang_pred in ("de", "en")
    none = li.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in li.identify_languages(docs, none).collect()} == {"und"}
    assert li.identify_languages(docs.limit(0), model).count() == 0
    shuffled = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1000)
    again = {r.doc_id - 1000: r.lang_pred for r in li.identify_languages(shuffled, model).collect()}
    assert again == {i: r.lang_pred for i, r in got.items()}


# 9. HTML

def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>if (a < b) x('</p>')</script></head><body>{body}</body></html>"


def test_html_cases(spark):
    shell = ("<header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
             "<article><h1>{0} &amp; title</h1><p>First&nbsp;  <b>bold</b>\n {0} para<br>line<p>Second {0} para</p><!-- <p>no</p> -->"
             "<div class=ad>Buy</div><form><label>Mail</label></form></article><section id='comments'><p>Reader {0}</p></section>"
             "<aside><p>More {0}</p></aside><footer>(c)</footer>")
    plain = ("<div id='menu'>Menu</div><div class='wrap'><div class='text'><h2>Head {0}</h2><p>Body {0} " + "long " * 20 + "</p><p>Also {0}</p></div>"
             "<div class='block'>Same on all pages</div></div>")
    rows = [(k, f"http://a.org/{k}", page(shell.format(f"x{k}"))) for k in range(4)] + [(10 + k, f"http://b.org/{k}", page(plain.format(f"y{k}"))) for k in range(5)]
    rows += [(20, None, None), (21, "http://c.org/", ""), (22, "http://c.org/2", "just text"), (23, "http://d.org/", "<p>open <b>tags <article><p>in"),
             (10, "http://b.org/0", page(plain.format("y0")))]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, host int")
    wrappers = hw.infer_wrappers(pages)
    out = hw.extract_text(pages, wrappers).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows)
    for k in range(4):
        assert got[k] == f"x{k} & title\nFirst bold x{k} para line\nSecond x{k} para"
    for k in range(5):
        assert got[10 + k] == f"Head y{k}\nBody y{k} " + " ".join(["long"] * 20) + f"\nAlso y{k}"
    assert got[20] == "" and got[21] == "" and got[22] == "just text" and got[23] == "in"
    expression = {r.host: r.wrapper for r in wrappers.collect()}["b.org"]
    assert "('" in expression and "#text" in expression
    assert hw.extract_text(pages.limit(0), hw.infer_wrappers(pages.limit(0))).count() == 0


@pytest.mark.parametrize("body", [
    "<article><div class='entry-header'><h1>Head</h1></div><p>Text</p></article>", "<article><header class='entry-header'><h1>Head</h1></header><p>Text</p></article>",
    "<div class='layout no-sidebar'><article><h1>Head</h1><p>Text</p></article></div>", "<main class='with-sidebar'><h1>Head</h1><p>Text</p></main>",
    "<section class='legal'><article><h1>Head</h1><p>Text</p></article></section>", "<div id='search-results-page'><article><h1>Head</h1><p>Text</p></article></div>",
    "<article class='post related-topic'><h1>Head</h1><p>Text</p></article>", "<div class='no-sidebar'><h1>Head</h1><p>Text</p></div>"])
def test_class_words_around_the_content_drop_nothing(body):
    assert [t for _, t, junk in hw.blocks(page(body)) if not junk] == ["Head", "Text"]
    inner = body.replace("<p>", "<div class='sidebar'>Side</div><p>", 1)
    assert [t for _, t, junk in hw.blocks(page(inner)) if junk] == ["Side"]


def test_alignment_generalises():
    a = hw.start(hw.fold(["h", "p", "p", "f"]))
    b = hw.start(hw.fold(["h", "x", "p", "f"]))
    whole = hw.align(a, b)
    assert whole == [[["h"], False, False], [["x"], False, True], [["p"], True, False], [["f"], False, False]]
    assert hw.align(whole, a) == whole
    assert hw.fold(["h", "p", "h", "p", "q"]) == [[["h", "p"], True], [["q"], False]]


@pytest.mark.parametrize("fault", ["hidden block", "title attribute", "form around", "two makes", "constant first", "related work", "two layouts", "long page"])
def test_one_page_empties_no_other(spark, fault):
    """Ways in which one page, attribute or class word used to cost whole hosts their text."""
    said = lambda i: f"Story number {i} tells of a day unlike any other, with its own words {i * 7}."
    body = {i: f"<article><h1>Day {i}</h1><p>{said(i)}</p></article>" for i in range(9)}
    want = {i: f"Day {i}\n{said(i)}" for i in range(9)}
    if fault == "hidden block":
        body[4] = body[4].replace("<p>", '<p style="display:none">secret</p><p>', 1)
    elif fault == "title attribute":
        body = {i: b.replace("<article>", '<article title="a hidden valley">') for i, b in body.items()}
    elif fault == "form around":
        body = {i: f"<form id=aspnetForm>{b}</form>" for i, b in body.items()}
    elif fault == "two makes":
        body = {i: b if i == 0 else b.replace("article>", "div>").replace("<div>", "<div class=post>", 1) for i, b in body.items()}
    elif fault == "constant first":
        body = {i: f"<div class=hero><b>Welcome to our site</b></div><div class=post><p>{said(i)}</p>{'<p>more ' + str(i) + '</p>' * (i % 2)}</div>" for i in body}
        want = {i: said(i) + (f"\nmore {i}" if i % 2 else f"\nmore {i}") for i in body}
    elif fault == "related work":
        body = {i: b.replace("</article>", f"<section class=related-work><p>Others wrote {i}.</p></section><div class=related-posts>Next</div></article>") for i, b in body.items()}
        want = {i: t + f"\nOthers wrote {i}." for i, t in want.items()}
    elif fault == "two layouts":
        body = {i: f"<div class={'post' if i < 6 else 'entry'}><p>{said(i)}</p></div>" for i in body}
        want = {i: said(i) for i in body}
    else:
        body[3] = "<article>" + "".join(f"<p>part {k} of it</p>" for k in range(20000)) + "</article>"
        want[3] = "\n".join(f"part {k} of it" for k in range(20000))
    rows = [(i, f"http://h.example/{i}", f"<html><body><nav>Menu</nav>{b}<footer>Foot</footer></body></html>") for i, b in body.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in hw.extract_text(pages, hw.infer_wrappers(pages)).collect()}
    assert got == want


def test_expression_decides_what_is_template(spark):
    """A block of the article's own path that says the same at one place of the expression is template; so is none that varies or lies elsewhere."""
    said = lambda i: f"Story number {i} tells of a day unlike any other, with its own words {i * 7}."
    body = {i: f"<div class=post><p>Print this page</p><h2>Day {i}</h2><p>{said(i)}</p>{'<h3>Note</h3><p>Note ' + str(i) + '</p>' * (i % 2)}</div>" for i in range(6)}
    body[5] = body[5].replace("</div>", "<pre>Print this page</pre></div>")
    rows = [(i, f"http://h.example/{i}", f"<html><body>{b}</body></html>") for i, b in body.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wrappers = hw.infer_wrappers(pages).cache()
    got = {r.page_id: r.text for r in hw.extract_text(pages, wrappers).collect()}
    assert all(not t.startswith("Print this page") and said(i) in t and f"Day {i}" in t for i, t in got.items()), got
    assert got[5].endswith("\nPrint this page") and got[1].endswith("\nNote 1")
    # Laid on another expression the same pages give other rows.
    other = wrappers.withColumn("expression", F.lit("[]"))
    assert hw.extract_text(pages, other).where("text like 'Print%'").count() == 6


def test_places_of_streams():
    tokens = ["h", "p", "p", "x", "p", "f"]
    assert hw.within(tokens, hw.fold(tokens)) == [0, 1, 1, 2, 3, 4]
    tokens = ["h", "p", "h", "p", "q"]
    assert hw.within(tokens, hw.fold(tokens)) == [0, 1, 0, 1, 2]
    a, b = hw.fold(["h", "p", "f"]), hw.start(hw.fold(["h", "x", "p", "f"]))
    assert hw.laid(a, b) == [0, 2, 3] and hw.laid(hw.fold(["z", "f"]), b) == [None, 3]


# 10. Decontamination

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_banded_distance_equals_the_whole_table():
    draw = random.Random(2)
    for _ in range(300):
        a = np.array([draw.randrange(4) for _ in range(draw.randint(1, 12))], np.uint64)
        b = np.array([draw.randrange(4) for _ in range(draw.randint(0, 15))], np.uint64)
        want, most = min(distance(a.tolist(), b.tolist())), draw.randint(0, 5)
        assert dc.edit_distance(a, b, most)[0] == min(want, most + 1)


def test_decontamination_recall_and_precision(spark):
    draw = random.Random(7)
    vocabulary = ["v%d" % k for k in range(400)]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(12, 60)))) for k in range(40)]
    rows, planted = [], set()
    for d in range(600):
        text = [draw.choice(vocabulary) for _ in range(draw.randint(50, 200))]
        if d % 2:
            k, item = items[d % 40]
            w = item.split()
            for _ in range(draw.randint(0, int(0.15 * len(w)))):
                kind, at = draw.randrange(3), draw.randrange(len(w))
                w[at:at + (kind != 1)] = [] if kind == 2 else ["edit"]
            at = draw.randrange(len(text))
            text[at:at] = w
            planted.add((d, k))
        rows.append((d, " ".join(text), None))
    benchmark = spark.createDataFrame(items + [(98, None), (99, "too short")], "item_id long, text string")
    found = dc.find_items(docs_of(spark, rows), benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(got) == len(found) and len(got & planted) >= 0.97 * len(planted)
    texts, item = {i: t.split() for i, t, _ in rows}, {k: t.split() for k, t in items}
    for r in found:  # every reported window is a true match
        window = texts[r.doc_id][r.first_word:r.first_word + r.n_words]
        assert distance(item[r.item_id], window)[-1] == r.edits <= int(0.15 * len(item[r.item_id]))
    blocks = {(r.doc_id, r.item_id) for r in dc.find_items(docs_of(spark, rows), benchmark, block_words=400).collect()}
    assert len(blocks & planted) >= 0.97 * len(planted)


def test_decontamination_of_long_items_with_edits_anywhere(spark):
    """Edits up to the bound at the head, in the middle, at the tail or spread out: all found, whatever the item's length."""
    draw = random.Random(17)
    items, rows, planted = [], [], set()
    for k, size in enumerate([8, 14, 40, 60, 100, 120, 200, 300, 500]):
        item = ["i%dx%d" % (k, draw.randrange(10**6)) for _ in range(size)]
        items.append((k, " ".join(item)))
        n = int(0.15 * size)
        for where in (range(n), range(size // 2, size // 2 + n), range(size - n, size), draw.sample(range(size), n)):
            w = list(item)
            for at in sorted(where, reverse=True):
                kind = draw.randrange(3)
                w[at:at + (kind != 1)] = [] if kind == 2 else ["e%d" % draw.randrange(10**6)]
            rest = ["o%d" % draw.randrange(10**6) for _ in range(60)]
            planted.add((len(rows), k))
            rows.append((len(rows), " ".join(rest[:30] + w + rest[30:]), None))
    found = dc.find_items(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    for r in found:
        window = rows[r.doc_id][1].split()[r.first_word:r.first_word + r.n_words]
        assert distance(items[r.item_id][1].split(), window)[-1] == r.edits


def test_decontamination_cases(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa."
    rows = [(1, "x " + item.upper() + " y", None), (1, "x " + item.upper() + " y", None), (2, None, None), (3, "", None), (4, item[:30], None),
            (5, item, None), (6, "pre " * 3000 + item, None)]
    benchmark = spark.createDataFrame([(7, item), (6, item + " "), (8, None), (None, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in dc.find_items(docs_of(spark, rows), benchmark).collect())
    assert got == [(1, 6, 0), (1, 6, 0), (5, 6, 0), (6, 6, 0)]
    small = sorted((r.doc_id, r.item_id, r.edits) for r in dc.find_items(docs_of(spark, rows), benchmark, block_words=4).collect())
    assert small == got  # the least id also where equal items fall in different blocks
    assert sorted(map(tuple, dc.equal_items(benchmark).collect())) == [(6, 6), (7, 6)]
    assert dc.find_items(docs_of(spark, rows).limit(0), benchmark).count() == 0
    assert dc.find_items(docs_of(spark, rows), benchmark.limit(0)).count() == 0


def test_decontamination_of_short_items(spark):
    """Items of one word and more match exactly, in one place or many, across no border of documents."""
    rows = [(1, "so the Answer is 42, they say", None), (2, "the answer is", None), (3, "42 is the answer", None), (4, "yes", None), (5, "", None), (6, "the answer is 42 " * 400, None)]
    items = [(1, "the answer is 42"), (2, "yes"), (3, "?!"), (4, "answer is"), (5, ""), (6, "one two three four five six seven")]
    benchmark, docs = spark.createDataFrame(items, "item_id long, text string"), docs_of(spark, [*rows, (7, "one two THREE five six seven", None)])
    got = sorted((r.doc_id, r.item_id, r.n_words, r.edits) for r in dc.find_items(docs, benchmark).collect())
    assert got == [(1, 1, 4, 0), (1, 4, 2, 0), (2, 4, 2, 0), (4, 2, 1, 0), (6, 1, 4, 0), (6, 4, 2, 0), (7, 6, 6, 1)]
    assert dc.find_items(docs, benchmark, min_words=8).count() == 0
