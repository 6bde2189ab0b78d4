"""Hard negatives, the filter audit and repeated passages against brute force on small, awkward tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmament.llm import filter_audit as fa
from firmament.llm import hard_negatives as hn
from firmament.llm import substring_dedup as sd

WORDS = "[^\x20\x09-\x0d]+"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# 11. Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, id string, vec int, slot int, score double, rank int, _anchor int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", 1, 2, 3.0, 4, 5) for i, v, g in rows], VECTORS)


def negatives_by_hand(rows, anchors, k=5, lower=80, upper=100):
    rows = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], g) for i, v, g in rows
            if i is not None and v is not None and g is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows = list({(i, tuple(v), g): (i, v, g) for i, v, g in rows}.values())
    dot = lambda v, w: sum(x * y for x, y in zip(v, w))
    out = []
    for a, v, g in rows:
        if a not in anchors:
            continue
        met = sorted((-dot(v, w), i, h) for i, w, h in rows if i != a)
        for s, p, _ in [m for m in met if m[2] == g][:k]:
            fits = [(n, t) for t, n, h in met if h != g and lower * -s <= 100 * -t <= upper * -s][:k]
            out += [(a, p, r, n, -s, -t) for r, (n, t) in enumerate(fits, 1)]
    return sorted(out)


def test_residue_scores_are_exact():
    rng = np.random.default_rng(5)
    for dims, most in ((1, 3), (64, 300), (7, 1 << 20), (5000, 1 << 9), (3, 1 << 30), (40, 1 << 52)):
        a, b = (rng.integers(-most, most + 1, (n, dims)) for n in (4, 6))
        r = hn.Residues(dims, dims * most * most)
        got = r.scores(r.split(a.astype(float)), r.split(b.astype(float)))
        want = [[max(-hn.LONG - 1, min(hn.LONG, sum(int(x) * int(y) for x, y in zip(v, w)))) for w in b] for v in a]
        assert got.tolist() == want, (dims, most)
        assert all(r.chunk * ((p - 1) // 2) ** 2 <= hn.EXACT for p in r.primes)


@pytest.mark.parametrize("block", [4096, 3])
def test_hard_negatives(spark, block):
    rng = random.Random(3)
    base = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.uniform(-0.2, 0.2) for x in base[i % 5]], rng.randrange(3)) for i in range(200)]
    rows += [(300 + i, base[0], i % 2) for i in range(12)]                       # ties
    rows += [rows[0], rows[10], rows[10], (10, rows[10][1], 2)]                  # repeats, and one id with two labels
    rows += [(None, base[0], 1), (400, None, 1), (410, base[1], None), (420, [0.5, None, 0.1], 1), (430, [float("nan")] * 6, 1),
             (440, [float("inf")] * 6, 0), (450, [], 1), (460, base[2][:3], 2), (470, base[2] + [0.5], 2)]
    found = hn.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, block=block)
    anchors = {i for i, _, _ in rows if i is not None and i % 10 == 0}
    assert rows_of(found) == [r for r, _ in itertools.groupby(negatives_by_hand(rows, anchors))]


def test_hard_negatives_of_huge_components_and_none(spark):
    rows = [(0, [3e38, 1e30], 1), (1, [3e38, -1e30], 1), (2, [2.7e38, 4.0], 0), (3, [-3e38, 0.0], 0)]
    got = rows_of(hn.hard_negatives(vectors_of(spark, rows), F.col("vec_id") == 0))
    assert got == [(0, 1, 1, 2, hn.LONG, hn.LONG)]
    none = hn.hard_negatives(vectors_of(spark, []), F.col("vec_id") == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hn.hard_negatives(vectors_of(spark, rows), F.lit(None).cast("boolean")).count() == 0


# 12. Filter audit

DOCS = "doc_id long, text string, source string, id string, part string, mask int, n long, digest string, quality int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 1, 2, "z", 3) for i, t, s in rows], DOCS)


def audit_by_hand(docs, labels):
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(WORDS, t)
        fails.append((s or "", {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)},
            i is not None and any(j == i and q == 1 for j, q, _ in labels), i is not None and any(j == i and x == 1 for j, _, x in labels)))
    out, share = {}, Counter()
    for part in {p for p, *_ in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                share[part, x] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(d[0][x] for d in mine) - len(gone), sum(d[0][x] and sum(d[0].values()) == 1 for d in mine),
                    sum(d[1] for d in gone), sum(d[2] for d in gone))
    return sorted((*k, *v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_filter_audit(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(400)] + ["Éa", "ß", "ABC", "#tag"]
    texts = [" ".join(rng.choice(vocabulary[:n]) for _ in range(m)) for n, m in ((404, 250), (30, 250), (400, 199), (400, 200), (5, 3), (400, 6000))]
    texts += [None, "", " \n\t", "AAAA", "Aa aa $", "word1\x0bword2\x1cword3", "trailing ", " leading"]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(60)]
    docs += [docs[3], docs[3], (docs[3][0], docs[3][1], "u"), (None, texts[0], "s"), (None, texts[0], "s"), (None, None, None), (-5, texts[1], "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 50)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (900, 1, 1)]
    found = fa.audit(fa.cells(fa.masks(docs_of(spark, docs)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert rows_of(found) == audit_by_hand(docs, labels)


def test_filter_audit_of_no_documents_and_of_other_letters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.cells(fa.masks(docs_of(spark, [])), labels)).count() == 0
    steps = fa.prefixes(spark, "XYZ")
    assert steps.select("prefix").distinct().count() == 3 + 6 + 6 and steps.count() == 15 * 8
    masked = spark.createDataFrame([("p", 0b011, 5, 1, 0), ("p", 0b100, 2, 0, 2)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): r for r in fa.audit(masked, "XYZ").collect()}
    assert len(got) == 18
    assert (got["XYZ", 1].removed, got["XYZ", 2].removed, got["XYZ", 2].redundant, got["XYZ", 3].kept, got["XYZ", 3].toxic_lost) == (5, 0, 5, 0, 2)
    assert got["YXZ", 1].shapley == 5 * 3 and got["ZXY", 1].shapley == 2 * 6


# 13. Repeated passages

TEXTS = "doc_id long, text string, id long, key string, words string, first int, odd int, n_words int"


def texts_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "w", 2, 3, 4) for i, t in rows], TEXTS)


def repeats_by_hand(docs, width):
    cut = [re.findall(WORDS, t or "") for _, t in docs]
    seen = Counter(tuple(w[p:p + width]) for w in cut for p in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(docs, cut):
        gone = {p + k for p in range(len(w) - width + 1) if seen[tuple(w[p:p + width])] > 1 for k in range(width)}
        spans = []
        for g in sorted(gone):
            if spans and spans[-1][1] == g:
                spans[-1][1] += 1
            else:
                spans.append([g, g + 1])
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone), tuple(map(tuple, spans))))
    return Counter(out)


def passages(rng, width):
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "Ü", "x", "Xx"])
    prose = lambda n: [word() for _ in range(n)]
    shared = [prose(n) for n in (width - 1, width, width + 1, 3 * width)]
    docs = []
    for i in range(60):
        text = prose(rng.randrange(0, 3 * width))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            a, b = rng.choice([(0, len(s)), (rng.randrange(0, 4), len(s)), (0, len(s) - rng.randrange(0, 4))])
            text += s[a:b] + prose(rng.randrange(0, 5))
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    near = shared[3] + prose(2 * width)
    docs += [(100 + i, " ".join(near[:i] + ["edit"] + near[i + 1:])) for i in range(0, len(near), 3)]      # near copies
    docs += [(200, "a " * (2 * width)), (201, "b c " * width), (202, None), (203, ""), (204, " \n "), (205, " ".join(prose(9)))]
    docs += [docs[0], docs[0], (0, docs[1][1]), (None, docs[2][1]), (None, " ".join(prose(width)))]
    return docs + [(300, " ".join(prose(20000)))]


@pytest.mark.parametrize("width, anchor, crowd", [(35, 12, 1024), (35, 12, 3), (9, 4, 1024), (9, 4, 2), (5, 5, 8), (8, 1, 4)])
def test_repeated_passages(spark, width, anchor, crowd):
    docs = passages(random.Random(width * 31 + crowd), width)
    found = sd.remove_repeats(texts_of(spark, docs), shape=sd.Shape(width, anchor), crowd=crowd)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text, tuple((s.start, s.end) for s in r.spans)) for r in found.collect())
    assert got == repeats_by_hand(docs, width)


def test_parsing_finds_windows_across_factor_boundaries():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(1, 1 << 60, 12, dtype=np.uint64) for _ in range(2))
    pieces = [np.concatenate((a[:7], b[:5])), np.concatenate((a[2:7], b[:5])), np.concatenate((a[:7], b[7:]))]
    found = sd.parse(np.concatenate(pieces), np.array([len(p) for p in pieces]), 5)
    want = []
    for i, p in enumerate(pieces):
        others = {q[k:k + 5].tobytes() for j, q in enumerate(pieces) if j != i for k in range(len(q) - 4)}
        want += [p[k:k + 5].tobytes() in others for k in range(len(p) - 4)]
    assert found.tolist() == want


def test_no_repeats_in_an_empty_table(spark):
    assert sd.remove_repeats(texts_of(spark, [])).count() == 0
    alone = sd.remove_repeats(texts_of(spark, [(1, "x " * 34), (2, "x " * 34)])).collect()
    assert [(r.n_removed, r.spans) for r in alone] == [(0, []), (0, [])]
    assert hashlib.sha256(alone[0].kept_text.encode()).hexdigest() == hashlib.sha256(" ".join(["x"] * 34).encode()).hexdigest()
