"""The pipeline against a brute-force version of its stages, and on odd rows."""

import re

import pyarrow as pa

import corpus_pipeline as cp
from firmament.llm import sentencepiece as sp
from tests.llm.test_llm_operators import GAPS, distance, groups_by_hand


def words_of(text):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]


def holds(text, items, max_edit=0.15):
    """Whether a text has a window within the allowed edits of an item: the whole table of every pair that shares enough words."""
    w = words_of(text)
    for item in items:
        d = int(max_edit * len(item))
        if len(item) >= 8 and len(set(item) & set(w)) >= len(set(item)) - d:
            row = [0] * (len(w) + 1)
            for i, x in enumerate(item, 1):
                new = [i]
                for j, y in enumerate(w, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            if min(row) <= d:
                return True
    return False


def by_hand(rows, items):
    """Ids that stay: rows (id, text)."""
    kept = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    first = {}
    for i, t in sorted(kept):
        first.setdefault(re.sub(GAPS, " ", t), i)
    kept = [(i, t) for i, t in kept if first[re.sub(GAPS, " ", t)] == i]
    group, _ = groups_by_hand([(i, t, None) for i, t in kept])
    kept = [(i, t) for i, t in kept if group[i] == i]
    return {i: t for i, t in kept if not holds(t, items)}


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = [words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    want = by_hand([(r.doc_id, r.text) for r in docs], items)
    out = cp.run(spark, sf)
    got = {r.doc_id: r.text for r in sp.decode(out).select("doc_id", "text").collect()}
    assert got == want and 0 < len(want) < len(docs)
    assert all(r.n_tokens == len(r.ids) for r in out.select("n_tokens", "ids").collect())


def test_stages_on_odd_rows(spark, sf):
    """Nulls in any column, repeated rows and ids, a long text, clashing columns, an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, _id string, ids string"
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(1, base, "en"), (1, base, "en"), (2, base + " more", None), (3, None, "en"), (4, "", "en"), (5, "12 34", "en"), (6, base.replace(" ", "  "), "en"),
            (None, "some other text here without an id", None), (7, "giant " * 9000, "de"), (8, "short", None), (8, "same id other text", "fr")]
    docs = spark.createDataFrame([(*r, None, None, True, 0.5, "x", "y") for r in rows], schema)
    kept, columns = docs, docs.columns
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns, name
        kept = spark.createDataFrame(kept.collect(), schema)
    left = sorted((str(r.doc_id), (r.text or "")[:12]) for r in kept.collect())
    assert left == [("1", base[:12]), ("7", "giant giant "), ("8", "same id othe"), ("8", "short"), ("None", "some other t")]
    tokens = cp.STAGES[-1][1](spark, kept, sf)
    assert sorted(str(r.doc_id) for r in tokens.collect()) == sorted(i for i, _ in left) and tokens.columns.count("ids") == 1
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_stage_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "decontaminate", "sentencepiece"]
    assert distance("abc", "abd")[-1] == 1


def test_stages_bound_their_batches_by_bytes(spark):
    """Large rows come to Python in small batches, and all of them come."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    spark.conf.unset(limit)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 500) as text", "'en' as lang")
    try:
        kept = cp.language_id(spark, docs, "")
        sizes = kept.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
        assert sum(r.n for r in sizes) == 4000 and max(r.size for r in sizes) < 5 << 20
        spark.conf.set(limit, "1000000")  # a session's own limit stays
        cp.token_ids(spark, docs, "")
        assert spark.conf.get(limit) == "1000000"
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
