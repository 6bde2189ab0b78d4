"""Exact duplicates by progressive refinement: length, then a hash of the head, then a hash of the whole text.

DataFrame functions only. The first scan yields a length and a head hash per row. Rows are grouped by length, those of shared
lengths by (length, head hash). The surviving groups are marked in a bitmap of fixed size (2**filter_bits bits, 1 MB as set),
which the second scan reads to hash the whole text of surviving rows only: no text is ever shuffled. A bit shared by chance costs
a needless hash and never a wrong result. Groups are counted by keyed aggregates with map-side combining, and rows meet their
group in an equi-join that adaptive execution can split, so a group holding a third of all rows is no hot task.

Null text counts as empty; empty texts equal each other. Ids that repeat with one text count as copies and share their flag; an
empty table gives an empty result. Columns other than id and text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import marked, marks, table
from firmament.llm.registry import query
from firmament.session import cut_lineage

def one_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = 64,
                filter_bits: int = 23, digest: bool = False) -> DataFrame:
    """One row per input row: id, keep_id (least id of the group), group_size, kept; with `digest` also every row's text_sha256."""
    base = docs.select(F.col(id_col).alias("_id"), one_space(F.col(text_col)).alias("_text"))
    seen = base.select("_id", "_text", F.length("_text").alias("_len"), F.xxhash64(F.substring("_text", 1, head_chars)).alias("_head"))

    keys = cut_lineage(seen.select("_len", "_head"))
    lengths = keys.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len")
    heads = keys.join(lengths, "_len").groupBy("_len", "_head").agg(F.count("*").alias("_n")).where("_n > 1")
    group = F.struct("_len", "_head")
    rows = marked(seen, group, marks(heads, group, filter_bits), filter_bits).withColumnRenamed("_maybe", "_alive")
    hashed = F.sha2(F.col("_text"), 256)
    rows = cut_lineage(rows.select("_id", "_alive", (hashed if digest else F.when(F.col("_alive"), hashed)).alias("_sha")))

    alive = rows.where("_alive")
    groups = alive.groupBy("_sha").agg(F.min("_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    found = alive.join(groups, "_sha", "left").select(
        "_id", F.coalesce("_keep", "_id").alias("_keep"), F.coalesce("_n", F.lit(1)).alias("_n"), "_sha")
    alone = rows.where("not _alive").select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), "_sha")
    out = found.unionByName(alone).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))
    return out if digest else out.drop("text_sha256")


@query("op2_exact_dedup", sql=r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)""")
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), digest=True)
