"""A corpus from raw documents to token ids, in five stages of Spark jobs.

Every stage takes the rows its predecessor kept and judges them anew; `run` writes each stage's rows to the shared folder before the next reads
them, so a lost executor costs a task and not the chain. Stages up to the last return the columns of their input. Rows that repeat a document id
are one document; rows without id are never taken for copies. An empty table passes through as an empty one. Stages that work in Python bound the
session's Arrow batches by bytes (`small_batches`), so that a task holds a few megabytes of text on each side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.llm.common import small_batches, table, without, write_table
from firmament.llm.decontaminate import find_items
from firmament.llm.exact_dedup import exact_dedup, one_space
from firmament.llm.language_id import UNKNOWN, fit, held_out, identify_languages
from firmament.llm.ngram_join import similar_groups
from firmament.llm.sentencepiece import encode
from firmament.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; null and letterless texts go. Ambiguous ones stay."""
    small_batches(spark)
    model = fit(docs.where(~held_out()))
    rest = [c for c in docs.columns if c != "text"]
    named = identify_languages(docs.select(F.struct(*rest).alias("_doc"), F.col("text").alias("_text")), model, text_col="_text")
    return named.where(F.col("lang_pred") != UNKNOWN).select("_doc.*", F.col("_text").alias("text")).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the least doc_id."""
    rows = cut_lineage(exact_dedup(docs))
    ids = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    left = without(docs, ids.where("not kept"))
    twice = cut_lineage(ids.where("kept and n > 1").select("doc_id"))
    if twice.isEmpty():
        return left
    again = left.join(twice, "doc_id", "left_semi").withColumn("_sha", F.sha2(one_space(F.col("text")), 256)).dropDuplicates(["doc_id", "_sha"])
    return without(left, twice).unionByName(again.select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of every group tied by 5-word shingle similarity of 3/4 or more."""
    small_batches(spark)
    groups = similar_groups(docs)
    return without(docs, groups.where("component_id <> doc_id").select("doc_id"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of 8 words or more; shorter ones, as "the answer is 42", are no evidence that a document leaks."""
    small_batches(spark)
    return without(docs, find_items(docs, table(spark, sf_dir, "benchmark"), min_words=8).select("doc_id"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' other columns with ids and n_tokens of the whole text."""
    small_batches(spark)
    keep = tuple(c for c in docs.columns if c not in ("text", "ids", "n_tokens"))
    return encode(docs, keep=keep).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies),
          ("decontaminate", benchmark_leaks), ("sentencepiece", token_ids)]

#: Language decisions and encoding are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(lambda docs, stage: write_table(stage[1](spark, docs, sf_dir)), STAGES, table(spark, sf_dir, "documents"))
