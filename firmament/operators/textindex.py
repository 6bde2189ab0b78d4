"""Substring search over a stored table by an index of trigrams.

`write_substring_index` stores three tables: the rows with their text, partitioned by the text's hash; postings (gram, text hash), one for every
distinct run of three characters of every distinct text, partitioned by gram bucket and sorted by gram; and the number of postings of every gram.
A search reads the postings of the needle's rarest grams, keeps the texts that have all of them, reads the rows of these and compares
the whole text, so its result is that of a scan. Needles of one or two characters have no gram and are scanned for.

Equal texts share their postings, and a frequent gram is split over files by the range of its hashes. Null texts count as empty; an empty
needle finds every row; repeated rows are found each; an empty table is an empty index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BUCKETS = 3, 64
OWN = ("_ix_text", "_ix_hash", "_ix_bucket")
POSTINGS, COUNTS = "gram string, _ix_hash long, bucket int", "gram string, n long, bucket int"


def _bucket(key: Column) -> Column:
    return F.pmod(key, F.lit(BUCKETS)).cast("int")


def _gram_bucket(gram: Column) -> Column:
    return _bucket(F.xxhash64(gram))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def write_substring_index(rows: DataFrame, text: Column, path: str) -> None:
    """Store `rows` under `path` with an index over the lower-cased `text`."""
    named = rows.withColumn("_ix_text", F.lower(F.coalesce(text, F.lit("")))).withColumn("_ix_hash", F.xxhash64("_ix_text"))
    named = named.withColumn("_ix_bucket", _bucket(F.col("_ix_hash")))
    named.limit(0).write.parquet(f"{path}/schema")  # an empty table has no partition to tell it
    named.repartition("_ix_bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.partitionBy(
        "_ix_bucket").parquet(f"{path}/rows")
    spark = rows.sparkSession
    texts = _rows(spark, path).select("_ix_hash", "_ix_text").distinct()
    # Every place of the text, by characters; one posting for a gram that repeats.
    grams = F.array_distinct(F.regexp_extract_all("_ix_text", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))
    postings = texts.select(F.explode(grams).alias("gram"), "_ix_hash").withColumn("bucket", _gram_bucket(F.col("gram")))
    postings.repartitionByRange("bucket", "gram", "_ix_hash").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(f"{path}/counts")


def _of_grams(stored: DataFrame, grams: list[str]) -> DataFrame:
    return stored.where(F.col("bucket").isin(*[_gram_bucket(F.lit(g)) for g in grams]) & F.col("gram").isin(*grams))


def candidate_texts(spark: SparkSession, path: str, needle: str, rarest: int = 4) -> DataFrame:
    """(_ix_bucket, _ix_hash) of the texts that hold the needle's `rarest` grams, among them all that hold the needle of three characters or more."""
    grams = sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})
    # One row for each of the needle's own grams.
    counts = {r.gram: r.n for r in _of_grams(spark.read.schema(COUNTS).parquet(f"{path}/counts"), grams).select("gram", "n").collect()}
    chosen = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:rarest]
    found = _of_grams(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), chosen).groupBy("_ix_hash").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(chosen)).select(_bucket(F.col("_ix_hash")).alias("_ix_bucket"), "_ix_hash")


def search_substring(spark: SparkSession, path: str, needle: str, rarest: int = 4) -> DataFrame:
    """The stored rows whose text holds `needle`, whatever its case."""
    needle, rows = needle.lower(), _rows(spark, path)
    if len(needle) >= GRAM:
        rows = rows.join(candidate_texts(spark, path, needle, rarest), ["_ix_bucket", "_ix_hash"], "left_semi")
    return rows.where(F.contains("_ix_text", F.lit(needle))).drop(*OWN)
