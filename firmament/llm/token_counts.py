"""Token counts of a corpus from an exact histogram of encoded lengths.

Every whole text is encoded once and only its length is kept. Lengths are counted by a keyed aggregate with map-side combining, so
what is shuffled grows with the number of distinct lengths, not with documents. Suffix sums over the histogram then answer, for any
context limit L: documents longer than L, tokens in all, tokens kept when texts are cut at L (sum of min(length, L)), and the
quantile of L. Suffix sums run in blocks of `block` lengths: a window within each block and one over block totals, so no task
holds the whole histogram.

Null and empty texts have length 0 and count as documents. Repeated rows count each time. An empty table gives an empty histogram.
Only the text column is read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmament.llm.common import slices, table
from firmament.llm.registry import query
from firmament.session import cut_lineage

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


@cache
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: the published split pattern of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: n_tokens of its whole text."""
    path = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, SPLIT).encode_ordinary
        for part in slices(batches, text=0, max_bytes=1 << 22):
            n = np.fromiter((len(encode(t)) if t else 0 for t in part.column(0).to_pylist()), np.int64, part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(n)], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    return lengths.groupBy(F.col(length_col).alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """Histogram rows with, for the limit L = length: docs_over, tokens_over (documents longer than L), docs_in_all,
    tokens_in_all, tokens_kept (texts cut at L), quantile (share of documents of at most L)."""
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens")).withColumn(
        "_block", F.floor(F.col("length") / block))
    # One row per `block` lengths; the longest text bounds their number.
    totals = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_block", F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_d"), F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_t"),
        F.sum("_d").over(whole).alias("docs_in_all"), F.sum("_t").over(whole).alias("tokens_in_all"))
    inside = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over_d = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("_d")
    over_t = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("_t")
    s = h.join(totals, "_block").withColumns({"docs_over": over_d, "tokens_over": over_t})
    kept = F.col("tokens_in_all") - F.col("tokens_over") + F.col("length") * F.col("docs_over")
    return s.select("length", "n_docs", "n_tokens", "docs_over", "tokens_over", "docs_in_all", "tokens_in_all",
                    kept.alias("tokens_kept"), (1 - F.col("docs_over") / F.col("docs_in_all")).alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """The answers at a given list of context limits, also between lengths that occur."""
    if not limits:
        return sums.sparkSession.createDataFrame([], "context_limit long, docs_over long, tokens_kept long")
    asked = sums.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))])))
    below = F.when(F.col("length") <= F.col("context_limit"), F.col("length"))
    last = asked.groupBy("context_limit").agg(
        F.max_by(F.struct("length", "docs_over", "tokens_kept"), below).alias("r"), F.max("docs_in_all").alias("docs_in_all"))
    over = F.coalesce("r.docs_over", "docs_in_all")
    grown = F.coalesce("r.tokens_kept", F.lit(0)) + over * (F.col("context_limit") - F.coalesce("r.length", F.lit(0)))
    return last.select("context_limit", over.alias("docs_over"), grown.alias("tokens_kept"))


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    # Read by the block totals and again by the rows: texts are encoded once.
    return suffix_sums(cut_lineage(length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))))
