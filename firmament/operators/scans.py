"""Running aggregates over groups that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmament.session import cut_lineage

_HOW = {"max": F.max, "min": F.min, "sum": F.sum}


def running(rows: DataFrame, part: list[str], order: str, value: Column, how: str = "max", out: str = "running", backward: bool = False) -> DataFrame:
    """Adds `out`: max, min or sum of the non-null `value` of the group's rows up to this one in `order` (from this one on, if `backward`).

    A window alone would sort a whole group in one task. Here rows are dealt by ranges of (part, order), so a large group spans several
    ranges; each range is scanned by itself and takes over what the group's ranges before it amount to. Rows of equal place
    share a range; among them the running value counts all.
    """
    agg = _HOW[how]
    dealt = rows.withColumn("_v", value).repartitionByRange(*part, order).withColumn("_range", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    place = F.desc(order) if backward else F.asc(order)
    local = Window.partitionBy("_range", *part).orderBy(place).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*part).orderBy(F.desc("_range") if backward else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range that a group spans.
    totals = dealt.groupBy("_range", *part).agg(agg("_v").alias("_t"), F.count("*").alias("_n"))
    carry = totals.withColumn("_c", agg("_t").over(before)).where("_c IS NOT NULL").select("_range", *part, "_c")
    scanned = dealt.withColumn(out, agg("_v").over(local)).join(carry, ["_range", *part], "left")
    if how == "sum":
        joined = F.when(F.col(out).isNull() & F.col("_c").isNull(), None).otherwise(F.coalesce(out, F.lit(0)) + F.coalesce("_c", F.lit(0)))
    else:
        joined = F.greatest(out, "_c") if how == "max" else F.least(out, "_c")
    return scanned.withColumn(out, joined).drop("_v", "_c", "_range")
