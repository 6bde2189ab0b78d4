"""Pairs of a cone search are dealt over tasks by cell, whatever the size of the input; rounding keeps its results."""

from pyspark.sql import functions as F

from firmament.operators import atlas, frames as FR
from firmament.operators import spatial
from firmament.queries.kit import r6


def _frames(spark, n, ra=10.0, dec=5.0):
    return spark.range(n).select(
        F.col("id").alias("fid"), F.lit(ra).alias("ra0"), F.lit(dec).alias("dec0"), F.lit(2000.0).alias("crpix_x"), F.lit(1500.0).alias("crpix_y"),
        F.lit(2.33 / 3600).alias("scale_deg"), F.lit(30.0).alias("orientation_deg"), F.lit(1).alias("parity"), F.lit(4000).alias("width"),
        F.lit(3000).alias("height"))


def _sky(spark, n):
    return spark.range(n).select(F.col("id").alias("obj_id"), (F.col("id") * 0.1).alias("ra_deg"), F.lit(5.0).alias("dec_deg"))


def test_cones_are_not_broadcast(spark):
    plan = spatial.cone_search_join(_frames(spark, 5), _sky(spark, 200))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_places_and_keys_of_frames_are_not_broadcast(spark, monkeypatch):
    """What a nearest search knows of each frame meets the frames in merge joins, however small its bytes are."""
    plans, cut = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    found = spatial.cone_search_join(_frames(spark, 5), _sky(spark, 200), nearest=2)
    assert found.count() == 15  # of each frame the object in its middle and two as far to either side
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert plans and all("BroadcastHashJoin [_cell#" in line for line in joins)  # hot cells are few


def test_a_hot_cell_is_split_and_whole(spark):
    cones = spark.range(20).select(F.lit(2).alias("_depth"), F.lit(3).alias("_row"), F.lit(4).alias("_col"), F.col("id").alias("fid"))
    sky = spark.range(3).select(F.lit(2).alias("_depth"), F.lit(3).alias("_row"), F.lit(4).alias("_col"), F.col("id").alias("obj_id"))
    left, right = spatial._dealt(cones, sky, full=4)
    assert left.select("_group").distinct().count() > 1 and right.count() == 3 * 5
    assert left.join(right, ["_cell", "_group"]).select("fid", "obj_id").distinct().count() == 60


def test_small_tables_fill_all_partitions(spark):
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = FR.graticule(_frames(spark, 200).coalesce(1))
    assert lines.select(F.spark_partition_id()).distinct().count() >= wide
    registry = spark.range(4).select(F.lit(1).alias("entry_ord"), F.col("id").alias("anno_ord"), F.lit("jet").alias("feature_type"), F.lit("point").alias("geom_type"),
                                     F.array(F.struct(F.lit(10.0).alias("ra"), F.lit(5.0).alias("dec"))).alias("vertices"))
    drawn = atlas.reproject_check(registry, _frames(spark, 200).coalesce(1).withColumn("entry_ord", F.lit(1)))
    assert drawn.count() == 800 and drawn.select(F.spark_partition_id()).distinct().count() == wide


def test_rounding_is_that_of_round(spark):
    x = [0.0, -0.0, 0.0000005, 0.0000015, -0.0000005, 1.0000005, 2.5, -2.4999995, 0.1234565, 12345.6789015, 99999.9999995, 1e5, 1e9 / 7, -1e15 / 3, 1e300, None,
         float("nan"), float("inf"), float("-inf"), 1e-12, -1e-12, 359.9999999, 1234.5678905]
    x += [i / 7.0 - 5000.0 for i in range(70000)] + [i * 5e-7 for i in range(-5000, 5000)]
    d = spark.createDataFrame([(v,) for v in x], "x double")
    got, want = r6("x"), F.round("x", 6) + F.lit(0.0)
    assert d.where(~F.hex(got.cast("string").cast("binary")).eqNullSafe(F.hex(want.cast("string").cast("binary")))).count() == 0
