"""Frame tables: solver calibrations to WCS, solve planning and the sky grid of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.functions import coords, geo
from firmament.session import spread


def calibration_to_wcs(cal: DataFrame) -> DataFrame:
    """Two solver conventions -> one WCS: parity flips for both, orientation for the local one."""
    return cal.select(
        *[c for c in cal.columns if c not in ("ra", "dec", "pixscale", "orientation", "parity")],
        F.col("ra").alias("ra0"), F.col("dec").alias("dec0"),
        (F.col("width") / 2.0).alias("crpix_x"), (F.col("height") / 2.0).alias("crpix_y"),
        (F.col("pixscale") / 3600.0).alias("scale_deg"),
        F.when(F.col("solver") == "local", 180.0 - F.col("orientation")).otherwise(F.col("orientation")).alias("orientation_deg"),
        F.when(F.col("parity") < 0, 1).otherwise(-1).alias("parity"),
    )


def _segments() -> Column:
    return F.sequence(F.lit(0), F.lit(48))


def graticule(frames: DataFrame) -> DataFrame:
    """RA/Dec grid lines with their projected points and label, one row per line.

    All lines of a frame are built inside its own row; frames are spread first, as a row grows to thousands of points.
    """
    wcs = {**geo.wcs_of(), **{c: F.col(c) for c in geo.TRIG_FIELDS}}
    radius = geo.field_radius_deg(wcs)
    f = geo.frame_trig(spread(frames, "fid")).withColumn("_r", radius).withColumn("_step", geo.nice_step(radius))
    f = f.withColumn("_dr", F.col("_r") / F.greatest(F.lit(0.05), F.cos(F.radians("dec0"))))

    def lines(lo: Column, hi: Column, point) -> Column:
        ks = F.sequence(F.ceil(lo / F.col("_step")), F.floor((hi + 1e-9) / F.col("_step")))
        made = F.transform(ks, lambda k: F.struct(
            (k * F.col("_step")).alias("value"),
            F.filter(F.transform(_segments(), lambda i: point(k * F.col("_step"), i)), lambda p: p.isNotNull()).alias("points"),
        ))
        return F.filter(made, lambda ln: F.size(ln["points"]) >= 2)

    def dec_point(value: Column, i: Column) -> Column:
        return geo.world_to_pixel(wcs, F.col("ra0") - F.col("_dr") + 2.0 * F.col("_dr") * i / 48.0, value)

    def ra_point(value: Column, i: Column) -> Column:
        return geo.world_to_pixel(wcs, value, F.col("dec0") - F.col("_r") + 2.0 * F.col("_r") * i / 48.0)

    def inside(points: Column) -> Column:
        return F.filter(points, lambda p: geo.in_image(wcs, p["px"], p["py"]))

    keep = [c for c in frames.columns]
    dec = f.select(*keep, F.posexplode(lines(F.col("dec0") - F.col("_r"), F.col("dec0") + F.col("_r"), dec_point)).alias("line_no", "ln"))
    dec = dec.withColumn("kind", F.lit("dec")).withColumn("top", F.lit(True)).withColumn(
        "_at", F.array_min(F.transform(inside(F.col("ln.points")), lambda p, i: F.struct(
            p["px"].alias("a"), i.alias("i"), p["px"].alias("x"), p["py"].alias("y"))))
    ).withColumn("label", F.concat(F.lit("Dec "), coords.format_dec_dm(F.col("ln.value"))))
    ra = f.select(*keep, F.posexplode(lines(F.col("ra0") - F.col("_dr"), F.col("ra0") + F.col("_dr"), ra_point)).alias("line_no", "ln"))
    ra = ra.withColumn("kind", F.lit("ra")).withColumn("top", F.col("line_no") % 2 == 0).withColumn(
        "_at", F.array_min(F.transform(inside(F.col("ln.points")), lambda p, i: F.struct(
            F.when(F.col("top"), p["py"]).otherwise(-p["py"]).alias("a"), i.alias("i"), p["px"].alias("x"), p["py"].alias("y"))))
    ).withColumn("label", F.concat(F.lit("RA "), coords.format_ra_hm(F.col("ln.value"))))
    both = dec.unionByName(ra)
    return both.select(
        "fid", "kind", "line_no", F.col("ln.value").alias("value"), F.col("ln.points").alias("points"),
        F.when(F.col("_at").isNotNull(), F.col("label")).alias("label"), "top",
        F.col("_at.x").alias("label_x"), F.col("_at.y").alias("label_y"),
    )


def solve_plan(images: DataFrame, solves: DataFrame, version: int = 2) -> tuple[DataFrame, DataFrame]:
    """(to_solve, reused): images without, and with, a current successful solve of their hash."""
    current = solves.where((F.col("status") == "solved") & (F.col("version") == version))
    to_solve = images.join(current, "hash", "left_anti")
    reused = images.join(current.drop("status", "version"), "hash").withColumn("cached", F.lit(True))
    return to_solve, reused


def solver_timing(solves: DataFrame) -> DataFrame:
    """Per solver: runs, mean and median time (a value that occurs; rank error at most n / 10000), share answered from the cache."""
    return solves.groupBy("solver").agg(
        F.count("*").alias("n"), F.avg("solve_ms").alias("avg_ms"),
        F.percentile_approx("solve_ms", 0.5, 10000).alias("median_ms"),
        F.count_if(F.coalesce("cached", F.lit(False))).alias("n_cached"),
        F.count_if(F.col("status") == "solved").alias("n_solved"),
    )
