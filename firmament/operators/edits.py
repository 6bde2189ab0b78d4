"""Applying an edit log to reading features in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["report", "feature_id"]


def _last(action: str, value: Column, extra: Column | None = None) -> Column:
    hit = F.col("action") == action
    if extra is not None:
        hit = hit & extra
    return F.max_by(value, F.when(hit, F.col("seq")))


def apply_edits(features: DataFrame, log: DataFrame) -> DataFrame:
    """Last write per (report, feature, field) in one partial aggregate, then a keyed join.

    log(report, seq, action, feature_id, cx, cy, r, offset_x, offset_y, lang, text). A body edit
    also clears physics and interesting.
    """
    zh, en = F.col("lang") == "zh", F.col("lang") == "en"
    text = F.col("text")
    last = log.groupBy(*KEY).agg(
        _last("setCircle", F.struct("cx", "cy", "r")).alias("_circle"), _last("setBadgeOffset", F.struct("offset_x", "offset_y")).alias("_offset"),
        _last("setLabel", text, zh).alias("_label_zh"), _last("setLabel", text, en).alias("_label_en"),
        _last("setFeatureBody", text, zh).alias("_body_zh"), _last("setFeatureBody", text, en).alias("_body_en"),
        _last("setColor", text).alias("_color"), _last("setBadgeNum", text).alias("_num"),
    )
    f = features.join(last, KEY, "left")
    edited = F.col("_body_zh").isNotNull() | F.col("_body_en").isNotNull()
    both = lambda c, z, e: F.struct(F.coalesce(z, f"{c}.zh").alias("zh"), F.coalesce(e, f"{c}.en").alias("en"))
    f = f.withColumn("label", both("label", "_label_zh", "_label_en")).withColumn("explanation", both("explanation", "_body_zh", "_body_en"))
    for c in ("cx", "cy", "r"):
        f = f.withColumn(c, F.coalesce(f"_circle.{c}", c))
    for c in ("offset_x", "offset_y"):
        f = f.withColumn(c, F.coalesce(f"_offset.{c}", c))
    for c in ("physics", "interesting"):
        if c in features.columns:
            f = f.withColumn(c, F.when(~edited, F.col(c)))
    f = f.withColumn("color_key", F.coalesce("_color", "color_key")).withColumn("num", F.coalesce("_num", "num"))
    return f.select(*features.columns)


def apply_report_edits(readings: DataFrame, log: DataFrame) -> DataFrame:
    """Last object name and narrative per language: readings(report, name, narrative)."""
    zh, en = F.col("lang") == "zh", F.col("lang") == "en"
    text = F.col("text")
    last = log.where(F.col("action").isin("setObjectName", "setNarrative")).groupBy("report").agg(
        _last("setObjectName", text, zh).alias("_nz"), _last("setObjectName", text, en).alias("_ne"),
        _last("setNarrative", text, zh).alias("_tz"), _last("setNarrative", text, en).alias("_te"))
    r = readings.join(last, "report", "left")
    r = r.withColumn("name", F.struct(F.coalesce("_nz", "name.zh").alias("zh"), F.coalesce("_ne", "name.en").alias("en")))
    r = r.withColumn("narrative", F.struct(F.coalesce("_tz", "narrative.zh").alias("zh"), F.coalesce("_te", "narrative.en").alias("en")))
    return r.select(*readings.columns)


def apply_nudges(features: DataFrame, log: DataFrame) -> DataFrame:
    """Relative moves add up after the last absolute circle: log(..., action, cx, cy, r, dx, dy).

    Two map-side-combined aggregates rather than a window, so that a feature with very many
    moves is summed in parallel.
    """
    placed = log.where("action = 'setCircle'").groupBy(*KEY).agg(F.max_by(F.struct("seq", "cx", "cy", "r"), "seq").alias("_at"))
    moves = log.where("action = 'nudge'").join(placed.select(*KEY, F.col("_at.seq").alias("_seq")), KEY, "left")
    moves = moves.where(F.col("_seq").isNull() | (F.col("seq") > F.col("_seq"))).groupBy(*KEY).agg(F.sum("dx").alias("_dx"), F.sum("dy").alias("_dy"))
    f = features.join(placed, KEY, "left").join(moves, KEY, "left")
    f = f.withColumn("cx", F.coalesce("_at.cx", "cx") + F.coalesce("_dx", F.lit(0.0))).withColumn("cy", F.coalesce("_at.cy", "cy") + F.coalesce("_dy", F.lit(0.0)))
    return f.withColumn("r", F.coalesce("_at.r", "r")).select(*features.columns)


def add_delete_features(features: DataFrame, log: DataFrame, reports: DataFrame) -> DataFrame:
    """New features with their defaults, then deletions: reports(report, width, height).

    The k-th addition of a report becomes f(n+k), n being its feature count; a later delete
    of the same id wins.
    """
    n = features.groupBy("report").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("report").orderBy("seq")
    adds = log.where("action = 'addFeature'").withColumn("_k", F.row_number().over(w)).join(n, "report", "left").join(reports, "report")
    num = F.coalesce("_n", F.lit(0)) + F.col("_k")
    adds = adds.select(
        "report", F.concat(F.lit("f"), num.cast("string")).alias("feature_id"), F.col("seq").alias("_born"),
        F.floor(F.col("width") / 2.0 + 0.5).cast("double").alias("cx"), F.floor(F.col("height") / 2.0 + 0.5).cast("double").alias("cy"),
        F.floor(F.least("width", "height") / 8.0 + 0.5).cast("double").alias("r"), F.lit("star").alias("color_key"), num.cast("string").alias("num"),
        F.struct(F.lit("新标注").alias("zh"), F.lit("New label").alias("en")).alias("label"))
    gone = log.where("action = 'deleteFeature'").groupBy(*KEY).agg(F.max("seq").alias("_died"))
    out = features.withColumn("_born", F.lit(-1).cast("long")).unionByName(adds, allowMissingColumns=True).join(gone, KEY, "left")
    return out.where(F.col("_died").isNull() | (F.col("_died") < F.col("_born"))).drop("_born", "_died")


def confirm_features(features: DataFrame, log: DataFrame) -> DataFrame:
    """Confirmed features no longer need review."""
    seen = log.where("action = 'confirmFeature'").select(*KEY).distinct().withColumn("_ok", F.lit(True))
    f = features.join(seen, KEY, "left")
    return f.withColumn("needs_human_review", F.col("needs_human_review") & F.col("_ok").isNull()).select(*features.columns)
