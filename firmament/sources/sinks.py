"""Writers. Documents are one row per frame or reading; tables are Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.operators import atlas as A
from firmament.streaming.state import StateTable


def documents(rows: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, document): the row's columns as one JSON text, NULL fields left out."""
    cols = columns or [c for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(*cols)).alias("document"))


def write_documents(rows: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """One JSON document per line; readers get them back with spark.read.text or .json."""
    documents(rows, key).select("document").write.mode(mode).text(path)


def _field(struct: Column, have: list[str], name: str, kind: str | None = None) -> Column:
    return struct[name] if name in have else F.lit(None).cast(kind or "string")


def factsheet_documents(sheets: DataFrame) -> DataFrame:
    """Sheets with their objects in the shape of the document contract, which `scan_factsheet` reads back."""
    have = sheets.schema["objects"].dataType.elementType.fieldNames()

    def shaped(o: Column) -> Column:
        f = lambda name, kind=None: _field(o, have, name, kind)
        sizes = F.array_compact(F.array(f("size_major", "double").cast("double"), f("size_minor", "double").cast("double")))
        place = F.struct(f("ra_deg", "double").alias("ra_deg"), f("dec_deg", "double").alias("dec_deg"), F.when(
            f("px", "double").isNotNull(), F.array(f("px", "double").cast("double"), f("py", "double").cast("double"))).alias("pixel"))
        kind = F.struct(f("otype").alias("otype"), f("type_zh").alias("zh"), f("type_en").alias("en"), f("type_source").alias("source"))
        plain = ["id", "role", "tier", "parent_object_id", "feature_type", "feature_class", "names", "common_name", "designations", "category", "distance",
                 "catalog_ids", "confidence", "type_confidence", "type_needs_review", "cross_match", "geometry_kind", "detection_source", "needs_human_review"]
        parts = [o[n].alias(n) for n in plain if n in have]
        parts += [kind.alias("type"), place.alias("coord"), F.when(F.size(sizes) > 0, sizes).alias("size_arcmin")]
        if "localization_confidence" in have:
            parts.append(F.struct(F.lit("atlas").alias("method"), o["localization_confidence"].alias("confidence")).alias("localization"))
        if "polygon" in have:
            parts.append(F.transform(o["polygon"], lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))).alias("polygon"))
        return F.struct(*parts)

    return sheets.withColumn("objects", F.transform("objects", shaped))


def write_factsheets(sheets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One contract document per line."""
    write_documents(factsheet_documents(sheets), path, "fid", mode)


def _feature(have: list[str]) -> Column:
    """A feature row in the shape of the document contract."""
    number = lambda n: F.col(n).cast("double")
    parts = [F.col(n) for n in ("id", "label", "color_key", "shape", "draw", "arc", "explanation", "physics", "interesting", "fact_ref", "needs_human_review") if n in have]
    if {"cx", "cy", "r"} <= set(have):
        parts.append(F.when(number("cx").isNotNull(), F.struct(*[number(n).alias(n) for n in ("cx", "cy", "r")])).alias("circle"))
    if {"arrow_x", "arrow_y"} <= set(have):
        parts.append(F.when(number("arrow_x").isNotNull(), F.array(number("arrow_x"), number("arrow_y"))).alias("arrow_to"))
    if "polygon" in have:
        parts.append(F.transform("polygon", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))).alias("polygon"))
    if {"offset_x", "offset_y", "bubble_r"} <= set(have):
        parts.append(F.struct(F.col("num").cast("string").alias("num"), *[number(n).alias(n) for n in ("offset_x", "offset_y", "bubble_r")]).alias("badge"))
    return F.struct(*parts)


def reading_documents(features: DataFrame, readings: DataFrame) -> DataFrame:
    """Features of each reading gathered in number order beside its title columns.

    A reading lists the few annotations of one picture.
    """
    cols = [c for c in features.columns if c != "reading_id"]
    name = F.col("id").cast("string") if "id" in cols else F.lit("")
    gathered = F.collect_list(F.struct("num", name.alias("_n"), _feature(cols).alias("f")))
    by_num = lambda a, b: F.when(a["num"] < b["num"], -1).when(a["num"] > b["num"], 1).when(a["_n"] < b["_n"], -1).when(a["_n"] > b["_n"], 1).otherwise(0)
    docs = features.groupBy("reading_id").agg(F.transform(F.array_sort(gathered, by_num), lambda x: x["f"]).alias("features"))
    return readings.join(docs, "reading_id", "left").withColumn("features", F.coalesce("features", F.array().cast(docs.schema["features"].dataType)))


def write_readings(features: DataFrame, readings: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_documents(reading_documents(features, readings), path, "reading_id", mode)


def write_registry(annotations: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The slim approved-only registry: documents of one entry, one per line, each with its ordinal."""
    registry_documents(annotations).write.mode(mode).text(path)


def registry_documents(annotations: DataFrame) -> DataFrame:
    """(document): every entry as a registry document, which `scan_registry` reads back."""
    entry = F.struct(F.col("entry_ord").cast("long").alias("entry_ord"), "primary_id", "aliases", "annotations")
    return A.export_registry(annotations).select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.array(entry).alias("objects"))).alias("document"))


def write_prompts(prompts: DataFrame, path: str, mode: str = "overwrite") -> None:
    prompts.write.mode(mode).parquet(path)


def write_draw_list(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(path)


def write_atlas(spark: SparkSession, entries: DataFrame, path: str, bad: Column | None = None, key: str | None = None) -> int:
    """Whole-store write as the next version of a state table; `read_atlas` gives the last one. Returns the version.

    Rows are validated and written before the store's log points to them: nothing is replaced when a row breaks the contract (`bad` is true
    for it) or the job ends half way, and at any moment some version can be read. `key` (the first column by default) spreads rows.
    """
    if bad is not None:
        entries = entries.withColumn("_bad", F.assert_true(~F.coalesce(bad, F.lit(True)), "atlas row breaks its contract")).where(F.col("_bad").isNull()).drop("_bad")
    return StateTable(spark, path, key or entries.columns[0], 16).replace(entries)


def read_atlas(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of a store written by `write_atlas`; None where nothing was ever written."""
    return StateTable(spark, path, "").read()
