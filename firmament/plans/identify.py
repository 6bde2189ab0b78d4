"""The two pipelines, each one plan over all frames: identify -> fact sheets, and annotate -> readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.functions import geo, names
from firmament.operators import annotate, atlas, factsheet, merge, select, spatial
from firmament.operators import pixels as px
from firmament.operators.tiles import Pictures, background_levels
from firmament.session import cut_lineage, pin
from firmament.sources.readers import union_sources


def merged_candidates(frames: DataFrame, catalogs: list[DataFrame]) -> DataFrame:
    """Everything catalogued in each frame's cone, duplicates merged within the frame; with the columns of the frame.

    Catalogues are unioned before the cone join, so the sky is shuffled once. Nicknames are a row's own: they are found before it meets any frame. Cones
    are merged where they are formed.
    """
    sky = union_sources(*catalogs)
    curated = select.nickname_overlay(sky.withColumn("famous", F.lit(False)), key=("src_rank", "row_idx"))
    own = [c for c in sky.columns]
    rows = curated.withColumn("famous", F.col("curated")).select(*[c for c in own if c not in ("fid", "famous")], "famous")
    return merge.merge_catalogs(spatial.cone_search_join(frames, rows, whole=True), by=("fid",), framed=True)


def gated_candidates(frames: DataFrame, merged: DataFrame) -> DataFrame:
    """Projected, gated and nickname-labelled candidates."""
    rows = merged if "ra0" in merged.columns else merged.join(frames, "fid")
    xy = pin(rows, _xy=geo.world_to_pixel(geo.wcs_of(), F.col("ra_deg"), F.col("dec_deg")))
    xy = xy.withColumn("px", F.col("_xy.px")).withColumn("py", F.col("_xy.py")).drop("_xy")
    return select.nickname_overlay(select.gate_candidates(xy), key=("fid", "src_rank", "row_idx"))


def with_brightness(gated: DataFrame, rasters: DataFrame) -> DataFrame:
    """Local median and background of each candidate, sampled from its frame's raster."""
    pictures = Pictures.of_rasters(rasters.join(gated.select("fid", "width", "height").distinct(), "fid") if "width" not in rasters.columns else rasters)
    told = gated.join(background_levels(pictures).withColumnRenamed("bg", "background"), "fid", "left").withColumn("_win", px.vis_window(F.col("width"), F.col("height")))
    return px.local_median(told, pictures, ["src_rank", "row_idx"], win="_win", out="lum").drop("_win")


def identify(
    frames: DataFrame, catalogs: list[DataFrame], registry: DataFrame | None = None, rasters: DataFrame | None = None,
    hits: DataFrame | None = None, entities: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(fact sheets, fact objects) of solved frames: cone, merge, gate, select, enrich, project, assemble.

    frames carry the WCS columns; catalogs have the candidate columns with src_rank and row_idx.
    """
    gated = gated_candidates(frames, merged_candidates(frames, catalogs))
    if rasters is not None:
        gated = with_brightness(gated, rasters)
    keyed = gated.withColumn("obj_id", F.shiftleft(F.col("src_rank").cast("long"), 48) + F.col("row_idx"))
    merge_order = ("merge_key",)
    # The cones are merged once: what may be selected is cut where it arises, and all routes read that.
    chosen = cut_lineage(select.select_objects(select.shortlist(keyed), tie=merge_order, few=True))
    if hits is not None and entities is not None:
        chosen = factsheet.entity_enrich(chosen, hits, entities)
    objects = factsheet.fact_objects(chosen).withColumn("host_id", F.col("id")).withColumn(
        "ids", F.concat("names", "designations", F.map_values("catalog_ids")))
    unmatched = objects
    rows = objects
    if registry is not None:
        features = atlas.project_registry(objects, registry, frames)
        unmatched = atlas.unmatched_hosts(objects, registry)
        host = objects.select("fid", F.col("id").alias("parent_object_id"), "category", F.col("ord").alias("_o"))
        tier_b = features.join(host, ["fid", "parent_object_id"]).select(
            "*", F.lit("B").alias("tier"), F.lit("context").alias("role"), (F.col("_o") + 1000).alias("ord"),
            F.array(F.concat("name.zh", F.lit(" / "), "name.en")).alias("names"), F.col("name.zh").alias("type_zh"), F.col("name.en").alias("type_en")).drop("_o", "name")
        rows = factsheet.union_objects(objects, tier_b)
    rows = rows.drop("host_id", "ids")
    status = frames.select("fid", F.lit("solved").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("target_name"))
    warnings = factsheet.facts_warnings(status, objects, unmatched)
    return factsheet.collect_factsheet(frames, rows, warnings), rows


def annotate_frames(objects: DataFrame, frames: DataFrame) -> DataFrame:
    """Fact objects -> reading features with labels, shapes and colours."""
    need = {"anchor_ref": "string", "arrow_x": "double", "arrow_y": "double", "feature_type": "string", "geometry_kind": "string",
            "polygon": "array<struct<x:double,y:double>>", "otype": "string", "designations": "array<string>", "catalog_ids": "map<string,string>",
            "common_name": "struct<zh:string,en:string>", "size_major": "double"}
    for c, t in need.items():
        if c not in objects.columns:
            objects = objects.withColumn(c, F.lit(None).cast(t))
    sized = frames.select("fid", "width", "height", (F.col("scale_deg") * 3600.0).alias("pixscale"))
    return annotate.build_annotations(objects, sized)


__all__ = ["annotate_frames", "gated_candidates", "identify", "merged_candidates", "names", "with_brightness"]
