"""Cone search, gate, ranking and selection queries."""

import uuid

from pyspark.sql import functions as F

from firmament.dims import vocab as V
from firmament.functions import kinds, names
from firmament.operators import select as S
from firmament.operators import spatial
from firmament.queries.kit import (
    BUBBLE_SQL, catalog, frames, gated, in_sql, query, rounded, s6, selected, sep_sql, view,
)
from firmament.session import shared_folder


@query("cone_search_join", f"SELECT fid, obj_id, {s6('sep_deg')} AS sep_deg FROM q_cone")
def cone_search_join(spark, sf):
    return rounded(spatial.cone_search_join(frames(spark, sf), catalog(spark, sf)).select("fid", "obj_id", "sep_deg"))


#: What a cone search reads of a frame.
CONE = ("fid", "ra0", "dec0", "width", "height", "scale_deg")

RADIUS = "CASE fid % 40 WHEN 0 THEN CAST(10 AS DOUBLE) WHEN 1 THEN CAST(3 AS DOUBLE) ELSE (fid % 8 + 1) * CAST(0.05 AS DOUBLE) END"


@query("zoned_cone_search", f"""
SELECT fid, obj_id, {s6('sep')} AS sep_deg
FROM (SELECT fid, obj_id, {sep_sql('ra0', 'dec0', 'ra_deg', 'dec_deg')} AS sep, r FROM (SELECT *, {RADIUS} AS r FROM v_frames) f, v_cat c) WHERE sep <= r""")
def zoned_cone_search(spark, sf):
    """Cones from 3 arcminutes to 10 degrees against a catalogue stored by sky cell."""
    path = f"{shared_folder(spark)}/zoned-{uuid.uuid4().hex}"
    spatial.write_zoned_catalog(catalog(spark, sf).select("obj_id", "ra_deg", "dec_deg"), path)
    f = frames(spark, sf).withColumn("r", F.expr(RADIUS))
    found = spatial.cone_search_join(f, spatial.read_zoned_catalog(spark, path), radius=F.col("r"))
    return rounded(found.select("fid", "obj_id", "sep_deg"))


@query("in_frame_join", f"SELECT fid, obj_id, {s6('px')} AS px, {s6('py')} AS py FROM q_px")
def in_frame_join(spark, sf):
    return rounded(spatial.in_frame_join(frames(spark, sf), catalog(spark, sf)).select("fid", "obj_id", "px", "py"))


@query("gate_candidates", f"SELECT fid, obj_id, category, {s6('px')} AS px, {s6('py')} AS py FROM q_gated")
def gate_candidates(spark, sf):
    c = spatial.in_frame_join(frames(spark, sf), S.appraise(catalog(spark, sf)))
    return rounded(S.gate_candidates(c, appraised=True).select("fid", "obj_id", "category", "px", "py"))


@query("nickname_overlay", """
SELECT fid, obj_id, curated, CASE WHEN curated THEN 'Statue of Liberty Nebula' END AS name_en,
       CASE WHEN curated THEN '自由女神星云' END AS name_zh FROM q_scored""")
def nickname_overlay(spark, sf):
    return gated(spark, sf).select(
        "fid", "obj_id", "curated", F.col("common_name.en").alias("name_en"), F.col("common_name.zh").alias("name_zh")
    )


@query("significance", f"SELECT fid, obj_id, {s6('score')} AS score FROM q_scored")
def significance(spark, sf):
    return rounded(S.score_candidates(gated(spark, sf)).select("fid", "obj_id", "score"))


@query("rank_candidates", """
SELECT fid, obj_id, row_number() OVER (PARTITION BY fid ORDER BY score DESC, src_rank, row_idx) AS rank FROM q_scored""")
def rank_candidates(spark, sf):
    return rounded(S.rank_candidates(gated(spark, sf)).select("fid", "obj_id", "rank"))


@query("is_prominent", "SELECT fid, obj_id, kind FROM q_prominent")
def is_prominent(spark, sf):
    return S.prominent(gated(spark, sf)).select("fid", "obj_id", kinds.kind_of(F.col("category")).alias("kind"))


@query("top_per_kind", "SELECT fid, obj_id, kind, kind_rank FROM q_topkind")
def top_per_kind(spark, sf):
    return rounded(S.top_per_kind(S.prominent(gated(spark, sf))).select("fid", "obj_id", "kind", "kind_rank"))


@query("select_objects", f"SELECT fid, obj_id, main_id, category, {s6('score')} AS score, rank FROM q_selected")
def select_objects(spark, sf):
    return rounded(selected(spark, sf).select("fid", "obj_id", "main_id", "category", "score", "rank"))


@query("bubble_star", f"""
SELECT * FROM (SELECT n.fid, s.obj_id, row_number() OVER (PARTITION BY n.fid, n.obj_id ORDER BY {sep_sql('n.ra_deg', 'n.dec_deg', 's.ra_deg', 's.dec_deg')}, s.src_rank, s.row_idx) AS bn
FROM (SELECT * FROM q_gated WHERE category = 'emission_nebula' AND size_major IS NOT NULL AND ({BUBBLE_SQL} OR obj_id % 3 = 0)
      QUALIFY row_number() OVER (PARTITION BY fid ORDER BY row_idx) = 1) n
JOIN (SELECT * FROM q_gated WHERE otype IN ('WR*', 'WR?')) s
 ON s.fid = n.fid AND {sep_sql('n.ra_deg', 'n.dec_deg', 's.ra_deg', 's.dec_deg')} < n.size_major * 8 / 120)
WHERE bn = 1""".replace("SELECT * FROM (SELECT n.fid", "SELECT fid, obj_id FROM (SELECT n.fid", 1))
def bubble_star(spark, sf):
    # Every third emission nebula is renamed to a known bubble so that the rule is exercised.
    g = gated(spark, sf)
    named = g.withColumn("names", F.when(F.col("obj_id") % 3 == 0, F.array(F.lit("NGC 6888"))).otherwise(F.col("names")))
    chosen = S.first_hit(
        named, ["fid"], ["row_idx"],
        (F.col("category") == "emission_nebula") & F.col("size_major").isNotNull() & names.is_wind_bubble(F.col("names")),
    ).withColumn("rank", F.lit(1)).withColumn("size_major", F.col("size_major") * 8)
    return S.bubble_star(chosen, g).select("fid", "obj_id")


@query("first_hit", """
SELECT fid, obj_id FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY sep_deg, obj_id) AS n FROM q_cone WHERE size_major > 30) WHERE n = 1""")
def first_hit(spark, sf):
    large = F.col("size_major") > 30
    # A frame's hit is among its nearest large objects: the rest of its cone is never formed.
    cone = spatial.cone_search_join(frames(spark, sf).select(*CONE), catalog(spark, sf).where(large).select("obj_id", "ra_deg", "dec_deg", "size_major"), nearest=1)
    return S.first_hit(cone, ["fid"], ["sep_deg", "obj_id"], large).select("fid", "obj_id")


@query("dedup_by_key", """
SELECT main_id, obj_id FROM (SELECT main_id, obj_id, row_number() OVER (PARTITION BY main_id ORDER BY src_rank, row_idx) AS n FROM (
  SELECT CASE WHEN obj_id % 3 = 0 THEN concat('N ', CAST(obj_id // 6 AS VARCHAR)) ELSE main_id END AS main_id, obj_id, src_rank, row_idx FROM v_cat)) WHERE n = 1""")
def dedup_by_key(spark, sf):
    c = catalog(spark, sf).withColumn("main_id", F.when(
        F.col("obj_id") % 3 == 0, F.concat(F.lit("N "), F.floor(F.col("obj_id") / 6).cast("string"))).otherwise(F.col("main_id")))
    return S.dedup_by_key(c, by=()).select("main_id", "obj_id")


@query("sized_objects_topn", """
SELECT fid, obj_id, size_rank FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY size_major DESC, src_rank, row_idx) AS size_rank
 FROM q_cone WHERE size_major IS NOT NULL)""")
def sized_objects_topn(spark, sf):
    cone = spatial.cone_search_join(frames(spark, sf), catalog(spark, sf))
    return rounded(S.sized_objects_topn(cone).select("fid", "obj_id", "size_rank"))


@query("capped_fetch", """
SELECT fid, source, obj_id, fetch_rank FROM (SELECT *, row_number() OVER (PARTITION BY fid, source ORDER BY mag NULLS LAST, obj_id) AS fetch_rank
 FROM q_cone) WHERE fetch_rank <= 2""")
def capped_fetch(spark, sf):
    # Only rows that can be fetched are formed. An ascending sort puts nulls first: `no_mag` puts them last.
    sky = catalog(spark, sf).select("obj_id", "source", "mag", "ra_deg", "dec_deg", F.col("mag").isNull().alias("no_mag"))
    cone = spatial.cone_search_join(frames(spark, sf).select(*CONE), sky, first=(2, ["source"], ["no_mag", "mag", "obj_id"]))
    out = S.capped_fetch(cone, ["fid", "source"], [F.col("mag").asc_nulls_last(), "obj_id"], 2)
    return rounded(out.select("fid", "source", "obj_id", "fetch_rank"))


@query("fluxes_join", f"""
WITH flux AS (SELECT obj_id, mag AS v_mag FROM v_cat WHERE mag IS NOT NULL),
j AS (SELECT q.fid, q.obj_id, q.otype, q.size_major, f.v_mag FROM q_cone q LEFT JOIN flux f USING (obj_id)),
parts AS (
 SELECT *, 0 AS query, NULL AS mag FROM j WHERE size_major IS NOT NULL
 UNION ALL SELECT *, 1, v_mag FROM j WHERE v_mag < 6
 UNION ALL SELECT *, 2, v_mag FROM j WHERE otype IN ('WR*', 'WR?')
 UNION ALL SELECT *, 3, v_mag FROM j WHERE obj_id IN (SELECT obj_id FROM v_cat WHERE main_id IN {in_sql(V.NICKNAMES)})),
firsts AS (SELECT *, row_number() OVER (PARTITION BY fid, obj_id ORDER BY query) AS k FROM parts)
SELECT fid, obj_id AS oid, query, {s6('mag')} AS mag, CASE WHEN obj_id % 10 = 0 THEN concat('Star ', CAST(obj_id AS VARCHAR)) END AS proper_name FROM firsts WHERE k = 1""")
def fluxes_join(spark, sf):
    c = catalog(spark, sf)
    basic = c.select(F.col("obj_id").alias("oid"), "main_id", "otype", "ra_deg", "dec_deg", "size_major", "size_minor")
    fluxes = c.where(F.col("mag").isNotNull()).select(F.col("obj_id").alias("oid"), F.col("mag").alias("v_mag"))
    ident = c.select(F.col("obj_id").alias("oid"), F.col("main_id").alias("id"), F.lit(0).alias("id_ord")).unionByName(
        c.where(F.col("obj_id") % 10 == 0).select(
            F.col("obj_id").alias("oid"), F.concat(F.lit("NAME Star "), F.col("obj_id").cast("string")).alias("id"), F.lit(1).alias("id_ord")))
    return rounded(S.fluxes_join(basic, fluxes, ident, frames(spark, sf)).select("fid", "oid", "query", "mag", "proper_name"))


__all__ = ["view"]
