"""Geometry and coordinate expression queries."""

from pyspark.sql import functions as F

from firmament.dims import vocab as V
from firmament.functions import coords, geo
from firmament.operators import frames as FR
from firmament.queries.kit import (
    define_view, flat_sql, frames, half_up_sql, in_sql, query, rounded, s6, sep_sql, values_sql, view,
)

# A catalogue row together with a frame pointing near it.
define_view("v_near", """
SELECT obj_id, ra_deg, dec_deg, otype, size_major, mag,
       ra_deg - ((obj_id % 200) - 100) / CAST(100 AS DOUBLE) AS ra0,
       greatest(CAST(-89 AS DOUBLE), least(CAST(89 AS DOUBLE), dec_deg - ((obj_id % 160) - 80) / CAST(100 AS DOUBLE))) AS dec0,
       CAST(2000 AS DOUBLE) AS crpix_x, CAST(1500 AS DOUBLE) AS crpix_y, CAST(2.33 AS DOUBLE) / 3600 AS scale_deg,
       CAST((obj_id * 37) % 360 AS DOUBLE) AS orientation_deg, CASE WHEN obj_id % 2 = 0 THEN 1 ELSE -1 END AS parity,
       4000 AS width, 3000 AS height,
       CAST((obj_id * 37) % 4000 AS DOUBLE) AS x, CAST((obj_id * 53) % 3000 AS DOUBLE) AS y,
       CAST((obj_id * 61) % 4000 AS DOUBLE) AS x2, CAST((obj_id * 71) % 3000 AS DOUBLE) AS y2
FROM v_catalog""")

define_view("q_near_px", """
SELECT *, crpix_x + parity * (cos(radians(orientation_deg)) * xi + sin(radians(orientation_deg)) * eta) AS px,
       crpix_y - (cos(radians(orientation_deg)) * eta - sin(radians(orientation_deg)) * xi) AS py
FROM (SELECT *, CASE WHEN cosc > 0 THEN cos(radians(dec_deg)) * sin(radians(ra_deg - ra0)) / cosc / radians(scale_deg) END AS xi,
       CASE WHEN cosc > 0 THEN (cos(radians(dec0)) * sin(radians(dec_deg)) - sin(radians(dec0)) * cos(radians(dec_deg)) * cos(radians(ra_deg - ra0)))
         / cosc / radians(scale_deg) END AS eta
FROM (SELECT *, sin(radians(dec0)) * sin(radians(dec_deg)) + cos(radians(dec0)) * cos(radians(dec_deg)) * cos(radians(ra_deg - ra0)) AS cosc FROM v_near))""")

W = geo.wcs_of
C = F.col


def near(spark, sf):
    return view(spark, sf, "v_near")


@query("ang_sep_deg", f"SELECT obj_id, {s6(sep_sql('ra0', 'dec0', 'ra_deg', 'dec_deg'))} AS sep FROM v_near")
def ang_sep_deg(spark, sf):
    return rounded(near(spark, sf).select("obj_id", geo.ang_sep_deg(C("ra0"), C("dec0"), C("ra_deg"), C("dec_deg")).alias("sep")))


@query("flat_sep_arcmin", f"SELECT obj_id, {s6(flat_sql('ra0', 'dec0', 'ra_deg', 'dec_deg'))} AS sep FROM v_near")
def flat_sep_arcmin(spark, sf):
    return rounded(near(spark, sf).select("obj_id", geo.flat_sep_arcmin(C("ra0"), C("dec0"), C("ra_deg"), C("dec_deg")).alias("sep")))


@query("bearing", f"""
SELECT obj_id, CAST(floor(pa + 0.5) AS BIGINT) AS pa,
  CASE CAST(floor(pa / 45 + 0.5) AS BIGINT) % 8 WHEN 0 THEN 'N' WHEN 1 THEN 'NE' WHEN 2 THEN 'E' WHEN 3 THEN 'SE' WHEN 4 THEN 'S' WHEN 5 THEN 'SW' WHEN 6 THEN 'W' ELSE 'NW' END AS cardinal
FROM (SELECT obj_id, (degrees(atan2(sin(radians(ra_deg - ra0)) * cos(radians(dec_deg)),
   cos(radians(dec0)) * sin(radians(dec_deg)) - sin(radians(dec0)) * cos(radians(dec_deg)) * cos(radians(ra_deg - ra0)))) + 360) % 360 AS pa
 FROM v_near WHERE ra0 <> ra_deg OR dec0 <> dec_deg)""")
def bearing(spark, sf):
    d = near(spark, sf).where("ra0 <> ra_deg OR dec0 <> dec_deg")
    return d.select("obj_id", geo.bearing(C("ra0"), C("dec0"), C("ra_deg"), C("dec_deg")).alias("b")).select("obj_id", "b.pa", "b.cardinal")


@query("world_to_pixel", f"SELECT obj_id, {s6('px')} AS px, {s6('py')} AS py FROM q_near_px")
def world_to_pixel(spark, sf):
    d = near(spark, sf).select("obj_id", geo.world_to_pixel(W(), C("ra_deg"), C("dec_deg")).alias("p"))
    return rounded(d.select("obj_id", "p.px", "p.py"))


def p2w_sql(src: str, x: str = "x", y: str = "y", keep: str = "obj_id") -> str:
    """SELECT keep..., wra, wdec: the inverse projection over a source."""
    return f"""
SELECT *, CASE WHEN rho = 0 THEN (ra0 % 360 + 360) % 360 ELSE ((ra0 + degrees(atan2(xi * sin(cc), rho * cos(radians(dec0)) * cos(cc) - eta * sin(radians(dec0)) * sin(cc)))) % 360 + 360) % 360 END AS wra,
  CASE WHEN rho = 0 THEN dec0 ELSE degrees(asin(least(1.0, greatest(-1.0, cos(cc) * sin(radians(dec0)) + eta * sin(cc) * cos(radians(dec0)) / rho)))) END AS wdec
FROM (SELECT *, sqrt(xi * xi + eta * eta) AS rho, atan(sqrt(xi * xi + eta * eta)) AS cc FROM (
 SELECT *, radians(scale_deg) * (cos(radians(orientation_deg)) * parity * ({x} - crpix_x) - sin(radians(orientation_deg)) * (crpix_y - {y})) AS xi,
  radians(scale_deg) * (sin(radians(orientation_deg)) * parity * ({x} - crpix_x) + cos(radians(orientation_deg)) * (crpix_y - {y})) AS eta FROM {src}))"""


@query("pixel_to_world", f"SELECT obj_id, {s6('wra')} AS ra, {s6('wdec')} AS dec FROM ({p2w_sql('v_near')})")
def pixel_to_world(spark, sf):
    d = near(spark, sf).select("obj_id", geo.pixel_to_world(W(), C("x"), C("y")).alias("w"))
    return rounded(d.select("obj_id", "w.ra", "w.dec"))


@query("field_radius_deg", f"SELECT fid, {s6('sqrt(power(width, 2) + power(height, 2)) / 2 * scale_deg')} AS r FROM v_frames")
def field_radius_deg(spark, sf):
    return rounded(frames(spark, sf).select("fid", geo.field_radius_deg(W()).alias("r")))


@query("hms_to_deg", f"""
SELECT obj_id, CASE WHEN obj_id % 7 = 0 THEN NULL ELSE {s6('((obj_id % 24) + (obj_id % 60) / 60.0 + (obj_id % 59 + 0.25) / 3600.0) * 15')} END AS ra,
 CASE WHEN obj_id % 7 = 0 THEN NULL ELSE {s6('(CASE WHEN obj_id % 2 = 0 THEN -1 ELSE 1 END) * ((obj_id % 90) + (obj_id % 60) / 60.0 + (obj_id % 59 + 0.5) / 3600.0)')} END AS dec FROM v_catalog""")
def hms_to_deg(spark, sf):
    o = C("obj_id")
    bad = o % 7 == 0
    ra = F.when(bad, F.lit("12:xx:1")).otherwise(F.concat(o % 24, F.lit(":"), o % 60, F.lit(":"), (o % 59).cast("string"), F.lit(".25")))
    dec = F.when(bad, F.lit("")).otherwise(F.concat(F.when(o % 2 == 0, "-").otherwise("+"), o % 90, F.lit(":"), o % 60, F.lit(":"), (o % 59).cast("string"), F.lit(".5")))
    d = view(spark, sf, "v_catalog").select("obj_id", ra.alias("r"), dec.alias("d"))
    return rounded(d.select("obj_id", coords.hms_to_deg(C("r")).alias("ra"), coords.dms_to_deg(C("d")).alias("dec")))


def _carry_sql(x: str) -> str:
    """h, m, s of x with seconds carry, as CTE-free nested SELECT columns h2, m3, s2."""
    return f"""SELECT *, m2 - CASE WHEN m2 >= 60 THEN 60 ELSE 0 END AS m3, h + CASE WHEN m2 >= 60 THEN 1 ELSE 0 END AS h2 FROM (
 SELECT *, m + CASE WHEN s >= 60 THEN 1 ELSE 0 END AS m2, s - CASE WHEN s >= 60 THEN 60 ELSE 0 END AS s2 FROM (
 SELECT *, CAST(floor(((v - h) * 60.0 - m) * 60.0 + 0.5) AS BIGINT) AS s FROM (
 SELECT *, CAST(floor((v - h) * 60.0) AS BIGINT) AS m FROM (SELECT *, CAST(floor(v) AS BIGINT) AS h FROM (SELECT obj_id, ra_deg, dec_deg, {x} AS v FROM v_catalog)))))"""


def _min_sql(x: str) -> str:
    return f"""SELECT *, m - CASE WHEN m >= 60 THEN 60 ELSE 0 END AS m3, h + CASE WHEN m >= 60 THEN 1 ELSE 0 END AS h2 FROM (
 SELECT *, CAST(floor((v - h) * 60.0 + 0.5) AS BIGINT) AS m FROM (SELECT *, CAST(floor(v) AS BIGINT) AS h FROM (SELECT obj_id, ra_deg, dec_deg, {x} AS v FROM v_catalog)))"""


RA_H = "(((ra_deg % 360) + 360) % 360) / 15.0"
P2 = lambda c: f"lpad(CAST({c} AS VARCHAR), 2, '0')"
SGN = "CASE WHEN dec_deg < 0 THEN '−' ELSE '+' END"


@query("format_ra_hms", f"SELECT obj_id, concat({P2('h2 % 24')}, 'h', {P2('m3')}, 'm', {P2('s2')}, 's') AS text FROM ({_carry_sql(RA_H)})")
def format_ra_hms(spark, sf):
    return view(spark, sf, "v_catalog").select("obj_id", coords.format_ra_hms(C("ra_deg")).alias("text"))


@query("format_dec_dms", f"SELECT obj_id, concat({SGN}, h2, '°', {P2('m3')}, '′', {P2('s2')}, '″') AS text FROM ({_carry_sql('abs(dec_deg)')})")
def format_dec_dms(spark, sf):
    return view(spark, sf, "v_catalog").select("obj_id", coords.format_dec_dms(C("dec_deg")).alias("text"))


@query("format_coord", f"""
SELECT a.obj_id, concat('RA ', {P2('a.h2 % 24')}, 'h', {P2('a.m3')}, 'm', {P2('a.s2')}, 's · Dec ', CASE WHEN a.dec_deg < 0 THEN '−' ELSE '+' END, b.h2, '°', {P2('b.m3')}, '′', {P2('b.s2')}, '″') AS text
FROM ({_carry_sql(RA_H)}) a JOIN ({_carry_sql('abs(dec_deg)')}) b USING (obj_id)""")
def format_coord(spark, sf):
    return view(spark, sf, "v_catalog").select("obj_id", coords.format_coord(C("ra_deg"), C("dec_deg")).alias("text"))


@query("format_ra_hm", f"SELECT obj_id, concat({P2('h2 % 24')}, 'h', {P2('m3')}, 'm') AS text FROM ({_min_sql(RA_H)})")
def format_ra_hm(spark, sf):
    return view(spark, sf, "v_catalog").select("obj_id", coords.format_ra_hm(C("ra_deg")).alias("text"))


@query("format_dec_dm", f"SELECT obj_id, concat({SGN}, h2, '°', {P2('m3')}, '′') AS text FROM ({_min_sql('abs(dec_deg)')})")
def format_dec_dm(spark, sf):
    return view(spark, sf, "v_catalog").select("obj_id", coords.format_dec_dm(C("dec_deg")).alias("text"))


define_view("v_calibration", """
SELECT fid, ra0 AS ra, dec0 AS "dec", scale_deg * 3600 AS pixscale, orientation_deg AS orientation, CAST(parity AS DOUBLE) AS parity,
       width, height, CASE WHEN fid % 3 = 0 THEN 'local' ELSE 'remote' END AS solver FROM v_frames""".replace('"dec"', "dec"))


@query("calibration_to_wcs", f"""
SELECT fid, solver, {s6('ra')} AS ra0, {s6('dec')} AS dec0, {s6('width / 2.0')} AS crpix_x, {s6('height / 2.0')} AS crpix_y, {s6('pixscale / 3600')} AS scale_deg,
 {s6("CASE WHEN solver = 'local' THEN 180 - orientation ELSE orientation END")} AS orientation_deg, CAST(CASE WHEN parity < 0 THEN 1 ELSE -1 END AS BIGINT) AS parity,
 CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height FROM v_calibration""")
def calibration_to_wcs(spark, sf):
    return rounded(FR.calibration_to_wcs(view(spark, sf, "v_calibration")))


STEPS = values_sql([(i, s) for i, s in enumerate(V.NICE_STEPS)])


@query("nice_step", f"""
SELECT obj_id, min_by(s, d * 1000 + i / 1e6) AS step FROM (SELECT obj_id, s, i, abs(s - 2 * ((obj_id % 977) / 30.0 + 0.013) / 12) AS d FROM v_catalog, ({STEPS}) t(i, s)) GROUP BY obj_id""")
def nice_step(spark, sf):
    return rounded(view(spark, sf, "v_catalog").select("obj_id", geo.nice_step((C("obj_id") % 977) / 30.0 + 0.013).alias("step")))


@query("graticule", f"""
WITH base AS (SELECT *, sqrt(power(width, 2) + power(height, 2)) / 2 * scale_deg AS r FROM v_frames),
stepped AS (SELECT b.*, (SELECT min_by(s, abs(s - 2 * b.r / 12) * 1000 + i / 1e6) FROM ({STEPS}) t(i, s)) AS step, b.r / greatest(0.05, cos(radians(b.dec0))) AS dr FROM base b),
lines AS (
 SELECT *, 'dec' AS kind, unnest(generate_series(CAST(ceil((dec0 - r) / step) AS BIGINT), CAST(floor((dec0 + r + 1e-9) / step) AS BIGINT))) AS k FROM stepped
 UNION ALL SELECT *, 'ra', unnest(generate_series(CAST(ceil((ra0 - dr) / step) AS BIGINT), CAST(floor((ra0 + dr + 1e-9) / step) AS BIGINT))) FROM stepped),
pts AS (SELECT *, unnest(generate_series(0, 48)) AS i FROM lines),
sky AS (SELECT *, CASE kind WHEN 'dec' THEN ra0 - dr + 2 * dr * i / 48.0 ELSE k * step END AS ra_deg, CASE kind WHEN 'dec' THEN k * step ELSE dec0 - r + 2 * r * i / 48.0 END AS dec_deg FROM pts),
c AS (SELECT *, sin(radians(dec0)) * sin(radians(dec_deg)) + cos(radians(dec0)) * cos(radians(dec_deg)) * cos(radians(ra_deg - ra0)) AS cosc FROM sky),
st AS (SELECT *, cos(radians(dec_deg)) * sin(radians(ra_deg - ra0)) / cosc / radians(scale_deg) AS xi,
  (cos(radians(dec0)) * sin(radians(dec_deg)) - sin(radians(dec0)) * cos(radians(dec_deg)) * cos(radians(ra_deg - ra0))) / cosc / radians(scale_deg) AS eta FROM c WHERE cosc > 0),
xy AS (SELECT *, crpix_x + parity * (cos(radians(orientation_deg)) * xi + sin(radians(orientation_deg)) * eta) AS px, crpix_y - (cos(radians(orientation_deg)) * eta - sin(radians(orientation_deg)) * xi) AS py FROM st),
grp AS (SELECT fid, kind, k, any_value(step) AS step, count(*) AS n FROM xy GROUP BY fid, kind, k HAVING count(*) >= 2),
num AS (SELECT *, row_number() OVER (PARTITION BY fid, kind ORDER BY k) - 1 AS line_no FROM grp),
lab AS (SELECT x.fid, x.kind, x.k, x.px, x.py, row_number() OVER (PARTITION BY x.fid, x.kind, x.k ORDER BY CASE WHEN x.kind = 'dec' THEN x.px WHEN n.line_no % 2 = 0 THEN x.py ELSE -x.py END, x.i) AS o
  FROM xy x JOIN num n USING (fid, kind, k) WHERE x.px >= 0 AND x.px <= x.width AND x.py >= 0 AND x.py <= x.height)
SELECT n.fid, n.kind, n.line_no, {s6('n.k * n.step')} AS value, n.n AS n_points, {s6('l.px')} AS label_x, {s6('l.py')} AS label_y
FROM num n LEFT JOIN lab l ON l.fid = n.fid AND l.kind = n.kind AND l.k = n.k AND l.o = 1""")
def graticule(spark, sf):
    g = FR.graticule(frames(spark, sf))
    return rounded(g.select("fid", "kind", C("line_no"), "value", F.size("points").alias("n_points"), "label_x", "label_y"))


@query("size_to_px", f"SELECT obj_id, {s6('size_major / 2 / (scale_deg * 60)')} AS r FROM v_near")
def size_to_px(spark, sf):
    return rounded(near(spark, sf).select("obj_id", geo.size_to_px(C("size_major"), C("scale_deg")).alias("r")))


RPX = "(size_major / 2 / (scale_deg * 60))"


@query("disc_frame_coverage", f"""
SELECT obj_id, {s6(f'greatest(0, least(x + {RPX}, width) - greatest(x - {RPX}, 0)) * greatest(0, least(y + {RPX}, height) - greatest(y - {RPX}, 0)) / (4 * {RPX} * {RPX})')} AS coverage,
 abs(x - width / 2) <= {RPX} AND abs(y - height / 2) <= {RPX} AS covers_centre FROM v_near""")
def disc_frame_coverage(spark, sf):
    d = near(spark, sf)
    c = geo.disc_frame_coverage(C("x"), C("y"), geo.size_to_px(C("size_major"), C("scale_deg")), C("width"), C("height"))
    return rounded(d.select("obj_id", c.alias("c")).select("obj_id", "c.coverage", "c.covers_centre"))


@query("center_factor", f"SELECT obj_id, {s6('1 - 0.4 * greatest(0, (greatest(abs(x - 2000) / 2000.0, abs(y - 1500) / 1500.0) - 0.5) / 0.5)')} AS f FROM v_near")
def center_factor(spark, sf):
    return rounded(near(spark, sf).select("obj_id", geo.center_factor(C("x"), C("y"), C("width"), C("height")).alias("f")))


@query("grid_cell_decode", f"""
SELECT obj_id, {half_up_sql("(greatest(0, instr('ABCDEFGH', chr(CAST(65 + obj_id % 10 AS INTEGER))) - 1) + least(1.0, greatest(0.0, (obj_id % 13) / 10.0 - 0.1))) * 4000 / 8")} AS px,
 {half_up_sql("((CASE WHEN obj_id % 7 = 0 THEN 3 ELSE obj_id % 7 END) - 1 + (obj_id % 11) / 10.0) * 3000 / 6.0")} AS py FROM v_near""")
def grid_cell_decode(spark, sf):
    o = C("obj_id")
    cell = F.concat(F.chr(65 + o % 10), (o % 7).cast("string"))
    d = near(spark, sf).select("obj_id", geo.grid_cell_decode(cell, (o % 13) / 10.0 - 0.1, (o % 11) / 10.0, C("width"), C("height")).alias("p"))
    return rounded(d.select("obj_id", "p.px", "p.py"))


ARM = "least(200.0, greatest(40.0, 0.04 * least(width, height)))"
DIST = "(CASE WHEN sqrt(power(x2 - x, 2) + power(y2 - y, 2)) = 0 THEN 1 ELSE sqrt(power(x2 - x, 2) + power(y2 - y, 2)) END)"


@query("arrow_toward", f"SELECT obj_id, {half_up_sql(f'x + (x2 - x) / {DIST} * {ARM}')} AS px, {half_up_sql(f'y + (y2 - y) / {DIST} * {ARM}')} AS py FROM v_near")
def arrow_toward(spark, sf):
    d = near(spark, sf).select("obj_id", geo.arrow_toward(C("x"), C("y"), C("x2"), C("y2"), C("width"), C("height")).alias("p"))
    return rounded(d.select("obj_id", "p.px", "p.py"))


# Line items of an order as the vertices of a polygon.
def polygons(spark, sf):
    return view(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("o"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 100).alias("y")))).alias("v"))


@query("polygon_centroid", f"SELECT l_orderkey, {half_up_sql('sum(l_quantity) / count(*)')} AS x, {half_up_sql('sum(l_extendedprice / 100) / count(*)')} AS y FROM lineitem GROUP BY 1")
def polygon_centroid(spark, sf):
    d = polygons(spark, sf).select("l_orderkey", geo.polygon_centroid(C("v")).alias("c"))
    return rounded(d.select("l_orderkey", "c.x", "c.y"))


@query("polygon_top_vertex", f"""
SELECT l_orderkey, {s6('l_quantity')} AS x, {s6('l_extendedprice / 100')} AS y FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / 100, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def polygon_top_vertex(spark, sf):
    d = polygons(spark, sf).select("l_orderkey", geo.polygon_top_vertex(C("v")).alias("c"))
    return rounded(d.select("l_orderkey", "c.x", "c.y"))


@query("min_vertices", f"""
SELECT l_orderkey, count(*) AS n, count(*) >= CASE l_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS complete FROM lineitem GROUP BY 1""")
def min_vertices(spark, sf):
    kind = F.when(C("l_orderkey") % 3 == 0, "point").when(C("l_orderkey") % 3 == 1, "polyline").otherwise("polygon")
    return rounded(polygons(spark, sf).select("l_orderkey", F.size("v").cast("long").alias("n"), (F.size("v") >= geo.min_vertices(kind)).alias("complete")))


__all__ = ["in_sql"]
