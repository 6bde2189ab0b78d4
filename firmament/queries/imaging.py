"""Pixel and region queries: 8 x 8 rasters from the embedding vectors, plus simple region rows."""

from pyspark.sql import functions as F

from firmament.operators import pixels as P
from firmament.operators import regions as RG
from firmament.operators import tiles as T
from firmament.queries.facts import objects
from firmament.session import pin, spread
from firmament.queries.kit import define_view, half_up_sql, query, r6, rounded, s6, sep_sql, table, view

C = F.col
L = F.lit

# DuckDB-side rasters (check SQL only).
define_view("q_ras", "SELECT vec_id AS fid, list_transform(embedding, lambda v: (CAST(v AS DOUBLE) + 0.6) * 200) AS a FROM embeddings")
define_view("q_pix", "SELECT fid, i % 8 AS gx, i // 8 AS gy, a[i + 1] AS lum FROM q_ras, (SELECT unnest(generate_series(0, 63)) AS i)")


def pixels(spark, sf):
    e = table(spark, sf, "embeddings").select(C("vec_id").alias("fid"), F.posexplode("embedding").alias("pos", "v"))
    lum = (C("v").cast("double") + 0.6) * 200
    return e.select("fid", (C("pos") % 8).alias("gx"), F.floor(C("pos") / 8).cast("int").alias("gy"), lum.alias("lum"), lum.alias("r"), (lum * 0.9).alias("g"), (lum * 0.5 + 30).alias("b"))


def rasters(spark, sf):
    """One row per frame: the vector is already the raster; 100 image pixels per cell.

    A frame is a few hundred bytes and thousands of samples, so frames are dealt over all partitions: a small file would be one task.
    """
    e = spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    return e.select(C("vec_id").alias("fid"), L(8).alias("gw"), L(8).alias("gh"), F.transform("embedding", lambda v: (v.cast("double") + 0.6) * 200).alias("lum"),
                    L(800).alias("width"), L(800).alias("height"), L(0.01).alias("scale_deg"),
                    (C("vec_id") * 37 % 800).cast("double").alias("x"), (C("vec_id") * 53 % 800).cast("double").alias("y"))


def smp(x, y):
    return f"CASE WHEN ({x}) >= 0 AND ({y}) >= 0 AND ({x}) < 800 AND ({y}) < 800 THEN a[CAST(least(7, floor(({y}) / 800.0 * 8)) * 8 + least(7, floor(({x}) / 800.0 * 8)) + 1 AS BIGINT)] END"


def um(lst):
    return f"list_sort(list_filter({lst}, lambda z: z IS NOT NULL))[CAST(floor(len(list_filter({lst}, lambda z: z IS NOT NULL)) / 2.0) AS BIGINT) + 1]"


def lm(x, y, win):
    return um(f"list_transform(generate_series(0, 48), lambda o: {smp(f'({x}) + (o // 7 - 3) * ({win} / 3.0)', f'({y}) + (o % 7 - 3) * ({win} / 3.0)')})")


BG = um(f"list_transform(generate_series(0, 528), lambda o: {smp('(o // 23 + 1) / 24.0 * 800', '(o % 23 + 1) / 24.0 * 800')})")
XY = "CAST(fid * 37 % 800 AS DOUBLE) AS x, CAST(fid * 53 % 800 AS DOUBLE) AS y"


@query("downsample_pixels", f"SELECT fid, gx // 3 AS gx, gy // 3 AS gy, {s6('greatest(avg(lum), avg(lum * 0.5 + 30))')} AS lum FROM q_pix WHERE gx < 6 AND gy < 6 GROUP BY ALL")
def downsample_pixels(spark, sf):
    return rounded(P.downsample_pixels(pixels(spark, sf), 3).select("fid", "gx", "gy", "lum"))


@query("background_level", f"SELECT fid, {s6(BG)} AS bg FROM q_ras")
def background_level(spark, sf):
    return rounded(rasters(spark, sf).select("fid", P.background_level(P.raster_of()).alias("bg")))


@query("local_median", f"SELECT fid, {s6(lm('x', 'y', 90))} AS m FROM (SELECT *, {XY} FROM q_ras)")
def local_median(spark, sf):
    r = rasters(spark, sf)
    d = P.local_median(r.select("fid", "x", "y", L(90.0).alias("win")), T.Pictures.of_rasters(r), ["x", "y"], "x", "y")
    return rounded(d.select("fid", "m"))


RAYS = f"""WITH b AS (SELECT *, {XY}, {BG} AS bg FROM q_ras), c AS (SELECT *, {lm('x', 'y', 90)} > bg * 1.15 AS lit FROM b),
s AS (SELECT fid, k, i, x + 400.0 * i / 40.0 * cos(k / 24.0 * (2 * pi())) AS px, y + 400.0 * i / 40.0 * sin(k / 24.0 * (2 * pi())) AS py, bg, a FROM c, (SELECT unnest(generate_series(0, 23)) AS k), (SELECT unnest(generate_series(1, 40)) AS i)),
m AS (SELECT fid, k, i, px < 0 OR py < 0 OR px >= 800 OR py >= 800 AS off, coalesce({lm('px', 'py', 90)} > bg * 1.15, FALSE) AS bright FROM s),
o AS (SELECT *, max(CAST(off AS INTEGER)) OVER w AS gone, coalesce(max(CASE WHEN bright THEN i END) OVER w, 0) AS last FROM m WINDOW w AS (PARTITION BY fid, k ORDER BY i ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, max(CAST(NOT bright AND i - last >= 4 AS INTEGER)) OVER (PARTITION BY fid, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS broken FROM o),
e AS (SELECT fid, k, max(CASE WHEN bright AND gone = 0 AND broken = 0 THEN 400.0 * i / 40.0 END) AS edge FROM g GROUP BY fid, k),
r AS (SELECT fid, list_sort(list(edge) FILTER (edge > 0)) AS es FROM e GROUP BY fid)
"""


@query("visible_radius", RAYS + f"SELECT fid, {s6('CASE WHEN lit AND len(es) >= 12 THEN es[CAST(floor(len(es) * 0.7) AS BIGINT) + 1] ELSE 0 END')} AS r FROM c JOIN r USING (fid)")
def visible_radius(spark, sf):
    r = rasters(spark, sf)
    d = r.select("fid", "width", "height", "x", "y", P.background_level(P.raster_of()).alias("bg"), L(400.0).alias("max_r"), L(90.0).alias("win"))
    d = P.visible_radius(d, T.Pictures.of_rasters(r), ["x", "y"], "x", "y")
    return rounded(d.select("fid", C("visible_r").alias("r")))


@query("ray_runs", RAYS + "SELECT fid, k AS ray, max(CASE WHEN bright AND broken = 0 THEN i END) AS extent FROM g GROUP BY fid, k")
def ray_runs(spark, sf):
    r = rasters(spark, sf)
    d = r.select("fid", P.background_level(P.raster_of()).alias("bg"), L(90.0).alias("win"), "x", P.ray_points(C("x"), C("y"), L(400.0)).alias("pts"))
    s = T.window_medians(d, T.Pictures.of_rasters(r), ["x"], "pts").select("fid", "bg", F.posexplode("_m").alias("i", "m"))
    s = s.select("fid", F.floor(C("i") / 40).alias("ray"), (C("i") % 40 + 1).alias("step"), F.coalesce(C("m") > C("bg") * 1.15, L(False)).alias("bright"))
    return rounded(P.ray_runs(s, 4))


@query("brightest_rim", f"""
WITH b AS (SELECT *, {XY} FROM q_ras), s AS (SELECT fid, a, k * 6 + j AS o, x + 300.0 * fr * cos(k / 48.0 * (2 * pi())) AS px, y + 300.0 * fr * sin(k / 48.0 * (2 * pi())) AS py
 FROM b, (SELECT unnest(generate_series(0, 47)) AS k), (VALUES (0, CAST(0.55 AS DOUBLE)), (1, CAST(0.65 AS DOUBLE)), (2, CAST(0.75 AS DOUBLE)), (3, CAST(0.85 AS DOUBLE)), (4, CAST(0.95 AS DOUBLE)), (5, CAST(1.0 AS DOUBLE))) t(j, fr)),
m AS (SELECT fid, o, px, py, {lm('px', 'py', 90)} AS lum FROM s WHERE px >= 0 AND py >= 0 AND px < 800 AND py < 800 AND sqrt(power(px - 400, 2) + power(py - 400, 2)) >= 144)
SELECT fid, {half_up_sql('px')} AS px, {half_up_sql('py')} AS py, {s6('lum')} AS lum FROM m WHERE lum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fid ORDER BY lum DESC, o) = 1""")
def brightest_rim(spark, sf):
    avoid = F.array(F.struct(L(400.0).alias("x"), L(400.0).alias("y")))
    r = rasters(spark, sf)
    d = r.select("fid", "width", "height", "x", "y", L(300.0).alias("radius"), L(90.0).alias("win"))
    d = P.brightest_rim(d, T.Pictures.of_rasters(r), avoid, ["x", "y"], "x", "y")
    return rounded(d.where("rim IS NOT NULL").select("fid", "rim.px", "rim.py", "rim.lum"))


FRACS_SQL = ", ".join(f"({j}, CAST({f} AS DOUBLE))" for j, f in enumerate(P.FRACS))
CLEAR = "sqrt(power(p.px - {x}, 2) + power(p.py - {y}, 2)) >= 23 * 1.6"


@query("rim_fronts", f"""
WITH b AS (SELECT fid, a, ord, CAST((fid * 37 % 800 + 150 * ord) % 800 AS DOUBLE) AS x, CAST(fid * 53 % 800 AS DOUBLE) AS y, {BG} AS bg FROM q_ras, (VALUES (1), (2)) t(ord)),
c AS (SELECT *, {lm('x', 'y', 23)} > bg * 1.15 AS lit FROM b),
s AS (SELECT fid, ord, k, i, x + 5000.0 * i / 40.0 * cos(k / 24.0 * (2 * pi())) AS px, y + 5000.0 * i / 40.0 * sin(k / 24.0 * (2 * pi())) AS py, bg, a FROM c, (SELECT unnest(generate_series(0, 23)) AS k), (SELECT unnest(generate_series(1, 40)) AS i)),
m AS (SELECT fid, ord, k, i, px < 0 OR py < 0 OR px >= 800 OR py >= 800 AS off, coalesce({lm('px', 'py', 23)} > bg * 1.15, FALSE) AS bright FROM s),
o AS (SELECT *, max(CAST(off AS INTEGER)) OVER w AS gone, coalesce(max(CASE WHEN bright THEN i END) OVER w, 0) AS last FROM m WINDOW w AS (PARTITION BY fid, ord, k ORDER BY i ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, max(CAST(NOT bright AND i - last >= 4 AS INTEGER)) OVER (PARTITION BY fid, ord, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS broken FROM o),
e AS (SELECT fid, ord, k, max(CASE WHEN bright AND gone = 0 AND broken = 0 THEN 5000.0 * i / 40.0 END) AS edge FROM g GROUP BY fid, ord, k),
r AS (SELECT fid, ord, list_sort(list(edge) FILTER (edge > 0)) AS es FROM e GROUP BY fid, ord),
v AS (SELECT c.*, es[CAST(floor(len(es) * 0.7) AS BIGINT) + 1] AS vr FROM c JOIN r USING (fid, ord) WHERE lit AND len(es) >= 12),
q AS (SELECT fid, ord, a, bg, k * 6 + j AS o, x + vr * fr * cos(k / 48.0 * (2 * pi())) AS px, y + vr * fr * sin(k / 48.0 * (2 * pi())) AS py
 FROM v, (SELECT unnest(generate_series(0, 47)) AS k), (VALUES {FRACS_SQL}) t(j, fr) WHERE vr > 23),
p AS (SELECT p.fid, p.ord, p.o, p.bg, p.px, p.py, {lm('p.px', 'p.py', 23)} AS lum FROM q p WHERE p.px >= 0 AND p.py >= 0 AND p.px < 800 AND p.py < 800
 AND NOT EXISTS (SELECT 1 FROM b WHERE b.fid = p.fid AND NOT ({CLEAR.format(x='b.x', y='b.y')}))),
one AS (SELECT fid, ord, bg, {half_up_sql('px')} AS hx, {half_up_sql('py')} AS hy, lum FROM (
 SELECT * FROM p WHERE ord = 1 AND lum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fid ORDER BY lum DESC, o) = 1) WHERE lum > bg * 1.25),
two AS (SELECT fid, ord, bg, {half_up_sql('px')} AS hx, {half_up_sql('py')} AS hy, lum FROM (
 SELECT p.* FROM p LEFT JOIN one USING (fid) WHERE p.ord = 2 AND p.lum IS NOT NULL AND (one.hx IS NULL OR {CLEAR.format(x='one.hx', y='one.hy')})
 QUALIFY row_number() OVER (PARTITION BY p.fid ORDER BY p.lum DESC, p.o) = 1) WHERE lum > bg * 1.25),
hits AS (SELECT * FROM one UNION ALL SELECT * FROM two)
SELECT fid, concat('bcv', row_number() OVER (PARTITION BY fid ORDER BY ord)) AS id, concat('obj', ord) AS parent_object_id, 'ionization_front' AS feature_type,
  {s6('hx')} AS px, {s6('hy')} AS py, {s6('lum')} AS lum,
  {s6("greatest(0.3, " + half_up_sql("CASE WHEN bg <> 0 THEN least(0.7, lum / (bg * 2.0)) ELSE 0.5 END * 100.0") + " / 100.0)")} AS confidence, 'cv' AS detection_source FROM hits""")
def rim_fronts(spark, sf):
    r = rasters(spark, sf)
    o = r.select("fid", F.explode(F.array(L(1).cast("long"), L(2).cast("long"))).alias("ord"), L("emission_nebula").alias("category"), "x", "y", L(6000.0).alias("size_major"))
    o = o.select("fid", "ord", F.concat(L("obj"), C("ord").cast("string")).alias("id"), "category", F.pmod(C("x") + 150 * C("ord"), L(800.0)).alias("px"), C("y").alias("py"), "size_major")
    return rounded(P.rim_fronts(o, T.Pictures.of_rasters(r), r))


# 64 vectors of 64 numbers make one frame of 64 x 64 cells (the last frame may have fewer rows).
define_view("q_big", "SELECT vec_id // 64 AS fid, vec_id % 64 AS gy, i AS gx, (CAST(embedding[i + 1] AS DOUBLE) + 0.6) * 200 AS lum FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)")
BIG_SIDE = 1600.0


def big_pictures(spark, sf, tile):
    e = table(spark, sf, "embeddings").select(F.floor(C("vec_id") / 64).alias("fid"), (C("vec_id") % 64).cast("int").alias("gy"), F.posexplode("embedding").alias("gx", "v"))
    cells = e.select("fid", "gx", "gy", ((C("v").cast("double") + 0.6) * 200).alias("lum"))
    frames = cells.select("fid").distinct().select("fid", L(BIG_SIDE).alias("width"), L(BIG_SIDE).alias("height"))
    return T.Pictures.of_pixels(cells, frames, tile)


@query("tiled_medians", f"""
WITH size AS (SELECT fid, max(gy) + 1 AS gh FROM q_big GROUP BY fid),
pts AS (SELECT fid, n, gh, CAST((fid * 131 + n * 17) % 1700 AS DOUBLE) - 50 AS x, CAST((fid * 71 + n * 29) % 1700 AS DOUBLE) - 50 AS y, CAST(20 + n % 90 AS DOUBLE) AS win FROM size, (SELECT unnest(generate_series(0, 199)) AS n)),
near AS (SELECT *, x + (o // 7 - 3) * (win / 3.0) AS sx, y + (o % 7 - 3) * (win / 3.0) AS sy FROM pts, (SELECT unnest(generate_series(0, 48)) AS o)),
smp AS (SELECT p.fid, p.n, list_sort(list(b.lum)) AS v FROM near p JOIN q_big b ON b.fid = p.fid AND b.gx = floor(sx / {BIG_SIDE} * 64) AND b.gy = floor(sy / {BIG_SIDE} * gh)
 WHERE sx >= 0 AND sy >= 0 AND sx < {BIG_SIDE} AND sy < {BIG_SIDE} GROUP BY p.fid, p.n)
SELECT fid, n, {s6('v[CAST(floor(len(v) / 2.0) AS BIGINT) + 1]')} AS m FROM pts LEFT JOIN smp USING (fid, n)""")
def tiled_medians(spark, sf):
    """200 windows a frame of 64 x 64 cells, read from tiles of 16 x 16."""
    pictures = big_pictures(spark, sf, 16)
    n = C("n")
    d = pictures.grids.select("fid", F.explode(F.sequence(L(0), L(199))).alias("n"))
    d = d.select("fid", "n", ((C("fid") * 131 + n * 17) % 1700 - 50).cast("double").alias("px"), ((C("fid") * 71 + n * 29) % 1700 - 50).cast("double").alias("py"), (n % 90 + 20).cast("double").alias("win"))
    return rounded(P.local_median(d, pictures, ["n"]).select("fid", "n", "m"))


@query("tiled_labels", """
WITH RECURSIVE cell AS (SELECT fid, gx, gy, gy * 64 + gx AS me FROM q_big WHERE lum > 150),
grow(fid, gx, gy, root) AS (
 SELECT fid, gx, gy, me FROM cell
 UNION
 SELECT c.fid, c.gx, c.gy, g.root FROM grow g JOIN cell c ON c.fid = g.fid AND abs(c.gx - g.gx) + abs(c.gy - g.gy) = 1 AND g.root < c.me),
low AS (SELECT fid, gx, gy, min(root) AS root FROM grow GROUP BY ALL),
num AS (SELECT fid, root, row_number() OVER (PARTITION BY fid ORDER BY root) AS label, n FROM (SELECT fid, root, count(*) AS n FROM low GROUP BY fid, root))
SELECT fid, gx, gy, label FROM low JOIN num USING (fid, root) WHERE n >= 3""")
def tiled_labels(spark, sf):
    pictures = big_pictures(spark, sf, 16)
    cells = pictures.pixels.where("lum > 150").join(pictures.grids.select("fid", L(64).alias("gw"), "gh"), "fid")
    return rounded(RG.label_regions(cells, min_size=3, tile=16))


@query("bright_centroid", f"""
WITH b AS (SELECT *, {XY}, {BG} AS bg FROM q_ras),
s AS (SELECT fid, x, y, sx, sy, {smp('sx', 'sy')} - bg AS w FROM (SELECT *, greatest(0.0, x - 200) + i * 6.0 AS sx, greatest(0.0, y - 200) + j * 6.0 AS sy FROM b, (SELECT unnest(generate_series(0, 70)) AS i), (SELECT unnest(generate_series(0, 70)) AS j))
 WHERE sx <= least(799.0, x + 200) AND sy <= least(799.0, y + 200) AND power(sx - x, 2) + power(sy - y, 2) <= 40000)
SELECT fid, {s6('coalesce(sum(sx * w) FILTER (w > 0) / sum(w) FILTER (w > 0), any_value(x))')} AS px, {s6('coalesce(sum(sy * w) FILTER (w > 0) / sum(w) FILTER (w > 0), any_value(y))')} AS py FROM s GROUP BY fid""")
def bright_centroid(spark, sf):
    d = pin(rasters(spark, sf), bg=P.background_level(P.raster_of()))
    return rounded(d.select("fid", P.bright_centroid(P.raster_of(), C("x"), C("y"), L(200.0), C("bg")).alias("c")).select("fid", "c.px", "c.py"))


SMOOTH = "SELECT p.fid, p.gx, p.gy, sum(q.lum) / 25 AS smooth FROM q_pix p JOIN q_pix q ON q.fid = p.fid AND q.gx BETWEEN p.gx - 2 AND p.gx + 2 AND q.gy BETWEEN p.gy - 2 AND p.gy + 2 WHERE p.gx BETWEEN 2 AND 5 AND p.gy BETWEEN 2 AND 5 GROUP BY ALL"


@query("smooth_mean", f"SELECT fid, gx, gy, {s6('smooth')} AS smooth FROM ({SMOOTH})")
def smooth_mean(spark, sf):
    return rounded(P.smooth_mean(pixels(spark, sf), 2))


@query("brightest_blob", f"SELECT fid, gx AS head_x, gy AS head_y, {s6('smooth')} AS head_val FROM ({SMOOTH}) QUALIFY row_number() OVER (PARTITION BY fid ORDER BY smooth DESC, gx, gy) = 1")
def brightest_blob(spark, sf):
    return rounded(P.brightest_blob(pixels(spark, sf), 2))


def cellsql(x, y):
    return f"a[CAST(greatest(0, least(7, {y})) * 8 + greatest(0, least(7, {x})) + 1 AS BIGINT)]"


M3 = f"list_transform(generate_series(0, 8), lambda o: {cellsql('cx + o // 3 - 1', 'cy + o % 3 - 1')})"


@query("half_max_radius", f"""
WITH s AS (SELECT fid, rad, k, a, floor(3 + rad * cos(k / 16.0 * (2 * pi())) + 0.5) AS cx, floor(4 + rad * sin(k / 16.0 * (2 * pi())) + 0.5) AS cy FROM q_ras, (SELECT unnest(generate_series(1, 3)) AS rad), (SELECT unnest(generate_series(0, 15)) AS k)),
m AS (SELECT fid, rad, count_if(list_sum({M3}) / 9 > 121) AS above FROM s GROUP BY fid, rad)
SELECT fid, coalesce(max(rad) FILTER (rad < stop), 1) AS r FROM (SELECT *, coalesce(min(CASE WHEN above <= 4 THEN rad END) OVER (PARTITION BY fid), 99) AS stop FROM m) GROUP BY fid""")
def half_max_radius(spark, sf):
    return rounded(rasters(spark, sf).select("fid", P.half_max_radius(P.raster_of(), L(3), L(4), L(121.0), L(1)).alias("r")))


@query("ray_extents", f"""
WITH s AS (SELECT fid, k, d, a, floor(3 + d * cos(k / 72.0 * (2 * pi())) + 0.5) AS cx, floor(4 + d * sin(k / 72.0 * (2 * pi())) + 0.5) AS cy FROM q_ras, (SELECT unnest(generate_series(0, 71)) AS k), (SELECT unnest(generate_series(2, 11)) AS d)),
m AS (SELECT fid, k, d, cx < 1 OR cy < 1 OR cx >= 7 OR cy >= 7 AS off, {um(M3)} > 118 AS bright FROM s),
o AS (SELECT *, max(CAST(off AS INTEGER)) OVER w AS gone FROM m WINDOW w AS (PARTITION BY fid, k ORDER BY d ROWS UNBOUNDED PRECEDING))
SELECT fid, k AS ray, coalesce(max(CASE WHEN bright AND gone = 0 THEN d END), 0) AS extent FROM o GROUP BY fid, k""")
def ray_extents(spark, sf):
    # The grid is smaller than the gap limit, so only the frame edge ends a ray here; gaps are unit-tested.
    d = rasters(spark, sf).withColumn("head_x", L(3)).withColumn("head_y", L(4)).withColumn("coma", L(0)).withColumn("tail_thr", L(118.0))
    return rounded(P.ray_extents(d).select("fid", F.posexplode("extents").alias("ray", "extent")))


@query("detect_comets")
def detect_comets(spark, sf):
    fr = rasters(spark, sf).select("fid", "width", "height", L(36.0).alias("pixscale"), L(10.0).alias("ra0"), L(20.0).alias("dec0"), L(400.0).alias("crpix_x"), L(400.0).alias("crpix_y"), "scale_deg", L(0.0).alias("orientation_deg"), L(1).alias("parity"))
    return P.detect_comets(pixels(spark, sf), fr).select("fid", "coma_px", F.size("tails").alias("n_tails"))


HIST = """WITH lim AS (SELECT fid, min(lum) AS mn, max(lum) AS mx FROM q_pix GROUP BY fid), h AS (SELECT fid, mn, 31 / (mx - mn) AS sc, floor((lum - mn) * (31 / (mx - mn)) + 0.5) AS bin FROM q_pix JOIN lim USING (fid)),
c AS (SELECT fid, bin, count(*) AS n, any_value(mn) AS mn, any_value(sc) AS sc FROM h GROUP BY fid, bin),
w AS (SELECT *, sum(n) OVER o AS wb, sum(n * bin) OVER o AS sb, sum(n) OVER t AS tot, sum(n * bin) OVER t AS s FROM c WINDOW o AS (PARTITION BY fid ORDER BY bin ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY fid)),
v AS (SELECT *, CASE WHEN tot > wb THEN wb * (tot - wb) * power(sb / wb - (s - sb) / (tot - wb), 2) ELSE 0 END AS between_ FROM w),
thr AS (SELECT fid, mn + bin / sc AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY fid ORDER BY round(between_, 9) DESC, bin) = 1)
"""


@query("histogram_threshold", HIST + f"SELECT fid, {s6('threshold')} AS threshold FROM thr")
def histogram_threshold(spark, sf):
    return rounded(RG.histogram_threshold(pixels(spark, sf), 32))


MASK = "(SELECT p.fid, gx, gy, lum FROM q_pix p JOIN (SELECT fid, quantile_cont(lum, 0.55) AS cut FROM q_pix GROUP BY fid) c USING (fid) WHERE lum > cut)"


@query("percentile_mask", f"SELECT fid, gx, gy FROM {MASK}")
def percentile_mask(spark, sf):
    return rounded(RG.percentile_mask(pixels(spark, sf), 55.0).select("fid", "gx", "gy"))


def mask(spark, sf):
    return RG.percentile_mask(pixels(spark, sf), 55.0).withColumn("gw", L(8)).withColumn("gh", L(8))


LAB = f"""WITH RECURSIVE mk AS MATERIALIZED (SELECT fid, gx, gy, gy * 8 + gx AS id FROM {MASK}),
lab AS (SELECT fid, gx, gy, id AS root FROM mk UNION SELECT m.fid, m.gx, m.gy, l.root FROM lab l JOIN mk m ON m.fid = l.fid AND abs(m.gx - l.gx) + abs(m.gy - l.gy) = 1 WHERE l.root < m.id),
lb AS (SELECT fid, gx, gy, min(root) AS root FROM lab GROUP BY fid, gx, gy), big AS (SELECT fid, root, count(*) AS n FROM lb GROUP BY fid, root),
fin AS (SELECT lb.*, dense_rank() OVER (PARTITION BY fid ORDER BY root) AS label FROM lb), kept AS (SELECT f.* FROM fin f JOIN big USING (fid, root) WHERE n >= 4)
"""


@query("label_regions", LAB + "SELECT fid, gx, gy, label FROM kept")
def label_regions(spark, sf):
    return rounded(RG.label_regions(mask(spark, sf), min_size=4))


MOM = """, mo AS (SELECT fid, label, count(*) AS area, avg(gx) AS cx, avg(gy) AS cy, var_pop(gx) AS m20, var_pop(gy) AS m02, covar_pop(gx, gy) AS m11 FROM kept GROUP BY ALL),
mm AS (SELECT *, 4 * sqrt(greatest((m20 + m02) / 2 + sqrt(power(m20 - m02, 2) + 4 * m11 * m11) / 2, 0)) AS major, 4 * sqrt(greatest((m20 + m02) / 2 - sqrt(power(m20 - m02, 2) + 4 * m11 * m11) / 2, 1e-9)) AS minor FROM mo)
"""


@query("region_moments", LAB + MOM + f"SELECT fid, label, area, {s6('cx')} AS cx, {s6('cy')} AS cy, {s6('major')} AS length_px, {s6('CASE WHEN minor > 0.01 THEN major / minor END')} AS elongation FROM mm")
def region_moments(spark, sf):
    m = RG.region_moments(RG.label_regions(mask(spark, sf), min_size=4), 1, 64)
    return rounded(m.select("fid", "label", "area", "cx", "cy", "length_px", F.when(C("minor_px") > 0.01, C("elongation")).alias("elongation")))


@query("rim_contact", LAB + MOM + f""", rim AS (SELECT fid, gx, gy FROM q_pix WHERE lum > 110),
nb AS (SELECT k.fid, k.label, k.gx, k.gy, t.o, k.gx + t.dx AS nx, k.gy + t.dy AS ny FROM kept k, (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) t(o, dx, dy)),
ed AS (SELECT n.* FROM nb n ANTI JOIN kept k ON k.fid = n.fid AND k.label = n.label AND k.gx = n.nx AND k.gy = n.ny WHERE nx BETWEEN 0 AND 7 AND ny BETWEEN 0 AND 7 QUALIFY row_number() OVER (PARTITION BY n.fid, n.label, n.gx, n.gy ORDER BY o) = 1),
ct AS (SELECT e.fid, e.label, count(*) AS edge, count(r.gx) AS hits, avg(r.gx) AS mx, avg(r.gy) AS my FROM ed e LEFT JOIN rim r ON r.fid = e.fid AND r.gx = e.nx AND r.gy = e.ny GROUP BY ALL)
SELECT fid, label, {s6('hits / edge')} AS rim_frac, {s6('degrees(atan2(my - cy, mx - cx))')} AS illum_deg FROM mm JOIN ct USING (fid, label) WHERE hits / edge >= 0.18 AND major / minor >= 1.3 AND abs(major / minor - 1.3) > 1e-6""")
def rim_contact(spark, sf):
    lab = RG.label_regions(mask(spark, sf), min_size=4).withColumn("gw", L(8)).withColumn("gh", L(8))
    m = RG.region_moments(lab, 1, 64).where(F.abs(C("elongation") - 1.3) > 1e-6)
    return rounded(RG.rim_contact(lab, m, pixels(spark, sf).where("lum > 110").select("fid", "gx", "gy"), elong_min=1.3).select("fid", "label", "rim_frac", "illum_deg"))


# Region rows: ten per frame.
define_view("v_regions", """
SELECT CAST(floor(obj_id / 10.0) AS BIGINT) AS fid, obj_id % 10 AS rid, CAST((obj_id * 37) % 400 AS DOUBLE) AS cx, CAST((obj_id * 53) % 300 AS DOUBLE) AS cy,
 CAST((obj_id * 7) % 120 AS DOUBLE) AS length_px, 1 + ((obj_id * 11) % 50) / CAST(10 AS DOUBLE) AS elongation, CAST((obj_id * 13) % 900 AS DOUBLE) AS area_px,
 ((obj_id * 17) % 100) / CAST(100 AS DOUBLE) AS solidity, ((obj_id * 19) % 100) / CAST(100 AS DOUBLE) AS local_brightness, ((obj_id * 23) % 100) / CAST(100 AS DOUBLE) AS rim_frac,
 CASE WHEN obj_id % 9 = 0 THEN NULL ELSE CAST((obj_id * 29) % 360 - 180 AS DOUBLE) END AS illum_deg FROM v_catalog""")

define_view("q_salience", """
SELECT *, 0.15 * (area_px / CASE WHEN amax = 0 THEN 1 ELSE amax END) + 0.15 * rim_frac + 0.05 * coalesce(least(sqrt(near / 400), 1), 1) + 0.05 * CASE WHEN edge <= 0.5 THEN 1 ELSE greatest(0, (0.75 - edge) / 0.25) END
  + 0.1 * solidity + 0.1 * least(1, greatest(0, (elongation - 2) / 2)) + 0.4 * local_brightness AS salience
FROM (SELECT r.*, max(area_px) OVER (PARTITION BY fid) AS amax, greatest(abs(cx - 200) / 200, abs(cy - 150) / 150) AS edge,
   (SELECT min(sqrt(power(o.cx - r.cx, 2) + power(o.cy - r.cy, 2))) FROM v_regions o WHERE o.fid = r.fid AND o.rid <> r.rid) AS near FROM v_regions r)
WHERE length_px >= 25 AND area_px >= 150 AND solidity >= 0.4 AND edge <= 0.8""")


def region_rows(spark, sf):
    r = view(spark, sf, "v_regions")
    return r, r.select("fid").distinct().select("fid", L(400).alias("gw"), L(300).alias("gh"))


@query("region_salience", f"SELECT fid, rid, {s6('salience')} AS salience FROM q_salience")
def region_salience(spark, sf):
    return rounded(RG.region_salience(*region_rows(spark, sf)).select("fid", "rid", "salience"))


CAPPED = "SELECT *, row_number() OVER (PARTITION BY fid ORDER BY salience DESC, rid) AS pick FROM (SELECT * FROM q_salience QUALIFY row_number() OVER (PARTITION BY fid, floor(cy / 300 * 3), floor(cx / 400 * 3) ORDER BY salience DESC, rid) <= {k}) QUALIFY pick <= {n}"


@query("outreach_grid_cap", "SELECT fid, rid, pick FROM (" + CAPPED.format(k=1, n=5) + ")")
def outreach_grid_cap(spark, sf):
    s = RG.region_salience(*region_rows(spark, sf))
    return rounded(RG.outreach_grid_cap(s, per_cell=1, n=5).select("fid", "rid", "pick"))


@query("outreach_top", "SELECT fid, rid, pick FROM (" + CAPPED.format(k=3, n=3) + ")")
def outreach_top(spark, sf):
    return rounded(RG.outreach_top(*region_rows(spark, sf)).select("fid", "rid", "pick"))


# Twelve anchors per frame; regions are ten per frame, so the last frames have none.
define_view("v_anchors", """
SELECT CAST(floor(obj_id / 12.0) AS BIGINT) AS fid, obj_id % 12 AS anchor_ord, CAST((obj_id * 41) % 400 AS DOUBLE) AS ax, CAST((obj_id * 43) % 300 AS DOUBLE) AS ay, CAST(20 + obj_id % 80 AS DOUBLE) AS nr
FROM v_catalog""")

# One comet per frame, amid its anchors.
define_view("v_comets", "SELECT fid, avg(ax) AS ax, avg(ay) AS ay FROM v_anchors GROUP BY fid")


@query("regions_in_glow", "SELECT fid, rid FROM v_regions r WHERE EXISTS (SELECT 1 FROM v_anchors a WHERE a.fid = r.fid AND sqrt(power(r.cx - a.ax, 2) + power(r.cy - a.ay, 2)) <= a.nr * 1.15)")
def regions_in_glow(spark, sf):
    neb = view(spark, sf, "v_anchors").select("fid", C("ax").alias("nx"), C("ay").alias("ny"), "nr")
    return RG.regions_in_glow(region_rows(spark, sf)[0], neb).select("fid", "rid")


@query("illumination_prior", """
SELECT r.fid, r.rid FROM v_regions r LEFT JOIN v_anchors a ON a.fid = r.fid
QUALIFY row_number() OVER (PARTITION BY r.fid, r.rid ORDER BY sqrt(power(r.cx - a.ax, 2) + power(r.cy - a.ay, 2)), anchor_ord) = 1 AND (a.fid IS NULL OR coalesce(abs(((illum_deg - degrees(atan2(ay - cy, ax - cx)) + 540) % 360 + 360) % 360 - 180) <= 55, FALSE))""")
def illumination_prior(spark, sf):
    return RG.illumination_prior(region_rows(spark, sf)[0], view(spark, sf, "v_anchors")).select("fid", "rid")


@query("comet_veto", """
SELECT fid FROM (SELECT fid, ax * 10 AS nx, ay * 10 AS ny FROM v_comets) c WHERE NOT EXISTS (SELECT 1 FROM v_objects g WHERE g.fid = c.fid AND g.size_major IS NOT NULL AND g.obj_id % 2 = 0 AND sqrt(power(g.px - nx, 2) + power(g.py - ny, 2)) < 900)""")
def comet_veto(spark, sf):
    comets = view(spark, sf, "v_comets").select("fid", (C("ax") * 10).alias("nucleus_x"), (C("ay") * 10).alias("nucleus_y"), L(300.0).alias("coma_px"))
    g = objects(spark, sf).withColumn("recognizable", C("obj_id") % 2 == 0)
    return P.comet_veto(comets, g).select("fid")


@query("comet_objects", """
SELECT a.fid, t.id, t.tier, t.ft AS feature_type, CASE WHEN t.k >= 3 THEN a.ax ELSE NULL END AS arrow_x FROM v_comets a,
 (VALUES (0, 'comet1', 'A', NULL), (1, 'comet_coma', 'B', 'comet_coma'), (2, 'comet_nuc', 'B', 'comet_nucleus'), (3, 'comet_tail1', 'B', 'comet_ion_tail')) t(k, id, tier, ft)""")
def comet_objects(spark, sf):
    tail = F.struct(L("ion").alias("kind"), C("ax").alias("tip_x"), C("ay").alias("tip_y"))
    c = view(spark, sf, "v_comets").select("fid", C("ax").alias("nucleus_x"), C("ay").alias("nucleus_y"), F.struct(L(1.0).alias("ra"), L(2.0).alias("dec")).alias("sky"), L(3.0).alias("coma_arcmin"), L(0.7).alias("confidence"), F.array(tail).alias("tails"))
    return P.comet_objects(c).select("fid", "id", "tier", "feature_type", "arrow_x")


# Objects of a frame pulled close together on the sky, so that nebulae hold others.
define_view("v_scene", """
SELECT obj_id, CAST(floor(obj_id / 10.0) AS BIGINT) AS fid, id, ord, main_id, px, py, 100 + (obj_id % 10) * CAST(0.05 AS DOUBLE) AS ra_deg, 20 + (obj_id % 7) * CAST(0.05 AS DOUBLE) AS dec_deg,
 CASE obj_id % 3 WHEN 0 THEN 'emission_nebula' WHEN 1 THEN 'star' ELSE 'dark_nebula' END AS category, CASE obj_id % 3 WHEN 0 THEN 'HII' WHEN 1 THEN CASE WHEN obj_id % 2 = 0 THEN 'WR*' ELSE 's*r' END ELSE 'DNe' END AS otype, size_major FROM v_objects""")


def scene(spark, sf):
    return view(spark, sf, "v_scene").withColumn("names", F.array(F.when(C("obj_id") % 6 == 0, "NGC 6888").otherwise(C("main_id"))))


SC = sep_sql("n.ra_deg", "n.dec_deg", "o.ra_deg", "o.dec_deg")
HOLD = f"(SELECT o.fid, o.id, n.id AS nebula_id, n.obj_id AS nid FROM v_scene o JOIN v_scene n ON n.fid = o.fid AND n.category = 'emission_nebula' AND n.size_major > 0 AND {SC} <= n.size_major / 120 QUALIFY row_number() OVER (PARTITION BY o.fid, o.id ORDER BY n.size_major, n.ord) = 1)"


@query("containing_nebula", f"SELECT fid, id, nebula_id FROM {HOLD}")
def containing_nebula(spark, sf):
    return RG.containing_nebula(scene(spark, sf))


@query("wind_shells", f"SELECT fid, concat('bshell', row_number() OVER (PARTITION BY fid ORDER BY ord)) AS id, nebula_id AS parent_object_id, id_ AS anchor_ref FROM (SELECT o.fid, o.ord, o.id AS id_, h.nebula_id FROM v_scene o JOIN {HOLD} h ON h.fid = o.fid AND h.id = o.id WHERE o.otype = 'WR*' AND h.nid % 6 = 0)")
def wind_shells(spark, sf):
    return RG.wind_shells(scene(spark, sf)).select("fid", "id", "parent_object_id", "anchor_ref")


@query("ionization_fronts", f"""
SELECT fid, concat('bfront', row_number() OVER (PARTITION BY fid ORDER BY ord)) AS id, id_ AS parent_object_id, star AS anchor_ref FROM (SELECT c.fid, c.ord, c.id AS id_,
 (SELECT min_by(o.id, o.ord) FROM v_scene o, v_scene n WHERE o.fid = c.fid AND o.otype = 'WR*' AND n.fid = c.fid AND n.id = h.nebula_id AND {SC} <= n.size_major / 120) AS star
 FROM v_scene c JOIN {HOLD} h ON h.fid = c.fid AND h.id = c.id WHERE c.category = 'dark_nebula') WHERE star IS NOT NULL""")
def ionization_fronts(spark, sf):
    return RG.ionization_fronts(scene(spark, sf)).select("fid", "id", "parent_object_id", "anchor_ref")


__all__ = ["r6"]
