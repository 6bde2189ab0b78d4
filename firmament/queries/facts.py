"""Fact-sheet and annotation queries over catalogue rows grouped into frames of ten."""

from pyspark.sql import functions as F

from firmament.dims import vocab as V
from firmament.functions import kinds, names
from firmament.operators import annotate as AN
from firmament.operators import factsheet as FS
from firmament.operators import select as S
from firmament.operators import spatial
from firmament.queries.kit import CATEGORY_SQL, case_sql, catalog, define_view, frames, gated, half_up_sql, query, r6, rounded, s6, selected, table, view
from firmament.queries.geometry import P2, RA_H, _carry_sql
from firmament.queries.scalars import EN, gloss_sql
from firmament.queries.sources import entity_dump
from firmament.sources import readers as R

C = F.col
L = F.lit

FT = ["comet_coma", "comet_nucleus", "pillar", "ionization_front", "bubble_shell", "comet_dust_tail", "hh_jet"]
DS = ["geometric", "cv", "ai", "atlas", "cv"]

define_view("v_obj0", f"""
SELECT obj_id, CAST(floor(obj_id / 10.0) AS BIGINT) AS fid, concat('obj', CAST(obj_id % 10 + 1 AS VARCHAR(20))) AS id, obj_id % 10 AS ord,
  CASE WHEN obj_id % 10 >= 5 THEN 'B' ELSE 'A' END AS tier, otype, main_id, messier, ngc, sharpless,
  CASE WHEN obj_id % 17 = 0 THEN NULL ELSE CAST((obj_id * 37) % 4000 AS DOUBLE) END AS px, CASE WHEN obj_id % 17 = 0 THEN NULL ELSE CAST((obj_id * 53) % 3000 AS DOUBLE) END AS py,
  size_major, mag, ra_deg, dec_deg,
  CASE WHEN obj_id % 10 >= 5 AND obj_id % 3 > 0 THEN concat('obj', CAST(obj_id % 10 - 4 AS VARCHAR(20))) END AS parent_object_id,
  CASE WHEN obj_id % 10 >= 5 AND obj_id % 4 = 1 THEN concat('obj', CAST(obj_id % 5 + 1 AS VARCHAR(20))) END AS anchor_ref,
  CASE WHEN obj_id % 10 >= 5 THEN {case_sql(f"CAST(obj_id % {len(FT)} AS VARCHAR(20))", {str(i): f for i, f in enumerate(FT)})} END AS feature_type,
  CASE WHEN obj_id % 10 >= 5 THEN {case_sql(f"CAST(obj_id % {len(DS)} AS VARCHAR(20))", {str(i): f for i, f in enumerate(DS)})} ELSE 'catalog' END AS detection_source,
  CASE WHEN obj_id % 10 >= 5 AND obj_id % 5 = 3 THEN CASE obj_id % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'polyline' ELSE 'point' END END AS geometry_kind,
  CASE WHEN obj_id % 10 >= 5 AND obj_id % 11 < 4 THEN CAST((obj_id * 91) % 4000 AS DOUBLE) END AS arrow_x,
  CASE WHEN obj_id % 10 >= 5 AND obj_id % 11 < 4 THEN CAST((obj_id * 29) % 3000 AS DOUBLE) END AS arrow_y,
  CASE WHEN obj_id % 10 >= 5 THEN obj_id % 4 ELSE 0 END AS n_poly, obj_id % 6 = 0 AS needs_human_review
FROM v_cat""")

define_view("v_objects", f"""
SELECT *, CASE WHEN tier = 'A' AND obj_id % 31 = 0 THEN 'comet' ELSE coalesce({CATEGORY_SQL}, 'star') END AS category FROM v_obj0""")


def objects(spark, sf):
    o = view(spark, sf, "v_objects")
    ids = F.map_filter(F.create_map(L("messier"), C("messier"), L("ngc"), C("ngc"), L("sharpless"), C("sharpless")), lambda _, v: v.isNotNull())
    # Polygon vertices on a small zigzag; fewer than two are no outline.
    pts = F.transform(F.sequence(L(1), C("n_poly")), lambda i: F.struct((C("obj_id") % 1000 + i * 10).cast("double").alias("x"), (C("obj_id") % 900 + (i % 2) * 30).cast("double").alias("y")))
    o = o.withColumn("polygon", F.when(C("n_poly") > 0, pts)).withColumn("catalog_ids", ids).withColumn("names", F.array("main_id"))
    lab = kinds.object_type_label(C("otype"), C("category"))
    o = o.withColumn("type_zh", lab["zh"]).withColumn("type_en", lab["en"]).withColumn("designations", names.designations(C("catalog_ids"), C("main_id")))
    return o.withColumn("common_name", F.when(C("obj_id") % 23 == 0, F.struct(L(None).cast("string").alias("zh"), F.concat(L("Name "), C("obj_id").cast("string")).alias("en"))))


def obj_frames(spark, sf):
    return view(spark, sf, "v_objects").select("fid").distinct().select("fid", L(4000).alias("width"), L(3000).alias("height"), L(2.33).alias("pixscale"))


def features(spark, sf):
    return AN.build_annotations(objects(spark, sf), obj_frames(spark, sf))


RAD = lambda s: f"coalesce(greatest(50.0, least(600.0, {half_up_sql(f'{s} * 60 / CAST(2.33 AS DOUBLE) / 2')})), 50.0)"
ANN = f"""WITH p AS (SELECT o.*, pr.px AS ppx, pr.py AS ppy, pr.size_major AS psize, pr.id IS NOT NULL AS pfound, an.px AS apx, an.py AS apy,
   row_number() OVER (PARTITION BY o.fid ORDER BY o.ord) AS num, coalesce(o.px, 2000) AS x, coalesce(o.py, 1500) AS y
 FROM v_objects o LEFT JOIN v_objects pr ON pr.fid = o.fid AND pr.id = o.parent_object_id LEFT JOIN v_objects an ON an.fid = o.fid AND an.id = o.anchor_ref
 WHERE NOT (o.category = 'comet' AND o.tier <> 'B')),
a AS (SELECT *, CASE WHEN geometry_kind = 'point' THEN 'dot' WHEN geometry_kind IS NOT NULL THEN geometry_kind WHEN tier <> 'B' THEN 'circle' WHEN detection_source = 'ai' THEN 'shell'
  WHEN feature_type = 'comet_coma' THEN 'circle' WHEN feature_type = 'comet_nucleus' THEN 'dot' WHEN feature_type = 'pillar' THEN 'polygon' WHEN feature_type = 'ionization_front' AND n_poly > 0 THEN 'polyline'
  WHEN arrow_x IS NOT NULL THEN 'arrow' WHEN feature_type = 'ionization_front' AND detection_source = 'cv' THEN 'arc' WHEN feature_type = 'bubble_shell' THEN 'shell' WHEN detection_source = 'cv' THEN 'shell' ELSE 'arrow' END AS asked FROM p),
s AS (SELECT *, CASE WHEN (asked IN ('polygon', 'polyline') AND n_poly < 2) OR (asked = 'arc' AND NOT (tier = 'B' AND ppx IS NOT NULL)) THEN 'shell' ELSE asked END AS shape,
  CASE WHEN asked IN ('polygon', 'polyline', 'arrow') THEN 50.0 WHEN asked = 'dot' THEN CASE WHEN pfound THEN {RAD('psize')} ELSE 100.0 END WHEN asked IN ('shell', 'arc') THEN 100.0 ELSE {RAD('size_major')} END AS r,
  asked IN ('polygon', 'polyline') AND n_poly >= 2 AS outl, asked = 'arrow' AND arrow_x IS NOT NULL AS tail,
  CASE WHEN sqrt(power(arrow_x - x, 2) + power(arrow_y - y, 2)) = 0 THEN 1 ELSE sqrt(power(arrow_x - x, 2) + power(arrow_y - y, 2)) END AS len,
  CASE WHEN sqrt(power(apx - x, 2) + power(apy - y, 2)) = 0 THEN 1 ELSE sqrt(power(apx - x, 2) + power(apy - y, 2)) END AS adist FROM a),
t AS (SELECT *, (arrow_x - x) / len AS ux, (arrow_y - y) / len AS uy, x + (arrow_x - x) / len * len * 0.45 AS tx, y + (arrow_y - y) / len * len * 0.45 AS ty FROM s),
u AS (SELECT *, CASE WHEN (2000 - tx) * -uy + (1500 - ty) * ux < 0 THEN -1 ELSE 1 END AS sg, greatest(50.0, least(160.0, len * 0.16)) AS arm FROM t),
f AS (SELECT *, CASE WHEN outl THEN CAST(obj_id % 1000 + 20 AS DOUBLE) WHEN tail THEN {half_up_sql('tx - uy * sg * arm')} ELSE x END AS cx,
  CASE WHEN outl THEN CAST(obj_id % 900 AS DOUBLE) WHEN tail THEN {half_up_sql('ty + ux * sg * arm')} ELSE y END AS cy,
  CASE WHEN shape = 'arrow' THEN CASE WHEN tail THEN {half_up_sql('tx')} ELSE {half_up_sql('x + (apx - x) / adist * least(adist, 450.0)')} END WHEN asked = 'polygon' THEN arrow_x END AS ax,
  CASE WHEN shape = 'arrow' THEN CASE WHEN tail THEN {half_up_sql('ty')} ELSE {half_up_sql('y + (apy - y) / adist * least(adist, 450.0)')} END WHEN asked = 'polygon' THEN arrow_y END AS ay FROM u)
"""
COLOR = f"""CASE WHEN detection_source = 'atlas' AND feature_type IS NOT NULL THEN {case_sql('feature_type', {k: v[3] for k, v in V.TAXONOMY.items()})} WHEN shape = 'polyline' THEN 'shock'
 WHEN feature_type IS NOT NULL THEN {case_sql('feature_type', {k: v[3] for k, v in V.TAXONOMY.items()})} ELSE {case_sql('category', {k: v[2] for k, v in V.CATEGORY.items()})} END"""


@query("annotation_circle", ANN + f"SELECT fid, id, {s6('r')} AS r, {s6('75')} AS bubble_r FROM f")
def annotation_circle(spark, sf):
    return rounded(features(spark, sf).select("fid", "id", "r", "bubble_r"))


@query("annotation_shape", ANN + f"SELECT fid, id, shape, {s6('cx')} AS cx, {s6('cy')} AS cy FROM f")
def annotation_shape(spark, sf):
    return rounded(features(spark, sf).select("fid", "id", "shape", "cx", "cy"))


@query("annotation_arc", ANN + f"""SELECT fid, id, {s6('ppx')} AS acx, {s6(half_up_sql('CASE WHEN sqrt(power(x - ppx, 2) + power(y - ppy, 2)) = 0 THEN 1 ELSE sqrt(power(x - ppx, 2) + power(y - ppy, 2)) END'))} AS ar, {s6('atan2(y - ppy, x - ppx) - 0.5')} AS a0 FROM f WHERE shape = 'arc'""")
def annotation_arc(spark, sf):
    return rounded(features(spark, sf).where("shape = 'arc'").select("fid", "id", C("arc.cx").alias("acx"), C("arc.r").alias("ar"), C("arc.a0").alias("a0")))


@query("annotation_arrow", ANN + f"SELECT fid, id, {s6('ax')} AS arrow_x, {s6('ay')} AS arrow_y FROM f WHERE ax IS NOT NULL")
def annotation_arrow(spark, sf):
    return rounded(features(spark, sf).where("arrow_x IS NOT NULL").select("fid", "id", "arrow_x", "arrow_y"))


@query("annotation_color", ANN + f"SELECT fid, id, {COLOR} AS color_key FROM f")
def annotation_color(spark, sf):
    return features(spark, sf).select("fid", "id", "color_key")


@query("badge_numbers", ANN + "SELECT fid, id, num FROM f")
def badge_numbers(spark, sf):
    return rounded(AN.badge_numbers(objects(spark, sf)).select("fid", "id", "num"))


@query("category_filter_review", ANN + "SELECT fid, id, CASE WHEN tier = 'B' THEN needs_human_review ELSE px IS NULL END AS review FROM f")
def category_filter_review(spark, sf):
    return features(spark, sf).select("fid", "id", C("needs_human_review").alias("review"))


@query("display_label", """
SELECT fid, id, CASE WHEN obj_id % 23 = 0 THEN concat('Name ', obj_id) WHEN NOT regexp_matches(main_id, '^(\\[|2MASX\\b|LEDA\\b|PGCC\\b|TGU\\b|GSC\\b|UCAC|Gaia |TYC |HD |HIP |SAO |\\* )') THEN main_id
 ELSE coalesce(messier, ngc, sharpless, main_id) END AS en FROM v_objects""".replace("\\\\", "\\"))
def display_label(spark, sf):
    o = objects(spark, sf)
    return o.select("fid", "id", AN.display_label(C("common_name"), C("names"), C("designations"), C("catalog_ids"), C("category"), C("otype"), C("type_zh"), C("type_en"))["en"].alias("en"))


@query("draw_list", ANN + f""", d AS (SELECT *, CASE WHEN shape = 'arrow' AND ax IS NULL THEN 'circle' ELSE shape END AS prim, atan2(ay - cy, ax - cx) AS ang FROM f)
SELECT fid, id, prim AS primitive, {case_sql(COLOR, V.PALETTE)} AS color, {s6("CASE WHEN prim = 'polyline' THEN 8 ELSE 10 END")} AS stroke_width, {s6("CASE WHEN prim = 'dot' THEN 25 ELSE r END")} AS r,
 {s6("CASE WHEN prim IN ('arrow', 'polygon') THEN ax - CASE prim WHEN 'arrow' THEN 60 ELSE 50 END * cos(ang - 0.4) END")} AS barb_x,
 {s6("CASE WHEN prim = 'arc' THEN ppx + floor(CASE WHEN sqrt(power(x - ppx, 2) + power(y - ppy, 2)) = 0 THEN 1 ELSE sqrt(power(x - ppx, 2) + power(y - ppy, 2)) END + 0.5) * cos(atan2(y - ppy, x - ppx) + 0.5) END")} AS arc_x,
 {s6('greatest(75, least(4000 - 75, cx + (r + 75) * 0.7071))')} AS badge_x, {s6('greatest(75, least(3000 - 75, cy - (r + 75) * 0.7071))')} AS badge_y FROM d""")
def draw_list(spark, sf):
    d = AN.draw_list(features(spark, sf))
    return rounded(d.select("fid", "id", "primitive", "color", "stroke_width", "r", C("barb_a.x").alias("barb_x"), C("arc_to.x").alias("arc_x"), "badge_x", "badge_y"))


@query("badge_overlaps", ANN + f""", b AS (SELECT fid, num, cx + (r + 75) * 0.7071 AS ax_, cy - (r + 75) * 0.7071 AS ay_ FROM f)
SELECT p.fid, p.num AS num_a, q.num AS num_b, {s6('sqrt(power(q.ax_ - p.ax_, 2) + power(q.ay_ - p.ay_, 2))')} AS dist FROM b p JOIN b q ON p.fid = q.fid AND p.num < q.num
WHERE sqrt(power(q.ax_ - p.ax_, 2) + power(q.ay_ - p.ay_, 2)) < 150 * 1.35""")
def badge_overlaps(spark, sf):
    return rounded(AN.badge_overlaps(features(spark, sf)))


@query("parent_links", "SELECT o.fid, o.id, p.main_id AS parent_name, a.main_id AS anchor_name FROM v_objects o LEFT JOIN v_objects p ON p.fid = o.fid AND p.id = o.parent_object_id LEFT JOIN v_objects a ON a.fid = o.fid AND a.id = o.anchor_ref")
def parent_links(spark, sf):
    return AN.parent_links(objects(spark, sf)).select("fid", "id", "parent_name", "anchor_name")


@query("tier_source_groups", "SELECT tier, detection_source, count(*) AS n, count_if(needs_human_review) AS n_review FROM v_objects GROUP BY ALL")
def tier_source_groups(spark, sf):
    return FS.tier_source_groups(objects(spark, sf))


@query("catalog_coverage", "SELECT fid, source, count(*) AS n FROM q_cone GROUP BY ROLLUP (fid, source) HAVING fid IS NOT NULL")
def catalog_coverage(spark, sf):
    return FS.catalog_coverage(spatial.cone_search_join(frames(spark, sf), catalog(spark, sf), whole=True))


@query("selection_funnel", """
SELECT fid, c AS candidates, coalesce(g, 0) AS gated, coalesce(s, 0) AS selected FROM (SELECT fid, count(*) AS c FROM q_cone GROUP BY 1) LEFT JOIN (SELECT fid, count(*) AS g FROM q_gated GROUP BY 1) USING (fid) LEFT JOIN (SELECT fid, count(*) AS s FROM q_selected GROUP BY 1) USING (fid)""")
def selection_funnel(spark, sf):
    c = spatial.cone_search_join(frames(spark, sf), catalog(spark, sf))
    g = gated(spark, sf)
    return FS.selection_funnel(c, g, selected(spark, sf))


@query("object_numbering", "SELECT fid, concat('obj', rank) AS id, CASE WHEN rank = 1 AND fid % 5 <> 0 THEN 'primary' ELSE 'secondary' END AS role, main_id FROM q_selected")
def object_numbering(spark, sf):
    comets = frames(spark, sf).where("fid % 5 = 0")
    return FS.object_numbering(selected(spark, sf), comets).select("fid", "id", "role", "main_id")


def solve_frames(spark, sf):
    f = frames(spark, sf)
    return f.withColumn("status", F.when(C("fid") % 7 == 0, "failed").otherwise("solved")).withColumn("error", F.when(C("fid") % 14 == 0, "timeout")).withColumn("target_name", F.when(C("fid") % 21 == 0, "M 1"))


@query("facts_warnings", """
SELECT f.fid, CASE WHEN f.fid % 21 = 0 THEN 'user_provided' WHEN f.fid % 7 = 0 THEN 'failed' ELSE 'solved' END AS status,
 CASE WHEN f.fid % 7 = 0 THEN concat(CASE WHEN f.fid % 21 = 0 THEN 'Plate solve failed.' ELSE 'Plate solve failed and no target name was given.' END, CASE WHEN f.fid % 14 = 0 THEN ' Reason: timeout.' ELSE '' END,
   CASE WHEN f.fid % 21 = 0 THEN ' Target name M 1 was given; names are not looked up here, so no object is claimed.' ELSE ' No object is claimed.' END)
 ELSE concat_ws('|', CASE WHEN o.n IS NULL THEN 'No prominent catalogued object with an optical counterpart in the field.' END, o.w) END AS warnings
FROM v_frames f LEFT JOIN (SELECT fid, count(*) AS n, string_agg(CASE WHEN category IN ('emission_nebula', 'reflection_nebula', 'planetary_nebula', 'supernova_remnant', 'dark_nebula', 'galaxy') AND obj_id % 2 = 0
   THEN concat('The registry has no outline of ', main_id, ' so far.') END, '|' ORDER BY ord) AS w FROM v_objects GROUP BY fid) o USING (fid)""")
def facts_warnings(spark, sf):
    o = objects(spark, sf)
    return FS.facts_warnings(solve_frames(spark, sf), o, o.where("obj_id % 2 = 0")).select("fid", "status", F.array_join("warnings", "|").alias("warnings"))


@query("suggest_identity", """
SELECT fid, coalesce(messier, ngc, sharpless, main_id) AS primary_id, concat_ws('|', CASE WHEN obj_id % 23 = 0 THEN concat('Name ', obj_id) END, CASE WHEN ngc IS NOT NULL AND ngc <> coalesce(messier, ngc) THEN ngc END,
 CASE WHEN sharpless IS NOT NULL AND sharpless <> coalesce(messier, ngc, sharpless) THEN sharpless END) AS aliases FROM v_objects WHERE ord = 0""")
def suggest_identity(spark, sf):
    o = objects(spark, sf).withColumn("role", F.when(C("ord") == 0, "primary").otherwise("secondary"))
    return FS.suggest_identity(o).select("fid", "primary_id", F.array_join("aliases", "|").alias("aliases"))


@query("cross_id_summary", """
SELECT obj_id, 2 AS n, greatest(obj_id % 9, obj_id % 4) + 0.5 <= coalesce(size_major, 5) AS same_object, concat(main_id, ' ↔ A · Δ ', obj_id % 9, '.5′|', main_id, ' ↔ B · Δ ', obj_id % 4, '.5′') AS items FROM v_cat""")
def cross_id_summary(spark, sf):
    x = F.array(*[F.struct(L(n).alias("id"), (C("obj_id") % m + 0.5).alias("sep_arcmin")) for n, m in (("A", 9), ("B", 4))])
    d = catalog(spark, sf).select("obj_id", FS.cross_id_summary(x, C("main_id"), C("size_major")).alias("s"))
    return rounded(d.select("obj_id", "s.n", "s.same_object", F.array_join("s.items", "|").alias("items")))


_PLAIN = "regexp_replace(CAST(o.size_major AS VARCHAR), '\\.0$', '')"


@query("object_detail_line", f"""
SELECT o.fid, o.id, concat_ws(' · ', coalesce(concat(o.otype, ' (') || {gloss_sql(EN, ' (cand.)').replace('otype', 'o.otype')} || ')', o.otype),
  concat('id ', CASE WHEN o.messier IS NOT NULL THEN '0.97' WHEN o.ngc IS NOT NULL THEN '0.90' WHEN o.sharpless IS NOT NULL THEN '0.82' WHEN o.mag IS NOT NULL THEN '0.85' ELSE '0.70' END), 'type 0.70 · wiki',
  concat({P2('a.h2 % 24')}, 'h', {P2('a.m3')}, 'm', {P2('a.s2')}, 's ', CASE WHEN o.dec_deg < 0 THEN '−' ELSE '+' END, b.h2, '°', {P2('b.m3')}, '′', {P2('b.s2')}, '″'), {_PLAIN} || '′', {_PLAIN} || ' pc') AS line
FROM v_objects o JOIN ({_carry_sql(RA_H)}) a USING (obj_id) JOIN ({_carry_sql('abs(dec_deg)')}) b USING (obj_id)""")
def object_detail_line(spark, sf):
    o = objects(spark, sf).withColumn("confidence", kinds.identity_confidence(C("catalog_ids"), C("mag"))).withColumn("type_confidence", L(0.7)).withColumn("type_source", L("wiki"))
    o = o.withColumn("distance", F.struct(C("size_major").alias("value"), L("pc").alias("unit")))
    return o.select("fid", "id", FS.object_detail_line("en").alias("line"))


@query("project_summary", """
SELECT o.fid AS reading_id, concat('n', o.fid) AS name, count(*) AS features, CASE WHEN o.fid % 4 > 0 THEN 'solved' END AS solve_status, CASE WHEN o.fid % 4 > 0 THEN count_if(needs_human_review) END AS needs_review FROM v_objects o GROUP BY o.fid""")
def project_summary(spark, sf):
    o = objects(spark, sf).withColumnRenamed("fid", "reading_id")
    name = F.concat(L("n"), C("reading_id").cast("string"))
    r = o.select("reading_id").distinct().select("reading_id", L("en").alias("display_language"), F.struct(L("x").alias("zh"), name.alias("en")).alias("name"), F.struct(L("x").alias("zh"), L("y").alias("en")).alias("type"), L(3).alias("stage"))
    sheets = r.where("reading_id % 4 > 0").select("reading_id", L("solved").alias("status"))
    return FS.project_summary(r, o, sheets, o).select("reading_id", "name", "features", "solve_status", "needs_review")


@query("unique_slugs", """
WITH ex AS (SELECT DISTINCT replace(p_name, ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-2' ELSE '-4' END AS slug FROM part WHERE p_partkey % 7 = 0),
nw AS (SELECT p_partkey, replace(p_name, ' ', '-') AS base, row_number() OVER (PARTITION BY replace(p_name, ' ', '-') ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 2 = 1),
cand AS (SELECT b.base, k, row_number() OVER (PARTITION BY b.base ORDER BY k) AS n FROM (SELECT base, count(*) AS c FROM nw GROUP BY base) b, (SELECT unnest(generate_series(1, (SELECT count(*) FROM nw) + 4)) AS k) WHERE k <= c + 4
  AND CASE WHEN k = 1 THEN b.base ELSE b.base || '-' || k END NOT IN (SELECT slug FROM ex))
SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM nw JOIN cand USING (base, n)""")
def unique_slugs(spark, sf):
    p = table(spark, sf, "part")
    base = F.replace(C("p_name"), L(" "), L("-"))
    ex = p.where("p_partkey % 7 = 0").select(F.concat(base, F.when(C("p_partkey") % 3 == 0, "").when(C("p_partkey") % 3 == 1, "-2").otherwise("-4")).alias("slug")).distinct()
    return FS.unique_slugs(p.where("p_partkey % 2 = 1").select("p_partkey", base.alias("base")), ex, "p_partkey").select("p_partkey", "slug")


@query("entity_enrich", """
WITH h AS (SELECT obj_id, t.o AS hit_ord, concat('Q', obj_id - obj_id % 3 + t.o) AS qid FROM v_cat, (VALUES (0), (1), (2), (3)) t(o)),
g AS (SELECT h.obj_id, e.obj_id AS eid, hit_ord, p31 FROM h JOIN v_entities e USING (qid) WHERE p31 IN ('Q207436', 'Q13632', 'Q523') OR has_p59 QUALIFY row_number() OVER (PARTITION BY h.obj_id ORDER BY hit_ord) = 1)
SELECT c.obj_id, CASE WHEN c.obj_id % 5 = 0 THEN '己' WHEN eid IS NOT NULL THEN CASE WHEN eid % 2 = 0 THEN concat('名 ', eid) ELSE concat('别 ', eid) END END AS zh, CASE p31 WHEN 'Q207436' THEN 'supernova_remnant' WHEN 'Q13632' THEN 'planetary_nebula' END AS wiki_category
FROM v_cat c LEFT JOIN g USING (obj_id)""")
def entity_enrich(spark, sf):
    c = catalog(spark, sf)
    name = F.concat(L("Name "), C("obj_id").cast("string"))
    sel = c.withColumn("common_name", F.struct(F.when(C("obj_id") % 5 == 0, "己").alias("zh"), name.alias("en")))
    hits = c.select(name.alias("name"), (C("obj_id") - C("obj_id") % 3).alias("b"), F.explode(F.sequence(L(0), L(3))).alias("hit_ord")).select("name", "hit_ord", F.concat(L("Q"), (C("b") + C("hit_ord")).cast("string")).alias("qid"))
    e = R.entities(entity_dump(spark, sf))
    return FS.entity_enrich(sel, hits, e).select("obj_id", C("common_name.zh").alias("zh"), "wiki_category")


@query("union_objects", "SELECT fid, tier, count(*) AS n FROM (SELECT fid, 'A' AS tier FROM v_objects WHERE tier = 'A' UNION ALL SELECT fid, 'B' FROM v_objects WHERE tier = 'B' UNION ALL SELECT c_custkey, 'A' FROM customer) GROUP BY ALL")
def union_objects(spark, sf):
    o = objects(spark, sf)
    comets = table(spark, sf, "customer").select(C("c_custkey").alias("fid"), L("comet1").alias("id"), L("A").alias("tier"))
    return FS.union_objects(comets, o.where("tier = 'A'"), o.where("tier = 'B'")).groupBy("fid", "tier").agg(F.count("*").alias("n"))


@query("collect_factsheet", "SELECT f.fid, count(id) AS n_objects, min_by(id, ord) AS first_id, max_by(main_id, ord) AS last_name FROM v_frames f LEFT JOIN v_objects o ON o.fid = f.fid GROUP BY f.fid")
def collect_factsheet(spark, sf):
    o = objects(spark, sf)
    w = FS.facts_warnings(solve_frames(spark, sf), o, o)
    d = FS.collect_factsheet(frames(spark, sf), o.select("fid", "ord", "id", "tier", "names", "category", "px", "py"), w)
    return rounded(d.select("fid", F.size("objects").cast("long").alias("n_objects"), F.try_element_at("objects", L(1))["id"].alias("first_id"), F.try_element_at("objects", L(-1))["names"][0].alias("last_name")))


__all__ = ["r6"]
