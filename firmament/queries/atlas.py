"""Annotation-atlas queries."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.dims import vocab as V
from firmament.operators import atlas as A
from firmament.queries.geometry import p2w_sql
from firmament.queries.kit import case_sql, catalog, define_view, frames, half_up_sql, query, rounded, s6, table, view
from firmament.session import shared_folder

C = F.col
L = F.lit

# Every annotation belongs to one of 40 entries; its shape is three points near a catalogue row.
define_view("v_registry", """
SELECT p_partkey AS anno_id, p_partkey % 40 AS entry_ord, concat('NGC', CAST((p_partkey % 40) * 4 AS VARCHAR(20))) AS primary_id,
       concat('Alias ', CAST(p_partkey % 40 AS VARCHAR(20))) AS alias, p_partkey AS anno_ord,
       CASE p_size % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'in_review' ELSE 'approved' END AS status,
       CASE p_size % 4 WHEN 0 THEN 'pillar' WHEN 1 THEN 'shell' WHEN 2 THEN 'filament' ELSE 'jet' END AS feature_type,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS label_en,
       CASE p_partkey % 3 WHEN 0 THEN 'polygon' WHEN 1 THEN 'polyline' ELSE 'point' END AS geom_type
FROM part""")

# A host per frame: identities hit entries by primary id or alias; its frame points near vertex offsets.
define_view("v_hosts", """
SELECT c_custkey AS fid, 'obj1' AS host_id, CASE WHEN c_custkey % 3 = 0 THEN concat('ngc ', CAST((c_custkey % 50) * 4 AS VARCHAR(20)))
  WHEN c_custkey % 3 = 1 THEN concat('ALIAS', CAST(c_custkey % 60 AS VARCHAR(20))) ELSE c_name END AS name FROM customer""")


def registry(spark, sf):
    r = view(spark, sf, "v_registry")
    lbl = F.struct(L("").alias("zh"), C("label_en").alias("en"))
    # Vertices: offsets of a third of a degree around (10 * entry, entry); two frames out of three see them.
    base_ra, base_dec = (C("entry_ord") * 10).cast("double"), C("entry_ord").cast("double")
    v = F.array(*[F.struct((base_ra + (C("anno_ord") % 7) * 0.05 + dx).alias("ra"), (base_dec + (C("anno_ord") % 5) * 0.05 + dy).alias("dec")) for dx, dy in ((0.0, 0.0), (0.1, 0.0), (0.1, 0.1))])
    v = F.when(C("geom_type") == "point", F.slice(v, 1, 1)).when(C("geom_type") == "polyline", F.slice(v, 1, 2)).otherwise(v)
    return r.withColumn("label", lbl).withColumn("note", L(None).cast("struct<zh:string,en:string>")).withColumn("vertices", v).withColumn("aliases", F.array("alias")).drop("alias", "label_en")


def hosts(spark, sf):
    return view(spark, sf, "v_hosts").withColumn("ids", F.array("name", L("shared")))


MATCH = """(SELECT h.fid, h.host_id, min(r.entry_ord) AS entry_ord FROM v_hosts h JOIN (SELECT DISTINCT entry_ord, primary_id, alias FROM v_registry) r
 ON upper(replace(h.name, ' ', '')) IN (upper(replace(r.primary_id, ' ', '')), upper(replace(r.alias, ' ', ''))) GROUP BY h.fid, h.host_id)"""


@query("registry_match", f"SELECT fid, host_id, entry_ord FROM {MATCH}")
def registry_match(spark, sf):
    return A.registry_match(hosts(spark, sf), registry(spark, sf))


@query("unmatched_hosts", f"SELECT fid, host_id, name FROM v_hosts h ANTI JOIN {MATCH} m ON m.fid = h.fid")
def unmatched_hosts(spark, sf):
    return A.unmatched_hosts(hosts(spark, sf), registry(spark, sf)).select("fid", "host_id", "name")


@query("unnamed_ordinals", """
SELECT anno_id, CASE WHEN label_en = '' AND count(*) OVER w > 1 THEN row_number() OVER (PARTITION BY entry_ord, feature_type, label_en = '' ORDER BY anno_ord) END AS ordinal
FROM v_registry WINDOW w AS (PARTITION BY entry_ord, feature_type, label_en = '')""")
def unnamed_ordinals(spark, sf):
    return rounded(A.unnamed_ordinals(registry(spark, sf)).select("anno_id", "ordinal"))


def host_frames(spark, sf):
    """Each host's frame points at the entry it matches (by construction of the adapter)."""
    f = frames(spark, sf)
    e = F.when(C("fid") % 3 == 0, C("fid") % 50).otherwise(C("fid") % 60)
    return f.withColumn("ra0", (e * 10).cast("double")).withColumn("dec0", e.cast("double") + (C("fid") % 3 - 1) * 0.9)


PROJ = f"""WITH m AS {MATCH},
f AS (SELECT * REPLACE (CAST(CASE WHEN fid % 3 = 0 THEN fid % 50 ELSE fid % 60 END * 10 AS DOUBLE) AS ra0, CASE WHEN fid % 3 = 0 THEN fid % 50 ELSE fid % 60 END + (fid % 3 - 1) * CAST(0.9 AS DOUBLE) AS dec0) FROM v_frames),
vtx AS (SELECT r.*, t.i, r.entry_ord * 10 + (r.anno_ord % 7) * CAST(0.05 AS DOUBLE) + t.dx AS vra, r.entry_ord + (r.anno_ord % 5) * CAST(0.05 AS DOUBLE) + t.dy AS vdec
  FROM v_registry r, (VALUES (0, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE)), (1, CAST(0.1 AS DOUBLE), CAST(0.0 AS DOUBLE)), (2, CAST(0.1 AS DOUBLE), CAST(0.1 AS DOUBLE))) t(i, dx, dy)
  WHERE t.i < CASE r.geom_type WHEN 'point' THEN 1 WHEN 'polyline' THEN 2 ELSE 3 END),
c AS (SELECT m.host_id, f.*, v.entry_ord, v.anno_ord, v.feature_type, v.geom_type, v.label_en, v.i, v.vra, v.vdec,
  sin(radians(f.dec0)) * sin(radians(v.vdec)) + cos(radians(f.dec0)) * cos(radians(v.vdec)) * cos(radians(v.vra - f.ra0)) AS cosc
  FROM m JOIN f USING (fid) JOIN vtx v ON v.entry_ord = m.entry_ord),
st AS (SELECT *, cos(radians(vdec)) * sin(radians(vra - ra0)) / cosc / radians(scale_deg) AS xi,
  (cos(radians(dec0)) * sin(radians(vdec)) - sin(radians(dec0)) * cos(radians(vdec)) * cos(radians(vra - ra0))) / cosc / radians(scale_deg) AS eta FROM c WHERE cosc > 0),
xy AS (SELECT *, crpix_x + parity * (cos(radians(orientation_deg)) * xi + sin(radians(orientation_deg)) * eta) AS px, crpix_y - (cos(radians(orientation_deg)) * eta - sin(radians(orientation_deg)) * xi) AS py FROM st),
"""
GRP = f"""grp AS (SELECT fid, host_id, anno_ord, any_value(entry_ord) AS entry_ord, any_value(feature_type) AS feature_type, any_value(geom_type) AS geom_type, any_value(label_en) AS label_en, count(*) AS n,
  {half_up_sql(f"sum({half_up_sql('px')}) / count(*)")} AS cx, {half_up_sql(f"sum({half_up_sql('py')}) / count(*)")} AS cy
  FROM xy GROUP BY fid, host_id, anno_ord HAVING bool_or(px >= 0 AND px <= width AND py >= 0 AND py <= height)),
tot AS (SELECT entry_ord, feature_type, count(*) AS k FROM v_registry WHERE label_en = '' GROUP BY ALL),
num AS (SELECT g.*, CASE WHEN g.label_en = '' AND t.k > 1 THEN row_number() OVER (PARTITION BY g.fid, g.host_id, g.feature_type, g.label_en = '' ORDER BY anno_ord) END AS ordinal
  FROM grp g LEFT JOIN tot t ON t.entry_ord = g.entry_ord AND t.feature_type = g.feature_type)"""
TAX_EN = {k: V.TAXONOMY[v][1] for k, v in V.ATLAS_TYPE.items()}


@query("project_registry", PROJ + GRP + f"""
SELECT n.fid, concat('atlas_obj1_', n.anno_ord + 1) AS id, {case_sql('n.feature_type', V.ATLAS_TYPE)} AS feature_type, CASE WHEN label_en <> '' THEN label_en ELSE concat({case_sql('n.feature_type', TAX_EN)}, coalesce(' ' || ordinal, '')) END AS name_en,
 cx AS px, cy AS py, CASE WHEN geom_type <> 'point' THEN n.n END AS n_points FROM num n""")
def project_registry(spark, sf):
    p = A.project_registry(hosts(spark, sf), registry(spark, sf), host_frames(spark, sf))
    return rounded(p.select("fid", "id", "feature_type", C("name.en").alias("name_en"), "px", "py", F.when(C("polygon").isNotNull(), F.size("polygon")).alias("n_points")))


@query("reproject_check", PROJ.rstrip().rstrip(",") + f"""
SELECT fid, anno_ord, count(*) AS n, {s6('min(px)')} AS min_px, {s6('max(py)')} AS max_py FROM xy GROUP BY fid, anno_ord""")
def reproject_check(spark, sf):
    other = A.registry_match(hosts(spark, sf), registry(spark, sf)).join(host_frames(spark, sf), "fid")
    p = A.reproject_check(registry(spark, sf), other)
    return rounded(p.select("fid", "anno_ord", F.size("points").alias("n"), F.array_min(F.transform("points", lambda q: q["px"])).alias("min_px"), F.array_max(F.transform("points", lambda q: q["py"])).alias("max_py")))


@query("status_counts", """SELECT primary_id, count(*) AS annotations, count_if(status = 'draft') AS draft, count_if(status = 'in_review') AS in_review, count_if(status = 'approved') AS approved FROM v_annotations GROUP BY 1""")
def status_counts(spark, sf):
    return A.status_counts(view(spark, sf, "v_annotations"))


@query("registry_counts", "SELECT count(DISTINCT primary_id) AS objects, count(*) AS annotations FROM v_annotations WHERE status = 'approved'")
def registry_counts(spark, sf):
    return A.registry_counts(view(spark, sf, "v_annotations"))


@query("export_registry", "SELECT primary_id, count(*) AS n, string_agg(feature_type || ':' || label_en, '|' ORDER BY anno_ord) AS annos FROM v_registry WHERE status = 'approved' GROUP BY 1")
def export_registry(spark, sf):
    e = A.export_registry(registry(spark, sf))
    return e.select("primary_id", F.size("annotations").cast("long").alias("n"), F.array_join(F.transform("annotations", lambda a: F.concat(a["feature_type"], L(":"), a["label"]["en"])), "|").alias("annos"))


# Layers: the registry, then an overlay of every third annotation under another spelling and some new entries.
@query("merge_registries", """
WITH a AS (SELECT 0 AS layer, entry_ord, primary_id, alias, anno_ord FROM v_registry
 UNION ALL SELECT 1, 100 + entry_ord, CASE WHEN entry_ord % 2 = 0 THEN replace(lower(primary_id), 'ngc', 'ngc ') ELSE concat('New', entry_ord) END, CASE WHEN entry_ord % 4 = 0 THEN alias ELSE concat('Other ', entry_ord) END, anno_ord FROM v_registry WHERE anno_id % 3 = 0),
k AS (SELECT *, upper(replace(primary_id, ' ', '')) AS key FROM a),
f AS (SELECT key, min_by(primary_id, layer * 1000000 + entry_ord) AS primary_id, count(*) AS n FROM k GROUP BY key),
al AS (SELECT key, string_agg(alias, '|' ORDER BY o) AS aliases FROM (SELECT key, alias, min(layer * 1000000 + entry_ord) AS o FROM k GROUP BY key, alias) GROUP BY key),
an AS (SELECT key, layer, anno_ord AS src, row_number() OVER (PARTITION BY key ORDER BY layer, entry_ord, anno_ord) - 1 AS anno_ord FROM k)
SELECT f.primary_id, al.aliases, an.src, an.anno_ord FROM an JOIN f USING (key) JOIN al USING (key)""")
def merge_registries(spark, sf):
    r = registry(spark, sf).withColumn("src", C("anno_ord"))
    over = r.where("anno_id % 3 = 0").withColumn("layer", L(1))
    over = over.withColumn("primary_id", F.when(C("entry_ord") % 2 == 0, F.replace(F.lower("primary_id"), L("ngc"), L("ngc "))).otherwise(F.concat(L("New"), C("entry_ord").cast("string"))))
    over = over.withColumn("aliases", F.when(C("entry_ord") % 4 == 0, C("aliases")).otherwise(F.array(F.concat(L("Other "), C("entry_ord").cast("string")))))
    over = over.withColumn("entry_ord", C("entry_ord") + 100)
    m = A.merge_registries(r.withColumn("layer", L(0)).unionByName(over))
    return rounded(m.select("primary_id", F.array_join("aliases", "|").alias("aliases"), "src", "anno_ord"))


def entries(spark, sf):
    r = registry(spark, sf).groupBy("entry_ord", "primary_id").agg(F.first("aliases").alias("aliases"), F.count("*").alias("annotations"), *[F.count_if(C("status") == s).alias(s) for s in ("draft", "in_review", "approved")])
    return r


def seeds(spark, sf):
    """Supplier rows as seed targets."""
    s = table(spark, sf, "supplier")
    k = C("s_suppkey").cast("string")
    return s.select(k.alias("key"), C("s_name").alias("designation"), C("s_name").alias("name_en"), C("s_name").alias("name_zh"),
                    F.array(F.concat(L("ngc "), (C("s_suppkey") * 8).cast("string")), C("s_name")).alias("match"), L("north").alias("hemisphere"), L("Nebula").alias("kind_en"), L("星云").alias("kind_zh"),
                    F.array(L("pillar")).alias("features"), L("").alias("note_en"), L("").alias("note_zh"))


# Needle and what is asked of a target beside it.
NEEDLES = {"ngc1": "approved > 0", "0007": "annotations >= 0", "neb": "annotations > 0", "c2": "annotations > 0", "星云": "annotations > 0"}
ENT = "(SELECT entry_ord, primary_id, any_value(alias) AS alias, count(*) AS annotations, count_if(status = 'draft') AS draft, count_if(status = 'approved') AS approved FROM v_registry GROUP BY entry_ord, primary_id)"
TARGETS = f"""WITH e AS {ENT}, s AS (SELECT s.*, e.* FROM supplier s LEFT JOIN e ON e.primary_id = concat('NGC', s_suppkey * 8)),
t AS (SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS designation, TRUE AS seed, primary_id, coalesce(annotations, 0) AS annotations, coalesce(approved, 0) AS approved, concat_ws(' ', s_name, s_name, s_name, 'Nebula', '星云', coalesce(primary_id, ''), concat('ngc ', s_suppkey * 8), s_name) AS hay FROM s
 UNION ALL SELECT concat('entry:', primary_id), primary_id, FALSE, primary_id, annotations, approved, concat_ws(' ', primary_id, primary_id, primary_id, '—', '—', primary_id, primary_id, alias) FROM e WHERE primary_id NOT IN (SELECT primary_id FROM s WHERE primary_id IS NOT NULL))
"""


@query("seed_target_list", TARGETS + "SELECT key, designation, seed, primary_id, annotations, approved FROM t")
def seed_target_list(spark, sf):
    return A.seed_target_list(seeds(spark, sf), entries(spark, sf)).select("key", "designation", "seed", "primary_id", "annotations", "approved")


@query("unclaimed_entries", f"SELECT entry_ord, primary_id FROM {ENT} WHERE primary_id NOT IN (SELECT concat('NGC', s_suppkey * 8) FROM supplier)")
def unclaimed_entries(spark, sf):
    h = seeds(spark, sf).select(C("key").alias("host_id"), C("match").alias("ids"))
    hit = A.registry_match(h, entries(spark, sf), ("host_id",))
    return A.unclaimed_entries(entries(spark, sf), hit).select("entry_ord", "primary_id")


@query("search_targets", TARGETS + "SELECT key FROM t WHERE contains(lower(hay), 'ngc1') AND approved > 0")
def search_targets(spark, sf):
    return A.search_targets(A.seed_target_list(seeds(spark, sf), entries(spark, sf)), " NGC1", "approved").select("key")


@query("search_target_index", " UNION ALL ".join(f"SELECT '{n}' AS needle, key FROM ({TARGETS} SELECT key FROM t WHERE contains(lower(hay), '{n}') AND {asked})" for n, asked in NEEDLES.items()))
def search_target_index(spark, sf):
    """Stored targets, searched by needles that are rare, frequent, too short for a gram, and of another script."""
    path = f"{shared_folder(spark)}/targets-{uuid.uuid4().hex}"
    A.write_target_index(A.seed_target_list(seeds(spark, sf), entries(spark, sf)), path)
    return reduce(DataFrame.unionByName, [
        A.search_target_index(spark, path, f" {n.upper()}", "approved" if asked.startswith("approved") else "all").where(asked).select(L(n).alias("needle"), "key")
        for n, asked in NEEDLES.items()])


@query("coverage_totals", TARGETS + "SELECT count_if(annotations > 0) AS covered, count(*) AS total FROM t")
def coverage_totals(spark, sf):
    return A.coverage_totals(A.seed_target_list(seeds(spark, sf), entries(spark, sf)))


@query("finish_shape", f"""
SELECT obj_id, {s6('wra')} AS ra, {s6('wdec')} AS dec FROM ({p2w_sql('v_near')}) WHERE obj_id % 4 >= CASE obj_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END""")
def finish_shape(spark, sf):
    n = view(spark, sf, "v_near")
    kind = F.when(C("obj_id") % 3 == 0, "point").when(C("obj_id") % 3 == 1, "polyline").otherwise("polygon")
    pts = F.slice(F.array_repeat(F.struct("x", "y"), 3), 1, (C("obj_id") % 4).cast("int"))
    d = A.finish_shape(n.withColumn("geom_type", kind).withColumn("points", pts))
    return rounded(d.select("obj_id", C("vertices")[0]["ra"].alias("ra"), C("vertices")[0]["dec"].alias("dec")))


__all__ = ["catalog"]
