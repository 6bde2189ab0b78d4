"""Whole identification and the document outputs."""

import uuid

from pyspark.sql import functions as F

from firmament.operators import annotate as AN
from firmament.operators import atlas as A
from firmament.operators import factsheet as FS
from firmament.plans import identify as ID
from firmament.queries.atlas import registry, seeds
from firmament.queries.facts import features, objects
from firmament.queries.kit import catalog, frames, query, r6, rounded, s6, table
from firmament.queries.sources import registry_docs
from firmament.sources import readers as R
from firmament.sources import sinks as K
from firmament.session import shared_folder

C = F.col
L = F.lit


def _catalog(spark, sf):
    return catalog(spark, sf).drop("obj_id", "famous")


@query("identify")
def identify(spark, sf):
    sheets, _ = ID.identify(frames(spark, sf), [_catalog(spark, sf)], registry(spark, sf))
    return sheets.select("fid", F.size("objects").cast("long").alias("n_objects"), F.try_element_at("objects", L(1))["names"][0].alias("primary_name"), F.size("warnings").cast("long").alias("n_warnings"))


@query("write_factsheets", """SELECT fid, min_by(id, ord) AS first_id, count(*) AS n FROM v_objects GROUP BY fid""")
def write_factsheets(spark, sf):
    o = objects(spark, sf)
    docs = o.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "tier", "names", "category"))).alias("objects")).withColumn("version", L("1.0"))
    text = K.documents(docs, "fid")
    return text.select("fid", F.get_json_object("document", "$.objects[0].id").alias("first_id"), F.size(F.from_json(F.get_json_object("document", "$.objects"), "array<struct<id:string>>")).cast("long").alias("n"))


def reading_ids(spark, sf):
    """Frames with a drawn object, as their features have them; no feature is formed for it."""
    return AN.drawn(objects(spark, sf)).where("fid IS NOT NULL").select(C("fid").alias("reading_id")).distinct()


@query("write_readings", "SELECT fid AS reading_id, count(*) AS n FROM v_objects WHERE NOT (category = 'comet' AND tier <> 'B') GROUP BY fid")
def write_readings(spark, sf):
    f = features(spark, sf).withColumnRenamed("fid", "reading_id")
    r = reading_ids(spark, sf).withColumn("version", L("2.0"))
    return K.documents(K.reading_documents(f, r), "reading_id").select("reading_id", F.size(F.from_json(F.get_json_object("document", "$.features"), "array<string>")).cast("long").alias("n"))


@query("scan_seed_targets", "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS designation, concat('ngc ', s_suppkey * 8) AS first_match FROM supplier")
def scan_seed_targets(spark, sf):
    text = seeds(spark, sf).select(F.to_json(F.struct("*")).alias("text"))
    d = text.select(F.from_json("text", R.SEED).alias("d")).select("d.*")
    return d.select("key", "designation", C("match")[0].alias("first_match"))


@query("scan_nicknames", "SELECT s_name AS designation, concat('Nick ', s_suppkey) AS en, NULL AS zh FROM supplier")
def scan_nicknames(spark, sf):
    s = table(spark, sf, "supplier")
    text = s.select(F.to_json(F.struct(C("s_name").alias("designation"), F.concat(L("Nick "), C("s_suppkey").cast("string")).alias("en"))).alias("text"))
    return text.select(F.from_json("text", "designation string, en string, zh string").alias("d")).select("d.*")


@query("nickname_table", """
SELECT obj_id, CASE WHEN k IS NOT NULL THEN concat('Nick ', k) END AS en FROM v_cat LEFT JOIN (SELECT concat('NGC ', s_suppkey * 4) AS d, s_suppkey AS k FROM supplier) n ON n.d = coalesce(ngc, main_id)""")
def nickname_table(spark, sf):
    from firmament.operators.select import nickname_overlay
    nick = table(spark, sf, "supplier").select(F.concat(L("ngc  "), (C("s_suppkey") * 4).cast("string")).alias("designation"), F.concat(L("Nick "), C("s_suppkey").cast("string")).alias("en"), L(None).cast("string").alias("zh"))
    return nickname_overlay(catalog(spark, sf), nick, key=("obj_id",)).select("obj_id", C("common_name.en").alias("en"))


@query("scan_layered_registries", f"""
SELECT layer, concat('NGC ', p_partkey) AS primary_id, {s6('CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 50 END')} AS last_dec FROM part, (VALUES (0), (1)) t(layer) WHERE layer = 0 OR p_partkey % 2 = 0""")
def scan_layered_registries(spark, sf):
    d = registry_docs(spark, sf)
    both = R.union_sources(R.registry_rows(d.withColumn("layer", L(0))), R.registry_rows(d.where("p_partkey % 2 = 0").withColumn("layer", L(1))))
    return rounded(both.select("layer", "primary_id", F.try_element_at("vertices", L(-1))["dec"].alias("last_dec")))


@query("scan_atlas", "SELECT concat('NGC ', p_partkey) AS primary_id, CASE WHEN p_partkey % 4 > 0 THEN 1 ELSE 0 END AS n, 'draft' AS status FROM part")
def scan_atlas(spark, sf):
    rows = R.registry_rows(registry_docs(spark, sf))
    return rows.groupBy("primary_id").agg(F.count("anno_ord").alias("n"), F.first("status").alias("status"))


@query("write_registry", "SELECT primary_id, count(*) AS n FROM v_registry WHERE status = 'approved' GROUP BY 1")
def write_registry(spark, sf):
    return K.documents(A.export_registry(registry(spark, sf)), "primary_id").select("primary_id", F.size(F.from_json(F.get_json_object("document", "$.annotations"), "array<struct<feature_type:string>>")).cast("long").alias("n"))


def fresh_folder(spark) -> str:
    """A new place in the shared folder; every run writes to one of its own."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


@query("factsheet_round_trip", f"""
SELECT o.fid, id, names, category, {s6('px')} AS px, {s6('py')} AS py, 'solved' AS status, {s6('f.ra0')} AS ra0, {s6('f.crpix_x')} AS crpix_x, {s6('f.width')} AS width
FROM (SELECT fid, id, main_id AS names, category, px, py FROM v_objects) o JOIN v_frames f USING (fid)""")
def factsheet_round_trip(spark, sf):
    """Sheets written to a folder and read back by path, field by field; many documents a file."""
    o = objects(spark, sf)
    fr = frames(spark, sf).withColumn("src", C("fid").cast("string"))
    w = FS.facts_warnings(fr.withColumn("status", L("solved")).withColumn("error", L(None).cast("string")).withColumn("target_name", L(None).cast("string")), o, o.where("1 = 0"))
    path = fresh_folder(spark)
    K.write_factsheets(FS.collect_factsheet(fr, o.select("fid", "ord", "id", "tier", "names", "category", "px", "py"), w), path)
    d = R.scan_factsheet(spark, path)
    rows = d.select(C("image.src").cast("long").alias("fid"), C("solve.status").alias("status"), C("solve.wcs.ra0_deg").alias("ra0"), C("solve.wcs.crpix_x").alias("crpix_x"),
                    C("image.width").cast("double").alias("width"), F.explode("objects").alias("o"))
    return rounded(rows.select("fid", C("o.id").alias("id"), C("o.names")[0].alias("names"), C("o.category").alias("category"), C("o.coord.pixel")[0].alias("px"), C("o.coord.pixel")[1].alias("py"),
                               "status", "ra0", "crpix_x", "width"))


@query("registry_round_trip", f"""
SELECT primary_id, entry_ord, feature_type, label_en, geom_type, n AS anno_ord FROM (SELECT *, row_number() OVER (PARTITION BY entry_ord, primary_id ORDER BY anno_ord) - 1 AS n FROM v_registry WHERE status = 'approved')""")
def registry_round_trip(spark, sf):
    path = fresh_folder(spark)
    K.write_registry(registry(spark, sf), path)
    d = R.scan_registry(spark, [path])
    return d.select("primary_id", "entry_ord", "feature_type", C("label.en").alias("label_en"), "geom_type", "anno_ord")


@query("write_atlas", "SELECT primary_id, entry_ord, status, count(*) AS n FROM v_registry GROUP BY ALL")
def write_atlas(spark, sf):
    """A store written, refused a broken rewrite, written again, and read back."""
    path = fresh_folder(spark)
    rows = registry(spark, sf).select("primary_id", "entry_ord", "anno_ord", "status")
    K.write_atlas(spark, rows.where("status = 'draft'"), path)
    try:
        K.write_atlas(spark, rows.limit(0).unionByName(rows), path, bad=C("status") == "approved")
    except Exception as e:  # the rewrite must fail for its own reason and leave the first version
        if "atlas row breaks its contract" not in str(e) or not K.read_atlas(spark, path).where("status <> 'draft'").isEmpty():
            raise
    K.write_atlas(spark, rows, path, bad=C("status").isNull())
    return K.read_atlas(spark, path).groupBy("primary_id", "entry_ord", "status").agg(F.count("*").alias("n"))


@query("reading_round_trip", "SELECT fid AS reading_id, count(*) AS n, count(*) AS named, count(*) AS numbered FROM v_objects WHERE NOT (category = 'comet' AND tier <> 'B') GROUP BY fid")
def reading_round_trip(spark, sf):
    f = features(spark, sf).withColumnRenamed("fid", "reading_id")
    r = reading_ids(spark, sf).withColumn("version", L("2.0")).withColumn("image", F.struct(C("reading_id").cast("string").alias("src")))
    path = fresh_folder(spark)
    K.write_readings(f, r, path)
    d = R.scan_reading(spark, path)
    return d.select(C("image_src").cast("long").alias("reading_id"), F.size("features").cast("long").alias("n"), F.size(F.filter("features", lambda x: x["id"].isNotNull())).cast("long").alias("named"),
                    F.size(F.filter("features", lambda x: x["badge"]["num"].isNotNull())).cast("long").alias("numbered"))


__all__ = ["r6"]
