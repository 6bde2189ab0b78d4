"""Source normaliser queries: the text is built from catalogue columns."""

from pyspark.sql import functions as F

from firmament.dims import vocab as V
from firmament.queries.kit import case_sql, catalog, define_view, frames, query, rounded, s6, table, values_sql, view
from firmament.sources import readers as R

C = F.col
L = F.lit
TYPES = list(V.NGC_TYPE) + ["Dup", "NonEx"]


def pick(values, n):
    return F.element_at(F.array(*[L(v) for v in values]), (n % len(values) + 1).cast("int"))


@query("scan_ngc_csv", f"""
SELECT row_idx, coalesce(m, d) AS main_id, concat(coalesce(m, d), '|', d) AS names, otype, {s6('ra')} AS ra_deg, {s6('de')} AS dec_deg, {s6('maj')} AS size_major, {s6('maj_min')} AS size_minor, {s6('mag')} AS mag,
 CASE WHEN row_idx % 11 = 0 THEN 'Big Nebula' END AS common_en FROM (
 SELECT obj_id AS row_idx, CASE WHEN obj_id % 50 = 0 THEN concat('M ', obj_id % 110) END AS m,
  concat(CASE WHEN obj_id % 2 = 0 THEN 'NGC ' ELSE 'IC ' END, obj_id, CASE WHEN obj_id % 7 = 0 THEN 'A' ELSE '' END) AS d,
  {case_sql('t', V.NGC_TYPE)} AS otype, (obj_id % 24 + (obj_id % 60) / 60.0 + 1.5 / 3600.0) * 15 AS ra, (CASE WHEN obj_id % 2 = 0 THEN -1 ELSE 1 END) * (obj_id % 90 + (obj_id % 60) / 60.0 + 2.25 / 3600.0) AS de,
  CASE WHEN obj_id % 5 = 0 THEN NULL ELSE obj_id % 40 + 0.5 END AS maj, CASE WHEN obj_id % 5 = 0 THEN NULL WHEN obj_id % 3 = 0 THEN obj_id % 40 + 0.5 ELSE obj_id % 10 + 1 END AS maj_min,
  CASE WHEN obj_id % 4 = 0 THEN obj_id % 15 + 0.25 WHEN obj_id % 4 = 1 THEN obj_id % 12 END AS mag
 FROM (SELECT obj_id, CASE obj_id % {len(TYPES)} {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES))} END AS t FROM v_catalog)
 WHERE obj_id % 13 <> 0) WHERE otype IS NOT NULL""")
def scan_ngc_csv(spark, sf):
    o = C("obj_id")
    s = lambda c: c.cast("string")
    raw = view(spark, sf, "v_catalog").select(
        o.alias("row_idx"),
        F.when(o % 13 == 0, "MESSIER031").otherwise(F.concat(
            F.when(o % 2 == 0, "NGC").otherwise("IC"), F.when(o < 10000, F.lpad(s(o), 4, "0")).otherwise(s(o)),
            F.when(o % 7 == 0, "a").otherwise(""))).alias("Name"),
        pick(TYPES, o).alias("Type"),
        F.concat(s(o % 24), L(":"), s(o % 60), L(":1.5")).alias("RA"),
        F.concat(F.when(o % 2 == 0, "-").otherwise("+"), s(o % 90), L(":"), s(o % 60), L(":2.25")).alias("Dec"),
        F.when(o % 5 == 0, "").otherwise(F.concat(s(o % 40), L(".5"))).alias("MajAx"),
        F.when(o % 3 == 0, "").otherwise(s(o % 10 + 1)).alias("MinAx"),
        F.when(o % 4 == 0, F.concat(s(o % 15), L(".25"))).otherwise("").alias("V-Mag"),
        F.when(o % 4 <= 1, s(o % 12)).otherwise("").alias("B-Mag"),
        F.when(o % 50 == 0, F.lpad(s(o % 110), 3, "0")).otherwise("").alias("M"),
        F.when(o % 11 == 0, "the Big Nebula,Other Name").otherwise("").alias("Common names"),
    )
    d = R.ngc_candidates(raw)
    return rounded(d.select("row_idx", "main_id", F.array_join("names", "|").alias("names"), "otype", "ra_deg", "dec_deg", "size_major", "size_minor", "mag", C("common_name.en").alias("common_en")))


# One two-row service response per catalogue row.
def tsv(spark, sf, header="Sh2\tDiam"):
    o = C("obj_id").cast("string")
    text = F.concat(L("#comment\n#more\n_RAJ2000\t_DEJ2000\t" + header + "\ndeg\tdeg\t\tarcmin\n------\t------\t---\t---\n"),
                    F.round("ra_deg", 4).cast("string"), L("\t "), F.round("dec_deg", 4).cast("string"), L(" \t"), o, L("\t "), (C("obj_id") % 30).cast("string"), L("\r\n"),
                    L("10.5\t-20.25\t"), F.when(C("obj_id") % 2 == 0, "").otherwise(o), L("\t"), (C("obj_id") % 7).cast("string"), L("\n"))
    return view(spark, sf, "v_catalog").select(o.alias("file"), F.when(C("obj_id") % 9 == 0, "#no rows\n").otherwise(text).alias("text"))


@query("scan_asu_tsv", """
SELECT obj_id AS file, r AS row_idx, CASE WHEN r = 0 OR obj_id % 2 = 1 THEN CAST(obj_id AS VARCHAR) ELSE '' END AS sh2, CAST(CASE r WHEN 0 THEN obj_id % 30 ELSE obj_id % 7 END AS VARCHAR) AS diam
FROM v_catalog, (VALUES (0), (1)) t(r) WHERE obj_id % 9 <> 0""")
def scan_asu_tsv(spark, sf):
    d = R.asu_rows(tsv(spark, sf))
    return d.select(C("file").cast("long").alias("file"), C("row_idx").cast("long").alias("row_idx"), F.element_at("cells", "Sh2").alias("sh2"), F.element_at("cells", "Diam").alias("diam"))


def _neb_sql():
    parts = []
    for i, (k, (idc, otype, prefix, rule, cols, source)) in enumerate(R.NEBULA_CATALOGS.items()):
        a, b = f"((obj_id + {i}) % 30)", f"((obj_id + {i}) % 20)"
        if rule == "diameter":
            maj = f"nullif({a}, 0)"; mnr = maj
        elif rule == "axes":
            maj = f"nullif({a}, 0)"; mnr = f"CASE WHEN {a} > 0 THEN coalesce(nullif({b}, 0), {a}) END"
        elif rule == "radius":
            maj = f"nullif(2 * greatest({a}, {b}), 0)"; mnr = maj
        else:
            maj = f"CASE WHEN {a} > 0 THEN 2 * sqrt({a} / pi()) * 60 END"; mnr = maj
        parts.append(f"SELECT obj_id AS row_idx, '{k}' AS catalog, concat('{prefix}', obj_id) AS main_id, '{otype}' AS otype, {s6('round(ra_deg, 4)')} AS ra_deg, {s6(maj)} AS size_major, {s6(mnr)} AS size_minor FROM v_catalog WHERE obj_id % 10 <> 0")
    return " UNION ALL ".join(parts)


@query("scan_nebula_catalogs", _neb_sql())
def scan_nebula_catalogs(spark, sf):
    base = view(spark, sf, "v_catalog")
    rows = {}
    for i, (k, (idc, _, _, _, cols, _)) in enumerate(R.NEBULA_CATALOGS.items()):
        vals = [((C("obj_id") + i) % n).cast("string") for n in (30, 20)]
        cells = [L("_RAJ2000"), F.round("ra_deg", 4).cast("string"), L("_DEJ2000"), F.round("dec_deg", 4).cast("string"),
                 L(idc), F.when(C("obj_id") % 10 == 0, "").otherwise(C("obj_id").cast("string"))]
        for c, v in zip(cols, vals):
            cells += [L(c), v]
        rows[k] = base.select(C("obj_id").alias("row_idx"), F.create_map(*cells).alias("cells"))
    d = R.scan_nebula_catalogs(rows)
    return rounded(d.select("row_idx", F.map_keys("catalog_ids")[0].alias("catalog"), "main_id", "otype", "ra_deg", "size_major", "size_minor"))


@query("scan_tap_json", f"""
SELECT obj_id, row_idx, CASE row_idx WHEN 0 THEN concat('NGC  ', obj_id) ELSE 'x' END AS main_id, {s6('round(ra_deg, 4)')} AS ra_deg, {s6('CASE WHEN row_idx = 0 THEN size_major END')} AS size_major, {s6('CASE WHEN row_idx = 0 THEN mag ELSE 4.5 END')} AS mag,
 CASE row_idx WHEN 0 THEN concat('NGC ', obj_id) END AS ngc FROM v_catalog, (VALUES (0), (1)) t(row_idx) WHERE row_idx = 0 OR obj_id % 2 = 0""")
def scan_tap_json(spark, sf):
    num = lambda c: F.coalesce(F.round(c, 4).cast("string"), L("null"))
    text = F.concat(
        L('{"metadata":[{"name":"main_id"},{"name":"ra"},{"name":"dec"},{"name":"otype"},{"name":"galdim_majaxis"},{"name":"vmag"}],"data":[["NGC  '),
        C("obj_id").cast("string"), L('",'), num(C("ra_deg")), L(","), num(C("dec_deg")), L(',"HII",'), num(C("size_major")), L(","), num(C("mag")),
        L('],["x",'), F.when(C("obj_id") % 2 == 0, num(C("ra_deg"))).otherwise("null"), L(",1.5,\"G \",null,4.5]]}"))
    d = R.tap_rows(view(spark, sf, "v_catalog").select("obj_id", text.alias("text")))
    return rounded(d.select("obj_id", "row_idx", "main_id", "ra_deg", "size_major", "mag", F.try_element_at("catalog_ids", L("ngc")).alias("ngc")))


@query("scan_wcsinfo", f"""
SELECT fid, {s6('CASE WHEN fid % 6 > 0 THEN round(ra0, 4) END')} AS ra_center, {s6('CASE WHEN fid % 6 > 0 THEN orientation_deg END')} AS orientation, {s6('CASE WHEN fid % 6 > 0 THEN parity END')} AS parity, {s6('CASE WHEN fid % 6 > 0 THEN 4000 END')} AS imagew FROM v_frames""")
def scan_wcsinfo(spark, sf):
    line = lambda k, v: F.concat(L(k + " "), v.cast("string"), L("\n"))
    text = F.concat(line("ra_center", F.round("ra0", 4)), line("dec_center", F.round("dec0", 4)), line("pixscale", C("scale_deg") * 3600), L("note hello\nbare\n"),
                    line("orientation", C("orientation_deg")), line("parity", C("parity")), line("imagew", C("width")),
                    F.when(C("fid") % 6 > 0, line("imageh", C("height"))).otherwise(""))
    d = R.wcsinfo(frames(spark, sf).select("fid", text.alias("text")))
    return rounded(d.select("fid", "ra_center", "orientation", "parity", "imagew"))


@query("scan_object_page", """
SELECT doc_id, CASE WHEN doc_id % 40 > 0 THEN CAST(doc_id % 40 AS DOUBLE) END AS size_arcmin,
 CASE WHEN doc_id % 5 > 0 THEN floor((doc_id % 5) * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END * CAST(3.26156 AS DOUBLE) + 0.5) END AS distance_ly FROM documents""")
def scan_object_page(spark, sf):
    o = C("doc_id")
    # The document text follows the facts: the whole page is scanned.
    page = F.concat(L("Object\nAngular size:  "), (o % 40).cast("string"), L(" (arcmin)\nDistances: value "), (o % 5).cast("string"), L(" "), pick(["pc", "kpc", "Mpc"], o), L(" ref\n"), F.substring(F.repeat(L(" . "), 200), 1, 500), C("text"))
    return rounded(R.object_page(table(spark, sf, "documents").select("doc_id", page.alias("text"))))


@query("scan_images", "SELECT doc_id, concat('sha256:', substring(sha256(text), 1, 16)) AS hash FROM documents")
def scan_images(spark, sf):
    return R.image_files(table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))).select("doc_id", "hash")


define_view("v_entities", """
SELECT obj_id, concat('Q', CAST(obj_id AS VARCHAR(20))) AS qid,
  CASE obj_id % 6 WHEN 0 THEN 'Q207436' WHEN 1 THEN 'Q523' WHEN 2 THEN 'Q5' WHEN 3 THEN 'Q13632' ELSE 'Q42' END AS p31,
  obj_id % 7 = 0 AS has_p59 FROM v_catalog""")


def entity_dump(spark, sf):
    e = view(spark, sf, "v_entities")
    text = F.concat(
        L('{"labels":{"en":{"value":"Name '), C("obj_id").cast("string"), L('"}'),
        F.when(C("obj_id") % 2 == 0, F.concat(L(',"zh":{"value":"名 '), C("obj_id").cast("string"), L('"}'))).otherwise(""),
        L('},"aliases":{"zh":[{"value":"别 '), C("obj_id").cast("string"), L('"}]},"claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"'), C("p31"), L('"}}}}]'),
        F.when(C("has_p59"), L(',"P59":["x"]')).otherwise(""), L("}}"))
    return e.select("qid", text.alias("text"))


@query("scan_entities", """
SELECT qid, concat('Name ', obj_id) AS label_en, CASE WHEN obj_id % 2 = 0 THEN concat('名 ', obj_id) END AS label_zh, concat('别 ', obj_id) AS alias_zh, p31, has_p59 FROM v_entities""")
def scan_entities(spark, sf):
    return R.entities(entity_dump(spark, sf)).select("qid", "label_en", "label_zh", "alias_zh", F.array_join("p31", "|").alias("p31"), "has_p59")


@query("scan_factsheet", """
SELECT p_partkey, 'unknown' AS band, n, 'A' AS tier, 'catalog' AS detection_source, FALSE AS needs_human_review FROM (SELECT p_partkey, 1 + p_partkey % 2 AS n FROM part)""")
def scan_factsheet(spark, sf):
    one = F.concat(L('{"id":"obj1","role":"primary","names":["'), C("p_name"), L('"],"category":"galaxy","type":{"otype":"G","zh":"a","en":"b"},"coord":{"ra_deg":1,"dec_deg":2,"pixel":[3,4]},"confidence":0.9}'))
    text = F.concat(L('{"version":"1.0","image":{"src":"a.jpg","width":10,"height":20,"hash":"h"},"objects":['), one, F.when(C("p_partkey") % 2 == 1, F.concat(L(","), one)).otherwise(""), L("]}"))
    d = R.factsheets(table(spark, sf, "part").select("p_partkey", text.alias("text")))
    o = C("objects")[0]
    return rounded(d.select("p_partkey", "image.band", F.size("objects").cast("long").alias("n"), o["tier"].alias("tier"), o["detection_source"].alias("detection_source"), o["needs_human_review"].alias("needs_human_review")))


@query("scan_reading", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'zh' END AS zh, p_name AS en, 'zh' AS display_language, 1 AS n FROM part""")
def scan_reading(spark, sf):
    name = F.when(C("p_partkey") % 3 == 0, F.concat(L('"'), C("p_name"), L('"'))).otherwise(F.concat(L('{"zh":"zh","en":"'), C("p_name"), L('"}')))
    text = F.concat(L('{"version":"2.0","image":{"src":"a","width":1,"height":2},"object":{"name":'), name, L(',"type":{"zh":"a","en":"b"}},"narrative":{"zh":"","en":""},"features":[{"id":"f1"}]}'))
    d = R.readings(table(spark, sf, "part").select("p_partkey", text.alias("text")))
    return d.select("p_partkey", "name.zh", "name.en", "display_language", F.size("features").cast("long").alias("n"))


def registry_docs(spark, sf):
    """One registry document per part, some without annotations."""
    anno = F.concat(L('{"feature_type":"pillar","geometry":{"type":"polygon","vertices":[[10.5,20],[11,21],[12,'), (C("p_partkey") % 50).cast("string"), L(']]},"label":{"zh":"","en":"'), C("p_name"), L('"}}'))
    text = F.concat(L('{"schema_version":1,"objects":[{"primary_id":"NGC '), C("p_partkey").cast("string"), L('","aliases":["'), C("p_name"), L('"],"annotations":['), F.when(C("p_partkey") % 4 > 0, anno).otherwise(""), L("]}]}"))
    return table(spark, sf, "part").select("p_partkey", text.alias("text"))


@query("scan_registry", f"""
SELECT p_partkey, concat('NGC ', p_partkey) AS primary_id, p_name AS alias, CASE WHEN p_partkey % 4 > 0 THEN 'polygon' END AS geom_type, {s6('CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 50 END')} AS last_dec, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS label_en FROM part""")
def scan_registry(spark, sf):
    d = R.registry_rows(registry_docs(spark, sf))
    return rounded(d.select("p_partkey", "primary_id", C("aliases")[0].alias("alias"), "geom_type", F.try_element_at("vertices", L(-1))["dec"].alias("last_dec"), C("label.en").alias("label_en")))


@query("union_sources", "SELECT source, count(*) AS n, count(size_major) AS sized FROM (SELECT source, size_major FROM v_cat UNION ALL SELECT 'SIMBAD', NULL FROM v_cat WHERE mag IS NOT NULL) GROUP BY source")
def union_sources(spark, sf):
    c = catalog(spark, sf)
    other = c.where("mag IS NOT NULL").select("obj_id", L("SIMBAD").alias("source"))
    return R.union_sources(c, other).groupBy("source").agg(F.count("*").alias("n"), F.count("size_major").alias("sized"))


__all__ = ["values_sql"]
