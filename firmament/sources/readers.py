"""Catalogue, calibration and document readers.

Each format has a reader over paths and a normaliser over columns, so text already held
in a table is parsed by the same code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.dims import vocab as V
from firmament.functions import coords, geo
from firmament.functions.names import catalog_ids_from_name
from firmament.session import literal_map, pin

EMPTY_NAME = "struct<zh:string,en:string>"

# --- open NGC/IC table ---------------------------------------------------------------------


def _number(c: Column) -> Column:
    """A finite number, else NULL."""
    n = F.trim(c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def scan_ngc_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon table with a header line."""
    return ngc_candidates(spark.read.csv(path, sep=";", header=True, inferSchema=False))


def ngc_candidates(raw: DataFrame) -> DataFrame:
    """Rows of the open NGC/IC table as catalogue candidates; unusable rows are dropped."""
    have = set(raw.columns)

    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in have else F.lit("")

    parts = F.regexp_extract
    name_re = r"^(NGC|IC)(\d+)([A-Za-z]*)$"
    prefix, number, letter = (parts(text("Name"), name_re, i) for i in (1, 2, 3))
    display = F.concat(prefix, F.lit(" "), number.try_cast("bigint").cast("string"), F.upper(letter))
    messier = F.regexp_extract(text("M"), r"^(\d+)", 1).try_cast("int").cast("string")
    major, minor = _number(text("MajAx")), _number(text("MinAx"))
    major = F.when(major > 0, major)
    common = F.regexp_replace(F.trim(F.split(text("Common names"), ",")[0]), r"(?i)^the\s+", "")
    out = raw.select(
        F.nullif(prefix, F.lit("")).alias("_p"), display.alias("_display"),
        F.when(messier.isNotNull(), F.concat(F.lit("M "), messier)).alias("_m"),
        F.try_element_at(literal_map(V.NGC_TYPE), text("Type")).alias("otype"),
        coords.hms_to_deg(text("RA")).alias("ra_deg"), coords.dms_to_deg(text("Dec")).alias("dec_deg"),
        major.alias("size_major"), F.when(major.isNotNull(), F.coalesce(F.when(minor > 0, minor), major)).alias("size_minor"),
        F.coalesce(_number(text("V-Mag")), _number(text("B-Mag"))).alias("mag"),
        F.nullif(common, F.lit("")).alias("_common"),
        *[c for c in raw.columns if c in ("row_idx", "src_rank")],
    ).where("_p IS NOT NULL AND otype IS NOT NULL AND ra_deg IS NOT NULL AND dec_deg IS NOT NULL")
    main = F.coalesce("_m", "_display")
    return out.select(
        main.alias("main_id"), F.array(main, F.col("_display")).alias("names"), "otype", "ra_deg", "dec_deg",
        "size_major", "size_minor", "mag",
        F.map_filter(F.create_map(F.when(F.col("_p") == "IC", "ic").otherwise("ngc"), F.col("_display"), F.lit("messier"), F.col("_m")),
                     lambda _, v: v.isNotNull()).alias("catalog_ids"),
        F.lit("OpenNGC").alias("source"),
        F.when(F.col("_common").isNotNull(), F.struct(F.lit(None).cast("string").alias("zh"), F.col("_common").alias("en")))
        .cast(EMPTY_NAME).alias("common_name"),
        *[c for c in out.columns if c in ("row_idx", "src_rank")],
    )


# --- tab-separated service responses ---------------------------------------------------------


def scan_asu_tsv(spark: SparkSession, path: str) -> DataFrame:
    """One small response per file -> (file, row_idx, cells)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return asu_rows(files)


def asu_rows(responses: DataFrame) -> DataFrame:
    """(file, text) -> one row per data line with a header->cell map of trimmed strings."""
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda ln: F.regexp_replace(ln, "\r$", "")),
        lambda ln: (F.length(ln) > 0) & ~ln.startswith("#"),
    )
    body = F.filter(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0))),
                    lambda ln: ~F.regexp_replace(ln, "\t", "").rlike(r"^[\s-]*$"))
    parsed = responses.withColumn("lines", lines).where(F.size("lines") >= 3)
    parsed = parsed.withColumn("header", F.transform(F.split(F.col("lines")[0], "\t"), lambda h: F.trim(h)))
    rows = parsed.select("file", "header", F.posexplode(body).alias("row_idx", "line"))
    cells = F.split("line", "\t")
    padded = F.transform(F.col("header"), lambda _, i: F.trim(F.coalesce(F.get(cells, i), F.lit(""))))
    return rows.select("file", "row_idx", F.map_from_arrays("header", padded).alias("cells"))


# Nebula catalogues: key -> (id column, object type, name prefix, size rule, size columns, source).
NEBULA_CATALOGS = {
    "sharpless": ("Sh2", "HII", "Sh 2-", "diameter", ("Diam",), "VII/20/catalog"),
    "rcw": ("RCW", "HII", "RCW ", "axes", ("MajAxis", "MinAxis"), "VII/216/rcw"),
    "vdb": ("VdB", "RNe", "vdB ", "radius", ("BRadMax", "RRadMax"), "VII/21/catalog"),
    "cederblad": ("Ced", "RNe", "Ced ", "axes", ("Dim1", "Dim2"), "VII/231/catalog"),
    "barnard": ("Barn", "DNe", "B ", "diameter", ("Diam",), "VII/220A/barnard"),
    "ldn": ("LDN", "DNe", "LDN ", "area", ("Area",), "VII/7A/ldn"),
}


def _sizes(rule: str, v: list[Column]) -> tuple[Column, Column]:
    if rule == "diameter":
        d = F.when(v[0] > 0, v[0])
        return d, d
    if rule == "axes":
        a = F.when(v[0] > 0, v[0])
        return a, F.when(a.isNotNull(), F.coalesce(F.when(v[1] > 0, v[1]), a))
    if rule == "radius":
        m = F.greatest(*[F.coalesce(x, F.lit(0.0)) for x in v])
        d = F.when(m > 0, 2.0 * m)
        return d, d
    d = F.when(v[0] > 0, 2.0 * F.sqrt(v[0] / F.pi()) * 60.0)  # equal-area disc, square degrees
    return d, d


def nebula_catalog(rows: DataFrame, key: str) -> DataFrame:
    """One nebula catalogue's response rows as candidates; rows without id or position drop.

    A row's cells are read and turned into numbers once: filters and sizes mention them many times.
    """
    id_col, otype, prefix, rule, columns, source = NEBULA_CATALOGS[key]
    keep = [c for c in rows.columns if c != "cells"]
    cell = lambda c: F.try_element_at("cells", F.lit(c))
    texts = {"_id": cell(id_col), "_ra": cell("_RAJ2000"), "_dec": cell("_DEJ2000")} | {f"_size{i}": cell(c) for i, c in enumerate(columns)}
    read = pin(rows, **{n: F.trim(c).try_cast("double") if n != "_id" else F.nullif(c, F.lit("")) for n, c in texts.items()})
    finite = lambda n: F.when(~F.isnan(n) & (F.abs(n) != float("inf")), F.col(n))
    name = F.concat(F.lit(prefix), F.col("_id"))
    major, minor = _sizes(rule, [finite(f"_size{i}") for i in range(len(columns))])
    return read.where(F.col("_id").isNotNull() & finite("_ra").isNotNull() & finite("_dec").isNotNull()).select(
        *keep,
        name.alias("main_id"), F.array(name).alias("names"), F.lit(otype).alias("otype"),
        F.col("_ra").alias("ra_deg"), F.col("_dec").alias("dec_deg"),
        major.alias("size_major"), minor.alias("size_minor"), F.lit(None).cast("double").alias("mag"),
        F.create_map(F.lit(key), F.coalesce(name, F.lit(""))).alias("catalog_ids"), F.lit(f"VizieR:{source}").alias("source"),
        F.lit(None).cast(EMPTY_NAME).alias("common_name"),
    )


def scan_nebula_catalogs(rows_by_key: dict[str, DataFrame]) -> DataFrame:
    return union_sources(*[nebula_catalog(rows_by_key[k], k) for k in NEBULA_CATALOGS if k in rows_by_key])


def union_sources(*parts: DataFrame) -> DataFrame:
    """All catalogues by column name; a column missing from one is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_or_empty(spark: SparkSession, reader, path: str, schema: str) -> tuple[DataFrame, str | None]:
    """A source that is missing contributes no rows and a warning; one that is broken fails."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.globStatus(jpath):
        return reader(spark, path), None
    return spark.createDataFrame([], schema), f"source {path} is missing"


# --- table-access JSON -------------------------------------------------------------------------


def tap_rows(responses: DataFrame, with_mag: bool = True, text: str = "text") -> DataFrame:
    """Column-described JSON responses -> candidates; NULL cells stay NULL."""
    doc = F.from_json(text, "metadata array<struct<name:string>>, data array<array<string>>")
    keep = [c for c in responses.columns if c != text]
    rows = responses.select(*keep, doc.alias("d")).select(
        *keep, F.transform("d.metadata", lambda m: m["name"]).alias("_n"), F.posexplode("d.data").alias("row_idx", "_v"))

    def cell(name: str) -> Column:
        return F.get("_v", F.array_position("_n", name).cast("int") - 1)

    main = F.trim(F.coalesce(cell("main_id"), F.lit("")))
    major = _number(cell("galdim_majaxis"))
    return rows.select(
        *keep, "row_idx", main.alias("main_id"),
        F.when(main != "", F.array(main)).otherwise(F.array().cast("array<string>")).alias("names"),
        F.trim(F.coalesce(cell("otype"), F.lit(""))).alias("otype"),
        _number(cell("ra")).alias("ra_deg"), _number(cell("dec")).alias("dec_deg"), major.alias("size_major"),
        F.when(major.isNotNull(), F.coalesce(_number(cell("galdim_minaxis")), major)).alias("size_minor"),
        (_number(cell("vmag")) if with_mag else F.lit(None).cast("double")).alias("mag"),
        catalog_ids_from_name(main).alias("catalog_ids"), F.lit("SIMBAD").alias("source"),
        F.lit(None).cast(EMPTY_NAME).alias("common_name"),
    ).where("ra_deg IS NOT NULL AND dec_deg IS NOT NULL")


def scan_tap_json(spark: SparkSession, path: str, with_mag: bool = True) -> DataFrame:
    return tap_rows(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")), with_mag)


# --- solver output and object pages ---------------------------------------------------------

WCSINFO_KEYS = ("ra_center", "dec_center", "pixscale", "orientation", "parity", "imagew", "imageh")


def wcsinfo(texts: DataFrame, text: str = "text") -> DataFrame:
    """'key value' lines -> calibration columns; all NULL unless every needed key is there."""
    pairs = F.transform(F.split(text, "\n"), lambda ln: F.struct(
        F.regexp_extract(ln, r"^([^ ]+) ", 1).alias("k"), F.trim(F.regexp_replace(ln, r"^[^ ]+ ", "")).try_cast("double").alias("v"), ))
    good = F.filter(pairs, lambda p: (p["k"] != "") & p["v"].isNotNull())
    out = texts.withColumn("_kv", good)

    def value(key: str) -> Column:  # the last line of a key wins
        hits = F.filter("_kv", lambda p: p["k"] == key)
        return F.try_element_at(hits, F.lit(-1))["v"]

    out = out.select(*[c for c in texts.columns if c != text], *[value(k).alias(k) for k in WCSINFO_KEYS])
    whole = F.lit(True)
    for k in WCSINFO_KEYS:
        whole = whole & F.col(k).isNotNull()
    out = out.withColumn("_ok", whole)
    for k in WCSINFO_KEYS:
        out = out.withColumn(k, F.when(F.col("_ok"), F.col(k)))
    return out.drop("_ok")


def scan_wcsinfo(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return wcsinfo(files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def object_page(texts: DataFrame, text: str = "text", reach: int | None = None) -> DataFrame:
    """Plain-text object page -> size_arcmin and distance_ly.

    A distance is looked for from the first mention of the word to the page's end, or over `reach` characters if given.
    """
    size = F.regexp_extract(text, r"(?i)Angular size:\s*([\d.]+)", 1).try_cast("double")
    at = F.instr(F.lower(F.col(text)), "distance")
    window = F.when(at > 0, F.substring(F.col(text), at, F.lit(reach) if reach is not None else F.length(text)))
    pattern = r"([\d.]+)\s*(kpc|Mpc|pc)\b"
    value = F.regexp_extract(window, pattern, 1).try_cast("double")
    unit = F.regexp_extract(window, pattern, 2)
    parsecs = F.when(unit == "pc", 1.0).when(unit == "kpc", 1000.0).when(unit == "Mpc", 1_000_000.0)
    return texts.select(
        *[c for c in texts.columns if c != text], F.when(size > 0, size).alias("size_arcmin"),
        F.when(value > 0, geo.half_up(value * parsecs * 3.26156)).alias("distance_ly"),
    )


def image_files(contents: DataFrame, content: str = "content") -> DataFrame:
    """Adds the content's digest, and its short label: 'sha256:' and the first 16 hex digits."""
    return contents.withColumn("digest", F.sha2(content, 256)).withColumn("hash", F.concat(F.lit("sha256:"), F.substring("digest", 1, 16)))


def scan_images(spark: SparkSession, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(glob)
    return image_files(files).select("path", "hash", "digest", "length")


# --- encyclopaedia entities ---------------------------------------------------------------------

ENTITY = (
    "labels map<string,struct<value:string>>, aliases map<string,array<struct<value:string>>>, "
    "claims struct<P31:array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>,P59:array<string>>"
)


def entities(dump: DataFrame, text: str = "text") -> DataFrame:
    """(qid, text) -> labels by language, first Chinese alias, classes, constellation flag."""
    e = dump.withColumn("_e", F.from_json(text, ENTITY))
    classes = F.filter(F.transform("_e.claims.P31", lambda c: c["mainsnak"]["datavalue"]["value"]["id"]), lambda i: i.isNotNull())
    return e.select(
        "qid", F.try_element_at("_e.labels", F.lit("en"))["value"].alias("label_en"),
        F.try_element_at("_e.labels", F.lit("zh"))["value"].alias("label_zh"),
        F.get(F.try_element_at("_e.aliases", F.lit("zh")), F.lit(0))["value"].alias("alias_zh"),
        F.coalesce(classes, F.array().cast("array<string>")).alias("p31"),
        F.coalesce(F.size("_e.claims.P59") > 0, F.lit(False)).alias("has_p59"),
    )


def scan_entities(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines {qid, labels, aliases, claims}."""
    lines = spark.read.text(path).select(F.get_json_object("value", "$.qid").alias("qid"), F.col("value").alias("text"))
    return entities(lines)


# --- documents -------------------------------------------------------------------------------------

_L = "struct<zh:string,en:string>"
WCS = "struct<ra0_deg:double,dec0_deg:double,crpix_x:double,crpix_y:double,scale_deg:double,orientation_deg:double,parity:int,width:double,height:double>"
COORD = "struct<ra_deg:double,dec_deg:double,pixel:array<double>>"
FACT_OBJECT = (
    f"struct<id:string,role:string,tier:string,parent_object_id:string,feature_type:string,feature_class:string,names:array<string>,"
    f"common_name:{_L},designations:array<string>,category:string,type:struct<otype:string,zh:string,en:string,source:string>,"
    f"coord:{COORD},size_arcmin:array<double>,distance:struct<value:double,unit:string,source:string>,catalog_ids:map<string,string>,"
    f"confidence:double,type_confidence:double,type_needs_review:boolean,cross_match:array<struct<id:string,sep_arcmin:double>>,"
    f"localization:struct<method:string,anchor_ref:string,direction:string,confidence:double>,arrow_to:{COORD},"
    f"polygon:array<array<double>>,geometry_kind:string,detection_source:string,needs_human_review:boolean>"
)
FACTSHEET = (
    "version string, image struct<src:string,width:double,height:double,hash:string,band:string,starless:boolean>, "
    "solve struct<status:string,ra_deg:double,dec_deg:double,radius_deg:double,pixscale_arcsec:double,orientation_deg:double,"
    f"solve_ms:double,solve_cached:boolean,solver:string,wcs:{WCS},frame:string>, objects array<{FACT_OBJECT}>, warnings array<string>, "
    "provenance struct<queries:array<string>,solver:string,timestamp:string>"
)
FEATURE = (
    f"struct<id:string,fact_ref:struct<object_id:string,feature_id:string>,label:{_L},color_key:string,circle:struct<cx:double,cy:double,r:double>,"
    f"shape:string,arrow_to:array<double>,polygon:array<array<double>>,arc:struct<cx:double,cy:double,r:double,a0:double,a1:double>,draw:boolean,"
    f"badge:struct<num:string,offset_x:double,offset_y:double,bubble_r:double>,explanation:{_L},physics:{_L},interesting:{_L},needs_human_review:boolean>"
)


def factsheets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fact-sheet JSON -> typed document columns with contract defaults; a malformed document raises."""
    d = docs.withColumn("_d", F.from_json(text, FACTSHEET, {"mode": "FAILFAST"})).select(*[c for c in docs.columns if c != text], "_d.*")
    obj = F.transform("objects", lambda o: o.withField("tier", F.coalesce(o["tier"], F.lit("A")))
                      .withField("designations", F.coalesce(o["designations"], F.array().cast("array<string>")))
                      .withField("type_needs_review", F.coalesce(o["type_needs_review"], F.lit(False)))
                      .withField("detection_source", F.coalesce(o["detection_source"], F.lit("catalog")))
                      .withField("needs_human_review", F.coalesce(o["needs_human_review"], F.lit(False))))
    return d.withColumn("objects", obj).withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>"))).withColumn(
        "image", F.col("image").withField("band", F.coalesce("image.band", F.lit("unknown")))
        .withField("starless", F.coalesce("image.starless", F.lit(False))))


def _documents(spark: SparkSession, path: str, one_per_file: bool) -> DataFrame:
    docs = spark.read.text(path, wholetext=one_per_file).select(F.col("value").alias("text"))
    return docs.where(F.trim("text") != "")


def scan_factsheet(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """One document per line, as the writer puts them; with `one_per_file` a file is one document, over lines or not."""
    return factsheets(_documents(spark, path, one_per_file))


def _localized(path: str) -> Column:
    """{zh,en} object, or a legacy plain string used for both languages."""
    v = F.try_variant_get("_v", path, "string")
    plain = F.when(F.schema_of_variant(F.try_variant_get("_v", path, "variant")) == "STRING", v)
    return F.struct(F.coalesce(plain, F.try_variant_get("_v", f"{path}.zh", "string")).alias("zh"),
                    F.coalesce(plain, F.try_variant_get("_v", f"{path}.en", "string")).alias("en"))


def readings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Reading JSON -> columns; names of old documents may be plain strings. A malformed document raises."""
    d = docs.withColumn("_v", F.parse_json(text))
    get = lambda path, t: F.try_variant_get("_v", path, t)
    return d.select(
        *[c for c in docs.columns if c != text], get("$.version", "string").alias("version"),
        get("$.image.src", "string").alias("image_src"), get("$.image.width", "double").alias("width"), get("$.image.height", "double").alias("height"),
        F.coalesce(get("$.display_language", "string"), F.lit("zh")).alias("display_language"),
        _localized("$.object.name").alias("name"), _localized("$.object.type").alias("type"),
        get("$.object.stage", "double").alias("stage"), _localized("$.narrative").alias("narrative"),
        F.coalesce(F.from_json(F.get_json_object(text, "$.features"), f"array<{FEATURE}>"), F.array().cast(f"array<{FEATURE}>")).alias("features"),
    )


def scan_reading(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """One document per line, or with `one_per_file` one per file."""
    return readings(_documents(spark, path, one_per_file))


GEOMETRY = "struct<type:string,vertices:array<array<double>>,radius_arcmin:double>"
ANNOTATION = f"struct<id:string,feature_type:string,geometry:{GEOMETRY},label:{_L},note:{_L},status:string,author:string,reviewed_by:string,created_at:string,updated_at:string>"
REGISTRY = f"schema_version int, objects array<struct<entry_ord:bigint,primary_id:string,aliases:array<string>,rev:bigint,annotations:array<{ANNOTATION}>>>"


def registry_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Registry or atlas JSON -> one row per annotation with its ordinals (entries without any keep one row).

    An entry's ordinal is its own where it has one, else its place in the document.
    """
    d = docs.withColumn("_d", F.from_json(text, REGISTRY, {"mode": "FAILFAST"}))
    keep = [c for c in docs.columns if c != text]
    e = d.select(*keep, F.posexplode("_d.objects").alias("_pos", "e"))
    a = e.select(*keep, F.coalesce("e.entry_ord", "_pos").alias("entry_ord"), "e.primary_id", F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"),
                 F.coalesce("e.rev", F.lit(0)).alias("rev"), F.posexplode_outer("e.annotations").alias("anno_ord", "a"))
    return a.select(
        *keep, "entry_ord", "primary_id", "aliases", "rev", "anno_ord", F.col("a.id").alias("anno_id"), "a.feature_type",
        F.coalesce("a.status", F.lit("draft")).alias("status"), F.col("a.geometry.type").alias("geom_type"),
        F.transform("a.geometry.vertices", lambda v: F.struct(v[0].alias("ra"), v[1].alias("dec"))).alias("vertices"),
        "a.label", "a.note", "a.author", "a.reviewed_by",
    )


def scan_registry(spark: SparkSession, paths: list[str], one_per_file: bool | None = None) -> DataFrame:
    """Layered registries, baseline first; a missing path is skipped, a malformed one raises.

    A path to a folder holds a document per line, as the writer puts them; a single file is one document. `one_per_file` says otherwise.
    """
    parts = []
    for layer, path in enumerate(paths):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jpath)
        if found:
            whole = all(f.isFile() for f in found) if one_per_file is None else one_per_file
            parts.append(registry_rows(_documents(spark, path, whole).select(F.lit(layer).alias("layer"), "text")))
    if parts:
        return union_sources(*parts)
    empty = spark.createDataFrame([], "layer int, text string")
    return registry_rows(empty)


def scan_atlas(spark: SparkSession, path: str) -> DataFrame:
    """The working store; absent means empty, corrupt raises."""
    return scan_registry(spark, [path]).drop("layer")


SEED = ("key string, designation string, name_en string, name_zh string, match array<string>, hemisphere string, kind_en string, "
        "kind_zh string, features array<string>, note_en string, note_zh string")


def scan_seed_targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEED).json(path, mode="FAILFAST")


def scan_nicknames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("designation string, en string, zh string").json(path, mode="FAILFAST")
