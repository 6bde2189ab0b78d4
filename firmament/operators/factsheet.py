"""Fact-sheet assembly, listings and detail lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmament.dims.vocab import ASTRO_CLASS, MECHANISM_CLASS, NEBULA_LIKE
from firmament.functions import coords, kinds, names
from firmament.functions.names import normalize_id
from firmament.operators.spatial import Cones, near_counts
from firmament.session import literal_map


def entity_enrich(selected: DataFrame, hits: DataFrame, entities: DataFrame) -> DataFrame:
    """First astronomical search hit of an object's common name: Chinese name and mechanism type.

    hits(name, hit_ord, qid). A zh name already present is kept.
    """
    astro = F.arrays_overlap("p31", F.array(*[F.lit(c) for c in (*MECHANISM_CLASS, *ASTRO_CLASS)])) | F.col("has_p59")
    mechanism = literal_map(MECHANISM_CLASS)
    good = entities.where(F.coalesce(astro, F.lit(False))).select(
        "qid", F.coalesce("label_zh", "alias_zh").alias("name_zh"),
        F.try_element_at(F.array_compact(F.transform("p31", lambda c: F.try_element_at(mechanism, c))), F.lit(1)).alias("wiki_category"))
    best = hits.join(good, "qid").groupBy("name").agg(F.min_by(F.struct("qid", "name_zh", "wiki_category"), "hit_ord").alias("_best"))
    out = selected.join(best, selected["common_name.en"] == best["name"], "left").drop("name")
    zh = F.coalesce(F.nullif("common_name.zh", F.lit("")), "_best.name_zh")
    return out.withColumn("common_name", F.when(F.col("common_name").isNotNull(), F.struct(zh.alias("zh"), F.col("common_name.en").alias("en")))).withColumn(
        "wiki_category", F.col("_best.wiki_category")).drop("_best")


def object_numbering(selected: DataFrame, comets: DataFrame | None = None) -> DataFrame:
    """objN ids in rank order; the first is primary unless the frame holds a comet."""
    out = selected.withColumn("id", F.concat(F.lit("obj"), F.col("rank").cast("string")))
    first = F.col("rank") == 1
    if comets is not None:
        out = out.join(comets.select("fid").distinct().withColumn("_comet", F.lit(True)), "fid", "left")
        first = first & F.col("_comet").isNull()
        out = out.withColumn("role", F.when(first, "primary").otherwise("secondary")).drop("_comet")
        return out
    return out.withColumn("role", F.when(first, "primary").otherwise("secondary"))


def fact_objects(selected: DataFrame, comets: DataFrame | None = None) -> DataFrame:
    """Selected candidates -> tier-A fact rows."""
    o = object_numbering(selected, comets)
    wiki = F.when(F.col("wiki_category").isNotNull(), F.struct(
        F.col("wiki_category").alias("category"), F.lit(None).cast("string").alias("zh"), F.lit(None).cast("string").alias("en"))
    ) if "wiki_category" in o.columns else F.lit(None).cast("struct<category:string,zh:string,en:string>")
    o = o.withColumn("_t", kinds.resolve_type(F.col("otype"), F.col("category"), F.col("source"), wiki))
    return o.select(
        "fid", "id", F.col("rank").alias("ord"), "role", F.lit("A").alias("tier"), F.lit(None).cast("string").alias("parent_object_id"),
        F.when(F.size("names") > 0, F.col("names")).otherwise(F.array("main_id")).alias("names"), "common_name",
        names.designations(F.col("catalog_ids"), F.col("main_id")).alias("designations"), F.col("_t.category").alias("category"),
        "otype", F.col("_t.zh").alias("type_zh"), F.col("_t.en").alias("type_en"), F.col("_t.source").alias("type_source"),
        "ra_deg", "dec_deg", "px", "py", "size_major", "size_minor", "catalog_ids",
        kinds.identity_confidence(F.col("catalog_ids"), F.col("mag")).alias("confidence"), *(["cross_match"] if "cross_match" in o.columns else []),
        F.col("_t.type_confidence").alias("type_confidence"), F.col("_t.type_needs_review").alias("type_needs_review"),
        F.lit("catalog").alias("detection_source"), F.lit(False).alias("needs_human_review"),
    )


def facts_warnings(frames: DataFrame, objects: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(fid, warnings): solve failure, empty field, and objects without baseline annotations.

    frames(fid, status, error, target_name); unmatched are objects without a registry entry.
    """
    missing = unmatched.where(F.col("category").isin(*NEBULA_LIKE)).groupBy("fid").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", F.coalesce(F.try_element_at("names", F.lit(1)), F.col("id")).alias("n")))),
        lambda x: F.concat(F.lit("The registry has no outline of "), x["n"], F.lit(" so far."))).alias("_missing"))
    some = objects.select("fid").distinct().withColumn("_some", F.lit(True))
    f = frames.join(some, "fid", "left").join(missing, "fid", "left")
    reason = F.coalesce(F.concat(F.lit(" Reason: "), F.col("error"), F.lit(".")), F.lit(""))
    target = F.nullif(F.col("target_name"), F.lit(""))
    failed = F.when(target.isNotNull(), F.concat(F.lit("Plate solve failed."), reason, F.lit(" Target name "), target, F.lit(
        " was given; names are not looked up here, so no object is claimed."))).otherwise(
        F.concat(F.lit("Plate solve failed and no target name was given."), reason, F.lit(" No object is claimed.")))
    solved = F.col("status") == "solved"
    empty = F.when(F.col("_some").isNull(), "No prominent catalogued object with an optical counterpart in the field.")
    return f.select("fid", F.when(solved, "solved").when(target.isNotNull(), "user_provided").otherwise("failed").alias("status"),
                    F.when(solved, F.concat(F.array_compact(F.array(empty)), F.coalesce("_missing", F.array().cast("array<string>"))))
                    .otherwise(F.array(failed)).alias("warnings"))


def union_objects(*parts: DataFrame) -> DataFrame:
    """Comet, catalogue and atlas rows of each frame as one object table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def collect_factsheet(frames: DataFrame, objects: DataFrame, warnings: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """One document row per frame. A fact sheet lists a frame's few selected objects."""
    cols = [c for c in objects.columns if c not in ("fid", "ord")]
    docs = objects.groupBy("fid").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "id", F.struct(*cols).alias("o"))), _by_ord), lambda x: x["o"]).alias("objects"))
    f = frames.join(docs, "fid", "left").join(warnings.select("fid", "warnings"), "fid", "left")
    known = lambda name, kind, source=None: (F.col(source or name) if (source or name) in frames.columns else F.lit(None)).cast(kind).alias(name)
    solved = F.col("status") if "status" in frames.columns else F.when(F.col("ra0").isNotNull(), "solved").otherwise("failed")
    wcs = F.struct(known("ra0_deg", "double", "ra0"), known("dec0_deg", "double", "dec0"), *[
        known(c, "double") for c in ("crpix_x", "crpix_y", "scale_deg", "orientation_deg")], known("parity", "int"), known("width", "double"), known("height", "double"))
    image = F.struct(known("src", "string"), known("width", "double"), known("height", "double"), known("hash", "string"), known("band", "string"), known("starless", "boolean"))
    solve = F.struct(
        solved.alias("status"), known("ra_deg", "double", "ra0"), known("dec_deg", "double", "dec0"), known("radius_deg", "double"),
        known("pixscale_arcsec", "double", "pixscale"), known("orientation_deg", "double"), known("solve_ms", "double"),
        known("solve_cached", "boolean", "cached"), known("solver", "string"), F.when(F.col("ra0").isNotNull(), wcs).alias("wcs"), known("frame", "string"))
    return f.select(
        "fid", F.lit("1.0").alias("version"), image.alias("image"), solve.alias("solve"),
        F.coalesce("objects", F.array().cast(docs.schema["objects"].dataType)).alias("objects"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        F.struct((F.col("queries") if "queries" in frames.columns else F.array().cast("array<string>")).alias("queries"),
                 (F.col("solver") if "solver" in frames.columns else F.lit("remote")).alias("solver"),
                 (timestamp if timestamp is not None else F.current_timestamp()).alias("timestamp")).alias("provenance"),
    )


def _by_ord(a: Column, b: Column) -> Column:
    return F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)


def suggest_identity(objects: DataFrame) -> DataFrame:
    """Per frame: the primary object's canonical id and its other names, each identity once."""
    w = Window.partitionBy("fid").orderBy(F.when(F.col("role") == "primary", 0).otherwise(1), "ord")
    main = objects.where("tier = 'A'").withColumn("_n", F.row_number().over(w)).where("_n <= 1")
    main = main.withColumn("primary_id", F.coalesce(F.try_element_at("designations", F.lit(1)), F.try_element_at("names", F.lit(1)), F.col("id")))
    pool = F.filter(F.concat(F.array("common_name.zh", "common_name.en"), "names", "designations", F.map_values("catalog_ids")),
                    lambda s: s.isNotNull() & (s != ""))
    keys = F.transform(pool, lambda s: normalize_id(s))
    # A spelling stays when its identity is new: not the primary's and not seen earlier.
    fresh = F.filter(F.transform(pool, lambda s, i: F.struct(s.alias("s"), (
        (normalize_id(s) != normalize_id(F.col("primary_id"))) & (F.array_position(F.col("_keys"), normalize_id(s)) == i + 1)).alias("ok"))), lambda x: x["ok"])
    return main.withColumn("_keys", keys).select("fid", "primary_id", F.transform(fresh, lambda x: x["s"]).alias("aliases"), "type_zh", "type_en", "otype")


def object_detail_line(lang: str = "en") -> Column:
    """otype (gloss) · id conf · type conf · coordinates · size · distance."""
    code = F.nullif(F.col("otype"), F.lit(""))
    gloss = kinds.otype_label(F.col("otype"))[lang]
    kind = F.coalesce(F.concat(code, F.lit(" ("), gloss, F.lit(")")), code)
    fixed = lambda c: F.format_string("%.2f", c)
    trust = F.concat(F.lit("type "), fixed(F.col("type_confidence")), F.when(F.col("type_source") == "wiki", " · wiki").otherwise(""))
    plain = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat_ws(
        " · ", kind, F.concat(F.lit("id "), fixed(F.col("confidence"))), trust,
        F.concat(coords.format_ra_hms(F.col("ra_deg")), F.lit(" "), coords.format_dec_dms(F.col("dec_deg"))),
        F.concat(plain(F.col("size_major")), F.lit("′")),
        F.concat(plain(F.col("distance.value")), F.lit(" "), F.col("distance.unit")),
    )


def cross_id_summary(cross: Column, own: Column, size_major: Column) -> Column:
    """struct(n, same_object, items) of an object's cross-identifications."""
    plain = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.struct(
        F.size(cross).alias("n"),
        F.forall(cross, lambda m: m["sep_arcmin"] <= F.coalesce(size_major, F.lit(5.0))).alias("same_object"),
        F.transform(cross, lambda m: F.concat(own, F.lit(" ↔ "), m["id"], F.lit(" · Δ "), plain(m["sep_arcmin"]), F.lit("′"))).alias("items"),
    )


def tier_source_groups(objects: DataFrame) -> DataFrame:
    return objects.groupBy("tier", "detection_source").agg(F.count("*").alias("n"), F.count_if("needs_human_review").alias("n_review"))


def _coverage_in_cones(cones: Cones) -> DataFrame:
    """`catalog_coverage` of frames of their own number: cones are counted home by home and their rows never formed."""
    sky = cones.catalog.select("source", "ra_deg", "dec_deg")

    def read(frames, rows, _):
        sources = pc.dictionary_encode(rows["source"], null_encoding="encode")
        group = np.cumsum(np.r_[0, np.diff(sources.indices.to_numpy()) != 0])  # rows come by source
        first = np.flatnonzero(np.r_[True, np.diff(group) != 0])
        for some, counts in near_counts(frames, rows, group, max(1, Cones.CANDIDATES // 4)):
            f, g = np.nonzero(counts)
            total = counts.sum(axis=1)
            held = np.flatnonzero(total)
            fid = frames["fid"].take(pa.array(some[np.r_[f, held]]))
            source = pa.concat_arrays([rows["source"].take(pa.array(first[g])), pa.nulls(len(held), rows["source"].type)])
            yield pa.RecordBatch.from_arrays([fid, source, pa.array(np.r_[counts[f, g], total[held]].astype(np.int64))], ["fid", "source", "n"])

    return cones.with_catalog(sky).form(read, f"fid {dict(cones.frames.dtypes)['fid']}, source {dict(sky.dtypes)['source']}, n bigint", ["source"])


def catalog_coverage(candidates: DataFrame | Cones) -> DataFrame:
    """Rows per frame and source, with the frame total (source NULL). Whole cones are counted without forming their rows."""
    if isinstance(candidates, Cones):
        own, shared = candidates.split()
        counted = _coverage_in_cones(own)
        return counted if shared is None else counted.unionByName(catalog_coverage(shared.rows()))
    return candidates.rollup("fid", "source").agg(F.count("*").alias("n")).where(F.col("fid").isNotNull())


def selection_funnel(candidates: DataFrame, gated: DataFrame, selected: DataFrame) -> DataFrame:
    """Per frame: candidates, gated and selected counts."""
    parts = [d.select("fid", *[F.lit(1 if i == j else 0).alias(c) for j, c in enumerate(("candidates", "gated", "selected"))])
             for i, d in enumerate((candidates, gated, selected))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("fid").agg(*[F.sum(c).alias(c) for c in ("candidates", "gated", "selected")])


def project_summary(readings: DataFrame, features: DataFrame, sheets: DataFrame, objects: DataFrame) -> DataFrame:
    """One listing row per reading; fact-sheet columns stay NULL where there is no sheet.

    readings(reading_id, display_language, name, type, stage); features(reading_id);
    sheets(reading_id, status); objects(reading_id, needs_human_review).
    """
    n = features.groupBy("reading_id").agg(F.count("*").alias("features"))
    review = objects.groupBy("reading_id").agg(F.count_if("needs_human_review").alias("needs_review"))
    shown = lambda c: F.when(F.col("display_language") == "en", F.col(f"{c}.en")).otherwise(F.col(f"{c}.zh"))
    out = readings.join(n, "reading_id", "left").join(sheets.select("reading_id", F.col("status").alias("solve_status")), "reading_id", "left").join(review, "reading_id", "left")
    return out.select("reading_id", shown("name").alias("name"), shown("type").alias("type"), "stage", F.coalesce("features", F.lit(0)).alias("features"),
                      "solve_status", F.when(F.col("solve_status").isNotNull(), F.coalesce("needs_review", F.lit(0))).alias("needs_review"))


def unique_slugs(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Distinct file slugs for new rows: base, base-2, base-3 ... skipping the taken ones.

    The n-th new row of a base takes the n-th free suffix. Taken suffixes of a base are
    joined as ranges, so no base is gathered into one place.
    """
    base = F.coalesce(F.nullif("base", F.lit("")), F.lit("reading"))
    rows = new.withColumn("base", base).withColumn("_n", F.row_number().over(Window.partitionBy("base").orderBy(order)))
    # Suffix number of an existing slug relative to each possible base: 1 for the base itself.
    plain = existing.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("k"))
    numbered = existing.select(F.regexp_extract("slug", r"^(.*)-([0-9]+)$", 1).alias("base"), F.regexp_extract("slug", r"^(.*)-([0-9]+)$", 2).alias("_d"))
    numbered = numbered.where((F.col("_d") != "") & ~F.col("_d").startswith("0")).select("base", F.col("_d").try_cast("long").alias("k")).where("k >= 2")
    taken = plain.union(numbered).where(F.col("k").isNotNull()).distinct()
    # With the taken numbers sorted, k - rank counts the free ones below; the n-th free number
    # is n plus the taken numbers whose count of free predecessors is below n.
    taken = taken.withColumn("_free", F.col("k") - F.row_number().over(Window.partitionBy("base").orderBy("k")))
    steps = taken.groupBy("base", "_free").agg(F.count("*").alias("_c"))
    steps = steps.select("base", F.col("_free").alias("_pos"), "_c", F.lit(None).cast("long").alias("_n"))
    marks = rows.select("base", (F.col("_n") - 1).alias("_pos"), F.lit(0).alias("_c"), "_n")
    w = Window.partitionBy("base").orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    shifted = steps.unionByName(marks).withColumn("_k", F.col("_n") + F.sum("_c").over(w)).where(F.col("_n").isNotNull())
    out = rows.join(shifted.select("base", "_n", "_k"), ["base", "_n"])
    return out.withColumn("slug", F.when(F.col("_k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("_k").cast("string")))).drop("_n", "_k")
