"""The reviewed annotation atlas: matching, projection, listing, export, saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmament.functions import geo, kinds
from firmament.functions.names import annotation_name, normalize_id
from firmament.operators.textindex import search_substring, write_substring_index
from firmament.session import pin, spread


def entry_keys(registry: DataFrame) -> DataFrame:
    """(key, entry_ord): every normalised identity of an entry, once; the first entry wins."""
    ids = F.concat(F.array("primary_id"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = registry.select("entry_ord", F.explode(ids).alias("_id")).select(normalize_id(F.col("_id")).alias("key"), "entry_ord")
    return keys.groupBy("key").agg(F.min("entry_ord").alias("entry_ord"))


def registry_match(hosts: DataFrame, registry: DataFrame, on: tuple[str, ...] = ("fid", "host_id"), ids: str = "ids") -> DataFrame:
    """(on, entry_ord): the first entry, in registry order, sharing any identity with a host.

    Host identities are reduced to distinct keys per host before the join; the key table has
    one row per key, so no hot identity multiplies rows.
    """
    keys = hosts.select(*on, F.explode(ids).alias("_id")).select(*on, normalize_id(F.col("_id")).alias("key")).distinct()
    return keys.join(entry_keys(registry), "key").groupBy(*on).agg(F.min("entry_ord").alias("entry_ord"))


def unmatched_hosts(hosts: DataFrame, registry: DataFrame, on: tuple[str, ...] = ("fid", "host_id"), ids: str = "ids") -> DataFrame:
    """Hosts that no registry entry covers."""
    return hosts.join(registry_match(hosts, registry, on, ids), list(on), "left_anti")


def _unnamed(zh: Column, en: Column) -> Column:
    return (F.trim(F.coalesce(zh, F.lit(""))) == "") & (F.trim(F.coalesce(en, F.lit(""))) == "")


def unnamed_ordinals(annotations: DataFrame, part: tuple[str, ...] = ("entry_ord",), order: str = "anno_ord") -> DataFrame:
    """Adds `ordinal` to unnamed annotations of a type that has several of them.

    `n_unnamed`, when present, is the count to compare with (else the rows at hand are counted).
    """
    unnamed = _unnamed(F.col("label.zh"), F.col("label.en"))
    group = Window.partitionBy(*part, "feature_type", unnamed)
    total = F.col("n_unnamed") if "n_unnamed" in annotations.columns else F.count("*").over(group)
    n = F.row_number().over(group.orderBy(order))
    return annotations.withColumn("ordinal", F.when(unnamed & (total > 1), n))


TRIG = ("sin_dec0", "cos_dec0", "sin_th", "cos_th", "scale_rad")


def project_registry(hosts: DataFrame, registry: DataFrame, frames: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Matched entries' annotations as pixel outlines on each host's frame (tier-B rows).

    Vertices behind the tangent plane drop; an annotation wholly off the frame drops; the
    outline stays inside its row (an annotation's vertices are one drawn shape), so the
    projection needs no shuffle beyond the match.
    """
    matched = registry_match(hosts, registry) if matched is None else matched
    unnamed = _unnamed(F.col("label.zh"), F.col("label.en"))
    annos = registry.where(F.col("vertices").isNotNull()).withColumn("_u", unnamed)
    totals = annos.where("_u").groupBy("entry_ord", "feature_type").agg(F.count("*").alias("n_unnamed"))
    annos = annos.join(totals, ["entry_ord", "feature_type"], "left").drop("_u")
    rows = spread(matched.join(frames, "fid"), "fid").join(annos, "entry_ord")  # a host meets every annotation of its entry
    wcs = geo.wcs_of()
    # A frame's own trigonometry is computed once per row; the outline is then projected and judged inside its row, so nothing is
    # shuffled after the match.
    rows = geo.frame_trig(rows)
    trig = {**wcs, **{c: F.col(c) for c in TRIG}}
    points = F.transform("vertices", lambda v: geo.world_to_pixel(trig, v["ra"], v["dec"]))
    rows = pin(rows, _pts=F.filter(points, lambda p: p.isNotNull()))
    rows = rows.where(F.exists("_pts", lambda p: geo.in_image(wcs, p["px"], p["py"]))).drop("vertices", *TRIG)
    rows = rows.withColumn("polygon", F.transform("_pts", lambda p: F.struct(geo.half_up(p["px"]).alias("x"), geo.half_up(p["py"]).alias("y")))).drop("_pts")
    rows = unnamed_ordinals(rows, ("fid", "host_id"))
    rows = rows.withColumn("pipeline_type", kinds.atlas_to_pipeline_type(F.col("feature_type")))
    tax = kinds.taxonomy_label(F.col("pipeline_type"))
    rows = rows.withColumn("_c", geo.polygon_centroid(F.col("polygon")))
    rows = rows.withColumn("_w", geo.pixel_to_world(wcs, F.col("_c.x"), F.col("_c.y")))
    name = annotation_name(F.coalesce("label.zh", F.lit("")), F.coalesce("label.en", F.lit("")), tax["zh"], tax["en"], F.col("ordinal"))
    return rows.select(
        "fid", F.concat(F.lit("atlas_"), F.col("host_id").cast("string"), F.lit("_"), (F.col("anno_ord") + 1).cast("string")).alias("id"),
        F.col("host_id").alias("parent_object_id"), F.col("pipeline_type").alias("feature_type"),
        F.lit("A+").alias("feature_class"), name.alias("name"), F.col("_c.x").alias("px"), F.col("_c.y").alias("py"),
        F.col("_w.ra").alias("ra_deg"), F.col("_w.dec").alias("dec_deg"), F.col("geom_type").alias("geometry_kind"),
        F.when(F.col("geom_type") != "point", F.col("polygon")).alias("polygon"),
        F.lit(1.0).alias("confidence"), F.lit(0.9).alias("localization_confidence"),
        F.lit("atlas").alias("detection_source"), F.lit(False).alias("needs_human_review"),
    )


def reproject_check(registry: DataFrame, other_frames: DataFrame) -> DataFrame:
    """The same annotations on another frame of the target: other_frames carry entry_ord.

    Shapes keep every vertex in front of the plane, on the frame or not.
    """
    wcs = {**geo.wcs_of(), **{c: F.col(c) for c in TRIG}}
    rows = spread(geo.frame_trig(other_frames), "fid").join(registry.where(F.col("vertices").isNotNull()), "entry_ord")
    points = F.filter(F.transform("vertices", lambda v: geo.world_to_pixel(wcs, v["ra"], v["dec"])), lambda p: p.isNotNull())
    return pin(rows, points=points).where(F.size("points") > 0).select(
        "fid", "entry_ord", "anno_ord", "feature_type", F.col("geom_type").alias("geometry_kind"), "points",
        (F.col("geom_type") == "polygon").alias("closed"))


def merge_registries(layers: DataFrame) -> DataFrame:
    """One entry per normalised primary id over ordered layers (one row per annotation).

    The first spelling and place stay; aliases unite in order; annotations follow one
    another, baseline first. Aliases are de-duplicated before they are gathered.
    """
    rows = layers.withColumn("_k", normalize_id(F.col("primary_id"))).withColumn("_o", F.struct("layer", "entry_ord"))
    first = rows.groupBy("_k").agg(F.min(F.struct("_o", "primary_id")).alias("_first"))
    alias = (
        rows.select("_k", "_o", F.posexplode("aliases").alias("_p", "_a"))
        .groupBy("_k", "_a").agg(F.min(F.struct("_o", "_p")).alias("_at"))
        .groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_a"))), lambda x: x["_a"]).alias("aliases"))
    )
    annos = rows.where(F.col("anno_ord").isNotNull())
    place = Window.partitionBy("_k").orderBy("layer", "entry_ord", "anno_ord")
    annos = annos.withColumn("anno_ord", (F.row_number().over(place) - 1))
    annos = annos.drop("aliases", "primary_id", "entry_ord", "layer", "_o")
    entries = first.join(alias, "_k", "left")
    # Registry order: by first appearance. The pair itself is the ordinal; no global sort.
    entries = entries.select("_k", F.col("_first._o.layer").alias("layer"), F.col("_first._o.entry_ord").alias("entry_ord"),
                             F.col("_first.primary_id").alias("primary_id"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    return entries.join(annos, "_k", "left").drop("_k")


def status_counts(annotations: DataFrame, by: str = "primary_id") -> DataFrame:
    return annotations.groupBy(by).agg(
        F.count("anno_id").alias("annotations"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("draft", "in_review", "approved")],
    )


def export_registry(annotations: DataFrame) -> DataFrame:
    """Approved annotations only, slim, one row per entry in document shape; empty entries leave.

    An entry is one document, so its annotations form one array.
    """
    vertices = F.transform("vertices", lambda v: F.array(v["ra"].cast("double"), v["dec"].cast("double")))
    slim = F.struct("anno_ord", "feature_type", F.struct(F.col("geom_type").alias("type"), vertices.alias("vertices")).alias("geometry"), "label", "note")
    ok = annotations.where(F.col("status") == "approved")
    return ok.groupBy("entry_ord", "primary_id").agg(
        F.first("aliases").alias("aliases"),
        F.transform(F.array_sort(F.collect_list(slim), lambda a, b: (a["anno_ord"] - b["anno_ord"]).cast("int")), lambda x: x.dropFields("anno_ord")).alias("annotations"))


def registry_counts(annotations: DataFrame) -> DataFrame:
    """Objects and annotations an export holds, without building its documents."""
    per = annotations.where(F.col("status") == "approved").groupBy("primary_id").count()
    return per.agg(F.count("*").alias("objects"), F.coalesce(F.sum("count"), F.lit(0)).alias("annotations"))


def seed_target_list(seeds: DataFrame, entries: DataFrame) -> DataFrame:
    """Seed pool left-joined with real entries by any identity; unclaimed entries appended.

    entries(entry_ord, primary_id, aliases, annotations, draft, in_review, approved).
    """
    counts = ["annotations", "draft", "in_review", "approved"]
    hosts = seeds.select(F.col("key").alias("host_id"), F.col("match").alias("ids"))
    hit = registry_match(hosts, entries, ("host_id",)).withColumnRenamed("host_id", "key")
    listed = seeds.join(hit, "key", "left").join(entries.select("entry_ord", "primary_id", *counts), "entry_ord", "left")
    listed = listed.withColumn("seed", F.lit(True))
    for c in counts:
        listed = listed.withColumn(c, F.coalesce(c, F.lit(0)))
    extra = unclaimed_entries(entries, hit).select(
        F.concat(F.lit("entry:"), F.col("primary_id")).alias("key"), F.col("primary_id").alias("designation"),
        F.col("primary_id").alias("name_en"), F.col("primary_id").alias("name_zh"), F.lit("—").alias("kind_en"), F.lit("—").alias("kind_zh"),
        F.lit("Not in the target list; entered by hand.").alias("note_en"), F.lit("不在目标清单中,由人工录入。").alias("note_zh"),
        F.lit("").alias("hemisphere"), F.array().cast("array<string>").alias("features"),
        F.concat(F.array("primary_id"), F.col("aliases")).alias("match"), F.lit(False).alias("seed"), "primary_id", "entry_ord", *counts)
    return listed.unionByName(extra, allowMissingColumns=True)


def unclaimed_entries(entries: DataFrame, claimed: DataFrame) -> DataFrame:
    return entries.join(claimed.select("entry_ord").distinct(), "entry_ord", "left_anti")


def target_text() -> Column:
    """What a search looks through: names, kinds and identities of a target."""
    fields = [F.coalesce(c, F.lit("")) for c in ("designation", "name_en", "name_zh", "kind_en", "kind_zh", "primary_id")]
    return F.concat_ws(" ", *fields, F.array_join("match", " "))


def with_status(targets: DataFrame, status: str = "all") -> DataFrame:
    column = {"none": "annotations", "draft": "draft", "review": "in_review", "approved": "approved"}.get(status)
    if status == "none":
        return targets.where(F.col("annotations") == 0)
    return targets.where(F.col(column) > 0) if column else targets


def search_targets(targets: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Case-insensitive substring over the names, plus a status filter."""
    targets, needle = with_status(targets, status), text.strip().lower()
    return targets.where(F.contains(F.lower(target_text()), F.lit(needle))) if needle else targets


def write_target_index(targets: DataFrame, path: str) -> None:
    """Store the targets with a trigram index over what a search looks through."""
    write_substring_index(targets, target_text(), path)


def search_target_index(spark: SparkSession, path: str, text: str = "", status: str = "all") -> DataFrame:
    """`search_targets` over stored targets: needles of three characters or more read the postings of their rarest grams, not the table."""
    return with_status(search_substring(spark, path, text.strip()), status)


def coverage_totals(targets: DataFrame) -> DataFrame:
    return targets.agg(F.count_if(F.col("annotations") > 0).alias("covered"), F.count("*").alias("total"))


def finish_shape(drawn: DataFrame) -> DataFrame:
    """Drawn pixel shapes with enough points become sky vertices (draft annotations)."""
    wcs = geo.wcs_of()
    ok = drawn.where(F.size("points") >= geo.min_vertices(F.col("geom_type")))
    return ok.withColumn("vertices", F.transform("points", lambda p: geo.pixel_to_world(wcs, p["x"], p["y"]))).withColumn("status", F.lit("draft"))
