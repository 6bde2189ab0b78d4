"""Annotations of a reading: label, shape, radius, arrows, colour, number and draw list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmament.dims.vocab import JUNK_NAME
from firmament.functions import geo, kinds
from firmament.functions.names import catalog_id, clean_star_id
from firmament.session import pin


def display_label(common: Column, names: Column, designations: Column, ids: Column, category: Column,
                  otype: Column, type_zh: Column, type_en: Column) -> Column:
    """struct(zh, en): common name, friendly name, designation, star designation, type."""
    c_zh, c_en = F.nullif(common["zh"], F.lit("")), F.nullif(common["en"], F.lit(""))
    name = F.nullif(F.try_element_at(names, F.lit(1)), F.lit(""))
    friendly = F.when(~name.rlike(JUNK_NAME), name)
    known = F.coalesce(F.try_element_at(designations, F.lit(1)), *[catalog_id(ids, k) for k in ("messier", "ngc", "ic")])
    star = F.when(category == "star", F.nullif(clean_star_id(name), F.lit("")))
    gloss = kinds.otype_label(otype)
    is_star = category == "star"
    plain = F.coalesce(friendly, known, star)
    return F.struct(
        F.coalesce(c_zh, c_en, plain, F.when(is_star, gloss["zh"]), type_zh).alias("zh"),
        F.coalesce(c_en, c_zh, plain, F.when(is_star, gloss["en"]), type_en).alias("en"),
    )


def star_radius(side: Column) -> Column:
    return F.greatest(F.lit(20.0), geo.half_up(side / 60.0))


def bubble_radius(side: Column) -> Column:
    return F.greatest(F.lit(24.0), geo.half_up(side / 40.0))


def sample_radius(side: Column) -> Column:
    return F.greatest(star_radius(side), geo.half_up(side / 30.0))


def annotation_circle(size_major: Column, pixscale: Column, side: Column) -> Column:
    """Radius of an object: its size in pixels within bounds, else the star marker."""
    r = geo.half_up(size_major * 60.0 / pixscale / 2.0)
    sized = F.greatest(star_radius(side), F.least(side * 0.2, r))
    return F.coalesce(F.when(pixscale > 0, sized), star_radius(side))


def annotation_shape(tier: Column, feature_type: Column, source: Column, geometry_kind: Column,
                     has_polygon: Column, has_arrow: Column) -> Column:
    """The shape asked for, before missing geometry is taken into account."""
    front, cv = feature_type == "ionization_front", source == "cv"
    inferred = (
        F.when(feature_type == "comet_coma", "circle").when(feature_type == "comet_nucleus", "dot")
        .when(feature_type == "pillar", "polygon").when(front & has_polygon, "polyline")
        .when(has_arrow, "arrow").when(front & cv, "arc").when(feature_type == "bubble_shell", "shell")
        .when(cv, "shell").otherwise("arrow")
    )
    drawn = F.when(tier != "B", "circle").when(source == "ai", "shell").otherwise(inferred)
    return F.when(geometry_kind == "point", "dot").when(geometry_kind.isNotNull(), geometry_kind).otherwise(drawn)


def annotation_arc(cx: Column, cy: Column, px: Column, py: Column) -> Column:
    """Arc around the parent's centre (px, py) through the rim point."""
    rr = F.hypot(cx - px, cy - py)
    theta = F.atan2(cy - py, cx - px)
    return F.struct(px.alias("cx"), py.alias("cy"), geo.half_up(F.when(rr == 0, 1.0).otherwise(rr)).alias("r"),
                    (theta - 0.5).alias("a0"), (theta + 0.5).alias("a1"))


def annotation_arrow(cx: Column, cy: Column, tip_x: Column, tip_y: Column, width: Column, height: Column) -> Column:
    """Short arrow onto a tail from the frame's inner side: struct(x, y, to_x, to_y)."""
    dx, dy = tip_x - cx, tip_y - cy
    length = F.hypot(dx, dy)
    length = F.when(length == 0, 1.0).otherwise(length)
    ux, uy = dx / length, dy / length
    px, py = cx + ux * length * 0.45, cy + uy * length * 0.45
    side = F.when((width / 2.0 - px) * -uy + (height / 2.0 - py) * ux < 0, -1.0).otherwise(1.0)
    arm = geo.clamp(length * 0.16, 50.0, 160.0)
    return F.struct(geo.half_up(px - uy * side * arm).alias("x"), geo.half_up(py + ux * side * arm).alias("y"),
                    geo.half_up(px).alias("to_x"), geo.half_up(py).alias("to_y"))


def annotation_color(source: Column, shape: Column, feature_type: Column, category: Column) -> Column:
    return (
        F.when((source == "atlas") & feature_type.isNotNull(), kinds.feature_color(feature_type))
        .when(shape == "polyline", "shock")
        .when(feature_type.isNotNull(), kinds.feature_color(feature_type))
        .otherwise(kinds.category_color(category))
    )


def parent_links(objects: DataFrame) -> DataFrame:
    """Adds the parent's and the anchor's pixel, size and name by id within the frame; a row for each object of that id, one if there is none.

    Rows and, beside them, what others may look up of them are dealt by frame once; each reference then meets its targets by a window in place.
    Joins would shuffle the whole rows for each reference and once more for what goes by frame.
    """
    refs = (("parent_object_id", "parent"), ("anchor_ref", "anchor"))
    target = F.struct("px", "py", F.col("size_major").alias("size"), F.get("names", F.lit(0)).alias("name"))
    targets = objects.where("fid IS NOT NULL AND id IS NOT NULL").select("fid", F.col("id").alias("_id"), target.alias("_target"))
    rows = objects.unionByName(targets, allowMissingColumns=True).repartition("fid")
    for ref, prefix in refs:
        meet = Window.partitionBy("fid", F.coalesce("_id", ref)).orderBy(F.col("_id").isNull()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(f"_{prefix}", F.collect_list("_target").over(meet))
    rows = rows.where("_id IS NULL")
    first = ["fid", *[ref for ref, _ in reversed(refs)]]
    out = rows.select(*first, *[c for c in objects.columns if c not in first], *[f"_{prefix}" for _, prefix in refs])
    for _, prefix in refs:
        out = out.withColumn(f"_{prefix}", F.explode_outer(f"_{prefix}"))
    found = [[F.col(f"_{prefix}.{c}").alias(f"{prefix}_{c}") for c in ("px", "py", "size", "name")] + [F.when(F.col(f"_{prefix}").isNotNull(), True).alias(f"{prefix}_found")]
             for _, prefix in refs]
    return out.select(*[c for c in out.columns if c not in ("_parent", "_anchor")], *found[0], *found[1])


def drawn(objects: DataFrame) -> DataFrame:
    """Objects that are drawn: a comet's head is a container."""
    return objects.where(~((F.col("category") == "comet") & (F.col("tier") != "B")))


def badge_numbers(objects: DataFrame) -> DataFrame:
    """Drawn objects with their 1..n number."""
    w = Window.partitionBy("fid").orderBy("ord")
    return drawn(objects).withColumn("num", F.row_number().over(w))


def build_annotations(objects: DataFrame, frames: DataFrame) -> DataFrame:
    """Fact objects -> reading features, one row each. frames need width, height, pixscale.

    What an object's own row decides (its label) is found before rows are dealt by frame; the names, ids and types it is made of stay behind.
    """
    label = display_label(F.col("common_name"), F.col("names"), F.col("designations"), F.col("catalog_ids"), F.col("category"),
                          F.col("otype"), F.col("type_zh"), F.col("type_en"))
    objects = objects.withColumn("label", F.when(F.col("tier") == "B", F.struct(F.col("type_zh").alias("zh"), F.col("type_en").alias("en"))).otherwise(label))
    o = badge_numbers(parent_links(objects)).join(frames.select("fid", "width", "height", "pixscale"), "fid")
    side = F.least("width", "height").cast("double")
    is_b = F.col("tier") == "B"
    asked = annotation_shape(F.col("tier"), F.col("feature_type"), F.col("detection_source"), F.col("geometry_kind"),
                             F.col("polygon").isNotNull(), F.col("arrow_x").isNotNull())
    o = pin(
        o, _asked=asked, _x=F.coalesce("px", geo.half_up(F.col("width") / 2.0)), _y=F.coalesce("py", geo.half_up(F.col("height") / 2.0)),
        _star=star_radius(side), _sample=sample_radius(side), _own=annotation_circle(F.col("size_major"), F.col("pixscale"), side),
        _outline=F.coalesce(F.size("polygon"), F.lit(0)) >= 2, bubble_r=bubble_radius(side),
        _par=annotation_circle(F.col("parent_size"), F.col("pixscale"), side),
    )
    lined = F.col("_asked").isin("polygon", "polyline")
    has_parent = is_b & F.col("parent_px").isNotNull()
    shape = F.when((lined & ~F.col("_outline")) | ((F.col("_asked") == "arc") & ~has_parent), "shell").otherwise(F.col("_asked"))
    r = (
        F.when(lined | (F.col("_asked") == "arrow"), F.col("_star"))
        .when(F.col("_asked") == "dot", F.when(F.col("parent_found"), F.col("_par")).otherwise(F.col("_sample")))
        .when(F.col("_asked").isin("shell", "arc"), F.col("_sample")).otherwise(F.col("_own"))
    )
    o = pin(o, shape=shape, r=r, _top=F.when(lined & F.col("_outline"), geo.polygon_top_vertex(F.col("polygon"))),
            _tail=F.when((F.col("_asked") == "arrow") & F.col("arrow_x").isNotNull(), annotation_arrow(
                F.col("_x"), F.col("_y"), F.col("arrow_x"), F.col("arrow_y"), F.col("width"), F.col("height"))))
    dist = F.hypot(F.col("anchor_px") - F.col("_x"), F.col("anchor_py") - F.col("_y"))
    dist = F.when(dist == 0, 1.0).otherwise(dist)
    reach = F.least(dist, F.least("width", "height") * 0.15)
    to_anchor = [geo.half_up(F.col(f"_{a}") + (F.col(f"anchor_p{a}") - F.col(f"_{a}")) / dist * reach) for a in "xy"]
    is_arrow = F.col("shape") == "arrow"
    return o.select(
        "fid", "id", "ord", "num", "shape", "r", "bubble_r", "width", "height",
        "label",
        annotation_color(F.col("detection_source"), F.col("shape"), F.col("feature_type"), F.col("category")).alias("color_key"),
        F.coalesce("_top.x", "_tail.x", "_x").alias("cx"), F.coalesce("_top.y", "_tail.y", "_y").alias("cy"),
        F.when(is_arrow, F.coalesce(F.col("_tail.to_x"), to_anchor[0])).when(F.col("_asked") == "polygon", F.col("arrow_x")).alias("arrow_x"),
        F.when(is_arrow, F.coalesce(F.col("_tail.to_y"), to_anchor[1])).when(F.col("_asked") == "polygon", F.col("arrow_y")).alias("arrow_y"),
        F.when(F.col("shape") == "arc", annotation_arc(F.col("_x"), F.col("_y"), F.col("parent_px"), F.col("parent_py"))).alias("arc"),
        F.when(F.col("_outline") & lined, F.col("polygon")).alias("polygon"),
        F.when(is_b, F.col("needs_human_review")).otherwise(F.col("px").isNull()).alias("needs_human_review"),
        F.lit(True).alias("draw"), F.lit(0.0).alias("offset_x"), F.lit(0.0).alias("offset_y"),
    )


def badge_overlaps(features: DataFrame, k: float = 1.35) -> DataFrame:
    """Pairs of one reading whose badge anchors are closer than k times their radii.

    Anchors are gridded by the reading's largest possible reach, so a badge only meets
    badges of its own and the neighbouring cells.
    """
    shift = (F.col("r") + F.col("bubble_r")) * 0.7071
    a = features.select("fid", "num", "bubble_r", (F.col("cx") + shift).alias("ax"), (F.col("cy") - shift).alias("ay"))
    cell = features.groupBy("fid").agg((F.max("bubble_r") * 2.0 * k).alias("_cell"))
    a = a.join(cell, "fid").withColumn("_i", F.floor(F.col("ax") / F.col("_cell"))).withColumn("_j", F.floor(F.col("ay") / F.col("_cell")))
    near = a.withColumn("_i", F.explode(F.array(*[F.col("_i") + d for d in (-1, 0, 1)]))).withColumn(
        "_j", F.explode(F.array(*[F.col("_j") + d for d in (-1, 0, 1)])))
    b = near.select("fid", "_i", "_j", F.col("num").alias("num_b"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bubble_r").alias("rb"))
    pairs = a.join(b, ["fid", "_i", "_j"]).where(F.col("num") < F.col("num_b"))
    dist = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return pairs.withColumn("dist", dist).where(F.col("dist") < (F.col("bubble_r") + F.col("rb")) * k).select("fid", F.col("num").alias("num_a"), "num_b", "dist")


def draw_list(features: DataFrame) -> DataFrame:
    """Drawing primitives of each feature: stroke, colour, arrowhead, arc ends, badge centre."""
    f = features.where(F.coalesce("draw", F.lit(True)))
    side = F.least("width", "height").cast("double")
    stroke = F.greatest(F.lit(2.0), geo.half_up(side / 300.0))
    f = f.withColumn("stroke", stroke)
    # A shape whose geometry is missing is drawn as a plain ring.
    outlined = F.coalesce(F.size("polygon"), F.lit(0)) > 1
    ok = (
        F.when(F.col("shape") == "arrow", F.col("arrow_x").isNotNull()).when(F.col("shape") == "arc", F.col("arc").isNotNull())
        .when(F.col("shape").isin("polygon", "polyline"), outlined).otherwise(True)
    )
    f = f.withColumn("primitive", F.when(ok, F.col("shape")).otherwise("circle"))
    headed = F.col("primitive").isin("arrow", "polygon") & F.col("arrow_x").isNotNull()
    ang = F.atan2(F.col("arrow_y") - F.col("cy"), F.col("arrow_x") - F.col("cx"))
    head = F.col("stroke") * F.when(F.col("primitive") == "arrow", 6.0).otherwise(5.0)

    def barb(turn: float) -> Column:
        return F.when(headed, F.struct((F.col("arrow_x") - head * F.cos(ang + turn)).alias("x"), (F.col("arrow_y") - head * F.sin(ang + turn)).alias("y")))

    def on_arc(a: str) -> Column:
        return F.when(F.col("primitive") == "arc", F.struct(
            (F.col("arc.cx") + F.col("arc.r") * F.cos(F.col(f"arc.{a}"))).alias("x"), (F.col("arc.cy") + F.col("arc.r") * F.sin(F.col(f"arc.{a}"))).alias("y")))

    shift = (F.col("r") + F.col("bubble_r")) * 0.7071

    def badge(v: Column, size: Column) -> Column:
        hi = size - F.col("bubble_r")
        return F.when(hi < F.col("bubble_r"), size / 2.0).otherwise(F.greatest(F.col("bubble_r"), F.least(hi, v)))

    width = F.when(F.col("primitive") == "polyline", F.greatest(F.lit(1.0), geo.half_up(F.col("stroke") * 0.8))).otherwise(F.col("stroke"))
    return f.select(
        "fid", "id", "num", "primitive", kinds.palette_hex(F.col("color_key")).alias("color"), width.alias("stroke_width"), "cx", "cy",
        F.when(F.col("primitive") == "dot", F.col("stroke") * 2.5).otherwise(F.col("r")).alias("r"),
        "arrow_x", "arrow_y", barb(-0.4).alias("barb_a"), barb(0.4).alias("barb_b"), on_arc("a0").alias("arc_from"), on_arc("a1").alias("arc_to"),
        F.when(F.col("primitive") == "arc", (F.col("arc.a1") - F.col("arc.a0") > F.pi()).cast("int")).alias("large_arc"), "polygon",
        badge(F.col("cx") + shift + F.col("offset_x"), F.col("width").cast("double")).alias("badge_x"),
        badge(F.col("cy") - shift + F.col("offset_y"), F.col("height").cast("double")).alias("badge_y"), "bubble_r",
    )
