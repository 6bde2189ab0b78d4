"""Object types, categories, scores and confidences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmament.dims import vocab as V
from firmament.functions.geo import half_up
from firmament.functions.names import catalog_id, has_any_id
from firmament.session import literal_map


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(mapping), key)


def is_optical(otype: Column) -> Column:
    return ~F.trim(otype).isin(*V.NON_OPTICAL)


def object_category(otype: Column) -> Column:
    t = F.trim(otype)
    return F.coalesce(_lookup(V.OTYPE_CATEGORY, t), F.when(t.contains("*"), F.lit("star")))


def feature_for_otype(otype: Column) -> Column:
    return _lookup(V.OTYPE_FEATURE, F.trim(otype))


def _gloss(code: Column, lang: int, suffix: str) -> Column:
    c = F.trim(code)
    table = {k: v[lang] for k, v in V.OTYPE_GLOSS.items()}
    base = _lookup(table, F.trim(F.regexp_replace(c, r"\?$", "")))
    return F.coalesce(_lookup(table, c), F.when(c.endswith("?"), F.concat(base, F.lit(suffix))))


def otype_label(code: Column) -> Column:
    """struct(zh, en); both NULL when the code is unknown. 'X?' is a candidate X."""
    return F.struct(
        _gloss(code, 0, "(候选)").alias("zh"), _gloss(code, 1, " (cand.)").alias("en")
    )


def category_label(category: Column) -> Column:
    return F.struct(
        _lookup({k: v[0] for k, v in V.CATEGORY.items()}, category).alias("zh"),
        _lookup({k: v[1] for k, v in V.CATEGORY.items()}, category).alias("en"),
    )


def object_type_label(otype: Column, category: Column) -> Column:
    gloss, plain = otype_label(otype), category_label(category)
    star = category == "star"
    return F.struct(
        F.coalesce(F.when(star, gloss["zh"]), plain["zh"]).alias("zh"),
        F.coalesce(F.when(star, gloss["en"]), plain["en"]).alias("en"),
    )


def taxonomy_label(feature_type: Column) -> Column:
    return F.struct(
        _lookup({k: v[0] for k, v in V.TAXONOMY.items()}, feature_type).alias("zh"),
        _lookup({k: v[1] for k, v in V.TAXONOMY.items()}, feature_type).alias("en"),
    )


def feature_color(feature_type: Column) -> Column:
    return _lookup({k: v[3] for k, v in V.TAXONOMY.items()}, feature_type)


def category_color(category: Column) -> Column:
    return _lookup({k: v[2] for k, v in V.CATEGORY.items()}, category)


def palette_hex(color_key: Column) -> Column:
    return _lookup(V.PALETTE, color_key)


def atlas_to_pipeline_type(atlas_type: Column) -> Column:
    return F.coalesce(_lookup(V.ATLAS_TYPE, atlas_type), F.lit(V.ATLAS_TYPE_DEFAULT))


def kind_of(category: Column) -> Column:
    return (
        F.when(category == "star", "star")
        .when(category.isin("globular_cluster", "open_cluster"), "cluster")
        .when(category == "galaxy", "galaxy")
        .otherwise("nebula")
    )


def significance(ids: Column, size_major: Column, common_name: Column, mag: Column) -> Column:
    """Catalogue weight + capped size + fame + brightness."""
    catalogue = (
        F.when(catalog_id(ids, "messier").isNotNull(), 1000.0)
        .when(has_any_id(ids, ("ngc", "ic")), 500.0)
        .when(has_any_id(ids), 300.0)
        .when(F.size(ids) > 0, 100.0)
        .otherwise(0.0)
    )
    size = F.coalesce(F.least(size_major, F.lit(300.0)), F.lit(0.0))
    named = F.coalesce(F.nullif(common_name["en"], F.lit("")), F.nullif(common_name["zh"], F.lit("")))
    bright = F.coalesce(F.greatest(F.lit(0.0), 6.5 - mag) * 60.0, F.lit(0.0))
    return catalogue + size + F.when(named.isNotNull(), 500.0).otherwise(0.0) + bright


def is_prominent(
    category: Column, ids: Column, size_major: Column, mag: Column, recognizable: Column,
    star_mag_max: float = 4.0, nebula_min: float = 8.0, galaxy_min: float = 3.0,
) -> Column:
    major = F.coalesce(size_major, F.lit(0.0))
    numbered = has_any_id(ids, ("messier", "ngc", "ic"))
    return (
        F.when(category == "star", F.coalesce(mag < star_mag_max, F.lit(False)))
        .when(category.isin("globular_cluster", "open_cluster"), numbered)
        .when(category == "galaxy", numbered & (major >= galaxy_min))
        .otherwise(recognizable & (major >= nebula_min))
    )


def is_visible(category: Column, curated: Column, lum: Column, background: Column) -> Column:
    """Bright structure, or a dark silhouette; unknown brightness never rejects."""
    return (
        F.when(lum.isNull() | background.isNull() | (category == "star") | curated, True)
        .when(category == "dark_nebula", lum < background * 0.92)
        .otherwise(lum > background * 1.12)
    )


def identity_confidence(ids: Column, mag: Column) -> Column:
    return (
        F.when(catalog_id(ids, "messier").isNotNull(), 0.97)
        .when(has_any_id(ids, ("ngc", "ic")), 0.9)
        .when(F.size(ids) > 0, 0.82)
        .when(mag.isNotNull(), 0.85)
        .otherwise(0.7)
    )


def resolve_type(otype: Column, category: Column, source: Column, wiki: Column) -> Column:
    """Type, category and trust; an encyclopaedia type (struct category, zh, en) wins.

    A type that comes from emission surveys alone is weak and needs review.
    """
    from_wiki = wiki.isNotNull()
    final = F.coalesce(wiki["category"], category)
    base = object_type_label(otype, final)
    weak = ~from_wiki & (category == "emission_nebula")
    return F.struct(
        F.coalesce(wiki["zh"], base["zh"]).alias("zh"),
        F.coalesce(wiki["en"], base["en"]).alias("en"),
        F.when(from_wiki, "wiki").when(source.startswith("VizieR"), "vizier").otherwise("simbad").alias("source"),
        final.alias("category"),
        F.when(weak, 0.4).otherwise(0.7).alias("type_confidence"),
        weak.alias("type_needs_review"),
    )


def prestige(ids: Column, source: Column) -> Column:
    """Authority of a designation when duplicates merge."""
    return (
        F.when(catalog_id(ids, "messier").isNotNull(), 5.0)
        .when(has_any_id(ids, ("ngc", "ic")), 4.0)
        .when(has_any_id(ids, ("sharpless",)), 3.5)
        .when(source.startswith("SIMBAD"), 3.0)
        .when(F.size(ids) > 0, 2.0)
        .otherwise(1.0)
    )


def prestige_sort(ids: Column, source: Column, famous: Column, size_major: Column, mag: Column,
                  src_rank: Column, row_idx: Column) -> Column:
    """Ascending struct key of the merge order; ends with the input order."""
    return F.struct(
        (-prestige(ids, source)).alias("k1"),
        F.when(famous, -1).otherwise(0).alias("k2"),
        (-F.coalesce(size_major, F.lit(0.0))).alias("k3"),
        F.coalesce(mag, F.lit(99.0)).alias("k4"),
        src_rank.cast("long").alias("k5"),
        row_idx.cast("long").alias("k6"),
    )


def distance_to_ly(value: Column, unit: Column) -> Column:
    factor = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in V.LY_PER.items() for x in kv]), unit
    )
    return half_up(value * factor)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b
