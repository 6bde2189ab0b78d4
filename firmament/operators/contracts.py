"""Contract checks: defaults, validation with reasons, dictionary integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.dims import vocab as V

# Defaults and enumerations of fact objects and reading features.
OBJECT_DEFAULTS = {
    "tier": "A", "type_source": "catalog", "type_needs_review": False, "detection_source": "catalog",
    "needs_human_review": False,
}
FEATURE_DEFAULTS = {
    "shape": "circle", "draw": True, "offset_x": 0.0, "offset_y": 0.0, "bubble_r": 30.0, "needs_human_review": False,
}
CONTRACTS = {"object": OBJECT_DEFAULTS, "feature": FEATURE_DEFAULTS}
ENUMS = {
    "tier": ("A", "B"),
    "role": ("primary", "secondary", "context"),
    "category": tuple(V.CATEGORY),
    "feature_class": V.FEATURE_CLASSES,
    "feature_type": tuple(V.TAXONOMY),
    "color_key": tuple(V.PALETTE),
    "shape": ("circle", "shell", "arrow", "arc", "dot", "polygon", "polyline"),
    "geometry_kind": ("polygon", "polyline", "point"),
    "detection_source": ("catalog", "geometric", "cv", "ai", "atlas"),
    "status": ("solved", "user_provided", "failed"),
    "display_language": ("zh", "en"),
}
RANGES = {"confidence": (0.0, 1.0), "type_confidence": (0.0, 1.0), "stage": (1.0, 7.0)}
LITERALS = {"factsheet": "1.0", "reading": "2.0"}


def apply_defaults(df: DataFrame, contract: str | dict) -> DataFrame:
    """Fill absent or NULL columns with the contract's defaults; arrays and maps become empty."""
    defaults = CONTRACTS[contract] if isinstance(contract, str) else contract
    have = set(df.columns)
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            df = df.withColumn(f.name, F.coalesce(f.name, F.array().cast(f.dataType)))
        elif kind == "map":
            df = df.withColumn(f.name, F.coalesce(f.name, F.create_map().cast(f.dataType)))
    return df


def violations(df: DataFrame, required: tuple[str, ...] = (), bilingual: tuple[str, ...] = (),
               version: tuple[str, str] | None = None, min_vertices: str | None = None) -> Column:
    """Array of reasons a row breaks its contract (empty when it is fine)."""
    have = set(df.columns)
    checks = []
    for c, allowed in ENUMS.items():
        if c in have:
            checks.append(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), f"{c}: not an allowed value"))
    for c, (lo, hi) in RANGES.items():
        if c in have:
            checks.append(F.when((F.col(c) < lo) | (F.col(c) > hi), f"{c}: out of range"))
    for c in required:
        checks.append(F.when(F.col(c).isNull(), f"{c}: missing"))
    for c in bilingual:
        checks.append(F.when(F.col(c).isNotNull() & (F.col(f"{c}.zh").isNull() | F.col(f"{c}.en").isNull()), f"{c}: needs both languages"))
    if version is not None:
        column, kind = version
        checks.append(F.when(~F.col(column).eqNullSafe(F.lit(LITERALS[kind])), f"{column}: unexpected version"))
    if min_vertices is not None:
        checks.append(F.when(F.coalesce(F.size(min_vertices), F.lit(0)) < 1, f"{min_vertices}: no vertices"))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def validate_rows(df: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): the quarantine keeps the row and its reasons."""
    checked = df.withColumn("reasons", violations(df, **rules))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def roundtrip_check(df: DataFrame) -> DataFrame:
    """Rows that change when written as JSON text and read back (none when lossless)."""
    packed = df.select(F.struct(*df.columns).alias("row"))
    back = packed.select(F.from_json(F.to_json("row", {"ignoreNullFields": "false"}), df.schema).alias("row"))
    return packed.select("row.*").exceptAll(back.select("row.*"))


def taxonomy_check(rows: DataFrame, column: str = "feature_type") -> DataFrame:
    """Rows whose feature type is not in the vocabulary, or lacks a valid class or colour."""
    valid = [k for k, v in V.TAXONOMY.items() if v[2] in V.FEATURE_CLASSES and v[3] in V.PALETTE]
    return rows.where(~F.coalesce(F.col(column).isin(*valid), F.lit(False)))
