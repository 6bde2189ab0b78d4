"""Identity, designation and free-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmament.dims.vocab import NAMED_CATALOGS, SURVEY_NAME, WIND_BUBBLES


def normalize_id(text: Column) -> Column:
    """Registry identity: every blank removed, upper case."""
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def normalize_designation(text: Column) -> Column:
    """Nickname identity: blanks collapsed, trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))


def catalog_id(ids: Column, key: str) -> Column:
    """One catalogue id; empty counts as absent."""
    return F.nullif(F.try_element_at(ids, F.lit(key)), F.lit(""))


def has_any_id(ids: Column, keys=NAMED_CATALOGS) -> Column:
    return F.coalesce(*[catalog_id(ids, k) for k in keys]).isNotNull()


def catalog_ids_from_name(name: Column) -> Column:
    """'M 42' / 'NGC 1976' / 'IC 434' -> one-entry id map, otherwise an empty map."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    messier = F.regexp_extract(n, r"(?i)^M\s*(\d+)$", 1)
    ngc = F.regexp_extract(n, r"(?i)^NGC\s*([0-9A-Z]+)$", 1)
    ic = F.regexp_extract(n, r"(?i)^IC\s*([0-9A-Z]+)$", 1)
    return F.map_filter(
        F.create_map(
            F.lit("messier"), F.concat(F.lit("M"), F.nullif(messier, F.lit(""))),
            F.lit("ngc"), F.concat(F.lit("NGC "), F.nullif(ngc, F.lit(""))),
            F.lit("ic"), F.concat(F.lit("IC "), F.nullif(ic, F.lit(""))),
        ),
        lambda _, v: v.isNotNull(),
    )


def is_survey_name(name: Column) -> Column:
    return F.trim(name).rlike(SURVEY_NAME)


def has_recognizable_name(main_id: Column, names: Column, ids: Column, curated: Column) -> Column:
    human = F.exists(
        F.concat(F.array(main_id), names), lambda n: (F.trim(n) != "") & ~is_survey_name(n)
    )
    return has_any_id(ids) | curated | F.coalesce(human, F.lit(False))


def clean_star_id(name: Column) -> Column:
    """Drop a leading '* ' and collapse blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"^\*\s+", ""), r"\s+", " "))


def designations(ids: Column, main_id: Column) -> Column:
    """Distinct catalogue ids, else the cleaned main id (empty array when blank)."""
    values = F.array_distinct(F.map_values(ids))
    fallback = F.filter(F.array(clean_star_id(main_id)), lambda d: d != "")
    return F.when(F.size(values) > 0, values).otherwise(fallback)


def designations_rest(ids: Column, label: Column) -> Column:
    return F.array_join(F.filter(ids, lambda d: (d != "") & (d != label)), " / ")


def is_wind_bubble(names: Column) -> Column:
    keys = F.array(*[F.lit(k) for k in WIND_BUBBLES])
    return F.arrays_overlap(F.transform(names, normalize_id), keys)


def is_exciting_star(otype: Column) -> Column:
    return otype.isin("WR*", "WR?")


# Accented Latin letters of each base letter.
ACCENTED = {
    "A": "ÀÁÂÃÄÅ", "C": "Ç", "E": "ÈÉÊË", "I": "ÌÍÎÏ", "N": "Ñ", "O": "ÒÓÔÕÖ", "U": "ÙÚÛÜ", "Y": "Ý",
    "a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ",
}
COMBINING = "\u0301"


def slugify(text: Column) -> Column:
    """ASCII file slug: accents split from their letter, other runs become '-', 60 characters."""
    for base, letters in ACCENTED.items():
        text = F.regexp_replace(text, f"[{letters}]", base + COMBINING)
    dashed = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 60)


def export_name(name: Column) -> Column:
    """File stem of an exported object."""
    stem = F.regexp_replace(name, r'[/\\:*?"<>|]+', "-")
    stem = F.regexp_replace(F.regexp_replace(stem, r"\s+", ""), r"^[.-]+|[.-]+$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("report"))


def escape_markup(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def paragraphs(*bodies: Column) -> Column:
    """Non-blank paragraphs of the given bodies, in order."""
    joined = F.concat_ws("\n\n", *[F.nullif(b, F.lit("")) for b in bodies])
    pieces = F.transform(F.split(joined, r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda p: p != "")


def annotation_name(zh: Column, en: Column, tax_zh: Column, tax_en: Column, ordinal: Column) -> Column:
    """struct(zh, en): own label filled from the other language, else type plus ordinal."""
    z, e = F.nullif(F.trim(zh), F.lit("")), F.nullif(F.trim(en), F.lit(""))
    suffix = F.coalesce(F.concat(F.lit(" "), ordinal.cast("string")), F.lit(""))
    return F.struct(
        F.coalesce(z, e, F.concat(tax_zh, suffix)).alias("zh"),
        F.coalesce(e, z, F.concat(tax_en, suffix)).alias("en"),
    )


def extract_json(raw: Column) -> Column:
    """The object inside a model reply: fence stripped, outermost braces kept."""
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(raw.rlike(r"(?is)```(?:json)?\s*.*?```"), fenced).otherwise(raw)
    start, end = F.instr(body, "{"), F.length(body) - F.instr(F.reverse(body), "}") + 1
    has_both = (start > 0) & (F.instr(body, "}") > 0) & (end >= start)
    text = F.when(has_both, F.substring(body, start, end - start + 1)).otherwise(body)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract_json_array(raw: Column) -> Column:
    """The outermost [...] of a model reply, '[]' when there is none."""
    start, end = F.instr(raw, "["), F.length(raw) - F.instr(F.reverse(raw), "]") + 1
    return F.when(
        (start > 0) & (F.instr(raw, "]") > 0) & (end > start), F.substring(raw, start, end - start + 1)
    ).otherwise("[]")


def repair_json(text: Column) -> Column:
    """Drop trailing commas and stray control characters."""
    no_commas = F.regexp_replace(text, r",(\s*[}\]])", "$1")
    return F.regexp_replace(no_commas, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
