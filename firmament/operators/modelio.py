"""Batch model input and output: prompts out, replies in. The model itself runs elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmament.dims.vocab import PRESETS
from firmament.functions import geo, kinds
from firmament.functions.names import extract_json, extract_json_array, repair_json

TAILORING = (
    "narrative struct<zh:string,en:string>, features array<struct<id:string,"
    "explanation:struct<zh:string,en:string>,physics:struct<zh:string,en:string>,interesting:struct<zh:string,en:string>>>"
)
AI_FEATURES = (
    "array<struct<type:string,label_zh:string,label_en:string,cell:string,pos:array<double>,toward_core:boolean,note:string>>"
)

INTRO = (
    "You write about astronomy for the public. The objects below were identified from the plate-solved field and its "
    "catalogues; their identity, order and position are fixed. Write bilingual (zh and en) text for each of them and do "
    "not add, drop or rename any."
)
RULES = (
    "Reply with one valid JSON object only: {\"narrative\": {zh, en}, \"features\": [{\"id\", \"explanation\": {zh, en}, "
    "optional \"physics\" and \"interesting\"}]}. Use exactly the given ids."
)


def build_prompts(features: DataFrame, readings: DataFrame) -> DataFrame:
    """One prompt per reading: headline, ordered item lines, optional image and tone blocks.

    features(reading_id, ord, id, name, type); readings(reading_id, headline, image_path, tone).
    """
    line = F.format_string("  - id=%s  %s  (%s)", "id", "name", "type")
    items = features.groupBy("reading_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    tone = F.nullif(F.trim(F.col("tone")), F.lit(""))
    return readings.join(items, "reading_id", "left").select("reading_id", F.concat_ws(
        "\n",
        F.lit(INTRO), F.lit(""),
        F.concat(F.lit("Subject: "), F.col("headline")), F.lit("Objects:"),
        F.coalesce("lines", F.lit("  (none)")),
        F.concat(F.lit("You may look at this image to enrich the wording: "), F.nullif(F.col("image_path"), F.lit(""))),
        F.lit(RULES),
        F.concat(F.lit("Tone and audience:\n"), tone),
    ).alias("prompt"))


def style_instructions(picks: DataFrame, language: Column, free: Column | None = None) -> DataFrame:
    """Chosen presets' texts joined in listed order: picks(reading_id, presets array)."""
    order = list(PRESETS)
    zh = F.create_map(*[F.lit(x) for k in order for x in (k, PRESETS[k][1])])
    en = F.create_map(*[F.lit(x) for k in order for x in (k, PRESETS[k][2])])
    chosen = F.filter(F.array(*[F.lit(k) for k in order]), lambda k: F.array_contains("presets", k))
    text = F.transform(chosen, lambda k: F.when(language == "en", F.try_element_at(en, k)).otherwise(F.try_element_at(zh, k)))
    extra = F.nullif(F.trim(free), F.lit("")) if free is not None else F.lit(None).cast("string")
    return picks.select("reading_id", F.nullif(
        F.array_join(F.array_compact(F.concat(text, F.array(extra))), "\n"), F.lit("")).alias("tone"))


def parse_model_output(outputs: DataFrame, schema: str, valid=None, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(ok, errors): parse the reply, else its repaired text, then check the contract.

    A text that is no JSON object leaves the corrupt-record column set; `valid` is a
    predicate over the parsed struct.
    """
    typed = f"{schema}, _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    text = outputs.withColumn("_text", extract_json(F.col(raw)))
    parsed = text.withColumn("_a", F.from_json("_text", typed, options)).withColumn(
        "_b", F.from_json(repair_json(F.col("_text")), typed, options))

    def clean(c: str) -> Column:
        return F.col(c).isNotNull() & F.col(f"{c}._corrupt").isNull()

    body = F.when(clean("_a"), F.col("_a")).when(clean("_b"), F.col("_b"))
    parsed = parsed.withColumn("data", body)
    good = F.lit(True) if valid is None else F.coalesce(valid(F.col("data")), F.lit(False))
    parsed = parsed.withColumn("error", F.when(F.col("data").isNull(), "not valid JSON").when(~good, "contract violated"))
    ok = parsed.where(F.col("error").isNull()).drop("_a", "_b", "_text", "error")
    return ok.withColumn("data", F.col("data").dropFields("_corrupt")), parsed.where(F.col("error").isNotNull()).drop("_a", "_b", "_text", "data")


def tailoring_contract(data: Column) -> Column:
    """Both languages everywhere and an id per feature."""
    def both(t: Column) -> Column:
        return t["zh"].isNotNull() & t["en"].isNotNull()

    return both(data["narrative"]) & data["features"].isNotNull() & F.forall(
        data["features"],
        lambda f: f["id"].isNotNull() & both(f["explanation"])
        & (f["physics"].isNull() | both(f["physics"])) & (f["interesting"].isNull() | both(f["interesting"])),
    )


def retry_prompts(prompts: DataFrame, errors: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Failed replies get their prompt again with the error, until the attempts are used up."""
    failed = errors.where(F.col("attempt") < max_attempts).select("reading_id", "attempt", "error")
    note = F.concat(F.col("prompt"), F.lit("\n\nYour last reply was not accepted: "), F.col("error"),
                    F.lit("\nReply again with corrected, strictly valid JSON and nothing else."))
    return prompts.join(failed, "reading_id").select("reading_id", (F.col("attempt") + 1).alias("attempt"), note.alias("prompt"))


def apply_tailoring(features: DataFrame, parsed: DataFrame) -> DataFrame:
    """Put parsed text onto features by (reading, id); absent text keeps the old one."""
    text = parsed.select("reading_id", F.inline("data.features")).withColumnsRenamed(
        {"explanation": "_e", "physics": "_p", "interesting": "_i"}).dropDuplicates(["reading_id", "id"])
    out = features.join(text, ["reading_id", "id"], "left")
    for new, old in (("_e", "explanation"), ("_p", "physics"), ("_i", "interesting")):
        out = out.withColumn(old, F.coalesce(new, old))
    return out.drop("_e", "_p", "_i")


def ai_feature_rows(outputs: DataFrame, frames: DataFrame, cores: DataFrame) -> DataFrame:
    """Model-suggested features as tier-B rows: outputs(fid, raw), cores(fid, core_id, core_x, core_y)."""
    parsed = outputs.select("fid", F.posexplode(F.from_json(extract_json_array(F.col("raw")), AI_FEATURES)).alias("k", "f"))
    rows = parsed.join(frames, "fid").join(cores, "fid")
    at = geo.grid_cell_decode(F.col("f.cell"), F.try_element_at("f.pos", F.lit(1)), F.try_element_at("f.pos", F.lit(2)),
                              F.col("width"), F.col("height"))
    rows = rows.withColumn("_at", at).withColumn("px", F.col("_at.px")).withColumn("py", F.col("_at.py"))
    arrow = geo.arrow_toward(F.col("px"), F.col("py"), F.col("core_x"), F.col("core_y"), F.col("width"), F.col("height"))
    rows = rows.withColumn("arrow", F.when(F.coalesce("f.toward_core", F.lit(False)), arrow))
    kind = F.when(F.col("f.type") == "bright_rim", "ionization_front").otherwise("pillar")
    rows = rows.withColumn("feature_type", kind)
    label = kinds.taxonomy_label(F.col("feature_type"))
    wcs = geo.wcs_of()
    return rows.select(
        "fid", F.concat(F.lit("ai"), (F.col("k") + 1).cast("string")).alias("id"),
        F.col("core_id").alias("parent_object_id"), "feature_type",
        F.coalesce("f.label_zh", label["zh"]).alias("zh"), F.coalesce("f.label_en", label["en"]).alias("en"),
        "px", "py", geo.pixel_to_world(wcs, F.col("px"), F.col("py")).alias("sky"),
        F.col("arrow.px").alias("arrow_px"), F.col("arrow.py").alias("arrow_py"),
        F.lit(0.6).alias("confidence"), F.lit("ai").alias("detection_source"), F.lit(True).alias("needs_human_review"),
    )
