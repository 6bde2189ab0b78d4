"""Edit-log, streaming-twin, model I/O and contract queries."""

import uuid

from pyspark.sql import functions as F

from firmament.dims import vocab as V
from firmament.operators import contracts as CT
from firmament.operators import edits as E
from firmament.operators import frames as FR
from firmament.operators import modelio as MI
from firmament.queries.kit import ORACLES, case_sql, define_view, frames, in_sql, query, r6, rounded, s6, table, view
from firmament.session import shared_folder
from firmament.sources import sinks as K
from firmament.streaming import jobs as J
from firmament.streaming.state import StateTable

C = F.col
L = F.lit

# Five features f0..f4 per report.
define_view("v_feats", """
SELECT report, concat('f', CAST(k AS VARCHAR(20))) AS feature_id, k, CAST(100 + k AS DOUBLE) AS cx, CAST(200 + k AS DOUBLE) AS cy, CAST(10 AS DOUBLE) AS r, k % 2 = 0 AS needs_human_review
FROM (SELECT DISTINCT user_id AS report FROM events), (VALUES (0), (1), (2), (3), (4)) AS t(k)""")


def feats(spark, sf):
    f = view(spark, sf, "v_feats")
    return f.select("report", "feature_id", "cx", "cy", "r", L(0.0).alias("offset_x"), L(0.0).alias("offset_y"), F.struct(L("z").alias("zh"), L("e").alias("en")).alias("label"),
                    F.struct(L("").alias("zh"), L("").alias("en")).alias("explanation"), L("p").alias("physics"), L("star").alias("color_key"), C("feature_id").alias("num"), "needs_human_review")


def log(spark, sf):
    g = view(spark, sf, "v_edit_log")
    return g.select("report", "seq", "ts", "action", "feature_id", C("value").alias("cx"), (C("value") * 2).alias("cy"), L(5.0).alias("r"), L(1.0).alias("offset_x"), L(2.0).alias("offset_y"),
                    F.when(C("seq") % 2 == 0, "zh").otherwise("en").alias("lang"), F.concat(L("t"), C("seq").cast("string")).alias("text"), C("value").alias("dx"), (-C("value")).alias("dy"))


@query("apply_edits", f"""
WITH l AS (SELECT *, CASE action WHEN 'addFeature' THEN 'setLabel' WHEN 'deleteFeature' THEN 'setFeatureBody' ELSE action END AS act FROM v_edit_log),
c AS (SELECT report, feature_id, max_by(value, seq) FILTER (act = 'setCircle') AS v, max_by(seq, seq) FILTER (act = 'setColor') AS col, max(seq) FILTER (act = 'setLabel' AND seq % 2 = 0) AS lz, max(seq) FILTER (act = 'setFeatureBody' AND seq % 2 = 1) AS be, max(seq) FILTER (act = 'setFeatureBody') AS b FROM l GROUP BY ALL)
SELECT f.report, f.feature_id, {s6('coalesce(v, cx)')} AS cx, {s6('CASE WHEN v IS NOT NULL THEN 5 ELSE r END')} AS r, coalesce('t' || col, 'star') AS color_key, coalesce('t' || lz, 'z') AS label_zh, coalesce('t' || be, '') AS body_en, CASE WHEN b IS NULL THEN 'p' END AS physics
FROM v_feats f LEFT JOIN c USING (report, feature_id)""")
def apply_edits(spark, sf):
    g = log(spark, sf).withColumn("action", F.when(C("action") == "addFeature", "setLabel").when(C("action") == "deleteFeature", "setFeatureBody").otherwise(C("action")))
    return rounded(E.apply_edits(feats(spark, sf), g).select("report", "feature_id", "cx", "r", "color_key", C("label.zh").alias("label_zh"), C("explanation.en").alias("body_en"), "physics"))


@query("apply_nudges", f"""
WITH p AS (SELECT report, feature_id, max(seq) AS s, max_by(value, seq) AS v FROM v_edit_log WHERE action = 'setCircle' GROUP BY ALL),
n AS (SELECT l.report, l.feature_id, sum(value) AS d FROM v_edit_log l LEFT JOIN p USING (report, feature_id) WHERE action = 'nudge' AND (p.s IS NULL OR l.seq > p.s) GROUP BY ALL)
SELECT f.report, f.feature_id, {s6('coalesce(v, cx) + coalesce(d, 0)')} AS cx, {s6('coalesce(v * 2, cy) - coalesce(d, 0)')} AS cy FROM v_feats f LEFT JOIN p USING (report, feature_id) LEFT JOIN n USING (report, feature_id)""")
def apply_nudges(spark, sf):
    return rounded(E.apply_nudges(feats(spark, sf), log(spark, sf)).select("report", "feature_id", "cx", "cy"))


@query("add_delete_features", f"""
WITH a AS (SELECT report, concat('f', 5 + row_number() OVER (PARTITION BY report ORDER BY seq)) AS feature_id, seq AS born, CAST(2000 AS DOUBLE) AS cx FROM v_edit_log WHERE action = 'addFeature'),
d AS (SELECT report, feature_id, max(seq) AS died FROM v_edit_log WHERE action = 'deleteFeature' GROUP BY ALL)
SELECT u.report, u.feature_id, {s6('u.cx')} AS cx FROM (SELECT report, feature_id, -1 AS born, cx FROM v_feats UNION ALL SELECT * FROM a) u LEFT JOIN d USING (report, feature_id) WHERE died IS NULL OR died < born""")
def add_delete_features(spark, sf):
    rep = feats(spark, sf).select("report").distinct().withColumn("width", L(4000)).withColumn("height", L(3000))
    return rounded(E.add_delete_features(feats(spark, sf), log(spark, sf), rep).select("report", "feature_id", "cx"))


@query("confirm_features", "SELECT report, feature_id, needs_human_review AND NOT EXISTS (SELECT 1 FROM v_edit_log l WHERE l.report = f.report AND l.feature_id = f.feature_id AND action = 'setColor') AS needs_human_review FROM v_feats f")
def confirm_features(spark, sf):
    g = log(spark, sf).withColumn("action", F.when(C("action") == "setColor", "confirmFeature").otherwise(C("action")))
    return E.confirm_features(feats(spark, sf), g).select("report", "feature_id", "needs_human_review")


def images(spark, sf):
    return table(spark, sf, "documents").select(C("doc_id").alias("path"), F.timestamp_seconds(C("doc_id")).alias("modificationTime"), F.encode("text", "UTF-8").alias("content"))


@query("ingest_images", "SELECT concat('sha256:', substring(sha256(text), 1, 16)) AS hash, min(doc_id) AS path FROM documents GROUP BY sha256(text)")
def ingest_images(spark, sf):
    return J.ingest_images(images(spark, sf)).select("hash", "path")


STATE = {"signup": "queued", "view": "running", "click": "running", "purchase": "done", "error": "failed"}


def job_events(spark, sf):
    st = F.create_map(*[L(x) for kv in STATE.items() for x in kv])
    return table(spark, sf, "events").select(C("user_id").alias("job"), C("event_id").alias("seq"), C("ts").cast("timestamp").alias("ts"), st[C("event_type")].alias("state"))


@query("job_status", f"""
SELECT job, CASE WHEN state = 'running' AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) > 300000000 THEN 'failed' ELSE state END AS state, seq FROM (
 SELECT user_id AS job, max_by({case_sql('event_type', STATE)}, event_id) AS state, max_by(ts, event_id) AS ts, max(event_id) AS seq FROM events GROUP BY 1)""")
def job_status(spark, sf):
    return J.job_status_batch(job_events(spark, sf))


@query("optimistic_saves", """
WITH RECURSIVE o AS (SELECT entry_key, seq, rev, row_number() OVER (PARTITION BY entry_key ORDER BY seq) AS n FROM v_saves),
f AS (SELECT entry_key, seq, rev, n, TRUE AS accepted, CAST(1 AS BIGINT) AS cur FROM o WHERE n = 1
 UNION ALL SELECT o.entry_key, o.seq, o.rev, o.n, o.rev = f.cur, f.cur + CASE WHEN o.rev = f.cur THEN 1 ELSE 0 END FROM f JOIN o ON o.entry_key = f.entry_key AND o.n = f.n + 1)
SELECT CAST(entry_key AS VARCHAR) AS entry_key, seq, accepted, cur AS new_rev FROM f""")
def optimistic_saves(spark, sf):
    return J.optimistic_saves_batch(view(spark, sf, "v_saves")).select("entry_key", "seq", "accepted", "new_rev")


@query("edit_sessions", f"""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 2000000000 THEN 0 ELSE 1 END AS fresh FROM v_edit_log WINDOW w AS (PARTITION BY report ORDER BY ts, seq)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY report ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT report, count(*) AS edits, {s6('max_by(value, seq)')} AS value, max(seq) AS seq FROM s GROUP BY report, sid""")
def edit_sessions(spark, sf):
    # The event table is sparse: sessions here close after 2000 seconds.
    return rounded(J.edit_sessions(view(spark, sf, "v_edit_log"), "2000 seconds").select("report", "edits", "value", "seq"))


@query("solve_metrics", f"""
SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS BIGINT) AS start, event_type AS solver, count(*) AS n, {s6('avg(value)')} AS avg_ms, count_if(event_id % 3 = 0) AS n_cached FROM events GROUP BY 1, 2""")
def solve_metrics(spark, sf):
    s = table(spark, sf, "events").select("ts", C("event_type").alias("solver"), C("value").alias("solve_ms"), (C("event_id") % 3 == 0).alias("cached"))
    return rounded(J.solve_metrics(s).select(F.unix_seconds("start").alias("start"), "solver", "n", "avg_ms", "n_cached"))


SOLVED = "(SELECT DISTINCT doc_id AS hash FROM v_solves WHERE status = 'solved' AND version = 2)"


def solve_tables(spark, sf):
    return table(spark, sf, "documents").select(C("doc_id").alias("hash")), view(spark, sf, "v_solves").withColumnRenamed("doc_id", "hash")


@query("solve_plan", f"SELECT hash, TRUE AS cached FROM {SOLVED} UNION ALL SELECT doc_id, FALSE FROM documents WHERE doc_id NOT IN (SELECT hash FROM {SOLVED})")
def solve_plan(spark, sf):
    todo, reused = FR.solve_plan(*solve_tables(spark, sf))
    return reused.select("hash", "cached").unionByName(todo.select("hash", L(False).alias("cached")))


@query("solve_plan_stream", f"SELECT doc_id AS hash FROM documents WHERE doc_id NOT IN (SELECT hash FROM {SOLVED})")
def solve_plan_stream(spark, sf):
    return J.solve_plan_stream(*solve_tables(spark, sf))


@query("solver_timing", f"SELECT solver, count(*) AS n, {s6('avg(solve_ms)')} AS avg_ms, {s6('quantile_disc(solve_ms, 0.5)')} AS median_ms, count_if(doc_id % 4 = 0) AS n_cached, count_if(status = 'solved') AS n_solved FROM v_solves GROUP BY 1")
def solver_timing(spark, sf):
    return rounded(FR.solver_timing(view(spark, sf, "v_solves").withColumn("cached", C("doc_id") % 4 == 0)))


STATUSES = {"signup": "draft", "view": "in_review", "click": "approved", "purchase": "approved", "error": "draft"}


@query("review_stream", f"""
WITH c AS (SELECT event_id % 100 AS anno_id, event_id AS seq, {case_sql('event_type', STATUSES)} AS status, concat('u', user_id) AS usr FROM events)
SELECT anno_id, max_by(status, seq) AS status, max_by(usr, seq) FILTER (status = 'approved') AS reviewed_by FROM c GROUP BY 1""")
def review_stream(spark, sf):
    st = F.create_map(*[L(x) for kv in STATUSES.items() for x in kv])
    c = table(spark, sf, "events").select((C("event_id") % 100).alias("anno_id"), C("event_id").alias("seq"), "ts", st[C("event_type")].alias("status"), F.concat(L("u"), C("user_id").cast("string")).alias("user"))
    return J.review_batch(c).select("anno_id", "status", "reviewed_by")


def halves(spark, d, path):
    """The rows of `d` as files that arrive in two deliveries, the later half of the keys' versions first. Yields after each delivery."""
    for half in (1, 0):
        d.where(C("event_id") % 2 == half).repartition(2).write.mode("append").parquet(path)
        yield spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("write_job_status", f"SELECT user_id AS job, max_by({case_sql('event_type', STATE)}, event_id) AS state, max(event_id) AS seq FROM events GROUP BY 1")
def write_job_status(spark, sf):
    """The stream runs, stops, is started again on new files, and its state table is read back."""
    base = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", C("ts").cast("timestamp").alias("ts"))
    st = F.create_map(*[L(x) for kv in STATE.items() for x in kv])
    for stream in halves(spark, e, f"{base}/in"):
        changes = stream.select(C("user_id").alias("job"), st[C("event_type")].alias("state"), C("event_id").alias("seq"), "ts")
        J.write_job_status(changes, f"{base}/table", f"{base}/offsets", 16).awaitTermination()
    return StateTable(spark, f"{base}/table", "job", 16).read().select("job", "state", "seq")


@query("review_table", ORACLES["review_stream"])
def review_table(spark, sf):
    """As write_job_status, for the review state."""
    base = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", C("ts").cast("timestamp").alias("ts"))
    st = F.create_map(*[L(x) for kv in STATUSES.items() for x in kv])
    for stream in halves(spark, e, f"{base}/in"):
        c = stream.select((C("event_id") % 100).alias("anno_id"), C("event_id").alias("seq"), "ts", st[C("event_type")].alias("status"), F.concat(L("u"), C("user_id").cast("string")).alias("user"))
        J.start_review(c, f"{base}/table", f"{base}/offsets", 16).awaitTermination()
    return StateTable(spark, f"{base}/table", "anno_id", 16).read().select("anno_id", "status", "reviewed_by")


# --- model input and output ----------------------------------------------------------------------


@query("extract_json", r"""SELECT conv_id, turn, concat('{"id":"c', conv_id, '","n":', turn, CASE WHEN turn % 2 = 0 THEN ',}' ELSE '}' END) AS body FROM conversations""")
def extract_json(spark, sf):
    return view(spark, sf, "v_outputs").select("conv_id", "turn", MI.extract_json(C("raw")).alias("body"))


@query("repair_json", r"""SELECT conv_id, turn, concat('{"id":"c', conv_id, '","n":', turn, '}') AS body FROM conversations""")
def repair_json(spark, sf):
    return view(spark, sf, "v_outputs").select("conv_id", "turn", MI.repair_json(F.concat(MI.extract_json(C("raw")), F.chr(L(7)))).alias("body"))


@query("parse_model_output", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'not valid JSON' WHEN turn % 3 = 1 AND conv_id % 2 = 0 THEN 'contract violated' ELSE 'ok' END AS outcome, CASE WHEN turn % 3 = 0 OR (turn % 3 = 1 AND conv_id % 2 = 1) THEN turn END AS n FROM conversations""")
def parse_model_output(spark, sf):
    bad = C("turn") % 3 == 2
    idpart = F.when((C("turn") % 3 == 1) & (C("conv_id") % 2 == 0), L("null")).otherwise(F.concat(L('"c'), C("conv_id").cast("string"), L('"')))
    raw = F.when(bad, F.concat(L("no json here: "), F.replace(F.replace(F.col("text"), L("{"), L("(")), L("}"), L(")")))).otherwise(
        F.concat(L("Sure:\n```json\n{\"id\":"), idpart, L(',"n":'), C("turn").cast("string"), L(",}\n```")))
    o = table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))
    ok, err = MI.parse_model_output(o, "id string, n bigint", lambda d: d["id"].isNotNull())
    return ok.select("conv_id", "turn", L("ok").alias("outcome"), "data.n").unionByName(err.select("conv_id", "turn", C("error").alias("outcome"), L(None).cast("long").alias("n")))


@query("build_prompts", f"""
SELECT CAST(floor(obj_id / 10.0) AS BIGINT) AS reading_id, string_agg(concat('  - id=', id, '  ', main_id, '  (', category, ')'), chr(10) ORDER BY ord) AS lines, CAST(floor(obj_id / 10.0) AS BIGINT) % 3 = 0 AS has_tone FROM v_objects GROUP BY ALL""")
def build_prompts(spark, sf):
    from firmament.queries.facts import objects
    o = objects(spark, sf)
    items = o.select(C("fid").alias("reading_id"), "ord", "id", C("main_id").alias("name"), C("category").alias("type"))
    r = o.select(C("fid").alias("reading_id")).distinct().select("reading_id", L("Title").alias("headline"), L(None).cast("string").alias("image_path"), F.when(C("reading_id") % 3 == 0, "kids ").otherwise("  ").alias("tone"))
    p = MI.build_prompts(items, r)
    lines = F.regexp_extract("prompt", r"(?s)Objects:\n(.*)\nReply with", 1)
    return p.select("reading_id", lines.alias("lines"), F.contains("prompt", L("Tone and audience:\nkids")).alias("has_tone"))


@query("write_prompts", "SELECT conv_id AS reading_id, string_agg(text, chr(10) ORDER BY turn) AS prompt FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) GROUP BY 1")
def write_prompts(spark, sf):
    """Prompts written and read back."""
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    turns = table(spark, sf, "conversations").groupBy(C("conv_id").alias("reading_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", L("")).alias("text")))).alias("t"))
    K.write_prompts(turns.select("reading_id", F.array_join(F.transform("t", lambda t: t["text"]), "\n").alias("prompt")), path)
    return spark.read.parquet(path)


@query("retry_prompts", "SELECT conv_id AS reading_id, min(turn) + 2 AS attempt FROM conversations GROUP BY 1 HAVING min(turn) + 1 < 3 AND conv_id % 2 = 0")
def retry_prompts(spark, sf):
    c = table(spark, sf, "conversations").groupBy(C("conv_id").alias("reading_id")).agg((F.min("turn") + 1).alias("attempt"))
    prompts = c.select("reading_id", L("base").alias("prompt"))
    errors = c.where("reading_id % 2 = 0").withColumn("error", L("bad"))
    return MI.retry_prompts(prompts, errors).select("reading_id", "attempt")


@query("apply_tailoring", """SELECT report AS reading_id, feature_id AS id, CASE WHEN k < 3 THEN concat('new ', report) ELSE '' END AS en FROM v_feats""")
def apply_tailoring(spark, sf):
    f = feats(spark, sf).withColumnsRenamed({"report": "reading_id", "feature_id": "id"}).withColumn("physics", L(None).cast("struct<zh:string,en:string>")).withColumn("interesting", L(None).cast("struct<zh:string,en:string>"))
    txt = F.concat(L("new "), C("reading_id").cast("string"))
    feat = lambda i: F.struct(L(f"f{i}").alias("id"), F.struct(L("x").alias("zh"), txt.alias("en")).alias("explanation"), L(None).cast("struct<zh:string,en:string>").alias("physics"), L(None).cast("struct<zh:string,en:string>").alias("interesting"))
    parsed = f.select("reading_id").distinct().select("reading_id", F.struct(F.array(feat(0), feat(1), feat(2)).alias("features")).alias("data"))
    return MI.apply_tailoring(f, parsed).select("reading_id", "id", C("explanation.en").alias("en"))


@query("style_instructions", f"""
SELECT p_partkey AS reading_id, nullif(concat_ws(chr(10), CASE WHEN p_partkey % 2 = 0 THEN '{V.PRESETS['kids'][2]}' END, CASE WHEN p_partkey % 3 = 0 THEN '{V.PRESETS['history'][2]}' END, CASE WHEN p_partkey % 5 = 0 THEN p_name END), '') AS tone FROM part""")
def style_instructions(spark, sf):
    p = table(spark, sf, "part").select(C("p_partkey").alias("reading_id"), F.array_compact(F.array(F.when(C("p_partkey") % 3 == 0, "history"), F.when(C("p_partkey") % 2 == 0, "kids"))).alias("presets"), F.when(C("p_partkey") % 5 == 0, C("p_name")).otherwise(" ").alias("free"))
    return MI.style_instructions(p, L("en"), C("free"))


@query("ai_feature_rows", """
SELECT fid, id, feature_type, en, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, arrow IS NOT NULL AS has_arrow FROM (
 SELECT fid, 'ai1' AS id, 'ionization_front' AS feature_type, 'Rim' AS en, 1750 AS px, 1250 AS py, 1 AS arrow FROM v_frames UNION ALL SELECT fid, 'ai2', 'pillar', 'Pillar', 3750, 2750, NULL FROM v_frames)""")
def ai_feature_rows(spark, sf):
    raw = 'Here: [{"type":"bright_rim","label_en":"Rim","cell":"D3","pos":[0.5,0.5],"toward_core":true},{"type":"x","cell":"H6"}] done'
    f = frames(spark, sf)
    out = f.select("fid", L(raw).alias("raw"))
    cores = f.select("fid", L("obj1").alias("core_id"), L(2000.0).alias("core_x"), L(1500.0).alias("core_y"))
    return rounded(MI.ai_feature_rows(out, f, cores).select("fid", "id", "feature_type", "en", "px", "py", C("arrow_px").isNotNull().alias("has_arrow")))


# --- contracts -------------------------------------------------------------------------------------


@query("apply_defaults", f"""
SELECT obj_id, coalesce(CASE WHEN obj_id % 3 = 0 THEN 'B' END, 'A') AS tier, 'catalog' AS detection_source, FALSE AS needs_human_review FROM v_catalog""")
def apply_defaults(spark, sf):
    d = view(spark, sf, "v_catalog").select("obj_id", F.when(C("obj_id") % 3 == 0, "B").alias("tier"))
    return CT.apply_defaults(d, "object").select("obj_id", "tier", "detection_source", "needs_human_review")


@query("validate_rows", f"""
SELECT obj_id, concat_ws('|', CASE WHEN coalesce(otype NOT IN {in_sql(V.CATEGORY)}, FALSE) AND obj_id % 2 = 0 THEN 'category: not an allowed value' END, CASE WHEN mag < 0 OR mag > 1 THEN 'confidence: out of range' END, CASE WHEN size_major IS NULL THEN 'size_major: missing' END,
 CASE WHEN obj_id % 5 = 1 THEN 'label: needs both languages' END) AS reasons FROM v_catalog""")
def validate_rows(spark, sf):
    d = view(spark, sf, "v_catalog").select("obj_id", F.when(C("obj_id") % 2 == 0, C("otype")).otherwise("star").alias("category"), C("mag").alias("confidence"), "size_major",
                                            F.struct(F.when(C("obj_id") % 5 != 1, "z").alias("zh"), L("e").alias("en")).alias("label"))
    good, bad = CT.validate_rows(d, required=("size_major",), bilingual=("label",))
    return bad.select("obj_id", F.array_join("reasons", "|").alias("reasons")).unionByName(good.select("obj_id", L("").alias("reasons")))


@query("roundtrip_check", "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber = 1")
def roundtrip_check(spark, sf):
    """Every order's first line carries a day that JSON cannot hold, so these rows, and no others, change."""
    rows = table(spark, sf, "lineitem").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), "l_quantity", "l_returnflag", F.array("l_tax", "l_discount").alias("a"),
                                               F.when(C("l_linenumber") == 1, F.to_timestamp(L("2020-01-01 00:00:00.123456"))).otherwise(F.to_timestamp(L("2020-01-01 00:00:00"))).alias("at"))
    return CT.roundtrip_check(rows).select("k", "n")


__all__ = ["r6"]
