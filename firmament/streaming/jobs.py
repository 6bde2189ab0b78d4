"""Structured Streaming jobs with batch twins.

Every job is a transformation usable on streams and batches plus a `start_*` that wires
the sink. Sinks are idempotent per batch so that a restarted query repeats safely.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from firmament.functions.names import normalize_id
from firmament.operators.scans import running
from firmament.operators.spatial import union_all
from firmament.session import cut_lineage
from firmament.streaming.state import StateTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def _use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- image ingest: one row per content ----------------------------------------------------------


def ingest_images(files: DataFrame, watermark: str = "7 days") -> DataFrame:
    """files(path, modificationTime, content, ...) -> one row per content; late repeats drop.

    Contents are told apart by the whole digest; `hash` is its short label.
    """
    keyed = files.withColumn("digest", F.sha2("content", 256)).drop("content")
    keyed = keyed.withColumn("hash", F.concat(F.lit("sha256:"), F.substring("digest", 1, 16)))
    if keyed.isStreaming:
        return keyed.withWatermark("modificationTime", watermark).dropDuplicatesWithinWatermark(["digest"])
    return ingest_images_batch(keyed)


def ingest_images_batch(keyed: DataFrame) -> DataFrame:
    """The earliest arrival of each content, by aggregate so that a hot copy group combines map-side."""
    cols = [c for c in keyed.columns if c != "digest"]
    return keyed.groupBy("digest").agg(F.min(F.struct("modificationTime", "path", *[c for c in cols if c not in ("modificationTime", "path")])).alias("f")).select("digest", "f.*")


def start_ingest_images(files: DataFrame, path: str, checkpoint: str, watermark: str = "7 days") -> StreamingQuery:
    _use_rocksdb(files)
    return _start(ingest_images(files, watermark), path, checkpoint)


# --- job status: latest state, running jobs time out --------------------------------------------

JOB_SCHEMA = "job long, state string, seq long, us long"
TIMEOUT_S = 300


class JobTracker(StatefulProcessor):
    """Latest state of a job; a running job without a result fails after the timeout (event time).

    Event times travel as microseconds since the epoch, so the session's time zone has no say.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "seq long, state string, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq").iloc[-1]
        old = self.latest.get() if self.latest.exists() else None
        if old is None or new.seq > old[0]:
            self.latest.update((int(new.seq), new.state, int(new.us)))
            if new.state == "running":
                self.handle.registerTimer(int(new.us) // 1000 + TIMEOUT_S * 1000)
            yield pd.DataFrame({"job": [key[0]], "state": [new.state], "seq": [int(new.seq)], "us": [int(new.us)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists():
            seq, state, us = self.latest.get()
            if state == "running" and us // 1000 + TIMEOUT_S * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                self.latest.update((seq, "failed", us))
                yield pd.DataFrame({"job": [key[0]], "state": ["failed"], "seq": [seq], "us": [us]})

    def close(self) -> None:
        pass


def job_status(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """events(job, seq, ts, state) as a stream -> status changes."""
    _use_rocksdb(events)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    changes = timed.withColumn("us", F.unix_micros("ts")).groupBy("job").transformWithStateInPandas(
        statefulProcessor=JobTracker(), outputStructType=JOB_SCHEMA, outputMode="Append", timeMode="EventTime")
    return changes.select("job", "state", "seq", F.timestamp_micros("us").alias("ts"))


def job_status_batch(events: DataFrame) -> DataFrame:
    """Final state per job; running jobs older than the timeout at the end of the data have failed."""
    last = events.groupBy("job").agg(F.max_by(F.struct("state", "ts", "seq"), "seq").alias("l"))
    end = events.agg(F.max(F.col("ts").cast("timestamp")).alias("end")).scalar()
    late = (F.col("l.state") == "running") & (F.unix_micros(end) - F.unix_micros(F.col("l.ts").cast("timestamp")) > TIMEOUT_S * 1_000_000)
    return last.select("job", F.when(late, "failed").otherwise(F.col("l.state")).alias("state"), "l.seq")


def start_job_status(events: DataFrame, path: str, checkpoint: str, watermark: str = "10 minutes") -> StreamingQuery:
    return _start(job_status(events, watermark), path, checkpoint)


def latest_status(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The last status of each job; of equal sequence numbers a final one counts."""
    rows = batch.select("job", "state", "seq", "ts")
    rows = rows if old is None else rows.unionByName(old.select("job", "state", "seq", "ts"))
    final = F.when(F.col("state") == "running", 0).otherwise(1)
    return rows.groupBy("job").agg(F.max(F.struct("seq", final.alias("o"), "state", "ts")).alias("s")).select("job", "s.state", "s.seq", "s.ts")


def write_job_status(changes: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Latest status per job in a state table; read it with `StateTable(spark, path, "job").read()`."""
    def upsert(batch: DataFrame, epoch: int) -> None:
        StateTable(batch.sparkSession, path, "job", buckets).apply(batch, epoch, latest_status)

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- optimistic saves -----------------------------------------------------------------------------

SAVE_SCHEMA = "entry_key string, seq long, rev long, accepted boolean, new_rev long"


class RevisionGuard(StatefulProcessor):
    """Accept a save only when it names the current revision; the first save always is accepted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rev = handle.getValueState("rev", "rev long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        current = self.rev.get()[0] if self.rev.exists() else None
        out = []
        for seq, rev in pd.concat(list(rows)).sort_values("seq")[["seq", "rev"]].itertuples(index=False):
            ok = current is None or rev == current
            if ok:
                current = (current or 0) + 1
            out.append((key[0], int(seq), int(rev), ok, int(current)))
        self.rev.update((int(current),))
        yield pd.DataFrame(out, columns=["entry_key", "seq", "rev", "accepted", "new_rev"])

    def close(self) -> None:
        pass


def optimistic_saves(saves: DataFrame) -> DataFrame:
    """saves(entry_key, seq, rev) as a stream -> accepted and conflicting saves. Feed limited batches."""
    _use_rocksdb(saves)
    keyed = saves.withColumn("entry_key", normalize_id(F.col("entry_key").cast("string")))
    return keyed.groupBy("entry_key").transformWithStateInPandas(
        statefulProcessor=RevisionGuard(), outputStructType=SAVE_SCHEMA, outputMode="Append", timeMode="None")


def optimistic_saves_batch(saves: DataFrame) -> DataFrame:
    """The same decisions in batch, without replaying a key's log in one task.

    If a save that names revision r is accepted, the next accepted one is the first later save that names r + 1: one backward scan gives every
    save this pointer. Pointer doubling then marks the saves on the path from a key's first: after t rounds the first 2**t of
    them, so rounds grow with the logarithm of the longest history. Scans split a key that holds any share of the rows.
    """
    keyed = saves.withColumn("entry_key", normalize_id(F.col("entry_key").cast("string"))).select(
        "entry_key", F.col("seq").cast("long").alias("seq"), F.col("rev").cast("long").alias("rev"))
    first = keyed.groupBy("entry_key").agg(F.min("seq").alias("seq")).withColumn("_first", F.lit(True))
    named = keyed.join(first, ["entry_key", "seq"], "left")
    # The first save is accepted whatever it names: it stands for revision 0, and nothing points to it.
    named = cut_lineage(named.withColumn("_rev", F.when(F.col("_first"), F.lit(0).cast("long")).otherwise(F.col("rev"))))
    none = F.lit(None).cast("long")
    sought = named.select("entry_key", (F.col("_rev") + 1).alias("r"), "seq", none.alias("at"))
    found = named.where("_first IS NULL").select("entry_key", F.col("rev").alias("r"), "seq", F.col("seq").alias("at"))
    scanned = running(sought.unionByName(found), ["entry_key", "r"], "seq", F.col("at"), "min", "next", backward=True)
    jump = cut_lineage(scanned.where("at IS NULL AND next IS NOT NULL").select("entry_key", "seq", "next").distinct())

    reached = cut_lineage(first.select("entry_key", "seq"))
    accepted = [reached]
    while True:
        new = union_all(accepted).join(jump, ["entry_key", "seq"]).select("entry_key", F.col("next").alias("seq"))
        new = cut_lineage(new)
        if new.isEmpty():
            break
        accepted.append(new)
        onward = jump.select("entry_key", F.col("seq").alias("next"), F.col("next").alias("_far"))
        jump = cut_lineage(jump.join(onward, ["entry_key", "next"]).select("entry_key", "seq", F.col("_far").alias("next")))
    ok = union_all(accepted).withColumn("accepted", F.lit(True))
    out = named.join(ok, ["entry_key", "seq"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    # An accepted save sets the revision; a rejected one finds the last that was set.
    out = running(out, ["entry_key"], "seq", F.when(F.col("accepted"), F.col("_rev") + 1), "max", "new_rev")
    return out.select("entry_key", "seq", "rev", "accepted", "new_rev")


def start_optimistic_saves(saves: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return _start(optimistic_saves(saves), path, checkpoint)


# --- edit sessions, solve metrics -------------------------------------------------------------------


def edit_sessions(edits: DataFrame, gap: str = "2 seconds", watermark: str = "1 minute") -> DataFrame:
    """Bursts of edits closed by silence, with the last version of each: edits(report, seq, ts, value)."""
    e = edits.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", watermark) if e.isStreaming else e
    return e.groupBy("report", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("edits"), F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")).select("report", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "edits", "value", "seq")


def start_edit_sessions(edits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return _start(edit_sessions(edits), path, checkpoint)


def solve_metrics(solves: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Tumbling (or sliding) latency and cached rate per solver: solves(ts, solver, solve_ms, cached)."""
    s = solves.withColumn("ts", F.col("ts").cast("timestamp"))
    s = s.withWatermark("ts", watermark) if s.isStreaming else s
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return s.groupBy(w.alias("w"), "solver").agg(F.count("*").alias("n"), F.avg("solve_ms").alias("avg_ms"), F.count_if("cached").alias("n_cached")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "solver", "n", "avg_ms", "n_cached")


def start_solve_metrics(solves: DataFrame, path: str, checkpoint: str, size: str = "1 hour", slide: str | None = None) -> StreamingQuery:
    return _start(solve_metrics(solves, size, slide), path, checkpoint)


# --- solve plan and review ------------------------------------------------------------------------


def solve_plan_stream(images: DataFrame, solves: DataFrame, version: int = 2) -> DataFrame:
    """Arriving images without a current successful solve (stream-static anti-join)."""
    current = solves.where((F.col("status") == "solved") & (F.col("version") == version)).select("hash").distinct()
    return images.join(current, "hash", "left_anti")


def start_solve_plan(images: DataFrame, solves_path: str, path: str, checkpoint: str, version: int = 2) -> StreamingQuery:
    """Each batch reads the solve table as it then is; a repeated batch overwrites its own folder."""
    def plan(batch: DataFrame, epoch: int) -> None:
        solves = batch.sparkSession.read.parquet(solves_path)
        solve_plan_stream(batch, solves, version).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return images.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def review_batch(changes: DataFrame) -> DataFrame:
    """Latest status per annotation; approving stamps the reviewer, who stays until the next approval.

    changes(anno_id, seq, ts, status, user).
    """
    approved = F.when(F.col("status") == "approved", F.col("seq"))
    return changes.groupBy("anno_id").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.max_by("ts", "seq").alias("updated_at"),
        F.max_by("user", approved).alias("reviewed_by"), F.max(approved).alias("approved_seq"))


def merge_review(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Earlier state joins as older changes."""
    state = review_batch(batch)
    if old is None:
        return state
    return state.unionByName(old.select(*state.columns)).groupBy("anno_id").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("_s"), F.max_by("updated_at", "seq").alias("updated_at"),
        F.max_by("reviewed_by", "approved_seq").alias("reviewed_by"), F.max("approved_seq").alias("approved_seq")).withColumnRenamed("_s", "seq")


def start_review(changes: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Review state in a state table; read it with `StateTable(spark, path, "anno_id").read()`."""
    def apply(batch: DataFrame, epoch: int) -> None:
        StateTable(batch.sparkSession, path, "anno_id", buckets).apply(batch, epoch, merge_review)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
