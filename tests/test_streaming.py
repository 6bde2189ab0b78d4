import tempfile

import pytest
from pyspark.sql import functions as F

from firmament.streaming import jobs as J
from firmament.streaming.state import StateTable


@pytest.fixture()
def run(spark, sf):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    src = f"{base}/src"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(src)
    return base, spark.read.parquet(src), lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_optimistic_saves_equal_batch(spark, run):
    base, batch, stream = run
    saves = lambda d: d.select((F.col("user_id") % 20).alias("entry_key"), F.col("event_id").alias("seq"), (F.floor("value").cast("long") % 4).alias("rev"))
    # Files arrive one by one; keep the order of the log.
    one = f"{base}/one"
    batch.coalesce(1).sortWithinPartitions("event_id").write.parquet(one)
    s = spark.readStream.schema(batch.schema).parquet(one)
    J.start_optimistic_saves(saves(s), f"{base}/out", f"{base}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{base}/out").select("entry_key", "seq", "accepted", "new_rev")) == rows(J.optimistic_saves_batch(saves(batch)).select("entry_key", "seq", "accepted", "new_rev"))


def test_sessions_and_metrics_equal_closed_part_of_batch(spark, run):
    base, batch, stream = run
    sol = lambda d: d.select("ts", F.col("event_type").alias("solver"), F.col("value").alias("solve_ms"), (F.col("event_id") % 3 == 0).alias("cached"))
    one = f"{base}/one"
    batch.coalesce(1).write.parquet(one)
    s = spark.readStream.schema(batch.schema).parquet(one)
    J.start_solve_metrics(sol(s), f"{base}/m", f"{base}/mc").awaitTermination()
    got, want = set(rows(spark.read.parquet(f"{base}/m").select("start", "solver", "n"))), set(rows(J.solve_metrics(sol(batch)).select("start", "solver", "n")))
    assert got and got <= want and len(want - got) <= 10


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Shanghai"])
def test_job_status_latest_and_timeout(spark, run, zone):
    """A job that has run for 200 of 300 seconds is not late in any time zone."""
    base, batch, stream = run
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _job_status(spark, base)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def _job_status(spark, base):
    ev = spark.createDataFrame([(1, 1, "running", 0), (1, 2, "done", 100), (2, 3, "running", 50), (3, 4, "queued", 5000), (3, 5, "running", 5001), (4, 7, "running", 8800)], "job long, seq long, state string, s long")
    ev = ev.select("job", "seq", F.timestamp_seconds("s").alias("ts"), "state")
    ev.coalesce(1).write.parquet(f"{base}/jobs")
    late = spark.createDataFrame([(9, 6, "done", 9000)], "job long, seq long, state string, s long").select("job", "seq", F.timestamp_seconds("s").alias("ts"), "state")
    late.coalesce(1).write.mode("append").parquet(f"{base}/jobs")
    s = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/jobs")
    J.start_job_status(s, f"{base}/js", f"{base}/jc", "1 minute").awaitTermination()
    got = {(r.job, r.state) for r in spark.read.parquet(f"{base}/js").collect()}
    assert {(1, "done"), (2, "failed"), (9, "done")} <= got and (4, "failed") not in got
    want = {r.job: r.state for r in J.job_status_batch(ev.unionByName(late)).collect()}
    assert want == {1: "done", 2: "failed", 3: "failed", 4: "running", 9: "done"}


def test_ingest_keeps_one_row_per_content(spark, run):
    base, _, _ = run
    files = spark.createDataFrame([("a", 1, b"x"), ("b", 2, b"x"), ("c", 3, b"y")], "path string, t long, content binary").select("path", F.timestamp_seconds("t").alias("modificationTime"), "content")
    files.coalesce(1).write.parquet(f"{base}/img")
    s = spark.readStream.schema(files.schema).parquet(f"{base}/img")
    J.start_ingest_images(s, f"{base}/io", f"{base}/ic").awaitTermination()
    assert {r.hash for r in spark.read.parquet(f"{base}/io").collect()} == {r.hash for r in J.ingest_images(files).collect()}
    assert spark.read.parquet(f"{base}/io").count() == 2


def test_review_stream_equals_batch(spark, run):
    base, batch, stream = run
    ch = lambda d: d.select((F.col("event_id") % 50).alias("anno_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "click", "approved").otherwise("draft").alias("status"), F.col("user_id").cast("string").alias("user"))
    q = J.start_review(ch(stream()), f"{base}/r", f"{base}/rc")
    q.awaitTermination()
    cols = ("anno_id", "status", "reviewed_by", "seq")
    assert rows(StateTable(spark, f"{base}/r", "anno_id").read().select(*cols)) == rows(J.review_batch(ch(batch)).select(*cols))


def test_solve_plan_stream(spark, run):
    base, batch, stream = run
    solves = batch.select(F.col("event_id").alias("hash"), F.lit("solved").alias("status"), F.lit(2).alias("version")).where("hash % 2 = 0")
    solves.write.parquet(f"{base}/solves")
    J.start_solve_plan(stream().select(F.col("event_id").alias("hash")), f"{base}/solves", f"{base}/plan", f"{base}/pc").awaitTermination()
    assert rows(spark.read.parquet(f"{base}/plan").select("hash")) == rows(batch.where("event_id % 2 = 1").select("event_id"))


def saves_by_hand(saves):
    out, current = [], {}
    for key, seq, rev in sorted(saves, key=lambda s: (s[0], s[1])):
        ok = key not in current or rev == current[key]
        if ok:
            current[key] = current.get(key, 0) + 1
        out.append((key, seq, rev, ok, current[key]))
    return sorted(out)


def test_long_histories_take_few_rounds(spark, monkeypatch):
    """One key holds most rows and 5,000 accepted saves in a row; rounds follow the logarithm."""
    import random

    rnd = random.Random(6)
    saves, rev = [("HOT", 0, 77)], 1
    for seq in range(1, 15000):
        if seq % 3 == 0:
            saves.append(("HOT", seq, rev))
            rev += 1
        else:
            saves.append(("HOT", seq, rnd.choice([0, rev - 1, rev + 1, 3])))
    saves += [(f"K{rnd.randrange(40)}", 20000 + i, rnd.randrange(4)) for i in range(2000)] + [("ALONE", 5, 9)]
    rounds, checkpoint = [], J.cut_lineage
    monkeypatch.setattr(J, "cut_lineage", lambda d: (rounds.append(1), checkpoint(d))[1])
    got = rows(J.optimistic_saves_batch(spark.createDataFrame(saves, "entry_key string, seq long, rev long").repartition(16)))
    assert got == saves_by_hand(saves)
    assert len(rounds) <= 3 + 2 * 14


@pytest.mark.parametrize("how, backward", [("max", False), ("min", True), ("sum", False), ("sum", True)])
def test_running_aggregates_over_a_hot_group(spark, how, backward):
    import random

    from firmament.operators.scans import running

    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}", rnd.randrange(400), rnd.choice([None, rnd.randrange(1000)])) for _ in range(1500)]
    found = running(spark.createDataFrame(data, "g string, o long, v long").repartition(8), ["g"], "o", F.col("v"), how, backward=backward).collect()
    assert len(found) == len(data)
    for r in found:
        seen = [v for g, o, v in data if g == r.g and v is not None and (o >= r.o if backward else o <= r.o)]
        assert r.running == ({"max": max, "min": min, "sum": sum}[how](seen) if seen else None)


def test_state_table_survives_a_crash_between_any_two_steps(spark, run, monkeypatch):
    base, _, _ = run
    table = StateTable(spark, f"{base}/state", "job", 8)
    assert table.read() is None and table.version() is None
    batch = lambda pairs, seq: spark.createDataFrame([(j, s, seq) for j, s in pairs], "job long, state string, seq long").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    now = lambda: {r.job: r.state for r in table.read().collect()}
    table.apply(batch([(j, "queued") for j in range(40)], 1), 0, J.latest_status)
    before = now()
    assert before == {j: "queued" for j in range(40)}
    point = StateTable._point

    def broken(self, version, folders):
        raise RuntimeError("lost before the log was written")

    monkeypatch.setattr(StateTable, "_point", broken)
    with pytest.raises(RuntimeError):
        table.apply(batch([(3, "running")], 2), 1, J.latest_status)
    assert now() == before and table.version() == 0
    monkeypatch.setattr(StateTable, "_point", point)
    old = table.folders()
    touched = table.apply(batch([(3, "running")], 2), 1, J.latest_status)
    assert len(touched) == 1 and {b for b, f in table.folders().items() if f != old[b]} == set(touched)  # only the changed bucket is written
    assert now() == before | {3: "running"}
    assert table.apply(batch([(3, "failed")], 9), 1, J.latest_status) == []  # a repeated batch changes nothing
    table.apply(batch([(3, "done"), (4, "done")], 3), 2, J.latest_status)
    assert now() == before | {3: "done", 4: "done"}
    table.vacuum(keep=1)
    assert now() == before | {3: "done", 4: "done"}


def test_job_table_after_a_restart(spark, run):
    base, batch, _ = run
    changes = lambda d: d.select(F.col("user_id").alias("job"), F.col("event_type").alias("state"), F.col("event_id").alias("seq"), "ts")
    src = f"{base}/halves"
    stream = lambda: changes(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(src))
    for half in (1, 0):  # later events first: older ones that arrive late change nothing
        batch.where(F.col("event_id") % 2 == half).repartition(2).write.mode("append").parquet(src)
        J.write_job_status(stream(), f"{base}/table", f"{base}/table-cp", 8).awaitTermination()
    got = StateTable(spark, f"{base}/table", "job", 8).read().select("job", "state", "seq")
    want = batch.groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("seq"))
    assert rows(got) == rows(want)
