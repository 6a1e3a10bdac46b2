"""Streams over files give what the batch operators give on the same rows."""

from pyspark.sql import functions as F

from tidelog.operators import tasks
from tidelog.plans.queries import task_events
from tidelog.streaming import live


def stream_of(spark, rows, path):
    rows.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def result(spark, frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_ingest_commits_versions_once(spark, tmp_path):
    rows = spark.range(50)
    stream = stream_of(spark, rows, str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        live.ingest(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 50 and got.select("version").distinct().count() == 1


def test_task_states_equal_the_fold(spark, small, tmp_path):
    events = task_events(spark, small)
    got = result(spark, live.task_states(stream_of(spark, events, str(tmp_path / "e")), "task", "event_id", "what"), "task_states", "update")
    want = tasks.folded(events, "task", "event_id", "what")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_counters_and_windows(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    stream = stream_of(spark, events, str(tmp_path / "e"))
    got = result(spark, live.counters(stream, "user_id", "event_id"), "totals", "update")
    want = events.groupBy("user_id").agg(F.sum("event_id").alias("total"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    counts = result(spark, live.windowed_counts(stream, "ts", "user_id"), "counts", "update")
    assert counts.agg(F.sum("n")).first()[0] == events.count()
    assert result(spark, live.first_seen(stream, "event_id", "ts"), "firsts", "append").count() == events.count()


def test_subscriptions_begin_where_they_are_asked_to(spark, tmp_path):
    out = str(tmp_path / "out")
    for version in (1, 2, 3):
        spark.range(version * 10, version * 10 + 5).write.parquet(f"{out}/version={version}")
    schema = spark.range(1).schema
    for since, want in (("earliest", {1, 2, 3}), (1, {2, 3}), ("live", set())):
        got = result(spark, live.subscribe(spark, out, schema, since), f"sub_{since}", "append")
        assert {r["version"] for r in got.collect()} == want and got.count() == 5 * len(want)


def test_claims_run_out_by_event_time(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = lambda *events: spark.createDataFrame(list(events), "task string, minute int, what string").select("task", (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("minute"))).alias("at"), "what").coalesce(1)
    batches = [
        rows(("a", 0, "claim"), ("b", 0, "claim"), ("c", 0, "claim"), ("c", 1, "fail")),
        rows(("b", 10, "complete"), ("z", 30, "claim")),
        rows(("z", 60, "claim"), ("a", 61, "claim")),
        rows(("a", 62, "complete"), ("z", 90, "claim"), ("y", 120, "claim")),
        rows(("y", 300, "complete")),
    ]
    mark, last = str(tmp_path / "mark"), {}
    for k, batch in enumerate(batches):
        batch.write.mode("append").parquet(path)
        stream = spark.readStream.schema(batch.schema).parquet(path)

        def keep(frame, number):
            last.update({r["task"]: (r["state"], r["attempts"]) for r in frame.collect()})

        live.leases(stream, "task", "at", "what", "20 minutes", retries=1).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
    assert last["a"] == ("DONE", 2) and last["b"] == ("DONE", 1) and last["c"] == ("FAILED", 1)
    assert last["z"][0] in ("QUEUED", "FAILED") and last["z"][1] == 2
