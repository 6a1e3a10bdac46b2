"""The same operators on streams: versioned ingest, retained topics, leases and tasks.

Batch functions of tidelog.operators are used inside foreachBatch wherever a micro-batch is enough;
state is Spark's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tidelog.operators.tasks import MOVES


def ingest(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch becomes a version: Parquet under version=N. A batch that is run again replaces its own version, so readers see it once."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number + 1}")

    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(spark: SparkSession, path: str, schema: StructType, since: int | str = "earliest") -> DataFrame:
    """The commits of a table that ingest() writes, as a stream of rows with their version.

    since: "earliest" for all that is held, "live" for what comes from now on, or a version after which to go on."""
    whole = StructType([*(f for f in schema if f.name != "version"), StructField("version", LongType())])
    if since == "live":
        since = spark.read.schema(whole).parquet(path).agg(F.max("version")).first()[0] or 0
    rows = spark.readStream.schema(whole).option("basePath", path).parquet(f"{path}/version=*")
    return rows if since == "earliest" else rows.where(F.col("version") > int(since))


def leases(events: DataFrame, key: str, at: str, event: str, lease: str = "20 minutes", late: str = "0 minutes", retries: int = 3) -> DataFrame:
    """key, state, attempts: tasks whose claims run out, by event time.

    events: key, at (a timestamp) and event (claim, complete, fail). A claim that is not ended within
    lease puts its task back when the watermark has passed it, at most retries times; then it fails."""
    span = pd.Timedelta(lease)

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts, until = state.get if state.exists else ("QUEUED", 0, 0)

        def lapse(time: int) -> None:
            nonlocal now, until
            if now == "CLAIMED" and time > until:
                now, until = "FAILED" if attempts > retries else "QUEUED", 0

        if state.hasTimedOut:
            lapse(until + 1)
        else:
            for time, what in sorted((int(t.value // 1_000_000), w) for b in batches for t, w in zip(b[at], b[event])):
                lapse(time)
                if what == "claim" and now == "QUEUED":
                    now, attempts, until = "CLAIMED", attempts + 1, time + int(span.total_seconds() * 1000)
                elif now == "CLAIMED" and what in ("complete", "fail"):
                    now, until = {"complete": "DONE", "fail": "FAILED"}[what], 0
        state.update((now, attempts, until))
        if until and until >= state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until + 1)
        elif until:
            lapse(until + 1)
            state.update((now, attempts, until))
        yield pd.DataFrame({key: [name[0]], "state": [now], "attempts": [attempts]})

    kind = dict(events.dtypes)[key]
    timed = events.withWatermark(at, late).groupBy(key)
    return timed.applyInPandasWithState(fold, f"{key} {kind}, state string, attempts long", "state string, attempts long, until long", "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, at: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each key by window of event time; rows later than late are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def first_seen(events: DataFrame, key: str, at: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark: an idempotent publish."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counters(messages: DataFrame, key: str, amount: str) -> DataFrame:
    """The running sum of each key after every micro-batch that adds to it."""

    def add(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        total += sum(int(b[amount].sum()) for b in batches)
        state.update((total,))
        yield pd.DataFrame({key: [name[0]], "total": [total]})

    kind = dict(messages.dtypes)[key]
    return messages.groupBy(key).applyInPandasWithState(add, f"{key} {kind}, total long", "total long", "update", GroupStateTimeout.NoTimeout)


def task_states(events: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """The state of each task after every micro-batch with events of it; the rules of tasks.folded."""

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("QUEUED", 0)
        log = pd.concat(list(batches)).sort_values(order)
        for what in log[event]:
            now, n = MOVES.get((now, what), now), n + 1
        state.update((now, n))
        yield pd.DataFrame({key: [name[0]], "state": [now], "n_events": [n]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, state string, n_events long", "state string, n long", "update", GroupStateTimeout.NoTimeout)
