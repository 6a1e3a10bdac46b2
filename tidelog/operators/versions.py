"""Versioned tables: every commit is a version, and rows carry theirs.

With the windowed policy of width K a table appends until its chain is K deep and then keeps the newest
K batches beside the new one, so versions v with (v - 1) mod K = 0 are Window commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.folds import folded_rows, numbered, running


def with_version(rows: DataFrame, order: str, batch: int) -> DataFrame:
    """version: batch rows a commit, in the order of a dense counter from 0."""
    return rows.withColumn("version", (F.floor(F.col(order) / batch) + 1).cast("long"))


def snapshot_at(rows: DataFrame, version: int) -> DataFrame:
    return rows.where(F.col("version") <= version)


def delta(rows: DataFrame, since: int, head: int) -> DataFrame:
    """Rows of the versions after since, up to head."""
    return rows.where((F.col("version") > since) & (F.col("version") <= head))


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: an aggregation with map-side combine, not a sort of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last")).select(key, *(F.col("_last")[c].alias(c) for c in others))


def number_per_key(rows: DataFrame, key: str, order: list[str], name: str = "version") -> DataFrame:
    """For keys with few rows each; folds.numbered has no such limit."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def interned(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first_seen, id): ids in the order of first sight. Keys are aggregated before they are numbered."""
    first = rows.groupBy(key).agg(F.min(order).alias("first_seen"))
    return numbered(first, [], "first_seen", "id", (key,))


def commit_states(commits: DataFrame, keys: list[str], version: str = "version", kind: str = "kind", keep: str = "keep") -> DataFrame:
    """commits with low, base and root after each: the oldest version still held, the version below which readers
    have lost rows, and the last commit that began anew.

    A Replace holds its own rows alone; an Append adds to what is held; a Window holds the newest keep
    versions before it, if they are held, and its own. All three are running maxima of what commits
    name, so no fold is needed."""
    v = F.col(version)
    replaced = F.when(F.col(kind) == "Replace", v)
    marks = {"low": F.coalesce(replaced, F.when(F.col(kind) == "Window", v - F.col(keep))), "_replaced": replaced, "root": F.when(F.col(kind) != "Append", v)}
    held = running(commits, keys, version, {}, maxima=marks)
    return held.withColumn("base", F.greatest(F.col("_replaced"), F.col("low") - 1)).drop("_replaced")


def mixed_reads(states: DataFrame, readers: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """readers (keys, since, head) with first, from_version and truncated: what a delta from since to head begins with.

    first: the oldest version read; above head, none. from_version: the commit that the oldest rows are
    read from; that of head for a reader who has it all. A reader at 0 reads all that is held."""
    at = states.select(*keys, F.col(version).alias("head"), "low", "base", "root")
    since, head = F.col("since"), F.col("head")
    truncated = (since > 0) & (since < F.col("base")) & (since < head)
    whole = (since == 0) | truncated
    first = F.when(since >= head, head + 1).when(whole, F.col("low")).otherwise(F.greatest(since + 1, F.col("low")))
    begun = F.when(since >= head, head).when(since < F.col("root"), F.col("root")).otherwise(since + 1)
    return readers.join(at, [*keys, "head"]).select(*readers.columns, first.cast("long").alias("first"), begun.cast("long").alias("from_version"), truncated.alias("truncated"))


def window_kind(version: Column, width: int) -> Column:
    return F.when((version - 1) % width == 0, F.lit("Window")).otherwise(F.lit("Append"))


def window_oldest(head: Column, width: int) -> Column:
    """The oldest version that head still holds."""
    step = F.floor((head - 1) / width)
    return F.greatest(F.lit(1), (step - 1) * width + 1).cast("long")


def window_base(head: Column, width: int) -> Column:
    """Readers below this have lost rows."""
    step = F.floor((head - 1) / width)
    return F.when(step == 0, 0).when(step == 1, 1).otherwise((step - 1) * width).cast("long")


def window_truncated(since: Column, head: Column, width: int) -> Column:
    root = F.floor((head - 1) / width) * width + 1
    return (since > 0) & (since < root) & (since < window_base(head, width)) & (head > width)


def window_first_read(since: Column, head: Column, width: int) -> Column:
    """The first version that a reader at since gets; above head: none."""
    whole = (since == 0) | window_truncated(since, head, width)
    return F.when(since >= head, head + 1).when(whole, window_oldest(head, width)).otherwise(since + 1).cast("long")


def running_totals(rows: DataFrame, amount: str) -> DataFrame:
    """version, rows_to, sum_to: over all versions up to each."""
    per = rows.groupBy("version").agg(F.count("*").alias("n"), F.sum(amount).alias("s"))
    return running(per, [], "version", {"rows_to": F.col("n"), "sum_to": F.col("s")}).select("version", "rows_to", "sum_to")


def put_if(attempts: DataFrame, key: str, order: list[str], expect: str, out: list[str]) -> DataFrame:
    """out, status and actual of each attempt, in order: it names the version that it expects its key to have.

    The first version is created by an attempt that expects 0; an attempt that names the current
    version installs the next one; others find another version. actual: the key's version after it."""
    kinds = dict(attempts.dtypes)
    rows = attempts.select(key, *order, expect, *(c for c in out if c not in {key, *order, expect}))
    place, names = rows.columns.index(expect), [rows.columns.index(c) for c in out]

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (now,) = state
        same = row[place] == now
        status = ("created" if now == 0 else "installed") if same else "VersionMismatch"
        return (now + same,), (*(row[k] for k in names), status, now + same)

    return folded_rows(rows, key, order, (0,), step, ", ".join([*(f"{c} {kinds[c]}" for c in out), "status string", "actual long"]))


def committed_only(rows: DataFrame, commits: DataFrame, txn: str) -> DataFrame:
    return rows.join(commits.select(txn).distinct(), txn, "left_semi")


def equal_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """missing, extra: rows that only one side has, repeats counted."""
    missing = a.exceptAll(b).agg(F.count("*").alias("missing"))
    return missing.crossJoin(b.exceptAll(a).agg(F.count("*").alias("extra")))  # two single rows


def lifecycles(ops: DataFrame, key: str, order: str, ends: str, names: str) -> DataFrame:
    """key, order, status, generation and version after each put or deletion, in order.

    A put on a key that is not there begins its next generation at version 1; a deletion takes a key
    that is there away if it names its generation, and may come again. Readers of a key that is gone
    find version 0."""
    kinds = dict(ops.dtypes)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        generation, version = state
        _, _, deletes, named = row
        if not deletes:
            status, now = ("installed", (generation, version + 1)) if version else ("created", (generation + 1, 1))
        elif not version:
            status, now = "gone", state
        else:
            status, now = ("deleted", (generation, 0)) if named == generation else ("stale", state)
        return now, (*row[:2], status, *now)

    return folded_rows(ops.select(key, order, ends, names), key, [order], (0, 0), step, f"{key} {kinds[key]}, {order} {kinds[order]}, status string, generation long, version long")
