"""What the operators of this folder share: reading tables, the shared folder, prefix sums."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Narrow rows that are broadcast; more are joined with a shuffle.
FEW = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session, whose executors are the driver, may do without and gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def with_ids(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """doc_id, no_id and the columns: a worker gets integers even where some ids are null, and so the digits of large ones."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), *columns)


def ids_of(batch: pd.DataFrame) -> pd.Series:
    """The doc_ids of a batch of with_ids(), null ones as such."""
    return pd.Series(pd.arrays.IntegerArray(batch["doc_id"].to_numpy(np.int64), batch["no_id"].to_numpy(bool).copy()))


def freeing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, which then gives back the Python worker's free memory: what a stage took is not held through the next ones."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        free()

    return run


def free() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written once to the shared folder and read again: its lineage is cut and no stage runs twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, name: str, most: int = FEW) -> DataFrame:
    """df, written, for a join: broadcast if it has at most so many rows, else as it is."""
    df = written(df, name)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def part_offsets(parts: DataFrame, part: str, amount: str, offset: str) -> DataFrame:
    """(part, offset): the sum of amount over all smaller parts.

    Rows of a part are summed first, so the one task that orders the parts gets a row for each
    partition of the table and not for each row."""
    totals = parts.groupBy(part).agg(F.sum(amount).alias("_total"))
    before = F.sum("_total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(part, F.coalesce(before, F.lit(0)).cast("long").alias(offset))


def ascii_lower(c: Column) -> Column:
    """A-Z only; every other character stays as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_group(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work on the rows of each group of keys, many groups in one Arrow batch. The callers bound their groups."""

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            key = batch[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(batch)]
            out = []
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if held and last != tuple(key[s]):
                    out.append(work(pd.concat(held)))
                    held = []
                last = tuple(key[s])
                held.append(batch.iloc[s:e])
            if out:
                yield pd.concat(out)
        if held:
            yield work(pd.concat(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(freeing(groups), schema)
