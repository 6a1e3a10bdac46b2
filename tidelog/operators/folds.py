"""Running sums and ordered folds that gather no key's rows in one place of memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a bucket, on average, that one task orders.
BUCKET_ROWS = 100_000
#: Totals of buckets, one narrow row each, that are broadcast; more are joined with a shuffle.
FEW_TOTALS = 200_000


def running(rows: DataFrame, groups: list[str], order: str, sums: dict[str, Column], ties: tuple[str, ...] = (), maxima: dict[str, Column] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with the running sums and maxima of each group, in the order of a number and then of ties; a row counts itself.

    The numbers are cut into buckets of equal width. Each bucket is ordered by itself, and what lies
    before it comes from the buckets' totals, so neither a large group nor the whole table goes through
    one task. Rows whose number is null come first. A null amount adds nothing. Null groups are a group."""
    tops = maxima or {}
    low, high, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    places = F.lit(0).cast("long")
    if low is not None and high > low:
        width = max((float(high) - float(low)) * bucket_rows / n, 1e-300)
        places = F.coalesce(F.floor((F.col(order).cast("double") - float(low)) / width), F.lit(-1)).cast("long")
    cut = rows.withColumn("_bucket", places).withColumns({f"_in_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()} | {f"_in_{k}": v for k, v in tops.items()})
    inside = Window.partitionBy(*groups, "_bucket").orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*groups, "_bucket").agg(*(F.sum(f"_in_{k}").alias(f"_t_{k}") for k in sums), *(F.max(f"_in_{k}").alias(f"_t_{k}") for k in tops))
    starts = totals.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_bucket").alias("_b"), *(F.sum(f"_t_{k}").over(before).alias(f"_s_{k}") for k in sums), *(F.max(f"_t_{k}").over(before).alias(f"_s_{k}") for k in tops))
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    if n / bucket_rows <= FEW_TOTALS and totals.limit(FEW_TOTALS + 1).count() <= FEW_TOTALS:
        starts = F.broadcast(starts)
    own = cut.withColumns({f"_o_{k}": F.sum(f"_in_{k}").over(inside) for k in sums} | {f"_o_{k}": F.max(f"_in_{k}").over(inside) for k in tops})
    out = own.join(starts, same)
    added = {k: F.col(f"_o_{k}") + F.coalesce(F.col(f"_s_{k}"), F.lit(0)) for k in sums} | {k: F.greatest(F.col(f"_o_{k}"), F.col(f"_s_{k}")) for k in tops}
    return out.select(*rows.columns, *(v.alias(k) for k, v in added.items()))


def numbered(rows: DataFrame, groups: list[str], order: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with their number, from 1, in each group."""
    return running(rows, groups, order, {name: F.lit(1).cast("long")}, ties)


def at_ranks(rows: DataFrame, groups: list[str], value: str, ranks: dict[str, Callable[[Column, Column], Column]], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Of each group, the values at ranks, from 1, of its rows in order, nulls last; null where there is none.

    ranks: each from the number of the group's rows and of those that are not null. Equal values are
    counted first, then ordered. Only groups of more than bucket_rows rows are cut into buckets, by their
    own range; they and their buckets are at most twice rows / bucket_rows, which is broadcast. No job
    runs before the result is asked for. Null groups are a group."""
    at = [f"_g{i}" for i in range(len(groups))]
    data = rows.select(*(F.col(g).alias(a) for g, a in zip(groups, at)), F.col(value).alias("_v"))
    sizes = data.groupBy(*at).agg(F.count("*").alias("_n"), F.min("_v").cast("double").alias("_low"), F.max("_v").cast("double").alias("_high"))
    width = F.greatest((F.col("_high") - F.col("_low")) * bucket_rows / F.col("_n"), F.lit(1e-300))
    large = sizes.where(F.col("_n") > bucket_rows).select(*(F.col(a).alias(f"_l{a}") for a in at), "_low", width.alias("_width"))
    bucket = F.coalesce(F.floor((F.col("_v").cast("double") - F.col("_low")) / F.col("_width")), F.lit(0)).alias("_bucket")

    def cut(how: str) -> DataFrame:
        same = F.lit(True)
        for a in at:
            same = same & F.col(a).eqNullSafe(F.col(f"_l{a}"))
        return data.join(F.broadcast(large), same, how).select(*at, bucket, "_v")

    counts = cut("left").groupBy(*at, "_bucket", "_v").agg(F.count("_v").alias("_c"), F.count("*").alias("_r"))
    inside = Window.partitionBy(*at, "_bucket")
    to = F.sum("_c").over(inside.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*at, "_bucket", "_v", to.alias("_to"), F.sum("_c").over(inside).alias("_in_c"), F.sum("_r").over(inside).alias("_in_r"))
    totals = cut("inner").groupBy(*at, "_bucket").agg(F.count("_v").alias("_c"), F.count("*").alias("_r"))
    buckets = Window.partitionBy(*at).orderBy("_bucket")
    before, whole = buckets.rowsBetween(Window.unboundedPreceding, -1), buckets.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(*(F.col(a).alias(f"_s{a}") for a in at), F.col("_bucket").alias("_b"), F.sum("_c").over(before).alias("_from"), F.sum("_c").over(whole).alias("_all_c"), F.sum("_r").over(whole).alias("_all_r"))
    same = F.col("_bucket") == F.col("_b")
    for a in at:
        same = same & F.col(a).eqNullSafe(F.col(f"_s{a}"))
    both = placed.join(F.broadcast(starts), same, "left")
    n, values, last = F.coalesce("_all_r", "_in_r"), F.coalesce("_all_c", "_in_c"), F.col("_to") + F.coalesce("_from", F.lit(0))
    found = {k: F.min(F.when((rank(n, values) >= 1) & (last >= rank(n, values)), F.col("_v"))) for k, rank in ranks.items()}
    return both.groupBy(*(F.col(a).alias(g) for g, a in zip(groups, at))).agg(*(v.alias(k) for k, v in found.items()))


def at_share(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Of each group, the values at shares of its values by nearest rank; null where all are null."""
    rank = lambda q: lambda _, n: F.greatest(n - F.floor(n - n * q), F.lit(1))
    return at_ranks(rows, groups, value, {k: rank(q) for k, q in shares.items()}, bucket_rows)


def folded_rows(rows: DataFrame, key: str, order: list[str], start: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple | None]], schema: str) -> DataFrame:
    """What step gives for each row of a key, in order: step(state, row) is (next state, output or None).

    rows' columns are the row that step sees. A key's rows stream through one task, which holds one
    batch of them and one state; keys lie in many tasks."""
    names = rows.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, at = None, start, names.index(key)
        for batch in batches:
            out = []
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                if last is None or last[0] != row[at]:
                    last, state = (row[at],), start
                state, found = step(state, row)
                if found is not None:
                    out.append(found)
            yield pd.DataFrame(out, columns=columns)

    columns = StructType.fromDDL(schema).names
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)
