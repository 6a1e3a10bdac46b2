"""Operator 8: nearest neighbours by cross-polytope hashing.

A pseudo-rotation (signs and a fast Hadamard transform, three times) turns a unit vector, and the
axis nearest to the result, with its sign, is a hash. A table's bucket is one hash or several, as many
as keep buckets at about BUCKET_ROWS rows. A query looks into its most likely buckets in every table;
whatever lies there is ranked by its exact inner product. How many buckets it takes is fitted: a few
queries are compared with all rows, and the least number that finds WANTED of their neighbours is
taken. Vectors of different lengths become unit vectors by one more component, which keeps the order
of inner products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import few, freeing, table, written
from tidelog.llm.vectors import chunk, each_chunk, stacked, usable

TABLES, BUCKET_ROWS, SEED = 16, 2048, 5
#: Queries that the fit compares with all rows, and the share of their neighbours that is to be found.
FIT_QUERIES, WANTED = 64, 0.95
NEAREST, QUERY_EVERY = 20, 20
#: Candidates and queries that are multiplied at a time.
CANDIDATES, QUERIES = 4096, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    n, dim = x.shape
    h = 1
    while h < dim:
        x = x.reshape(n, -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(n, dim)
        h *= 2
    return x / np.sqrt(dim)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """x under the rotation of a table; rows are filled up with zeros to a power of two."""
    dim = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    for signs in np.random.default_rng([SEED, number, dim]).choice([-1.0, 1.0], (3, dim)):
        x = hadamard(x * signs)
    return x


def hash_sizes(rows: int, dim: int, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """The signed axes that each hash of a bucket can take: all of them for the first, and more hashes while buckets would hold more than bucket_rows."""
    every = 2 << max(1, dim.bit_length())  # a component more, filled up to a power of two
    sizes, left = [every], rows / bucket_rows / every
    while left >= 2:
        sizes.append(min(every, 1 << int(math.log2(left))))
        left /= sizes[-1]
    return sizes


def _signed(x: np.ndarray, table: int, number: int, size: int) -> np.ndarray:
    """Components along the first signed axes after a rotation."""
    turned = rotated(x, 16 * table + number)[:, : size // 2]
    return np.concatenate([turned, -turned], 1)


def buckets(x: np.ndarray, table: int, sizes: list[int]) -> np.ndarray:
    """The bucket of each row of unit vectors."""
    out = np.zeros(len(x), np.int64)
    for number, size in enumerate(sizes):
        out = out * size + _signed(x, table, number, size).argmax(1)
    return out


def probes(x: np.ndarray, table: int, sizes: list[int], n: int) -> np.ndarray:
    """Each row's n most likely buckets, likeliest first: those whose axes fall least short of the nearest ones; -1 where there are fewer."""
    cost, out = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for number, size in enumerate(sizes):
        signed = _signed(x, table, number, size)
        order = np.argsort(-signed, axis=1, kind="stable")[:, :n]
        short = (signed.max(1, keepdims=True) - np.take_along_axis(signed, order, 1)) ** 2
        cost = (cost[:, :, None] + short[:, None, :]).reshape(len(x), -1)
        out = (out[:, :, None] * size + order[:, None, :]).reshape(len(x), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :n]
        cost, out = np.take_along_axis(cost, best, 1), np.take_along_axis(out, best, 1)
    return np.pad(out, ((0, 0), (0, n - out.shape[1])), constant_values=-1)


def needed_probes(queries: np.ndarray, near: np.ndarray, owner: np.ndarray, sizes: list[int], tables: int, most: int) -> np.ndarray:
    """How many probes a table find each neighbour; more than most: most + 1. owner: the query that it is near to."""
    need = np.full(len(near), most + 1)
    for t in range(tables):
        at = probes(queries, t, sizes, most)[owner] == buckets(near, t, sizes)[:, None]
        need = np.minimum(need, np.where(at.any(1), at.argmax(1) + 1, most + 1))
    return need


def unit(x: np.ndarray, longest: float | None) -> np.ndarray:
    """longest: of stored vectors, which get what they lack of it as a component; None: a query."""
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    if longest is None:
        return np.concatenate([x / norm, np.zeros_like(norm)], 1)
    return np.concatenate([x, np.sqrt(np.maximum(longest * longest - norm * norm, 0))], 1) / longest


def _hashed(rows: DataFrame, longest: float | None, sizes: dict[int, list[int]], tables: int, n: int) -> DataFrame:
    """id, dim, vector, table, bucket: a row for each table and probe."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                for dim, part in batch.iloc[k : k + 1000].groupby("dim"):
                    x = unit(stacked(part["vector"], dim), longest)
                    for t in range(tables):
                        places = buckets(x, t, sizes[dim])[:, None] if longest is not None else probes(x, t, sizes[dim], n)
                        for place in places.T:
                            some = place >= 0
                            yield pd.DataFrame({"id": part["id"].to_numpy()[some], "dim": dim, "vector": part["vector"].to_numpy()[some], "table": t, "bucket": place[some]})

    return rows.select("id", "dim", "vector").mapInPandas(freeing(hashed), "id long, dim int, vector binary, table int, bucket long")


def _ranked(stored: DataFrame, asked: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """(query, id, score): of each group of keys, each query's keep best. Large groups are dealt out in
    chunks of both sides, and each side is sent once for each chunk of the other."""
    count = lambda rows, size, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    big = few(count(stored, CANDIDATES, "nc").join(count(asked, QUERIES, "nq"), keys).where(F.greatest("nc", "nq") > 1), "large-groups")
    left = stored.join(big, keys, "left").select(*keys, chunk("nc").alias("c"), each_chunk("nq").alias("q"), F.lit(False).alias("asked"), "id", "vector")
    right = asked.join(big, keys, "left").select(*keys, each_chunk("nc").alias("c"), chunk("nq").alias("q"), F.lit(True).alias("asked"), "id", "vector")
    by = [*keys, "c", "q"]

    def best(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        """Of each group, between two cuts: stored rows in the order of their ids, then queries."""
        ids, firsts = rows["id"].to_numpy(), np.concatenate([[0], np.cumsum(~rows["asked"].to_numpy(bool))])
        dims, vectors = rows["dim"].to_numpy(), rows["vector"]
        whole = stacked(vectors, int(dims[0])) if len(rows) and (dims == dims[0]).all() else None
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for s, e in zip(cuts, cuts[1:]):
            m = s + int(firsts[e] - firsts[s])
            if s == m or m == e:
                continue
            x = whole[s:e] if whole is not None else stacked(vectors.iloc[s:e], int(dims[s]))
            score = x[m - s :] @ x[: m - s].T
            n = min(keep, m - s)
            if n < m - s:  # whatever ties with the last place is sorted too
                limit = -np.partition(-score, n - 1, axis=1)[:, n - 1 : n]
                score = np.where(score >= limit, score, -np.inf)
            order = np.argsort(-score, axis=1, kind="stable")[:, :n]
            out.append((np.repeat(ids[m:e], n), ids[s:m][order].ravel(), np.take_along_axis(score, order, 1).ravel()))
        return pd.DataFrame(dict(zip(("query", "id", "score"), map(np.concatenate, zip(*out)))))

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the last group, which may go on
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch])
            key = batch[by].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
            yield best(batch.iloc[: cuts[-1]], cuts)
            held = batch.iloc[cuts[-1] :]
        if held is not None:
            yield best(held, [0, len(held)])

    return left.unionByName(right).repartition(*by).sortWithinPartitions(*by, "asked", "id").mapInPandas(freeing(groups), "query long, id long, score double")


def _first(found: DataFrame, group: str, name: str, n: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), name)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def search(rows: DataFrame, queries: DataFrame, nearest: int = NEAREST, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (rows of vec_id and embedding) the nearest other rows.

    Equal vectors are searched and stored once, with as many of their smallest vec_ids as one answer
    can hold. A query whose buckets hold too few is compared with all rows, in blocks, so it gets all
    there are. Vectors that are null, zero or empty or hold null or non-finite components take no
    part, nor rows without vec_id; vectors are compared with those of their length. Rows that repeat a
    vec_id count as one where their vectors are equal. An empty table gives no row; other columns are
    ignored."""
    keep = nearest + 1  # a query's own row is among them
    vectors = written(usable(rows).select("vec_id", "dim", "vector", "norm2").distinct(), "vectors")
    low = F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep)
    part = vectors.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))  # so no task gathers all copies of a vector
    parts = part.groupBy("dim", "vector", "_part").agg(low.alias("some"), F.max("norm2").alias("norm2"))
    classes = parts.groupBy("dim", "vector").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, keep).alias("ids"), F.max("norm2").alias("norm2"))
    classes = written(classes.withColumn("id", F.col("ids")[0]), "classes")
    asked = written(usable(queries).select("vec_id", "dim", "vector").distinct().join(classes.select("dim", "vector", "id"), ["dim", "vector"]).select("vec_id", "id"), "queries")
    query_classes = classes.join(asked.select("id").distinct(), "id", "left_semi").select("id", "dim", "vector")
    there = classes.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("norm2")).collect()  # a row for each length of vectors
    longest = math.sqrt(max((r["norm2"] for r in there), default=1.0))
    sizes = {r["dim"]: hash_sizes(r["n"], r["dim"], bucket_rows) for r in there}
    stored = classes.select("id", "dim", "vector")
    n = _fit(stored, query_classes, longest, sizes, tables, keep)
    hits = _ranked(_hashed(stored, longest, sizes, tables, 1), _hashed(query_classes, None, sizes, tables, n), ["table", "bucket", "dim"], keep)
    best = written(_first(hits.groupBy("query", "id").agg(F.max("score").alias("score")), "query", "id", keep).select("query", "id", "score"), "nearest")
    enough = classes.groupBy("dim").agg(F.least(F.count("*"), F.lit(keep)).alias("there"))
    short = query_classes.join(enough, "dim").join(best.groupBy("query").agg(F.count("*").alias("n")).withColumnRenamed("query", "id"), "id", "left").where(F.coalesce("n", F.lit(0)) < F.col("there")).select("id", "dim", "vector")
    short = written(short, "short")
    if short.limit(1).count():
        more = _ranked(stored, short, ["dim"], keep)
        best = _first(best.unionByName(more).groupBy("query", "id").agg(F.max("score").alias("score")), "query", "id", keep).select("query", "id", "score")
    named = best.join(classes.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    each = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("query")).join(_first(named, "query", "vec_id", keep).drop("rank"), "query").where("vec_id != query_id")
    return _first(each, "query_id", "vec_id", nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _fit(stored: DataFrame, queries: DataFrame, longest: float, sizes: dict[int, list[int]], tables: int, keep: int) -> int:
    """How many buckets a query looks into in each table, by FIT_QUERIES queries (those of the smallest hash) and their true neighbours."""
    some = written(queries.orderBy(F.xxhash64("id"), "id").limit(FIT_QUERIES), "fit-queries")
    true = _first(_ranked(stored, some, ["dim"], keep), "query", "id", keep).where("id != query").select("query", "id")
    pairs = true.join(some.select(F.col("id").alias("query"), "dim", F.col("vector").alias("asked")), "query").join(stored.select("id", "vector"), "id").toPandas()  # FIT_QUERIES * keep rows at most
    pairs = pairs.sort_values(["query", "id"])
    most = 32
    while len(pairs):
        need = []
        for dim, part in pairs.groupby("dim"):
            first = part.drop_duplicates("query")
            owner = np.searchsorted(first["query"].to_numpy(), part["query"].to_numpy())
            need.append(needed_probes(unit(stacked(first["asked"], dim), None), unit(stacked(part["vector"], dim), longest), owner, sizes[dim], tables, most))
        need = np.sort(np.concatenate(need))[math.ceil(WANTED * len(pairs)) - 1]
        if need <= most:
            return int(need)
        most *= 2
    return 1


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))
