"""Operator 9: near-duplicate vectors by collision counting.

Unit vectors are projected on many random directions, and sorted on each. Two vectors at a cosine of
0.98 or more are so near that their projections fall into one another's windows on most directions;
how many is known, so a count can be set that such a pair misses with a chance below MISS. Pairs that
reach the count are decided by their cosine.

A label of few vectors is one group. Those of a larger one are first dealt out by cells of a few
projections together, many times over: so many projections that a cell holds about BLOCK vectors that
are not alike, and so often that a pair at the limit shares no cell with a chance below MISS. A pair
counts in the first cell that both share. Large groups are compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import by_group, few, freeing, table, written
from tidelog.llm.components import components, spanning
from tidelog.llm.vectors import chunk, each_chunk, stacked, takes_part, usable

COSINE = 0.98
DIRECTIONS, SEED = 48, 11
#: Half a window, in distances of the farthest pair that is wanted.
HALF_WINDOW, MISS = 1.5, 1e-7
#: Vectors that are compared at a time, and those of a label that is one group.
BLOCK, WHOLE = 1024, 16_384
#: The width of a cell, in standard deviations of a unit vector's projections.
CELL = 1.0


def needed_collisions(directions: int = DIRECTIONS, half_window: float = HALF_WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the limit falls short of with a chance of at most miss; nearer pairs collide more often."""
    p = math.erf(half_window / math.sqrt(2))
    below = 0.0
    for k in range(directions + 1):
        below += math.comb(directions, k) * p**k * (1 - p) ** (directions - k)
        if below > miss:
            return k
    return directions


def directions(dim: int, n: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, n))


def same_cell(distance: float, width: float = CELL) -> float:
    """The chance that two unit vectors at a distance have projections in one cell of a grid with a random origin."""
    z = width / distance
    return math.erf(z / math.sqrt(2)) - math.sqrt(2 / math.pi) * (1 - math.exp(-z * z / 2)) / z


def cell_plan(n: int, cosine: float = COSINE, block: int = BLOCK, miss: float = MISS) -> tuple[int, int]:
    """Projections in a cell, and how often n vectors are dealt out."""
    k = max(1, math.ceil(math.log(n / block) / -math.log(same_cell(math.sqrt(2)))))
    return k, math.ceil(math.log(miss) / math.log1p(-(same_cell(math.sqrt(2 - 2 * cosine)) ** k)))


def cells(x: np.ndarray, k: int, times: int) -> np.ndarray:
    """The cell of each unit vector, as a number of 32 bits, each time it is dealt out."""
    rng = np.random.default_rng([SEED, 1, x.shape[1]])
    out = np.empty((len(x), times), np.int32)
    for t in range(times):
        place = np.floor(x @ rng.normal(size=(x.shape[1], k)) / CELL + rng.random(k)).astype(np.int64).astype(np.uint64)
        code = np.zeros(len(x), np.uint64)
        for c in place.T:
            code = (code ^ c) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(32)
        out[:, t] = code.astype(np.uint32).view(np.int32)
    return out


def collisions(p: np.ndarray, q: np.ndarray, width: float) -> np.ndarray:
    """On how many directions each row of q lies in the window of each row of p. At most 65535 rows of q, 255 directions."""
    out = np.zeros((len(p), len(q)), np.uint8)
    order = np.argsort(q, axis=0, kind="stable")
    for k in range(p.shape[1]):
        line = q[order[:, k], k]
        place = np.empty(len(q), np.uint16)
        place[order[:, k]] = np.arange(len(q), dtype=np.uint16)
        low, high = np.searchsorted(line, p[:, k] - width, "left"), np.searchsorted(line, p[:, k] + width, "right")
        low, size = low.astype(np.uint16)[:, None], (high - low).astype(np.uint16)[:, None]
        for a in range(0, len(p), 256):  # places before low wrap around to beyond any size
            out[a : a + 256] += (place[None, :] - low[a : a + 256]) < size[a : a + 256]
    return out


def near_pairs(x: np.ndarray, y: np.ndarray | None, cosine: float = COSINE) -> np.ndarray:
    """Pairs (row of x, row of y; i < j within x where y is None) with at least that cosine, found by collisions."""
    unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
    a = unit(x)
    b = a if y is None else unit(y)
    r = directions(x.shape[1])
    width = HALF_WINDOW * math.sqrt(2 - 2 * cosine)
    enough = collisions((a @ r).astype(np.float32), (b @ r).astype(np.float32), np.float32(width * 1.0001)) >= needed_collisions()
    i, j = np.nonzero(np.triu(enough, 1) if y is None else enough)
    keep = [np.zeros(0, bool)]
    other = x if y is None else y
    for k in range(0, len(i), 50_000):
        p, q = x[i[k : k + 50_000]], other[j[k : k + 50_000]]
        keep.append((p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))) >= cosine)
    ok = np.concatenate(keep)
    return np.stack([i[ok], j[ok]], 1)


def _dealt(classes: DataFrame, cosine: float, whole: int, block: int) -> DataFrame:
    """classes with time, cell and cells (all of the vector's, binary): a row for each time that a vector is dealt out."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    big = few(sizes.where(F.col("n") > whole), "large-labels")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                for (dim, n), part in batch.iloc[a : a + 1000].groupby(["dim", "n"]):
                    if n:
                        x = stacked(part["vector"], dim)
                        found = cells(x / np.sqrt((x * x).sum(1, keepdims=True)), *cell_plan(n, cosine, block))
                    else:
                        found = np.zeros((len(part), 1), np.int32)
                    part = part.drop(columns="n").assign(cells=[row.tobytes() for row in found])
                    for t, column in enumerate(found.T):
                        yield part.assign(time=t, cell=column)

    placed = classes.join(big, ["label", "dim"], "left").select("label", "dim", "id", "copies", "vector", F.coalesce("n", F.lit(0)).alias("n"))
    return placed.mapInPandas(freeing(deal), "label long, dim int, id long, copies long, vector binary, cells binary, time int, cell int")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of rows.

    Only rows of one label, not null, are compared. Vectors that are null, zero or empty or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Repeated rows are
    vectors of their own and link with each other. A null vec_id has no links, is kept, and has no
    component. An empty table gives no row; other columns are ignored."""
    vectors = written(usable(rows).where("label IS NOT NULL"), "vectors")
    classes = written(vectors.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    dealt = written(_dealt(classes, cosine, whole, block), "cells")
    group = ["label", "dim", "time", "cell"]
    sizes = dealt.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    large = few(sizes.where("chunks > 1"), "large-cells")
    spread = dealt.join(large, group, "left").withColumn("chunk", chunk("chunks")).withColumn("other", each_chunk("chunks"))
    blocks = spread.select(*group, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "copies", "vector", "cells")

    def compare(one: pd.DataFrame) -> pd.DataFrame:
        dim, time, i, j = (int(one[c].iloc[0]) for c in ("dim", "time", "i", "j"))
        left = one if i == j else one[one["chunk"] == i]
        right = None if i == j else one[one["chunk"] == j]
        if len(left) < 2 if right is None else not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="Int64")
        pairs = near_pairs(stacked(left["vector"], dim), None if right is None else stacked(right["vector"], dim), cosine)
        if right is not None:
            one, pairs = pd.concat([left, right]), pairs + np.array([0, len(left)])
        if time:  # pairs that shared an earlier cell are counted there
            before = np.frombuffer(b"".join(one["cells"]), np.int32).reshape(len(one), -1)[:, :time]
            fresh = [(before[pairs[k : k + 50_000, 0]] != before[pairs[k : k + 50_000, 1]]).all(1) for k in range(0, len(pairs), 50_000)]
            pairs = pairs[np.concatenate([np.zeros(0, bool), *fresh])]
        ids, copies = one["id"].to_numpy(), one["copies"].to_numpy()
        n = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(ids)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(ids))
        some, tree = np.flatnonzero(n), ids[spanning(pairs, len(ids))]
        return pd.DataFrame({"a": np.concatenate([ids[some], tree[:, 0]]), "b": pd.array([None] * len(some) + tree[:, 1].tolist(), "Int64"), "n": np.concatenate([n[some].astype(np.int64), np.zeros(len(tree), np.int64)])})

    found = written(by_group(blocks, [*group, "i", "j"], compare, "a long, b long, n long"), "collisions")
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    out = classes.join(links, "id", "left").join(labels, "id", "left").select("label", "dim", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    of_class = vectors.join(out, ["label", "dim", "vector"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~(takes_part(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    alone = rest.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    both = of_class.unionByName(alone)
    return both.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """All pairs of a label in DuckDB SQL."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND list_dot_product(x, x) > 0 AND list_dot_product(x, x) < 'infinity'::DOUBLE),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id != b.vec_id
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
walk(id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT walk.id, links.b FROM walk JOIN links ON links.a = walk.reached)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id)::BIGINT AS n_links, min(w.reached)::BIGINT AS component_id, v.vec_id = min(w.reached) AS kept
FROM v JOIN walk w ON w.id = v.vec_id GROUP BY v.vec_id"""
