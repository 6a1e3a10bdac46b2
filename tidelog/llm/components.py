"""Connected components of an edge list, by alternating star contractions, and trees of small ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import written


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Every node's neighbours (larger: the larger ones; else the smaller ones and the node) tied to the smallest of its neighbourhood."""
    pairs = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = pairs.join(least, "a")
    if larger:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component_id) for every node of links (a, b); component_id is the smallest node reachable.

    Every round ties each node's larger neighbours to its smallest neighbour, then its smaller ones;
    the edge list ends as stars, in about log(n) rounds or fewer. Each round's list is written to the
    shared folder, so lost executors repeat one round at most. No component is gathered anywhere.
    Repeated links, links to oneself and an empty list are fine; null ends are dropped."""
    now = written(links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        now = written(_stars(_stars(now, True), False), "links")
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("component_id")).select(F.col("a").alias("id"), "component_id").unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


def spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """Pairs that join all that pairs join: from the member with most partners on, each new one by the pair that reached it first."""
    if len(pairs) < 2:
        return pairs[:, :2]
    i, j = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    degree = np.bincount(i, minlength=n)
    first = np.cumsum(degree) - degree
    seen = np.zeros(n, bool)
    out = []
    for root in np.argsort(-degree, kind="stable"):
        if seen[root] or not degree[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            k = todo.pop(0)
            fresh = j[first[k] : first[k] + degree[k]]
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            out.append(np.stack([np.full(len(fresh), k), fresh], 1))
            todo += fresh[np.argsort(-degree[fresh], kind="stable")].tolist()
    return np.concatenate(out)
