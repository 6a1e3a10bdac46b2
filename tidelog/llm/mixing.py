"""Operator 5: mixing sources to target weights.

The words of each source form one stream, cut into blocks of fixed length. The mix is a sequence of
slots in output shards; a multinomial draw deals each shard's slots out to the sources, and slot k of a
source names the block that a pseudorandom permutation of the source's blocks has at k. Slots and
blocks are then joined by source and block. Nothing is sorted at random and no source is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import freeing, part_offsets, table, written

WORD = r"[^\x20\x09-\x0D]+"
#: The dealt weights, by code point order of the sources, and the most passes over a source.
WEIGHTS, PASSES = (5, 2, 1), 3
BLOCK_WORDS, SHARD_SLOTS, SEED = 128, 4096, 17
#: Sources are named by a mixing recipe; their totals (one row each) go to the driver up to this many.
MOST_SOURCES = 100_000
#: Equal rows that one task deals out at a time.
COPIES = 1024
SLOTS = "source_rank int, block long, pass int, words long, shard long, slot long"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> list[float]:
    """What each source gives: shares of the total size by weight, at most passes times its size; what is over goes to the others by weight."""
    weight = [float(weights[k % len(weights)]) for k in range(len(sizes))]
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weight[k] for k in sorted(open_))
        share = {k: left * weight[k] / total for k in sorted(open_)}
        full = [k for k in sorted(open_) if share[k] > passes * sizes[k]]
        if not full:
            for k, v in share.items():
                out[k] = v
            break
        for k in full:
            out[k] = float(passes * sizes[k])
            left -= out[k]
            open_.remove(k)
    return out


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Permutation:
    """A keyed bijection of range(n): a Feistel network over the next even power of two, walked until it is back in range."""

    def __init__(self, n: int, *key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [int(k) for k in np.random.default_rng(list(key)).integers(0, 1 << 63, 4)]

    def _round_trip(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        x = np.asarray(x, np.uint64).copy()
        todo = np.arange(len(x))
        while len(todo):
            high, low = x[todo] >> self.half, x[todo] & self.mask
            for k in keys:
                if back:
                    high, low = low ^ (_mixed(high, k) & self.mask), high
                else:
                    high, low = low, high ^ (_mixed(low, k) & self.mask)
            x[todo] = high << self.half | low
            todo = todo[x[todo] >= np.uint64(self.n)]
        return x.astype(np.int64)

    def at(self, k: np.ndarray) -> np.ndarray:
        return self._round_trip(k, self.keys, False)

    def place_of(self, block: np.ndarray) -> np.ndarray:
        return self._round_trip(block, self.keys[::-1], True)


class Plan:
    """How many slots each source has, how long its blocks are, and what its last slot still takes."""

    def __init__(self, sizes: list[int], wanted: list[int], block_words: int, seed: int):
        self.sizes, self.block_words, self.seed = sizes, block_words, seed
        self.blocks = [-(-s // block_words) for s in sizes]
        self.slots, self.last = [], []
        for k, (size, want) in enumerate(zip(sizes, wanted)):
            if not size or not want:
                self.slots.append(0)
                self.last.append(0)
                continue
            full, rest = divmod(want, size)
            if not rest:
                self.slots.append(full * self.blocks[k])
                self.last.append(None)
                continue
            tail = size - (self.blocks[k] - 1) * block_words
            place = int(self.permutation(k, full).place_of(np.array([self.blocks[k] - 1]))[0])
            upto = lambda j, p=place, t=tail: j * block_words - (block_words - t) * (p < j)
            need = -(-rest // block_words)
            need += upto(need) < rest
            self.slots.append(full * self.blocks[k] + need)
            self.last.append(rest - upto(need - 1))

    def permutation(self, source: int, pass_: int) -> Permutation:
        return Permutation(self.blocks[source], self.seed, source, pass_)

    def shards(self, low: int, high: int, shard_slots: int) -> Iterator[tuple[int, list[int], list[int]]]:
        """(shard, first slot of each source, slots of each source) for low <= shard < high.

        The shards are halved again and again; the left half's counts are drawn from a multinomial
        over what each source still has, held to what is there. Any range of shards can so be made
        by itself, and over all shards every source has exactly its slots."""
        total = sum(self.slots)

        def halves(a: int, b: int, first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
            if a >= high or b <= low:
                return
            if b - a == 1:
                yield a, first.tolist(), counts.tolist()
                return
            mid = (a + b) // 2
            n = min(mid * shard_slots, total) - a * shard_slots
            rng = np.random.default_rng([self.seed, a, b])
            left = np.zeros(len(counts), np.int64)
            while n > left.sum():
                room = counts - left
                left += np.minimum(rng.multinomial(n - left.sum(), room / room.sum()), room)
            yield from halves(a, mid, first, left)
            yield from halves(mid, b, first + left, counts - left)

        yield from halves(0, -(-total // shard_slots), np.zeros(len(self.slots), np.int64), np.array(self.slots, np.int64))


def sized(docs: DataFrame) -> DataFrame:
    """Rows of docs without their texts, with size and text_hash; written once."""
    text = F.coalesce("text", F.lit(""))
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash")), "sizes")


def placed(sizes: DataFrame, ranks: DataFrame, rows: int) -> DataFrame:
    """Each row's first word in its source's stream (start). Streams run through hash buckets of doc_id and
    text, about as many as the square root of the rows, so neither a bucket of the largest source nor a
    source's list of buckets is large. Equal rows stand one after the other; they are counted first, so
    however many there are, one row goes into the order."""
    buckets = math.isqrt(rows) + 1
    named = sizes.join(F.broadcast(ranks), sizes["source"].eqNullSafe(ranks["source"])).select("doc_id", sizes["source"], "size", "text_hash", "source_rank")
    dealt = named.groupBy("source_rank", "source", "doc_id", "size", "text_hash").agg(F.count("*").alias("copies")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    amount = F.col("size") * F.col("copies")
    within = Window.partitionBy("source_rank", "bucket").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("source_rank", "bucket").agg(F.sum(amount).alias("_n")).select("source_rank", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(totals, ["source_rank", "bucket"])
    first = own.select("doc_id", "source", "source_rank", "size", "text_hash", (F.col("_own") + F.col("_before")).cast("long").alias("start"), "copies")
    some = first.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("_part"))
    many = some.where(F.col("copies") > COPIES).repartition("doc_id", "text_hash", "_part").unionByName(some.where(F.col("copies") <= COPIES))
    each = many.withColumn("_k", F.explode(F.sequence(F.col("_part") * COPIES, F.least(F.col("_part") * COPIES + COPIES, F.col("copies")) - 1)))
    return each.select("doc_id", "source", "source_rank", "size", "text_hash", (F.col("start") + F.col("_k") * F.col("size")).alias("start"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces).

    rows: doc_id, source, source_rank, size, text_hash, start, source_size, target: a row for each of
    docs. pieces: the runs of words that the mix takes: doc_id, source_rank, start, text_hash, size,
    shard, slot, pass, first (in the document) and length.

    Null text has no words and is taken 0 times; null source is a source of its own, the last; null
    doc_id is a name like others; repeated rows are documents of their own. An empty table gives no
    row. Reruns give the same mix; other columns are ignored."""
    spark = docs.sparkSession
    sizes = sized(docs)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    amounts = [int(r["n"]) for r in totals]
    wanted = targets(amounts, weights, passes)
    plan = Plan(amounts, [min(passes * s, math.floor(t + 0.5)) for s, t in zip(amounts, wanted)], block_words, seed)
    ranks = spark.createDataFrame([(r["source"], k, s, t) for k, (r, s, t) in enumerate(zip(totals, amounts, wanted))], "source string, source_rank int, source_size long, target double")
    rows = written(placed(sizes, ranks, sum(int(r["rows"]) for r in totals)), "streams").join(F.broadcast(ranks.drop("source")), "source_rank")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                for shard, firsts, counts in plan.shards(int(shard), int(shard) + 1, shard_slots):
                    order = np.random.default_rng([plan.seed, shard]).permutation(sum(counts))
                    at = 0
                    for source, (first, count) in enumerate(zip(firsts, counts)):
                        if not count:
                            continue
                        k = np.arange(first, first + count)
                        m = plan.blocks[source]
                        pass_ = k // m
                        block = np.empty(count, np.int64)
                        for p in np.unique(pass_):
                            block[pass_ == p] = plan.permutation(source, int(p)).at(k[pass_ == p] % m)
                        words = np.where(block == m - 1, plan.sizes[source] - (m - 1) * block_words, block_words)
                        if first + count == plan.slots[source] and plan.last[source] is not None:
                            words[-1] = plan.last[source]
                        yield pd.DataFrame({"source_rank": source, "block": block, "pass": pass_, "words": words, "shard": shard, "slot": order[at : at + count]})
                        at += count

    shards = -(-sum(plan.slots) // shard_slots)
    dealt = spark.range(0, shards, 1, max(1, min(shards, 8 * spark.sparkContext.defaultParallelism))).mapInPandas(freeing(slots), SLOTS)
    first, last = F.col("start") / block_words, (F.col("start") + F.col("size") - 1) / block_words
    blocks = rows.where("size > 0").select("doc_id", "source_rank", "start", "text_hash", "size", F.explode(F.sequence(F.floor(first), F.floor(last))).alias("block"))
    begin = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))  # in the block
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.col("words"))
    taken = blocks.join(dealt.hint("merge"), ["source_rank", "block"]).where(end > begin)  # a row for each slot: it grows with the words
    pieces = taken.select("doc_id", "source_rank", "start", "text_hash", "size", "shard", "slot", "pass", (F.col("block") * block_words + begin - F.col("start")).alias("first"), (end - begin).alias("length"))
    return rows, pieces


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mix(table(spark, sf_dir, "documents"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    sums = pieces.groupBy("source_rank", "start").agg(F.sum("length").alias("taken"))
    full = rows.where("size > 0").join(sums, ["source_rank", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return full.select(out).unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(out))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs after the mix, with their columns: a row for each document and pass that takes any of its words.

    A pass that takes all words keeps the text; one that takes some keeps those words in their order,
    a space between two. n_chars is counted anew. Equal rows of docs share one text, so each is found
    by doc_id and hash."""
    rows, pieces = mix(docs)
    runs = pieces.groupBy("doc_id", "source_rank", "text_hash", "size", "start", "pass").agg(F.sum("length").alias("taken"), F.sort_array(F.collect_list(F.struct("first", "length"))).alias("runs"))
    sources = rows.select("source_rank", F.col("source").alias("name")).distinct()
    runs = runs.join(F.broadcast(sources), "source_rank")  # a row for each source
    runs = runs.select(*(F.col(c).alias(f"_mix_{c}") for c in ("doc_id", "name", "text_hash", "size", "taken", "runs")))
    texts = docs.withColumn("_mix_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    if rows.groupBy("doc_id", "source", "text_hash").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "source", "_mix_hash"])
    joined = texts.join(runs, texts["doc_id"].cast("long").eqNullSafe(runs["_mix_doc_id"]) & texts["source"].cast("string").eqNullSafe(runs["_mix_name"]) & (texts["_mix_hash"] == runs["_mix_text_hash"]))
    partly = F.col("_mix_taken") < F.col("_mix_size")
    joined = joined.withColumn("_mix_words", F.when(partly, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    kept = F.array_join(F.flatten(F.transform("_mix_runs", lambda r: F.slice(F.col("_mix_words"), (r["first"] + 1).cast("int"), r["length"].cast("int")))), " ")
    cut = joined.withColumn("text", F.when(partly, kept).otherwise(F.col("text")))
    names = docs.columns
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else cut.select(*names)
