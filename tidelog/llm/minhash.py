"""Operator 6: near-duplicates by bottom-k sketches.

One hash function orders a document's five-word shingles; the k smallest are its sketch. Documents
with equal sets are taken together first. Inverted lists of the sketches' smallest values bring the
others together; the overlap of two sketches, and then the share of common values in the sketch of
their union, filters pairs; full sets decide.

Short lists give all their pairs. Of a longer list, a tree over what looks alike is checked, of one of
many blocks a star around one member, so a group of n copies costs about n checks. Whoever is then
still apart from its list's first member is compared with the whole list, block by block: sketches
say which members need their full sets there, and full sets which are linked; each block gives a tree.
Long lists hold only documents that have few other values: a passage that half the corpus quotes
brings nobody together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import by_group, few, freeing, ids_of, table, with_ids, written
from tidelog.llm.components import components, spanning

SHINGLE, SKETCH = 5, 64
#: Linked: 100 * intersection >= SHARE * union.
SHARE = 75
#: Values of a sketch that are listed: all. A document with ENOUGH values that are not crowded stays out of
#: crowded lists: at the wanted similarity a quarter of its values at most may be its own, so even if just
#: those are the ones not crowded, 36 of 64 are with a chance of about 2e-8. Where the sketch is the whole
#: set, more values than that quarter are enough.
LISTED, ENOUGH = 64, 36
#: Documents in a block of a list; longer lists are dealt out in blocks.
BLOCK = 1024
#: Lists up to this length give all their pairs at once.
SHORT = 8
#: Common values of two full sketches from which a pair is checked: 48 are expected at a similarity of 0.75, and fewer than this about once in a million.
COMMON = 31
#: Members of full sets that a block's comparison takes up at a time.
AT_A_TIME = 2_000_000
#: Ids of 8 bytes that are broadcast.
FEW_IDS = 2_000_000
#: Bytes of the longest word that is hashed in numpy, and of text that is hashed at a time.
LONG_WORD, BATCH = 64, 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_numbers(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes a round, each round mixed; long words by blake2b."""
    length = end - start
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,)).copy()  # the eight bytes from each place on
    out = _mix((length.astype(np.uint64) + np.uint64(1)) * _ODD)
    long = length > LONG_WORD
    todo = np.flatnonzero(~long)
    for k in range(0, LONG_WORD, 8):
        todo = todo[length[todo] > k]
        if not len(todo):
            break
        out[todo] = _mix((out[todo] ^ (eight[start[todo] + k] & _MASKS[np.minimum(length[todo] - k, 8)])) * _ODD)
    for k in np.flatnonzero(long):
        out[k] = int.from_bytes(blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def _chained(word: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all runs of n words."""
    code = np.zeros(len(word) - n + 1, np.uint64)
    for k in range(n):
        code = _mix(code * _ODD + word[k : k + len(code)] + np.uint64(k + 1))
    return code if n == SHINGLE else code + np.uint64(n)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's set as sorted 64-bit hashes: its distinct shingles, or all its words as one where they are fewer than five.

    Two different shingles share a hash with a chance of 2 ** -64."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        group.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= BATCH or k == len(texts) - 1:
            raw = _LOWER[np.frombuffer(b"\n".join([*group, b""]), np.uint8)]  # a line feed ends every text
            edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw]]).view(np.int8)))
            start = edge[::2]
            word = word_numbers(raw, start, edge[1::2])
            code = _chained(word, SHINGLE) if len(word) >= SHINGLE else None
            cuts = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in group)])).tolist()
            for a, b in zip(cuts, cuts[1:]):
                out.append(np.unique(code[a : b - SHINGLE + 1]) if b - a >= SHINGLE else _chained(word[a:b], b - a) if b > a else np.zeros(0, np.uint64))
            group, size = [], 0
    return out


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def sketch(codes: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """The k smallest; the numbers are hashes already."""
    return codes[:k]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, same (equal for equal sets), sketch (binary), written once."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": ids_of(batch), "text_hash": batch["text_hash"], "n_shingles": [len(s) for s in sets], "same": [blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "sketch": [sketch(s).tobytes() for s in sets]})

    return written(with_ids(docs, "text", F.xxhash64("text").alias("text_hash")).mapInPandas(freeing(sign), "doc_id long, text_hash long, n_shingles long, same binary, sketch binary"), "signatures")


def _common(row: np.ndarray, col: np.ndarray, n: int, width: int, early: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many columns each two of n rows share, and how many of those by entries (row, col) that early marks."""
    common, before = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for a in range(0, width, 4096):
        b = min(a + 4096, width)
        part = (col >= a) & (col < b)
        has = np.zeros((n, b - a), np.float32)
        has[row[part], col[part] - a] = 1
        common += has @ has.T
        part &= early
        if part.any():
            first, at = np.unique(col[part], return_inverse=True)
            low = np.zeros((n, len(first)), np.float32)
            low[row[part], at] = 1
            before += low @ low.T
    return common, before


def _overlaps(sets: list[np.ndarray], sizes: np.ndarray, absent: np.ndarray, at: np.uint64, apart: np.ndarray | None = None) -> np.ndarray:
    """Pairs (i < j) of a list's members whose sketches have enough in common and no value before at whose list holds both.

    absent: for each member, bit k is set if the list of its k-th value leaves it out.
    apart: a matrix; only pairs that it marks count."""
    n, counts = len(sets), np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    need = np.minimum(COMMON, -(-3 * counts // 4))  # a partner's sketch has at least so many of one's values; that of a larger set shows only a part
    alive = np.ones(n, bool)
    place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    early = (values < at) & ((absent[owner] >> place) & 1 == 0)
    uniq, where = np.unique(values, return_inverse=True)
    for _ in range(2):  # values that nobody shares, then members with too few others
        times = np.bincount(where[alive[owner]], minlength=len(uniq))
        shared = np.bincount(owner, (times[where] > 1) & alive[owner], minlength=n)
        alive &= shared >= need
    if alive.sum() < 2:
        return np.zeros((0, 2), np.int64)
    members = np.flatnonzero(alive)
    times = np.bincount(where[alive[owner]], minlength=len(uniq))
    column = np.cumsum(times > 1) - 1
    used = alive[owner] & (times[where] > 1)
    row, col = (np.cumsum(alive) - 1)[owner[used]], column[where[used]]
    common, before = _common(row, col, len(members), int((times > 1).sum()), early[used])
    k, m = counts[members], sizes[members]
    whole = (m <= SKETCH)[:, None] & (m <= SKETCH)[None, :]
    enough = np.where(whole, 7 * common >= 3 * (k[:, None] + k[None, :]), common >= COMMON)
    near = 4 * np.minimum(m[:, None], m[None, :]) >= 3 * np.maximum(m[:, None], m[None, :])
    ok = np.triu(enough & near & (before == 0), 1)
    if apart is not None:
        ok &= apart[np.ix_(members, members)]
    i, j = np.nonzero(ok)
    return np.stack([members[i], members[j]], 1)


def _linked(sets: list[np.ndarray], apart: np.ndarray) -> np.ndarray:
    """Pairs (i < j) whose full sets are similar enough, of those that apart marks. Sets are read range by range, so many long ones take no more memory at a time."""
    n, size = len(sets), np.array([len(s) for s in sets])
    parts = max(1, -(-int(size.sum()) // AT_A_TIME))
    edges = np.array([(k << 64) // parts for k in range(parts)], np.uint64)
    cuts = np.concatenate([np.stack([np.searchsorted(s, edges) for s in sets]), size[:, None]], 1)
    common = np.zeros((n, n), np.float64)
    for k in range(parts):
        values = np.concatenate([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)])
        owner = np.repeat(np.arange(n), cuts[:, k + 1] - cuts[:, k])
        _, where, times = np.unique(values, return_inverse=True, return_counts=True)
        used = times[where] > 1
        column = np.cumsum(times > 1) - 1
        common += _common(owner[used], column[where[used]], n, int((times > 1).sum()), np.zeros(int(used.sum()), bool))[0]
    ok = np.triu(apart & (100 * common >= SHARE * (size[:, None] + size[None, :] - common)), 1)
    i, j = np.nonzero(ok)
    return np.stack([i, j], 1)


def _union_passes(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> bool:
    """Whether the sketch of the union leaves the similarity possible."""
    union = np.union1d(a, b)
    if n_a <= SKETCH and n_b <= SKETCH:
        return 100 * (len(a) + len(b) - len(union)) >= SHARE * len(union)
    union = union[:SKETCH]
    return len(np.intersect1d(a[a <= union[-1]], b[b <= union[-1]], assume_unique=True)) >= COMMON


def _numbers(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column]


def _trees(members: DataFrame) -> DataFrame:
    """Pairs (a, b): of each list (v, id, n_shingles, sketch, absent) a tree over what looks alike."""

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        found = _overlaps(_numbers(group["sketch"]), group["n_shingles"].to_numpy(), group["absent"].to_numpy(), np.int64(group["v"].iloc[0]).astype(np.uint64))
        ids = group["id"].to_numpy()[spanning(found, len(group))]
        return pd.DataFrame({"a": ids.min(1), "b": ids.max(1)})

    return by_group(members.select("v", "id", "n_shingles", "sketch", "absent"), ["v"], tree, "a long, b long")


def _still_apart(lists: DataFrame, labels: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between members of a list (v, id) that have different labels.

    Members whose label is not that of the list's first are compared with all members; both sides are
    dealt out in blocks, and a group is a block of either side."""
    marked = lists.join(labels, "id", "left").select("v", "id", F.coalesce("component_id", "id").alias("label"))
    per = marked.groupBy("v").agg(F.min_by("label", "id").alias("main"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low != high")
    some = marked.join(few(per.select("v", "main", "n"), "lists-apart"), "v")
    others = few(some.where("label != main").groupBy("v").agg(F.count("*").alias("r")), "others")
    some = written(some.join(others, "v").select("v", "id", "label", (F.col("label") != F.col("main")).alias("other"), F.ceil(F.col("n") / BLOCK).cast("int").alias("ni"), F.ceil(F.col("r") / BLOCK).cast("int").alias("nj")), "apart")
    i, j = F.pmod(F.xxhash64("id"), F.col("ni")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("nj")).cast("int")
    stored = some.select("v", "id", "label", F.lit(False).alias("asked"), i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"))
    asked = some.where("other").select("v", "id", "label", F.lit(True).alias("asked"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), j.alias("j"))
    dealt = stored.unionByName(asked).join(classes.select("id", "n_shingles", "sketch", "absent"), "id")

    def marks(group: pd.DataFrame) -> np.ndarray:
        label, side = group["label"].to_numpy(), group["asked"].to_numpy()
        return (label[:, None] != label[None, :]) & (side[:, None] != side[None, :])

    def possible(group: pd.DataFrame) -> pd.DataFrame:
        if group["asked"].nunique() < 2:
            return group.iloc[:0][["v", "i", "j", "id", "label", "asked"]]
        sizes, sets = group["n_shingles"].to_numpy(), _numbers(group["sketch"])
        found = _overlaps(sets, sizes, group["absent"].to_numpy(), np.int64(group["v"].iloc[0]).astype(np.uint64), marks(group))
        return group.iloc[np.unique(found)][["v", "i", "j", "id", "label", "asked"]]

    def links(group: pd.DataFrame) -> pd.DataFrame:
        found = _linked(_numbers(group["shingles"]), marks(group))
        ids = group["id"].to_numpy()[spanning(found, len(group))]
        return pd.DataFrame({"a": ids.min(1), "b": ids.max(1)})

    keys = ["v", "i", "j"]
    needed = written(by_group(dealt.select(*keys, "id", "label", "asked", "n_shingles", "sketch", "absent"), keys, possible, "v long, i int, j int, id long, label long, asked boolean"), "needed")
    sets = sets_of(needed.select("id").distinct())
    return written(by_group(needed.join(sets, "id").select(*keys, "id", "label", "asked", "shingles"), keys, links, "a long, b long").distinct(), "late-links")


def _short_pairs(listed: DataFrame) -> DataFrame:
    """All pairs (a < b) of short lists."""
    ids = listed.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    each = F.expr("flatten(transform(sequence(1, size(ids) - 1), k -> transform(slice(ids, k + 1, size(ids)), b -> struct(ids[k - 1] AS a, b AS b))))")
    return ids.select(F.explode(each).alias("p")).select("p.a", "p.b")


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that sizes and the sketch of the union leave possible."""

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = 4 * np.minimum(batch["n_a"], batch["n_b"]) >= 3 * np.maximum(batch["n_a"], batch["n_b"])
            batch = batch[near.to_numpy(bool)]
            keep = [_union_passes(x, y, m, n) for x, y, m, n in zip(_numbers(batch["of_a"]), _numbers(batch["of_b"]), batch["n_a"], batch["n_b"])]
            yield batch.loc[keep, ["a", "b"]]

    side = lambda name: classes.select(F.col("id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"of_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInPandas(freeing(possible), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= SHARE * (len(p) + len(q) - both))
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    return written(both.select("a", "b", "set_a", "set_b").mapInPandas(freeing(check), "a long, b long"), "verified")


def _sets(docs: DataFrame, ids: DataFrame, classes: DataFrame, repeats: bool) -> DataFrame:
    """id, shingles (binary) of the named classes, from a document of each. repeats: a doc_id may stand in several rows.

    Few ids, by their count, go to where the texts are; many are joined with a shuffle of the texts."""

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "shingles": [x.tobytes() for x in shingle_sets(batch["text"].tolist())]})

    wanted = few(classes.join(ids, "id", "left_semi").select("id", "doc_id", "text_hash"), "wanted", FEW_IDS)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).join(wanted, ["doc_id", "text_hash"]).select("id", "text")
    found = found.mapInPandas(freeing(full), "id long, shingles binary")
    return written(found.dropDuplicates(["id"]) if repeats else found, "sets")


def _named(classes: DataFrame, full: DataFrame) -> DataFrame:
    """classes with ids of their own where rows that repeat a doc_id bring it into several: a hash that is no doc_id, no other's id."""
    clash = classes.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id")
    known = full.select(F.col("doc_id").alias("id")).distinct()
    alone, several = classes.join(clash, "id", "left_anti"), classes.join(clash, "id", "left_semi")
    for salt in range(100):
        fresh = written(several.withColumn("id", F.xxhash64("same", F.lit(salt))), "named")
        if not fresh.join(known, "id", "left_semi").limit(1).count() and not fresh.groupBy("id").count().where("count > 1").limit(1).count():
            return written(alone.unionByName(fresh), "classes")
    raise RuntimeError("no free ids")


def _different(lists: DataFrame) -> DataFrame:
    """Of lists (v, id) with the same members, the one of the least value: near copies share many values, and one list says it all.

    Values are compared as the unsigned numbers that they are, as _overlaps does. Members are told by
    their number and two hashes over all of them."""
    per = lists.groupBy("v").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    first = per.groupBy("n", "x", "y").agg(F.min(F.struct(F.col("v") < 0, "v")).alias("_first"))
    return lists.join(first.select("_first.v"), "v", "left_semi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Null and empty texts, and texts of white space, have an empty set and are linked with nothing, not
    even with each other. A null doc_id has no name to be linked by: it is kept, with a null
    component_id. Rows that repeat a doc_id stay and share its component: each text's links count for
    the doc_id. An empty table gives no row; other columns are ignored."""
    signed = signatures(docs)
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    repeats = full.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    first = F.min(F.struct("doc_id", "text_hash"))
    classes = full.groupBy("same").agg(first.alias("_first"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes = written(classes.select("same", F.col("_first.doc_id").alias("id"), "_first.*", "n_shingles", "sketch", "copies"), "classes")
    if repeats:
        classes = _named(classes, full)
    copies = full.select("same", F.col("doc_id").alias("b")).join(classes.where("copies > 1 OR id != doc_id").select("same", F.col("id").alias("a")), "same").select("a", "b").where("a != b").distinct()

    @F.pandas_udf("array<long>")
    def first_values(sketches: pd.Series) -> pd.Series:
        return sketches.map(lambda s: np.frombuffer(s, np.int64)[:LISTED])

    index = classes.select("id", F.posexplode(first_values("sketch")).alias("place", "v"))
    often = written(index.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "often")
    hot = few(often.where(F.col("n") > BLOCK), "hot")  # with its count beside the index rows, so no task gathers a hot value's
    cold = index.join(hot, "v", "left_anti").join(often.where(F.col("n") <= BLOCK), "v")
    listed = written(cold.unionByName(index.join(hot, "v")), "lists")
    crowded = listed.where(F.col("n") > BLOCK).groupBy("id").agg(F.count("*").alias("hot"), F.sum(F.expr("shiftleft(1L, place)")).alias("places"))
    own = F.when(F.col("n_shingles") <= SKETCH, F.col("n_shingles") - F.col("hot") <= F.floor(F.col("n_shingles") * (100 - SHARE) / 100))
    left = own.otherwise(LISTED - F.col("hot") < ENOUGH)
    # of a crowded value's list, who has enough other values is absent
    placed = classes.join(crowded, "id", "left").select("id", "n_shingles", "sketch", F.when(~left, F.col("places")).otherwise(0).alias("absent"))
    lean = classes.join(crowded, "id").where(left).select("id")
    short = min(SHORT, BLOCK)
    middle = written(_different(listed.where((F.col("n") > short) & (F.col("n") <= BLOCK)).select("v", "id")), "middle-lists")
    long = written(listed.where(F.col("n") > BLOCK).join(lean, "id", "left_semi").select("v", "id"), "long-lists")
    star = long.join(few(long.groupBy("v").agg(F.min("id").alias("a")), "stars"), "v").where("a != id").select("a", F.col("id").alias("b")).distinct()
    pairs = _possible(_short_pairs(listed.where(F.col("n") <= short)).unionByName(star).distinct(), classes)
    trees = _trees(middle.join(placed, "id"))
    first = written(pairs.unionByName(trees).distinct(), "pairs")
    sets_of = lambda ids: _sets(docs, ids, classes, repeats)
    linked = _verified(first, sets_of(first.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    late = _still_apart(middle.unionByName(long), components(linked), placed, sets_of)
    found = components(linked.unionByName(copies).unionByName(late))
    if repeats:  # a class may have an id that is no document's
        real = found.join(full.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
        found = real.join(real.groupBy("component_id").agg(F.min("id").alias("_least")), "component_id").select("id", F.col("_least").alias("component_id"))
    return signed.join(found, signed["doc_id"] == found["id"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all columns; of rows that repeat a doc_id, the one whose hash over all columns is least."""
    found = written(near_duplicates(docs), "found")
    names = docs.columns
    gone = few(found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone", FEW_IDS)
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    times = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1")
    again = few(times.select(F.col("doc_id").alias("_again")), "again", FEW_IDS)
    if not again.limit(1).count():
        return kept
    several = kept.join(again, F.col("doc_id").cast("long") == F.col("_again"), "left_semi").withColumn("_row", F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind)))
    least = several.groupBy(F.col("doc_id").alias("_id")).agg(F.min("_row").alias("_least"))
    one = several.join(least, (F.col("doc_id") == F.col("_id")) & (F.col("_row") == F.col("_least"))).select(*names).dropDuplicates(["doc_id"])
    return kept.join(again, F.col("doc_id").cast("long") == F.col("_again"), "left_anti").unionByName(one)


def oracle() -> str:
    """The same in DuckDB SQL: all shingles, all pairs that share one, and a walk over the links."""
    return r"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM ws),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id != y.doc_id GROUP BY ALL) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
walk(id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.id, links.b FROM walk JOIN links ON links.a = walk.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(reached)::BIGINT AS component_id FROM walk GROUP BY id) m ON m.id = d.doc_id"""
