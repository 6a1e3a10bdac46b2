"""Operator 4: token ids in files, one wavelet matrix for each shard.

A shard's ids are numbered densely; bit k of the numbers makes one plane, and each plane orders the
next one stably by its bits. Planes are stored packed with their counts of ones before each block,
which is all that access, rank, select, counting and occurrence lookup need: rank counts on from a
block's count, select searches the counts and then one block. Each shard is a compressed file of its own.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import freeing, part_offsets, shared_dir, table, with_ids
from tidelog.llm.tokens import encoder, public_path

MAGIC, BLOCK, SEED = b"WVM1", 64, 3  # BLOCK: bytes between two stored counts
#: Tokens after which a shard is closed; a document is never cut.
SHARD_TOKENS = 1 << 21
SHARD_SCHEMA = "part int, shard int, local_start long, n_tokens long, doc_ids array<long>, no_ids array<boolean>, doc_tokens array<long>, payload binary"


class WaveletMatrix:
    """A sequence of unsigned ids."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray], counts: list[np.ndarray]):
        self.n, self.alphabet, self.zeros, self.planes, self.counts = n, alphabet, zeros, planes, counts

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        n = len(ids)
        alphabet = np.flatnonzero(np.bincount(ids)).astype("<u4") if n else np.zeros(0, "<u4")
        depth = max(0, int(len(alphabet) - 1).bit_length()) if n else 0
        kind = np.uint16 if depth <= 16 else np.uint32
        number = np.zeros(int(alphabet[-1]) + 1 if n else 1, kind)
        number[alphabet] = np.arange(len(alphabet), dtype=kind)
        now = number[ids] if n else np.zeros(0, kind)
        zeros, planes, counts = [], [], []
        for level in range(depth):
            ones = (now & kind(1 << (depth - 1 - level))) != 0
            plane = np.packbits(ones)
            low, high = now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))
            now = np.concatenate([low, high])
            zeros.append(len(low))
            planes.append(plane)
            counts.append(_counts(plane))
        return cls(n, alphabet, zeros, planes, counts)

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QII", self.n, len(self.alphabet), len(self.planes)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        return b"".join([head, self.alphabet.tobytes(), *(x.tobytes() for x in self.counts), *(x.tobytes() for x in self.planes)])

    @classmethod
    def from_bytes(cls, data: bytes) -> "WaveletMatrix":
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, sigma, depth = struct.unpack_from("<QII", data, 4)
        zeros = list(struct.unpack_from(f"<{depth}Q", data, 20))
        at = 20 + 8 * depth
        alphabet = np.frombuffer(data, "<u4", sigma, at)
        at += 4 * sigma
        size = (n + 7) // 8
        blocks = (size + BLOCK - 1) // BLOCK
        counts = [np.frombuffer(data, "<u4", blocks, at + 4 * blocks * k) for k in range(depth)]
        at += 4 * blocks * depth
        return cls(n, alphabet, zeros, [np.frombuffer(data, np.uint8, size, at + size * k) for k in range(depth)], counts)

    def tokens(self) -> np.ndarray:
        """All ids, from the deepest plane upwards."""
        depth = len(self.planes)
        kind = np.uint16 if depth <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(depth - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            z = self.zeros[level]
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~ones)] = now[:z]
            up[np.flatnonzero(ones)] = now[z:] | kind(1 << (depth - 1 - level))
            now = up
        return self.alphabet.take(now)

    def _rank1(self, level: int, i: int) -> int:
        byte = i >> 3
        block = byte // BLOCK
        if block >= len(self.counts[level]):
            return self.n - self.zeros[level]
        part = self.planes[level][block * BLOCK : byte + (1 if i & 7 else 0)]
        total = int(self.counts[level][block]) + int(np.bitwise_count(part).sum())
        return total - (int(part[-1] & ((1 << (8 - (i & 7))) - 1)).bit_count() if i & 7 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (7 - (i & 7))) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _leaf(self, code: int, until: int) -> tuple[int, int]:
        """Where the ids of a code stand below the deepest plane, of the first until ids."""
        low, high = 0, until
        for level in range(len(self.planes)):
            a, b = self._rank1(level, low), self._rank1(level, high)
            if code >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The places of ones (bit 1) or zeros number k (from 0) of a plane."""
        ones = self.counts[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * (8 * BLOCK) - ones
        block = np.searchsorted(before, k, "right") - 1
        part = block[:, None] * BLOCK + np.arange(BLOCK)
        held = np.where(part < len(self.planes[level]), self.planes[level].take(part, mode="clip"), 0).astype(np.uint8)
        bits = np.unpackbits(held, axis=1) ^ (1 - bit)
        return block * (8 * BLOCK) + (np.cumsum(bits, axis=1, dtype=np.int16) <= (k - before[block])[:, None]).sum(1)

    def _up(self, code: int, place: np.ndarray) -> np.ndarray:
        """The places in the text of places below the deepest plane."""
        for level in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - level) & 1
            place = self._select(level, bit, place - self.zeros[level] * bit)
        return place

    def rank(self, token: int, i: int) -> int:
        """How often token occurs among the first i ids."""
        code = self._code(token)
        if code is None:
            return 0
        low, high = self._leaf(code, min(max(i, 0), self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of occurrence k (from 0) of token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        code = self._code(token)
        return int(self._up(code, np.array([self._leaf(code, self.n)[0] + k]))[0])

    def occurrences(self, token: int) -> list[int]:
        """All places of token, a few thousand at a time."""
        code = self._code(token)
        if code is None:
            return []
        low, high = self._leaf(code, self.n)
        return [x for a in range(low, high, 4096) for x in self._up(code, np.arange(a, min(a + 4096, high))).tolist()]


def _counts(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of BLOCK bytes."""
    starts = np.arange(0, len(plane), BLOCK)
    ones = np.add.reduceat(np.bitwise_count(plane).astype(np.uint32), starts) if len(plane) else np.zeros(0, np.uint32)
    return (np.cumsum(ones) - ones).astype("<u4")


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shard files of docs (doc_id, text), in ascending doc_id order, as a table in the shared folder.

    Null text counts as empty: the document is its end id alone. Null doc_id comes first; rows of one
    doc_id are ordered by a hash of their texts, and repeated rows stay: however many there are, they
    may lie in many tasks. An empty table gives no shard. Other columns are ignored."""

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, shard, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], enc.dtype)
        names: list = []
        docs_: list[np.ndarray] = []
        size = 0

        def close() -> pd.DataFrame:
            ids = np.concatenate([x for d in docs_ for x in (d, end)])
            row = {"part": part, "shard": shard, "local_start": start, "n_tokens": len(ids), "doc_ids": [k for k, _ in names], "no_ids": [none for _, none in names], "doc_tokens": [len(d) + 1 for d in docs_], "payload": WaveletMatrix.build(ids).to_bytes()}
            return pd.DataFrame([row])

        for batch in batches:
            for k in range(0, len(batch), 256):
                for name, ids in zip(zip(batch["doc_id"].iloc[k : k + 256].tolist(), batch["no_id"].iloc[k : k + 256].tolist()), enc.encode(batch["text"].iloc[k : k + 256].tolist())):
                    names.append(name)
                    docs_.append(ids)
                    size += len(ids) + 1
                    if size >= shard_tokens:
                        yield close()
                        names, docs_, shard, start, size = [], [], shard + 1, start + size, 0
        if docs_:
            yield close()

    spark = docs.sparkSession
    texts = with_ids(docs, F.coalesce("text", F.lit("")).alias("text")).withColumns({"_hash": F.xxhash64("text"), "_deal": F.rand(SEED)})
    ordered = texts.repartitionByRange(~F.col("no_id"), "doc_id", "_hash", "_deal").sortWithinPartitions(~F.col("no_id"), "doc_id", "_hash", "text").select("doc_id", "no_id", "text")
    path = f"{shared_dir(spark)}/tables/wavelet-shards-{uuid.uuid4().hex}"
    ordered.mapInPandas(freeing(shards), SHARD_SCHEMA).write.partitionBy("part", "shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """Each document's ids, read from shard files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = WaveletMatrix.from_bytes(row.payload).tokens()
                sizes = np.asarray(row.doc_tokens, np.int64)
                ends = np.cumsum(sizes)
                yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(np.asarray(row.doc_ids, np.int64), np.array(row.no_ids, bool)), "start": row.local_start + row.offset + ends - sizes, "n_tokens": sizes, "ids": [ids[e - s : e].tobytes() for s, e in zip(sizes, ends)]})

    offsets = part_offsets(shards.select("part", "n_tokens"), "part", "n_tokens", "offset")
    placed = shards.join(F.broadcast(offsets), "part")  # a row for each partition of the write
    return placed.select("local_start", "offset", "doc_ids", "no_ids", "doc_tokens", "payload").mapInPandas(freeing(documents), "doc_id long, start long, n_tokens long, ids binary")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_shards(write_shards(table(spark, sf_dir, "documents"), public_path(), end_id=2))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
