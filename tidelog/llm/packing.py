"""Operator 3: concatenate and cut.

Every partition's tokens are counted, prefix sums over the partitions' totals give each document its
place in one long stream, and the stream is cut into fixed windows. Boundary records say which part of
which document lies where. Only the last window is not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import freeing, ids_of, part_offsets, table, with_ids, written
from tidelog.llm.tokens import encoder, public_path

WINDOW = 1024
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """docs with their ids, written to the shared folder: part, local_start, doc_id, n_tokens, ids (16 or 32 bits)."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for k in range(0, len(batch), 256):
                ids = enc.encode(batch["text"].iloc[k : k + 256].tolist())
                sizes = np.array([len(x) + 1 for x in ids], np.int64)
                ends = np.cumsum(sizes)
                yield pd.DataFrame({"part": part, "local_start": start + ends - sizes, "doc_id": ids_of(batch.iloc[k : k + 256]), "n_tokens": sizes, "ids": [x.tobytes() + end for x in ids]})
                start += int(ends[-1])

    texts = with_ids(docs, F.coalesce("text", F.lit("")).alias("text"))
    return written(texts.mapInPandas(freeing(encode), "part int, local_start long, doc_id long, n_tokens long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Boundary records with their ids (little-endian unsigned 32-bit): one row for each piece.

    padded_length is what the piece's sequence is padded to: the window, but a last sequence whose
    length is a power of two stays as it is. Null text counts as empty: the document is its end id
    alone. Null doc_id and repeated rows stay, each row a document of its own; an empty table gives no
    piece; other columns are ignored."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for name, place, n, total, data in zip(ids_of(batch), batch["place"], batch["n_tokens"], batch["total"], batch["ids"]):
                ids = np.frombuffer(data, f"<u{len(data) // n}").astype("<u4")
                at = 0
                while at < n:
                    seq, off = divmod(place + at, window)
                    size = min(window - off, n - at)
                    last = total - seq * window
                    full = last if last < window and last & (last - 1) == 0 else window
                    out.append((name, at, size, n, seq, off, full, ids[at : at + size].tobytes()))
                    at += size
                if len(out) >= 4096:
                    yield _frame(out)
                    out = []
            if out:
                yield _frame(out)

    tokens = tokenized(docs, tokenizer_path, end_id)
    places = part_offsets(tokens.select("part", "n_tokens"), "part", "n_tokens", "part_offset")
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    placed = tokens.join(F.broadcast(places), "part").crossJoin(F.broadcast(total))  # a row for each partition, and one row
    return with_ids(placed, (F.col("local_start") + F.col("part_offset")).alias("place"), "n_tokens", "total", "ids").mapInPandas(freeing(cut), PIECES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"])
    return frame.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))


def packed_digest(docs: DataFrame) -> DataFrame:
    pieces = pack(docs, public_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))
