"""Vectors as rows: what takes part, and groups of them dealt out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidelog.llm.common import freeing


def takes_part(vector: Column) -> Column:
    """True for a vector that is not null, zero or empty and has finite components only."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, dim, vector (binary: floats as they come, or doubles) and norm2 of the rows whose vector takes part and that have a vec_id."""
    single = isinstance(rows.schema[vector].dataType.elementType, FloatType)
    kind = np.dtype("<f4" if single else "<f8")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len).to_numpy()
            for dim in np.unique(sizes):
                part = batch[sizes == dim]
                x = np.concatenate(part["v"].tolist()).astype(kind).reshape(len(part), dim) + kind.type(0)  # -0 and 0 are one
                data, width = x.tobytes(), int(dim) * kind.itemsize
                norm2 = (x.astype(np.float64) ** 2).sum(1)
                yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"].astype("Int64"), "dim": int(dim), "vector": [data[k : k + width] for k in range(0, len(data), width)], "norm2": norm2})

    label = F.col("label").cast("long") if "label" in rows.columns else F.lit(None).cast("long")
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v")).where(takes_part(F.col("v")) & F.col("vec_id").isNotNull())
    return some.mapInPandas(freeing(pick), "vec_id long, label long, dim int, vector binary, norm2 double")


def stacked(column: pd.Series, dim: int) -> np.ndarray:
    """A matrix of the vectors of a column, as doubles."""
    data = b"".join(column)
    return np.frombuffer(data, "<f4" if len(data) == 4 * dim * len(column) else "<f8").reshape(len(column), dim).astype(np.float64)


def chunk(n: str, salt: int = 0) -> Column:
    """Which of n chunks (a column; null: one) an id is in."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.coalesce(F.col(n), F.lit(1))).cast("int")


def each_chunk(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
