"""Embeddings as packed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(df: DataFrame, vec_id: str, embedding: str, keep: str | None = None) -> DataFrame:
    """(vec_id, kept, vec): the components as packed doubles; null if the vector takes no part.

    Null, empty and zero vectors, and those with null or non-finite components, take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2):
                values = None if not v.is_valid else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                good = values is not None and len(values) and np.isfinite(values).all() and values.any()
                out.append(values.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "kept", "vec"])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(keep) if keep else F.lit(None).cast("int")).alias("kept"), F.col(embedding).alias("e"))
    return rows.mapInArrow(run, f"vec_id bigint, kept {rows.schema['kept'].dataType.simpleString()}, vec binary")


def matrix(column, dim: int) -> np.ndarray:
    """Packed vectors of one dimension as the rows of a matrix."""
    parts = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return np.frombuffer(b"".join(parts), np.float64).reshape(-1, dim)


def sample_of(packed: DataFrame, rows: int, where: str = "vec IS NOT NULL AND vec_id IS NOT NULL") -> np.ndarray:
    """At most ``rows`` vectors, chosen by a hash of the id; those of the commonest dimension among them."""
    taken = packed.where(where).orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("vec").toPandas()["vec"].tolist()
    if not taken:
        return np.empty((0, 0))
    sizes = np.array([len(v) for v in taken])
    dim = np.bincount(sizes).argmax()
    return np.frombuffer(b"".join(v for v in taken if len(v) == dim), np.float64).reshape(-1, dim // 8)
