"""Helpers of the corpus operators: row keys, joins with hot keys, byte windows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.staging import stage

__all__ = ["blank", "hot_cold_join", "pack_windows", "read_table", "released", "row_key", "small_batches", "stage", "tally"]

#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What stands for a row where results are joined back: the same for repeated rows only."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.length(F.col(text)))


def small_batches(spark: SparkSession) -> None:
    """From now on Spark sends workers batches of BATCH_BYTES at most (a longer row alone), not of 10,000 texts of any length.

    An executor holds a batch several times for each task: as vectors, as the bytes sent, and in the worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``; what Arrow and the C library keep of a task is given back when the task ends.

    Workers live on through all stages, so else each holds the most that any of its tasks needed.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
                trim(0)

    return task


def hot_cold_join(
    rows: DataFrame, table: DataFrame, on: str, weight: str, share: float, how: str = "left"
) -> DataFrame:
    """Join a table that is unique on ``on`` and whose ``weight`` says how often a key occurs in ``rows``.

    Keys with at least ``share`` of all the weight, so at most 1/share of them, are broadcast; the
    others are shuffled, and none of those is frequent enough to fill a task.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) >= F.lit(max(2.0, total * share))
    hot_keys = F.broadcast(table.where(hot).select(F.col(on).alias("__hot")))
    marked = rows.join(hot_keys, F.col(on) == F.col("__hot"), "left")
    near = marked.where(F.col("__hot").isNotNull()).drop("__hot")
    far = marked.where(F.col("__hot").isNull()).drop("__hot")
    return near.join(F.broadcast(table.where(hot)), on, how).unionByName(
        far.join(table.where(~hot), on, how)
    )


def pack_windows(data: np.ndarray, width: int) -> np.ndarray:
    """Every run of ``width`` (at most 8) bytes as one unsigned integer, the last byte lowest."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out <<= np.uint64(8)
        out |= data[i : i + n]
    return out


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often (or with which weight) each occurs."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights
