"""Nearest given centroid, and how well clusters separate, for any number of centroids.

A centroid table is cut into blocks of bounded size. One block at a time is sent to the tasks and every
row keeps the best it has met so far, so neither the driver nor a task holds more than a block, and rows
are not shuffled. A table that fits one block is one pass; each further block is one more pass over the
rows and their running result, written in between.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import discard, stage

# Bytes of centroids that travel at once, and rows that a task compares with them at once.
BLOCK_BYTES = 64_000_000
ROWS = 1_024
# A bound on the rounding error of distances by a matrix product, relative to the sizes involved.
SLACK = 1e-9


def mean_centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(code, centroid): the mean vector of every label."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    return df.groupBy(F.col(label).cast("int").alias("code")).agg(
        vector_to_array(Summarizer.mean(as_vector)).alias("centroid")
    )


@dataclass(frozen=True)
class Block:
    """Some centroids by code, with one more number each."""

    codes: np.ndarray
    points: np.ndarray
    extra: np.ndarray


@dataclass(frozen=True)
class Rows:
    """Some rows: vectors, their own code and number, the best code and value so far (NaN: none)."""

    points: np.ndarray
    codes: np.ndarray
    extra: np.ndarray
    held: np.ndarray
    best: np.ndarray


# (place in the block or -1, value) of the better centroid of every row
Step = Callable[[Rows, Block], tuple[np.ndarray, np.ndarray]]


def blocks_of(centroids: DataFrame, extra: Column, block_bytes: int) -> tuple[int, Iterator[Block]]:
    """How many blocks a table (code, centroid, ...) has, and the blocks, read one at a time."""
    known = centroids.where(F.col("code").isNotNull() & F.col("centroid").isNotNull())
    table = stage(known.select("code", "centroid", extra.cast("double").alias("extra")), "centroids")
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("centroid")).alias("cells")).first()
    if not size["n"]:
        raise ValueError("no centroids")
    count = max(1, math.ceil(size["cells"] * 8 / block_bytes))

    def read() -> Iterator[Block]:
        for b in range(count):
            rows = table.where(F.pmod(F.xxhash64("code"), F.lit(count)) == b).orderBy("code").collect()
            if rows:
                codes, points, more = zip(*rows)
                yield Block(np.array(codes, "int32"), np.array(points, float), np.array(more, float))

    return count, read()


def _better(block, step: Step):
    @F.pandas_udf("code int, value double")
    def better(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known = block.value
        width = known.points.shape[1]
        for vectors, *numbers in batches:
            own, extra, code, best = (n.to_numpy("float64", na_value=np.nan).copy() for n in numbers)
            fits = np.flatnonzero([v is not None and len(v) == width for v in vectors])
            for at in range(0, len(fits), ROWS):
                some = fits[at : at + ROWS]
                x = np.array([vectors.iloc[i] for i in some], float)
                found, value = step(Rows(x, own[some], extra[some], code[some], best[some]), known)
                won = found >= 0
                code[some[won]], best[some[won]] = known.codes[found[won]], value[won]
            yield pd.DataFrame({"code": pd.Series(code).astype("Int32"), "value": best})

    return better


def fold_blocks(
    df: DataFrame, vector: Column, own: Column, extra: Column, blocks: tuple[int, Iterator[Block]], step: Step
) -> DataFrame:
    """``df`` with ``_best`` (code, value) after all blocks; rows without a vector have null."""
    count, each = blocks
    sc, written = df.sparkSession.sparkContext, []
    rows = df.withColumn("_best", F.lit(None).cast("struct<code: int, value: double>"))
    for block in each:
        shipped = sc.broadcast(block)
        better = _better(shipped, step)(
            vector, own.cast("double"), extra.cast("double"), F.col("_best.code"), F.col("_best.value")
        )
        rows = rows.withColumn("_best", better)
        if count > 1:
            rows = stage(rows, "nearest", written)
            shipped.destroy()
            discard(df.sparkSession, written[:-1])
            written = written[-1:]
    return rows


def _distances(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and a bound on their error per row."""
    mine, theirs = (x**2).sum(axis=1), (points**2).sum(axis=1)
    return mine[:, None] + theirs[None, :] - 2 * (x @ points.T), SLACK * (1 + mine + theirs.max())


def closest(rows: Rows, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least squared distance plus the centroid's number, without the row's own code.

    The matrix product only names the centroids that may be the closest; those are measured exactly.
    """
    near, slack = _distances(rows.points, block.points)
    near += block.extra[None, :]
    near[block.codes[None, :] == rows.codes[:, None]] = np.inf
    found, best = np.full(len(near), -1), np.where(np.isnan(rows.best), np.inf, rows.best)
    low = near.min(axis=1)
    for i, j in zip(*np.nonzero((near <= (low + 2 * slack)[:, None]) & np.isfinite(near)), strict=True):
        exact = ((rows.points[i] - block.points[j]) ** 2).sum() + block.extra[j]
        held = rows.held[i] if found[i] < 0 else block.codes[found[i]]
        if exact < best[i] or (exact == best[i] and block.codes[j] < held):
            found[i], best[i] = j, exact
    return found, best


def worst_ratio(rows: Rows, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Largest (own number + the centroid's number) / distance, without the row's own code."""
    apart = np.stack([np.sqrt(((block.points - x) ** 2).sum(axis=1)) for x in rows.points])
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (rows.extra[:, None] + block.extra[None, :]) / apart
    ratio[np.isnan(ratio) | (block.codes[None, :] == rows.codes[:, None])] = -np.inf
    found = ratio.argmax(axis=1)
    best = ratio[np.arange(len(ratio)), found]
    better = best > np.where(np.isnan(rows.best), -np.inf, rows.best)
    return np.where(better, found, -1), best


def nearest_centroid(
    df: DataFrame, vector: str, centroids: DataFrame, code: str = "archetype_n1", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``df`` plus the code and squared distance of the closest centroid (lowest code on a tie).

    A row without a vector, or with one of another size than the centroids, gets null for both.
    """
    blocks = blocks_of(centroids, F.lit(0), block_bytes)
    rows = fold_blocks(df, F.col(vector), F.lit(None), F.lit(0), blocks, closest)
    return rows.withColumns({code: F.col("_best.code"), "distance": F.col("_best.value")}).drop("_best")


def describe(df: DataFrame, vector: str, code: str) -> tuple[DataFrame, DataFrame]:
    """Rows (code, vector, square) and clusters (code, centroid, n, spread, scatter).

    ``square`` is the squared distance to the own centroid, ``spread`` the mean distance, ``scatter`` the
    mean squared one. Rows without a code or a vector are left out.
    """
    rows = df.where(F.col(code).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(code).cast("int").alias("code"), F.col(vector).cast("array<double>").alias("vector")
    )
    means = stage(mean_centroids(rows, "vector", "code"), "means")
    square = F.expr("aggregate(zip_with(vector, centroid, (x, y) -> (x - y) * (x - y)), 0D, (s, z) -> s + z)")
    placed = rows.join(means, "code").select("code", "vector", square.alias("square"))
    stats = placed.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.sqrt("square")).alias("spread"), F.avg("square").alias("scatter")
    )
    return placed, stage(means.join(stats, "code"), "clusters")


def davies_bouldin(clusters: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row: mean over clusters of the worst (spread_i + spread_j) / distance(i, j).

    The pairs are clusters, not rows, and meet block by block. A cluster alone has no value.
    """
    blocks = blocks_of(clusters, F.col("spread"), block_bytes)
    rows = fold_blocks(clusters, F.col("centroid"), F.col("code"), F.col("spread"), blocks, worst_ratio)
    return rows.agg(F.avg("_best.value").alias("davies_bouldin"), F.count(F.lit(1)).cast("int").alias("clusters"))


def silhouette(placed: DataFrame, clusters: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row: mean squared-distance silhouette of the rows that ``describe`` gives.

    The mean squared distance of a row to the rows of a cluster is its squared distance to the centroid
    plus the cluster's scatter, so the nearest other cluster is a nearest centroid with that added. A row
    alone in its cluster counts as zero; with one cluster there is no value.
    """
    blocks = blocks_of(clusters, F.col("scatter"), block_bytes)
    rows = fold_blocks(placed, F.col("vector"), F.col("code"), F.lit(0), blocks, closest)
    own = clusters.select("code", "n", "scatter")
    inside = (F.col("square") + F.col("scatter")) * F.col("n") / (F.col("n") - 1)
    other = F.col("_best.value")
    width = F.when(F.col("n") > 1, F.try_divide(other - inside, F.greatest(other, inside))).otherwise(F.lit(0.0) * other)
    return rows.join(own, "code").agg(F.avg(width).alias("silhouette"))


def cluster_quality(df: DataFrame, vector: str, code: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row: davies_bouldin, clusters, silhouette."""
    placed, clusters = describe(df, vector, code)
    placed = stage(placed, "placed")
    score = silhouette(placed, clusters, block_bytes).first()["silhouette"]
    return davies_bouldin(clusters, block_bytes).withColumn("silhouette", F.lit(score).cast("double"))
