"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every row is put into a leaf by descending it. A query walks
the tree through a priority queue of nodes by their centroid's inner product and visits leaves in that
order. How many leaves it visits is calibrated: for a sample of queries the true neighbours among all
rows are found by one scan, and visits widen until the wanted share of them lies in visited leaves.
Queries then meet the rows of their leaves in blocks of bounded size on both sides, a leaf with many
rows or many queries being several blocks, and the nearest of all blocks are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.llm.vectors import matrix, pack, sample_of

#: Bound on rows that fit the tree; children of a node; rows that a sample leaf is split down to.
SAMPLE_ROWS, BRANCHES, LEAF_ROWS = 20_000, 8, 160
#: Queries that calibrate, the recall they must reach, and rows or queries in one block of a leaf.
PROBES, RECALL, BLOCK_ROWS = 200, 0.97, 4_096


class Tree:
    """Centroids of all nodes; children follow each other."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        self.centroids, self.children, self.leaf_of = [sample.mean(axis=0)], [[]], {}
        rng, queue = np.random.default_rng(seed), [(0, sample)]
        while queue:
            node, rows = queue.pop(0)
            parts = self._split(rows, branches, rng) if len(rows) > leaf_rows else []
            if len(parts) < 2:
                self.leaf_of[node] = len(self.leaf_of)
                continue
            for part in parts:
                self.centroids.append(part.mean(axis=0))
                self.children.append([])
                self.children[node].append(len(self.centroids) - 1)
                queue.append((len(self.centroids) - 1, part))
        self.centroids = np.stack(self.centroids)

    @staticmethod
    def _split(rows: np.ndarray, k: int, rng) -> list[np.ndarray]:
        centers = rows[rng.choice(len(rows), k, replace=False)]
        for _ in range(10):
            own = ((rows**2).sum(1)[:, None] - 2 * rows @ centers.T + (centers**2).sum(1)).argmin(axis=1)
            centers = np.stack([rows[own == j].mean(axis=0) if (own == j).any() else centers[j] for j in range(k)])
        return [rows[own == j] for j in range(k) if (own == j).any()]

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every node."""
        out, queue = np.empty(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while queue:
            node, at = queue.pop()
            if not self.children[node]:
                out[at] = self.leaf_of[node]
                continue
            kids = np.array(self.children[node])
            c = self.centroids[kids]
            own = ((c**2).sum(1) - 2 * rows[at] @ c.T).argmin(axis=1)
            queue += [(int(kids[j]), at[own == j]) for j in range(len(kids)) if (own == j).any()]
        return out

    def order(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, best bin first."""
        near = (self.centroids @ query).tolist()
        heap, out = [(-near[0], 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                out.append(self.leaf_of[node])
            for kid in self.children[node]:
                heapq.heappush(heap, (-near[kid], kid))
        return out


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and exact products of its k best rows; ties go to the smaller id.

    Products of one matrix multiplication choose; a row's final product is one sum in a fixed order, so
    equal vectors get equal products.
    """
    found = []
    for a in range(0, len(queries), 256):
        fast = queries[a : a + 256] @ rows.T
        for i, line in enumerate(fast):
            q = queries[a + i]
            line[ids == query_ids[a + i]] = -np.inf
            keep = np.arange(len(ids))
            if len(ids) > k:
                edge = np.partition(line, len(ids) - k)[len(ids) - k]
                keep = np.flatnonzero(line >= edge - 1e-9 * max(1.0, abs(edge)))
            keep = keep[line[keep] > -np.inf]
            exact = (rows[keep] * q).sum(axis=1)
            best = np.lexsort((ids[keep], -exact))[:k]
            found.append((ids[keep][best], exact[best]))
    return found


def calibrate(packed: DataFrame, tree: Tree, every: int, k: int, probes: int = PROBES, recall: float = RECALL) -> tuple[int, float]:
    """Leaves to visit, and the recall that many reach for the probing queries against all rows."""
    leaves, dim = len(tree.leaf_of), tree.centroids.shape[1]
    chosen = packed.where(F.pmod("vec_id", F.lit(every)) == 0).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(probes).toPandas()
    if chosen.empty:
        return leaves, 1.0
    queries, ids = matrix(chosen["vec"], dim), chosen["vec_id"].to_numpy()
    shipped = packed.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = shipped.value
        for batch in batches:
            rows, row_ids = matrix(batch.column(1), dim), batch.column(0).to_numpy()
            where = dict(zip(row_ids.tolist(), batch.column(2).to_pylist(), strict=True))
            for q, (near, score) in zip(own.tolist(), nearest(queries, own, rows, row_ids, k), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(near), pa.int64()), pa.array(near), pa.array(score), pa.array([where[i] for i in near.tolist()], pa.int64())], ["q", "id", "score", "leaf"])

    best = packed.select("vec_id", "vec", "leaf").mapInArrow(run, "q bigint, id bigint, score double, leaf bigint")
    top = best.withColumn("r", F.expr("row_number() OVER (PARTITION BY q ORDER BY score DESC, id)")).where(F.col("r") <= k).toPandas()  # probes * k rows
    ranks = []
    for q, vec in zip(ids.tolist(), queries, strict=True):
        place = {leaf: i + 1 for i, leaf in enumerate(tree.order(vec, leaves))}
        ranks += [place[leaf] for leaf in top["leaf"][top["q"] == q]]
    reached = np.cumsum(np.bincount(ranks, minlength=leaves + 1))[1:] / max(1, len(ranks))
    visits = int(np.argmax(reached >= recall)) + 1 if len(ranks) else leaves
    return visits, float(reached[visits - 1]) if len(ranks) else 1.0


def search(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``.

    Rows that take no part (see ``vectors.pack``), that have a null id or another dimension than most,
    are neither queries nor found. A repeated id is found as often as it is there, but never by itself.
    Without any row the result is empty.
    """
    packed = stage(pack(vectors, vec_id, embedding).where("vec IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "vec"), "ann-rows")
    sample = sample_of(packed, SAMPLE_ROWS)
    if not len(sample):
        return packed.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    tree, dim = Tree(sample), sample.shape[1]
    shipped = vectors.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shipped.value.leaves(matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "vec", "leaf"])

    index = stage(packed.where(F.length("vec") == dim * 8).mapInArrow(place, "vec_id bigint, vec binary, leaf bigint"), "ann-index")
    visits, _ = calibrate(index, tree, every, k)
    # One row per leaf, and a sample of SAMPLE_ROWS bounds the leaves.
    sizes = {r["leaf"]: -(-r["n"] // BLOCK_ROWS) for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    asking = index.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vec").dropDuplicates(["vec_id", "vec"])
    asking = stage(asking, "ann-queries")

    def count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shipped.value.leaf_of), np.int64)
        for batch in batches:
            for q in matrix(batch.column(1), dim):
                counts[shipped.value.order(q, visits)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], ["leaf", "n"])

    asked = asking.mapInArrow(count_visits, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n"))
    slices = {r["leaf"]: -(-r["n"] // BLOCK_ROWS) for r in asked.collect() if r["leaf"] in sizes}
    if not slices:
        return packed.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                ids, leaves, blocks, parts, vecs = [], [], [], [], []
                for i, vec, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), matrix(batch.column(1), dim), strict=True):
                    for leaf in shipped.value.order(q, visits):
                        for block in range(sizes.get(leaf, 0)):
                            ids.append(i)
                            leaves.append(leaf)
                            blocks.append(block)
                            parts.append((i // every) % slices[leaf])
                            vecs.append(vec)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in (leaves, blocks, parts, ids)), pa.array(vecs, pa.binary())],
                    ["leaf", "block", "part", "query_id", "vec"],
                )

    queries = asking.mapInArrow(visit, "leaf bigint, block bigint, part bigint, query_id bigint, vec binary")
    per_leaf = lambda counts: F.element_at(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)), F.col("leaf")).cast("long")
    rows = index.withColumns({"block": F.pmod(F.xxhash64("vec_id", "vec"), per_leaf(sizes)), "parts": per_leaf(slices)})
    # Leaves that no query visits stay out; the others come once per block of queries.
    rows = rows.where("parts IS NOT NULL").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")

    def meet(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or held.empty:
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        own = asking["query_id"].to_numpy()
        found = nearest(matrix(asking["vec"], dim), own, matrix(held["vec"], dim), held["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": own, "ids": [i.tobytes() for i, _ in found], "scores": [s.tobytes() for _, s in found]})

    met = queries.groupBy("leaf", "block", "part").cogroup(rows.groupBy("leaf", "block", "part")).applyInPandas(meet, "query_id bigint, ids binary, scores binary")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(group["ids"]), np.int64)
        scores = np.frombuffer(b"".join(group["scores"]), np.float64)
        best = np.lexsort((ids, -scores))[:k]
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": ids[best], "score": scores[best]})

    return met.groupBy("query_id").applyInPandas(merge, "query_id bigint, rank int, vec_id bigint, score double")
