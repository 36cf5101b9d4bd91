"""Embedding near-duplicates by PCA-ordered tiles.

Equal vectors of a label are one entry with a number of its own. Entries are ordered by label, dimension
and first principal coordinate and cut into tiles; two tiles of a label and dimension meet only if their
boxes of leading coordinates are near enough for the threshold. Boxes find each other by cells of the first
coordinate, so a label with many tiles is spread over many tasks. A pair of tiles adds up products over the leading coordinates first; what the remaining
coordinates can add is bounded by the product of their norms, so pairs that cannot reach the threshold
drop out early and a tile pair without any left stops. Survivors are decided by the cosine of the
original vectors in double precision. A tile pair returns link counts and the edges of stars of its
components, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hot_cold_join, stage
from tidemark.llm.components import components
from tidemark.llm.vectors import matrix, pack, sample_of

#: Rows of a tile, leading coordinates of its box, and rows that fit the basis (any basis gives the same links).
TILE, BOX, SAMPLE_ROWS = 512, 6, 10_000
#: Vectors with at least this share of all copies are joined by broadcast.
HOT_SHARE = 1 / 4_096
#: Room for rounding before the exact decision.
EDGE = 1e-9
#: Cells of the first coordinate for each reach of the threshold.
CELLS = 8


def basis_of(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling variance of unit vectors."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1]


def linked(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b whose cosine reaches the threshold."""
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    pa_, pb = (a / norm_a[:, None]) @ basis, (b / norm_b[:, None]) @ basis
    rest_a = np.sqrt(np.maximum(0, 1 - np.cumsum(pa_**2, axis=1)))
    rest_b = np.sqrt(np.maximum(0, 1 - np.cumsum(pb**2, axis=1)))
    dim = pa_.shape[1]
    sums, done = np.zeros((len(a), len(b))), 0
    ai = bi = None
    for upto in [*(n for n in (8, 16, 32) if n < dim), dim]:
        if ai is None:
            sums += pa_[:, done:upto] @ pb[:, done:upto].T
            alive = sums + np.outer(rest_a[:, upto - 1], rest_b[:, upto - 1]) >= threshold - EDGE
            if alive.sum() < 0.1 * alive.size:
                ai, bi = np.nonzero(alive)
                kept = sums[ai, bi]
        else:
            kept = kept + np.einsum("ij,ij->i", pa_[ai, done:upto], pb[bi, done:upto])
            stay = kept + rest_a[ai, upto - 1] * rest_b[bi, upto - 1] >= threshold - EDGE
            ai, bi, kept = ai[stay], bi[stay], kept[stay]
        done = upto
        if ai is not None and not len(ai):
            return ai, bi
    if ai is None:
        ai, bi = np.nonzero(alive)
    parts = [(a[ai[s : s + 20_000]] * b[bi[s : s + 20_000]]).sum(axis=1) for s in range(0, len(ai), 20_000)]
    sure = (np.concatenate(parts) if parts else np.empty(0)) / (norm_a[ai] * norm_b[bi]) >= threshold
    return ai[sure], bi[sure]


def _stars(ai: np.ndarray, bi: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest id of each component of the links (ai, bi) to its other members."""
    label = ids.copy()
    while True:
        low = label.copy()
        np.minimum.at(low, ai, label[bi])
        np.minimum.at(low, bi, low[ai])
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != ids)
    return label[other], ids[other]


def _label_text(label: str, kind: str) -> Column:
    """A label of any type as text; both zeros are one label."""
    value = F.col(label)
    return (value + F.lit(0.0) if kind in ("float", "double") else value).cast("string")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; only rows of one label that is not null are compared.

    Rows that take no part (see ``vectors.pack``), with a null label or null id, link with nothing and are
    kept. Labels may be of any type that has a text. Rows of one label whose dimensions differ do not link.
    Every row is a vector of its own, also where an id repeats; the smallest id of a component names it.
    Other columns are ignored whatever their names; an empty table gives no rows.
    """
    text = vectors.select(
        vectors[vec_id].alias("vec_id"), vectors[embedding].alias("embedding"), vectors[label].alias("label")
    )
    text = text.withColumn("label", _label_text("label", vectors.schema[label].dataType.simpleString()))
    takes_part = F.col("vec").isNotNull() & F.col("kept").isNotNull() & F.col("vec_id").isNotNull()
    key = F.sha2(F.concat(F.col("vec"), F.col("kept").cast("binary")), 256)
    rows = stage(pack(text, "vec_id", "embedding", keep="label").withColumn("key", F.when(takes_part, key)), "tile-rows")
    entries = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("kept").alias("label"), F.first("vec").alias("vec"))
    # Numbers stand in the written table, so a task that comes again reads the same ones.
    entries = stage(entries.withColumn("node", F.monotonically_increasing_id()), "tile-entries")
    sample = sample_of(entries.withColumnRenamed("rep", "vec_id"), SAMPLE_ROWS, "true")
    if not len(sample):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = stage(_links_of(entries, sample, threshold), "tile-links")
    roots = components(links.where("b IS NOT NULL").select("a", "b"))
    counts = links.where("b IS NULL").groupBy("a").agg(F.sum("w").alias("w"))
    table = entries.select("key", "node", "rep", "n").join(counts, F.col("node") == F.col("a"), "left").drop("a")
    table = stage(table.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "tile-roots")
    least = table.groupBy("root").agg(F.min("rep").alias("component_id"))
    table = table.join(least, "root")
    table = stage(table.select("key", "n", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "tile-table")
    # Rows without a key get a key of their own, which spreads them over the join.
    keyed = rows.select("vec_id", F.coalesce("key", F.concat(F.lit("none "), F.coalesce("vec_id", F.lit(-1)).cast("string"))).alias("key"))
    out = hot_cold_join(keyed, table, "key", "n", HOT_SHARE)
    root = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))


_ENTRY = "node bigint, n bigint, label string, dim int, vec binary, lead double"
_TILE = "label string, dim int, tile bigint, low array<double>, high array<double>, nodes binary, ns binary, vecs binary"
_TILE_SCHEMA = pa.schema([
    ("label", pa.string()), ("dim", pa.int32()), ("tile", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
    ("nodes", pa.binary()), ("ns", pa.binary()), ("vecs", pa.binary()),
])


def _links_of(entries: DataFrame, sample: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, w): star edges (w 0), and with b null how many rows link to entry a."""
    common, fitted = sample.shape[1], basis_of(sample)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def basis(dim: int) -> np.ndarray:
        """Any basis gives the same links; the fitted one, where it fits, gives them sooner."""
        return fitted if dim == common else np.eye(dim)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec").to_pylist()
            dims = np.array([len(v) // 8 for v in vectors], np.int32)
            first = np.empty(len(vectors))
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                x = matrix([vectors[i] for i in of], int(dim))
                first[of] = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ basis(int(dim))[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "n", "label")), pa.array(dims), batch.column("vec"), pa.array(first)],
                ["node", "n", "label", "dim", "vec", "lead"],
            )

    led = stage(entries.select("node", "n", "label", "vec").mapInArrow(lead, _ENTRY), "tile-leads")
    order = ["label", "dim", "lead", "node"]
    ordered = led.repartitionByRange(*order).sortWithinPartitions(*order)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held, out = cut(new if held is None else pa.concat_tables([held, new]), last=False)
            yield from out
        if held is not None and held.num_rows:
            yield from cut(held, last=True)[1]

    def cut(table: pa.Table, last: bool) -> tuple[pa.Table, list[pa.RecordBatch]]:
        """What is left of the table, and its tiles; the last one may still grow."""
        groups = list(zip(table.column("label").to_pylist(), table.column("dim").to_pylist(), strict=True))
        at, out = 0, []
        while at < len(groups):
            end = at
            while end < len(groups) and end - at < TILE and groups[end] == groups[at]:
                end += 1
            if end == len(groups) and end - at < TILE and not last:
                break
            part, (label, dim) = table.slice(at, end - at), groups[at]
            x = matrix(part.column("vec"), dim)
            p = np.zeros((len(x), BOX))
            p[:, : min(BOX, dim)] = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ basis(dim)[:, :BOX]
            nodes, ns = (np.array(part.column(c).to_pylist(), np.int64) for c in ("node", "n"))
            out.append({
                "label": label, "dim": dim, "tile": int(nodes[0]), "low": p.min(axis=0).tolist(), "high": p.max(axis=0).tolist(),
                "nodes": nodes.tobytes(), "ns": ns.tobytes(), "vecs": x.tobytes(),
            })
            at = end
        return table.slice(at), [pa.RecordBatch.from_pylist(out, _TILE_SCHEMA)] if out else []

    tiles = stage(ordered.select("node", "n", "label", "dim", "vec").mapInArrow(tile, _TILE), "tiles")
    widest = tiles.agg(F.max(F.col("high")[0] - F.col("low")[0])).first()[0] or 0.0
    cell = reach / CELLS
    boxes = tiles.select("label", "dim", "tile", "low", "high")
    # A box stands in the cell of its low end, and looks into all cells where the low end of a near box may lie.
    own = boxes.withColumn("cell", F.floor(F.col("low")[0] / cell))
    seen = F.sequence(F.floor((F.col("low")[0] - reach - widest) / cell), F.floor((F.col("high")[0] + reach) / cell))
    other = boxes.select(
        "label", "dim", F.col("tile").alias("o_tile"), F.col("low").alias("o_low"), F.col("high").alias("o_high"), F.explode(seen).alias("cell")
    )
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col("o_low")[i] - F.col("high")[i], F.col("low")[i] - F.col("o_high")[i]), 2) for i in range(BOX)), F.lit(0.0))
    near = own.join(other, ["label", "dim", "cell"]).where((F.col("tile") <= F.col("o_tile")) & (gap <= reach * reach))
    pairs = near.select("dim", "tile", "o_tile")
    left = tiles.select("tile", F.col("nodes").alias("a_nodes"), F.col("ns").alias("a_ns"), F.col("vecs").alias("a_vecs"))
    right = tiles.select(F.col("tile").alias("o_tile"), F.col("nodes").alias("b_nodes"), F.col("ns").alias("b_ns"), F.col("vecs").alias("b_vecs"))
    met = pairs.join(left, "tile").join(right, "o_tile").select("dim", "tile", "o_tile", "a_nodes", "a_ns", "a_vecs", "b_nodes", "b_ns", "b_vecs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[v], np.float64).reshape(-1, row["dim"]) for v in ("a_vecs", "b_vecs"))
                ra, rb, na, nb = (np.frombuffer(row[c], np.int64) for c in ("a_nodes", "b_nodes", "a_ns", "b_ns"))
                same = row["tile"] == row["o_tile"]
                ai, bi = linked(a, b, basis(row["dim"]), threshold)
                if same:
                    ai, bi = ai[ai < bi], bi[ai < bi]
                if not len(ai):
                    continue
                counts_a = np.bincount(ai, nb[bi], len(a)).astype(np.int64)
                counts_b = np.bincount(bi, na[ai], len(b)).astype(np.int64)
                ids, shift = (ra, 0) if same else (np.concatenate([ra, rb]), len(ra))
                low, high = _stars(ai, bi + shift, ids)
                who = np.concatenate([ra, rb])
                count = np.concatenate([counts_a, counts_b])
                who, count = who[count > 0], count[count > 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([low, who])), pa.array(np.concatenate([high, np.zeros_like(who)]), mask=np.r_[np.zeros(len(low), bool), np.ones(len(who), bool)]), pa.array(np.concatenate([np.zeros_like(low), count]))],
                    ["a", "b", "w"],
                )

    return met.mapInArrow(compare, "a bigint, b bigint, w bigint")
