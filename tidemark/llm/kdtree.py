"""Shards of near equal bytes by a k-d tree over document metadata. DataFrame operations only.

The text is read once for its size and checksum; everything after that works on a narrow table. Copies
of a text get the place of their first row, so that they lie together. A node that is to become k leaves
is cut along its widest dimension where floor(k/2)/k of its bytes lie below. All cuts of a level are
found together: a pass sums bytes per node and bin of the cut's key, the bin that holds the cut is
narrowed by the next pass, and rows that tie in the dimension are told apart by the text's hash, then
by the row's. So no row is sorted or collected: the driver sees sums per bin, and the cuts, fewer than
leaves, are joined as constants. A cut falls inside a group of copies only where the group is larger
than the slack.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import blank, hot_cold_join, stage

#: Bytes that a row takes besides its text; bins per node and pass; rows that one slot group should have.
OVERHEAD, BINS, SLOT_ROWS = 16, 2_048, 20_000
#: A cut moves to the edge of a run of equal keys if that is at most this share of a leaf away.
SLACK = 0.005
#: Texts with this share of all rows or more are joined by broadcast.
HOT_TEXTS = 1 / 4_096
DIMENSIONS = ("k_source", "k_lang", "k_size", "k_id")
KEYS = ("k_dim", "k_text", "k_row")
_MOST = (1 << 63) - 1


@dataclass
class Search:
    """A node that is cut, and how far its cut is narrowed."""

    node: int
    leaves: int
    dim: int = 0
    lo: int = 0
    hi: int = 0
    want: float = 0.0
    below: int = 0
    fixed: list[int] = field(default_factory=list)

    @property
    def width(self) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // BINS))

    @property
    def bounds(self) -> list[int]:
        return [*self.fixed, _MOST, _MOST][:3]


def _constants(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A table of as many rows as a level has nodes, as a part of the plan."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({names})"))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, keys): the narrow table, with one long per dimension and tie."""
    body = blank(text)
    size = F.octet_length(body).cast("long") + OVERHEAD
    place = lambda c: F.shiftright(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), 2)
    rows = stage(docs.select(
        F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        place(source).alias("k_source"), place(lang).alias("k_lang"), (F.log2(size) * F.lit(1 << 40)).cast("long").alias("k_size"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("k_id"),
        F.shiftright(F.xxhash64(body), 2).alias("k_text"), F.shiftright(F.xxhash64(F.col(doc_id), body), 2).alias("k_row"),
    ), "kd-rows")
    # Groups of copies take the place of their first row; single texts keep their own.
    groups = rows.groupBy("k_text").agg(F.min(F.struct("k_id", "k_source", "k_lang")).alias("first"), F.count("*").alias("n")).where("n > 1")
    out = hot_cold_join(rows, stage(groups, "kd-copies"), "k_text", "n", HOT_TEXTS)
    moved = {k: F.coalesce(F.col(f"first.{k}"), F.col(k)) for k in ("k_source", "k_lang", "k_id")}
    return out.withColumns(moved).drop("first", "n")


def _dimension():
    return F.element_at(F.array(*DIMENSIONS), F.col("dim").cast("int") + 1)


def _descend(rows: DataFrame, cuts: list[Search]) -> DataFrame:
    """Move every row from its node to the side of the cut it lies on."""
    table = _constants(rows.sparkSession, "at, dim, half, b0, b1, b2", [(c.node, c.dim, c.leaves // 2, *c.bounds) for c in cuts])
    joined = rows.join(table, F.col("node") == F.col("at"), "left").withColumn("k_dim", _dimension())
    left = (F.col("k_dim") < F.col("b0")) | ((F.col("k_dim") == F.col("b0")) & (
        (F.col("k_text") < F.col("b1")) | ((F.col("k_text") == F.col("b1")) & (F.col("k_row") <= F.col("b2")))))
    node = F.when(F.col("at").isNull(), F.col("node")).when(left, 2 * F.col("node")).otherwise(2 * F.col("node") + 1)
    first = F.when(F.col("at").isNull() | left, F.col("leaf")).otherwise(F.col("leaf") + F.col("half"))
    return joined.withColumns({"node": node, "leaf": first}).drop("at", "dim", "half", "b0", "b1", "b2", "k_dim")


def _search_level(rows: DataFrame, level: list[Search], slack: float) -> None:
    """Complete the cuts of one level; ``rows`` carry their node."""
    sums = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(k).alias(f"{n}_{k}") for k in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))))
    spread = {r["node"]: r for r in sums.collect()}
    whole = {k: max(1, max(r[f"hi_{k}"] for r in spread.values()) - min(r[f"lo_{k}"] for r in spread.values())) for k in DIMENSIONS}
    open_ = {}
    for s in level:
        if (r := spread.get(s.node)) is None:
            s.fixed = [0]
            continue
        s.dim = max(range(len(DIMENSIONS)), key=lambda i: (r[f"hi_{DIMENSIONS[i]}"] - r[f"lo_{DIMENSIONS[i]}"]) / whole[DIMENSIONS[i]])
        s.lo, s.hi = r[f"lo_{DIMENSIONS[s.dim]}"], r[f"hi_{DIMENSIONS[s.dim]}"]
        s.want = r["bytes"] * (s.leaves // 2) / s.leaves
        open_[s.node] = s
    while open_:
        table = _constants(rows.sparkSession, "at, dim, step, f0, f1, lo, hi, width", [(s.node, s.dim, len(s.fixed), *[*s.fixed, 0, 0][:2], s.lo, s.hi, s.width) for s in open_.values()])
        near = rows.join(table, F.col("node") == F.col("at")).withColumn("k_dim", _dimension())
        key = F.when(F.col("step") == 0, F.col("k_dim")).when(F.col("step") == 1, F.col("k_text")).otherwise(F.col("k_row"))
        here = ((F.col("step") == 0) | (F.col("k_dim") == F.col("f0"))) & ((F.col("step") < 2) | (F.col("k_text") == F.col("f1")))
        near = near.where(here).withColumn("v", key).where("v BETWEEN lo AND hi").withColumn("bin", F.expr("(v - lo) div width"))
        bins: dict[int, list] = {}
        for r in near.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.min("v").alias("first"), F.max("v").alias("last")).collect():
            bins.setdefault(r["node"], []).append(r)
        for node, s in list(open_.items()):
            for r in sorted(bins[node], key=lambda r: r["bin"]):
                if s.below + r["bytes"] >= s.want:
                    break
                s.below += r["bytes"]
            else:
                s.below -= r["bytes"]
            under, over = s.want - s.below, s.below + r["bytes"] - s.want
            if min(under, over) <= slack or r["first"] == r["last"] and len(s.fixed) == 2:
                s.fixed.append(r["last"] if over <= under else r["first"] - 1)
                del open_[node]
            elif r["first"] < r["last"]:
                s.lo, s.hi = r["first"], r["last"]
            else:
                s.fixed.append(r["first"])
                s.lo, s.hi = -(1 << 61), (1 << 61) - 1


def assign(narrow: DataFrame, leaves: int) -> DataFrame:
    """``narrow`` with the leaf of each row, from 0."""
    total = narrow.agg(F.sum("size")).first()[0] or 0
    rows = narrow.withColumns({"node": F.lit(1).cast("long"), "leaf": F.lit(0).cast("long")})
    level = [Search(1, leaves)] if leaves > 1 and total else []
    while level:
        _search_level(rows, level, SLACK * total / leaves)
        rows = _descend(rows, level)
        level = [Search(2 * s.node + side, k) for s in level for side, k in ((0, s.leaves // 2), (1, s.leaves - s.leaves // 2)) if k > 1]
    return rows


def shard(
    docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row, in ``leaves`` shards or as many as reach ``target_bytes``.

    Null texts are empty and weigh OVERHEAD bytes; null languages and sources are one place of their
    dimension. Slots count from 0 without gaps in each shard. Rows that agree in everything stay in one shard.
    """
    narrow = stage(measured(docs, doc_id, text, lang, source), "kd-narrow")
    if leaves is None:
        total = narrow.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, math.ceil(total / max(1, target_bytes or total or 1)))
    placed = assign(narrow, leaves).select("doc_id", "size", "text_crc32", "k_row", F.col("leaf").cast("int").alias("shard"))
    # Rows are numbered in groups of a shard, and groups by the counts before them.
    groups = max(1, math.ceil(narrow.count() / leaves / SLOT_ROWS))
    placed = placed.withColumn("part", F.pmod(F.hash("k_row"), F.lit(groups)))
    before = F.expr("sum(n) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.expr("row_number() OVER (PARTITION BY shard, part ORDER BY k_row, doc_id)")
    numbered = placed.withColumn("nr", inside).join(offsets, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("nr") - 1 + F.col("before")).cast("long").alias("slot"))
