"""Merkle manifest of a dataset, with a proof for every row.

Rows of a group ascend and are dealt out in aligned blocks of ``2**BLOCK_LEVELS``. A block hashes its own
tree; then blocks exchange subtree roots as in a butterfly: in round r, a block swaps the root of its
aligned set of ``FANOUT**r`` blocks with the partners whose number differs in digit r only, and every block
of a set hashes the same ancestors for itself. After the last round each block holds its upper proof and the
root of the group, so nothing is sent down again. Groups with fewer blocks than a full set have no partner
for some digits; there the last block stands in. Roots of groups are the rows of one more tree.

A node is the lowercase hex SHA-256 of its children's digests put together; a last child alone is hashed
again. Positions come from a range sort, counts per sorted part and their prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

#: Rows of a block are 2**BLOCK_LEVELS; a round of the exchange climbs FAN_LEVELS levels at once.
BLOCK_LEVELS, FAN_LEVELS = 8, 4
PROOF = "array<struct<left: boolean, digest: string>>"
_PROOF_TYPE = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())]))
#: Blocks whose proofs are sent back to Spark at once.
SLICE = 16


def leaf(*columns: str | Column) -> Column:
    """Digest of the columns: ``-`` for null, else the UTF-8 byte count, a colon and the value, in a row."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def tree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of ``levels`` further levels, the given ones first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_parent(below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def path(levels: list[list[str]], index: int) -> list[dict]:
    """The sibling at every level but the last: None where the node is alone."""
    out = []
    for nodes in levels[:-1]:
        beside = index ^ 1
        out.append({"left": bool(index & 1), "digest": nodes[beside] if beside < len(nodes) else None})
        index >>= 1
    return out


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    return (n - 1).bit_length()


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(
        proof, start,
        lambda node, s: F.sha2(
            F.when(s["digest"].isNull(), node).when(s["left"], F.concat(s["digest"], node)).otherwise(F.concat(node, s["digest"])), 256
        ),
    )


def siblings(proof: Column) -> Column:
    """All digests of a proof in a row, from the leaf up."""
    return F.concat_ws("", F.transform(proof, lambda s: s["digest"]))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (group, leaf, ...) with ``n``, the rows of the group, and ``at``, the place in it from 0.

    Rows that agree in everything are told apart by a running number, so that many of them spread too.
    """
    keys = ["group", *order, "leaf", "__tie"]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(ranged.drop("__tie").withColumn("__seq", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__seq", 33).alias("__part")
    counts = placed.groupBy(part, "group").agg(F.count(F.lit(1)).alias("m"), F.min("__seq").alias("head"))
    of_group = Window.partitionBy("group")
    before = F.coalesce(F.sum("m").over(of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stage(counts.select("__part", F.col("group").alias("__group"), "head", before.alias("before"), F.sum("m").over(of_group).alias("n")), "counts")
    joined = placed.withColumn("__at", part).join(counts, (F.col("__at") == F.col("__part")) & F.col("group").eqNullSafe(F.col("__group")))
    return joined.withColumn("at", F.col("__seq") - F.col("head") + F.col("before")).drop("__seq", "__at", "__part", "__group", "head", "before")


def _block_roots(block_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [
                tree(leaves, min(block_levels, height(n)))[-1][0]
                for n, leaves in zip(batch.column("n").to_pylist(), batch.column("leaves").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), batch.column("block"), batch.column("n"), pa.array(roots, pa.string())], ["group", "block", "n", "root"]
            )

    return run


def _ancestors(level: int, fan_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, roots = [], []
            for n, digit, nodes in zip(*(batch.column(c).to_pylist() for c in ("n", "digit", "nodes")), strict=True):
                levels = tree(nodes, min(fan_levels, height(n) - level))
                proofs.append(path(levels, digit))
                roots.append(levels[-1][0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), batch.column("block"), batch.column("n"), pa.array(roots, pa.string()), pa.array(proofs, _PROOF_TYPE)],
                ["group", "block", "n", "root", "proof"],
            )

    return run


def _exchange(state: DataFrame, kind: str, block_levels: int, fan_levels: int, turn: int) -> DataFrame:
    """One round: (group, block, n, root, proof) of the blocks whose group has levels left."""
    level, fan, step = block_levels + turn * fan_levels, 1 << fan_levels, 1 << (turn * fan_levels)
    count = f"(n + {(1 << block_levels) - 1}) div {1 << block_levels}"
    first = f"(block div {step * fan}) * {step * fan}"
    mine = f"(block div {step}) % {fan}"
    partners = f"filter(transform(sequence(0, {fan - 1}), d -> {first} + d * {step} + block % {step}), b -> b < {count})"
    # The last block also answers for the blocks that its incomplete set does not have.
    instead = (
        f"CASE WHEN block = {count} - 1 AND {mine} > 0 "
        f"THEN filter(sequence({first}, {first} + {mine} * {step} - 1), b -> b % {step} > block % {step}) ELSE array() END"
    )
    sent = state.select(
        "group", "n", F.expr(mine).alias("from"), "root", F.explode(F.expr(f"concat({partners}, {instead})")).alias("block")
    )
    got = sent.groupBy("group", "block", "n").agg(F.sort_array(F.collect_list(F.struct("from", "root"))).alias("got"))
    got = got.select("group", "block", "n", F.expr(mine).cast("int").alias("digit"), F.expr("transform(got, x -> x.root)").alias("nodes"))
    return got.mapInArrow(_ancestors(level, fan_levels), f"group {kind}, block bigint, n bigint, root string, proof {PROOF}")


def _blocks(rows: DataFrame, order: list[str], block_levels: int, fan_levels: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (group, block, n, rows) and what each has learnt (group, block, root, upper)."""
    kind = rows.schema["group"].dataType.simpleString()
    numbered = _numbered(rows, order)
    carried = F.struct("at", *[c for c in rows.columns if c != "group"])
    grouped = numbered.groupBy("group", F.shiftright("at", block_levels).alias("block"), "n").agg(F.sort_array(F.collect_list(carried)).alias("rows"))
    blocks = stage(grouped, "blocks")
    leaves = blocks.select("group", "block", "n", F.expr("transform(rows, r -> r.leaf)").alias("leaves"))
    state = stage(leaves.mapInArrow(_block_roots(block_levels), f"group {kind}, block bigint, n bigint, root string"), "roots")
    rounds = [state.withColumn("proof", F.lit(None).cast(PROOF)).withColumn("turn", F.lit(-1))]
    most, turn = height(state.agg(F.max("n")).first()[0] or 1), 0
    while block_levels + turn * fan_levels < most:
        # A group has levels left if it has more rows than the levels below can hold.
        left = state.where(F.col("n") > F.lit(1 << (block_levels + turn * fan_levels)))
        state = stage(_exchange(left, kind, block_levels, fan_levels, turn), f"round-{turn}")
        rounds.append(state.withColumn("turn", F.lit(turn)))
        turn += 1
    steps = F.sort_array(F.collect_list(F.struct("turn", "root", "proof")))
    learnt = reduce(DataFrame.unionByName, rounds).groupBy("group", "block").agg(steps.alias("steps"))
    upper = F.expr("flatten(filter(transform(steps, s -> s.proof), p -> p IS NOT NULL))")
    return blocks, stage(learnt.select("group", "block", F.element_at("steps", -1)["root"].alias("root"), upper.alias("upper")), "learnt")


def _own_paths(block_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch, proofs = whole.slice(at, SLICE), []
                for n, leaves, upper in zip(*(batch.column(c).to_pylist() for c in ("n", "leaves", "upper")), strict=True):
                    levels = tree(leaves, min(block_levels, height(n)))
                    proofs.append([path(levels, i) + upper for i in range(len(leaves))])
                added = pa.array(proofs, pa.list_(_PROOF_TYPE))
                keep = [c for c in batch.schema.names if c not in ("leaves", "upper")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), added], [*keep, "proofs"])

    return run


def _unfolded(blocks: DataFrame, block_levels: int) -> DataFrame:
    """Blocks (rows, n, upper, ...) as their rows with ``proof``."""
    ready = blocks.withColumn("leaves", F.expr("transform(rows, r -> r.leaf)"))
    kept = [f for f in ready.schema.fields if f.name not in ("leaves", "upper")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", proofs array<{PROOF}>"
    out = ready.mapInArrow(_own_paths(block_levels), schema)
    beside = [f.name for f in kept if f.name not in ("rows", "n", "block")]
    each = out.select(*beside, F.explode(F.arrays_zip("rows", "proofs")).alias("e"))
    carried = [f.name for f in blocks.schema["rows"].dataType.elementType.fields if f.name != "at"]
    return each.select(*beside, *[F.col(f"e.rows.{c}").alias(c) for c in carried], F.col("e.proofs").alias("proof"))


def manifest(rows: DataFrame, order: list[str], block_levels: int = BLOCK_LEVELS, fan_levels: int = FAN_LEVELS) -> DataFrame:
    """``rows`` (group, leaf, ...) with ``proof`` (siblings from the leaf to the root), ``subroot`` and ``root``.

    Leaves of a group ascend by ``order`` (nulls first), equal ones by digest; groups ascend by their value in
    byte order, null first, and a null group is a group. A lone leaf is its subroot, a lone subroot the root.
    Repeated rows are leaves of their own; an empty table gives no rows. No group, digest list or proof of
    unbounded size meets in one task: a block has ``2**block_levels`` rows, a round ``2**fan_levels`` digests.
    """
    blocks, learnt = _blocks(rows, order, block_levels, fan_levels)
    roots = learnt.where("block = 0").select(F.lit(0).alias("group"), F.col("group").alias("name"), F.col("root").alias("leaf"))
    top_blocks, top_learnt = _blocks(roots, ["name"], block_levels, fan_levels)
    top = top_blocks.join(top_learnt, ["group", "block"]).drop("group")
    top = stage(_unfolded(top, block_levels).select("name", "leaf", "root", "proof"), "top")
    top = top.select(F.col("name").alias("__name"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("__above"))
    both = learnt.select(F.col("group").alias("__group"), F.col("block").alias("__block"), F.col("upper").alias("__upper"))
    known = both.join(top, F.col("__group").eqNullSafe(F.col("__name"))).drop("__name")
    joined = blocks.join(known, F.col("group").eqNullSafe(F.col("__group")) & (F.col("block") == F.col("__block")))
    ready = joined.withColumn("upper", F.concat("__upper", "__above")).drop("__group", "__block", "__upper", "__above")
    return _unfolded(ready, block_levels)


def documents(df: DataFrame, every: int = 7, block_levels: int = BLOCK_LEVELS, fan_levels: int = FAN_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, tampered): the manifest of ``documents``, grouped by language.

    ``tampered`` is the leaf with 1 added to ``n_chars`` where ``every`` divides the CRC-32 of the decimal id,
    and the leaf itself elsewhere; a null ``n_chars`` stays, and a row with a null id is not tampered with.
    Empty and very long texts are leaves like any other; other columns are ignored whatever their names.
    """
    columns = [df[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [*columns[:3], columns[3].cast("decimal(38, 0)") + 1, columns[4]]
    hit = F.coalesce(F.crc32(columns[0].cast("string").cast("binary")) % every == 0, F.lit(False))
    leaves = df.select(
        df["doc_id"].alias("doc_id"), df["lang"].alias("group"), leaf(*columns).alias("leaf"), F.when(hit, leaf(*changed)).alias("changed")
    )
    out = manifest(stage(leaves, "leaves"), ["doc_id"], block_levels, fan_levels)
    return out.select("doc_id", "leaf", "subroot", "root", "proof", F.coalesce("changed", "leaf").alias("tampered"))
