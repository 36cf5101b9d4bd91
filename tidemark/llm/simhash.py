"""SimHash near-duplicates through an inverted index over byte positions.

The index lists every fingerprint under the bytes at sets of positions. In a list the shared positional
bytes of each pair are tallied, pairs reaching a minimum are retained, and their differing bits counted.

``BITS`` gives the guaranteed form: two fingerprints that differ in at most 3 of 64 bits share at least 5
of 8 bytes, and the eight triples of positions (all within the first four and within the last four
bytes) are such that any five positions contain one, so no pair is missed. ``SIMILAR`` is for texts of
similarity 0.8 or more: their 5-word shingles set 256 bits of which about 39 differ (56 at most but for
a pair in hundreds), and 9 of 32 bytes agree on average; the lists are pairs of positions.

Equal fingerprints are one entry. One shuffle deals the entries to their lists; a list longer than a
tile is set aside and compared tile against tile in groups of bounded size. A list or tile pair returns
the edges of stars, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hot_cold_join, released, stage
from tidemark.llm.components import components


@dataclass(frozen=True)
class Index:
    """Bytes of a fingerprint, position sets, the least shared bytes and the most differing bits of a link."""

    bytes: int
    lists: tuple[tuple[int, ...], ...]
    shared: int
    distance: int


BITS = Index(8, (*combinations(range(4), 3), *combinations(range(4, 8), 3)), 5, 3)
SIMILAR = Index(32, tuple((i, (i + step) % 32) for step in (1, 7) for i in range(32)), 2, 56)
#: Rows of a list that one group compares; rows of lists that are compared at once.
TILE, BLOCK = 2_048, 60_000
#: Fingerprints of at least this share of all rows are joined by broadcast.
HOT_SHARE = 1 / 4_096


def fingerprint(text: str | None, words: int, width: int = 8, seed: int = 42) -> bytes:
    """Majority of the bits of all shingle hashes, repeats included; highest byte first, zero without words.

    Eight bytes are XXH64 of the shingle, more are 128-bit hashes of successive seeds.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return bytes(width)
    joined = b" ".join(tokens)
    cuts = np.cumsum([0, *[len(t) + 1 for t in tokens]]).tolist()
    n = max(1, len(tokens) - words + 1)
    ends = cuts[words:] if len(tokens) >= words else cuts[-1:]
    shingles = [joined[a : b - 1] for a, b in zip(cuts, ends, strict=False)]
    if width == 8:
        hashes = b"".join([xxhash.xxh64_digest(s, seed) for s in shingles])
    else:
        hashes = b"".join([xxhash.xxh3_128_digest(s, seed + k) for s in shingles for k in range(width // 16)])
    ones = np.zeros(width * 8, np.int64)
    table = np.frombuffer(hashes, np.uint8).reshape(n, width)
    for a in range(0, n, 8_192):
        ones += np.unpackbits(table[a : a + 8_192], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(
    docs: DataFrame, words: int = 5, width: int = 8, doc_id: str = "doc_id", text: str = "text", keep_key: str | None = None
) -> DataFrame:
    """(doc_id, fp). A null or blank text has zero. ``keep_key`` names a column to pass through as row_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words, width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(fps, pa.binary())], names)

    extra = [keep_key] if keep_key else []
    names = ["doc_id", *(["row_key"] * len(extra)), "fp"]
    chosen = [docs[doc_id].alias("doc_id"), docs[text].alias("text"), *(docs[k].alias("row_key") for k in extra)]
    kinds = [docs.schema[c].dataType.simpleString() for c in (doc_id, *extra)] + ["binary"]
    return docs.select(*chosen).mapInArrow(released(run), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def _linked(a: np.ndarray, b: np.ndarray, index: Index) -> np.ndarray:
    """Which rows of fingerprints (as bytes) share enough bytes and differ in few enough bits."""
    differ = a ^ b
    out = (differ == 0).sum(axis=1) >= index.shared
    near = np.flatnonzero(out)
    bits = np.bitwise_count(np.ascontiguousarray(differ[near]).view(np.uint64)).sum(axis=1)
    out[near] = bits <= index.distance
    return out


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """From the links i-j of n rows: each linked row with the first row of its component."""
    label = np.arange(n)
    while len(i):
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != np.arange(n))
    return label[other], other


def _compare_lists(keys: np.ndarray, fps: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links inside runs of equal keys."""
    left, right, near, step = [], [], np.arange(len(keys)), 1
    while True:
        near = near[near + step < len(keys)]
        near = near[keys[near] == keys[near + step]]
        if not len(near):
            break
        for a in range(0, len(near), 200_000):
            at = near[a : a + 200_000]
            hit = at[_linked(fps[at], fps[at + step], index)]
            left.append(hit)
            right.append(hit + step)
        step += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _stars(np.concatenate(left), np.concatenate(right), len(keys))


def links(distinct: DataFrame, index: Index = BITS) -> DataFrame:
    """(a, b): edges that connect what links connect. ``distinct`` has one column ``fp`` without repeats."""
    width = index.bytes

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4_096):
                fps = whole.column(0).slice(at, 4_096).to_pylist()
                table = np.frombuffer(b"".join(fps), np.uint8).reshape(-1, width).astype(np.int64)
                keys = []
                for part, places in enumerate(index.lists):
                    key = np.full(len(table), part, np.int64)
                    for p in places:
                        key = key << 8 | table[:, p]
                    keys.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fps * len(index.lists), pa.binary())], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of the lists that fit a tile; (key, a) of the rows of longer ones."""
        keys, fps, long_key = np.empty(0, np.int64), np.empty((0, width), np.uint8), None

        def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
            packed = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            return pa.RecordBatch.from_arrays([
                pa.nulls(len(a), pa.int64()) if key is None else pa.array(key), packed(a), pa.nulls(len(a), pa.binary()) if b is None else packed(b)], ["key", "a", "b"])

        def closed(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(keys):
                return
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[start, len(keys)])
            long = np.repeat((size > TILE) | (keys[start] == long_key if long_key is not None else np.zeros(len(start), bool)), size)
            if long.any():
                yield out(fps[long], None, keys[long])
            keys, fps = keys[~long], fps[~long]
            a, b = _compare_lists(keys, fps, index)
            yield out(fps[a], fps[b], None)

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width)])
            if len(keys) >= BLOCK:
                last = int(np.searchsorted(keys, keys[-1], "left")) if keys[-1] != long_key else len(keys)
                if len(keys) - last > TILE:
                    yield from closed(keys[:last], fps[:last])
                    long_key, last, keys, fps = keys[-1], 0, keys[last:], fps[last:]
                    yield out(fps, None, keys)
                    keys, fps = keys[:0], fps[:0]
                    continue
                yield from closed(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        yield from closed(keys, fps)

    entries = distinct.select("fp").mapInArrow(listed, "key bigint, fp binary")
    met = stage(entries.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "key bigint, a binary, b binary"), "byte-index")
    long = met.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    sizes = long.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp", "key"), F.col("tiles")).cast("int")
    # A tile takes part in one group for each tile of its list, itself included.
    dealt = long.join(sizes, "key").withColumn("own", own).select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("high"), "fp")

    def tiles(_, group):
        fps = np.frombuffer(b"".join(group.column("fp").to_pylist()), np.uint8).reshape(-1, width)
        high = group.column("high").to_numpy(zero_copy_only=False).astype(bool)
        same = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        low_at, high_at = (np.arange(len(fps)),) * 2 if same else (np.flatnonzero(~high), np.flatnonzero(high))
        left, right = [], []
        for k, i in enumerate(low_at):
            others = high_at[k + 1 :] if same else high_at
            hit = others[_linked(fps[others], fps[i][None, :], index)]
            left.append(np.full(len(hit), i))
            right.append(hit)
        a, b = _stars(np.concatenate(left), np.concatenate(right), len(fps)) if left else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array([fps[i].tobytes() for i in a], pa.binary()), "b": pa.array([fps[i].tobytes() for i in b], pa.binary())})

    far = dealt.groupBy("key", "lo", "hi").applyInArrow(tiles, "a binary, b binary")
    return met.where("key IS NULL").select("a", "b").unionByName(far)


def near_duplicates(
    docs: DataFrame, words: int = 5, index: Index = SIMILAR, doc_id: str = "doc_id", text: str = "text", keep_key: str | None = None
) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable by links, per row.

    Rows with equal fingerprints are linked, blank and null texts (fingerprint zero) like any others.
    Repeated rows give repeated results. Null ids never name a component unless it has no other id.
    ``keep_key`` is passed through as ``row_key``.
    """
    marked = stage(fingerprints(docs, words, index.bytes, doc_id, text, keep_key), "fingerprints")
    groups = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprint-groups")
    found = components(links(groups.select("fp"), index))
    rooted = groups.join(found, groups["fp"] == found["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "fingerprint-roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = stage(rooted.join(smallest, "root").select("fp", "n", "component_id"), "fingerprint-table")
    out = hot_cold_join(marked, table, "fp", "n", HOT_SHARE)
    return out.select("doc_id", *(["row_key"] if keep_key else []), "fp", "component_id")
