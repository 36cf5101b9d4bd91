"""Phrase collocations by counting quotient filters.

Words get ids from a hash of language and word whose width makes clashes unlikely; that no two words that
can be counted share an id is checked, and another seed is taken if they do. A phrase is its packed ids.
Every task counts the phrases of its texts into filters (``quotient_filter``), one for each shard, and
filters of a shard are merged. A phrase that is frequent has frequent parts, so phrases of n words are only
counted where both parts of n - 1 words may be frequent: a bitmap of fixed size says so, and what it lets
through by mistake is counted like any other and then found to be rare.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import quotient_filter as qf
from tidemark.llm.common import blank, hot_cold_join, stage

#: Words of the longest phrase.
LONGEST = 4
#: Positions of the bitmaps that are sent to all tasks: 8 MB each, whatever the corpus.
BITMAP_BITS = 26
#: Text that is counted at once, and entries that a task holds before it sends them on.
FLUSH_BYTES, HELD = 4_000_000, 2_000_000
#: Occurrences of words for each shard of the merge, so entries of a shard are at most as many.
SHARD_WORDS = 2_000_000
#: Candidates for each group of the first step of the ranking.
RANKED = 100_000

#: Lower case for A-Z, a break (a byte that no UTF-8 text has) for . , ; : ! ? and line ends.
BREAK = b"\xff"
_TABLE = bytes(
    255 if i in b".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256)
)


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of the texts in order, with BREAK between pieces and texts."""
    return BREAK.join(texts).translate(_TABLE).replace(BREAK, b" \xff ").split()


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, a few megabytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        for lang, text in zip(langs, texts, strict=True):
            data = text.as_py()
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size > FLUSH_BYTES:
                yield held
                held, size = {}, 0
    yield held


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(BREAK, None)
            words = pa.array(found.keys(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), words, pa.array(found.values(), pa.int64())], ["lang", "word", "uses"]
            )
        counts.clear()

    for texts in _by_lang(batches):
        for lang, some in texts.items():
            counts.setdefault(lang, Counter()).update(tokens(some))
        if sum(map(len, counts.values())) > HELD // 4:
            yield from out()
    yield from out()


def _prefix(seed: int, lang: str) -> bytes:
    return f"{seed}:{len(lang.encode())}:{lang}".encode()


def _word_hash(seed: int) -> Column:
    """The same as XXH64 with seed 42 of ``_prefix`` and the word."""
    return F.xxhash64(F.concat(F.lit(f"{seed}:"), F.octet_length("lang").cast("string"), F.lit(":"), "lang", "word"))


def _bitmap(rows: DataFrame, place: str) -> np.ndarray:
    """Set positions as one array of fixed size, put together by Spark in words of 64 bits."""
    words = rows.groupBy(F.shiftright(place, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({place} & 63 AS int))")).alias("bits")
    )
    found = words.toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _local_grams(words: list[bytes], lang: str, seed: int, width: int, n: int, maps: list[np.ndarray]):
    """Phrases of n words that may be frequent, as global ids, each once with its count."""
    distinct = list(dict.fromkeys(words))
    start = _prefix(seed, lang)
    hashes = np.fromiter((xxhash.xxh64_intdigest(start + w, 42) for w in distinct), np.uint64, len(distinct))
    known = _has(maps[0], hashes)
    if BREAK in (place := dict(zip(distinct, range(len(distinct)), strict=True))):
        known[place[BREAK]] = False
    ids = hashes[known] & np.uint64(2**width - 1)
    local = np.where(known, np.cumsum(known) - 1, -1)
    for word, number in zip(distinct, local.tolist(), strict=True):
        place[word] = number
    row = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    fits = np.ones(max(len(row) - n + 1, 0), bool)
    for i in range(n):
        fits &= row[i : len(row) - n + 1 + i] >= 0
    for i in range(2 if n > 2 else 0):
        at = np.flatnonzero(fits) + i
        parts = ids[np.stack([row[at + j] for j in range(n - 1)])] if len(at) else np.empty((n - 1, 0), np.uint64)
        fits[at - i] = _has(maps[n - 2], qf.gram_hash(parts))
    at = np.flatnonzero(fits)
    grams = np.stack([row[at + j] for j in range(n)]).astype(np.uint64)
    bits = max(len(ids).bit_length(), 1)
    if n * bits <= 64:
        packed = np.zeros(len(at), np.uint64)
        for part in grams:
            packed = (packed << np.uint64(bits)) | part
        packed, counts = np.unique(packed, return_counts=True)
        grams = np.stack([(packed >> np.uint64(bits * (n - 1 - j))) & np.uint64(2**bits - 1) for j in range(n)])
    else:
        grams, counts = qf.add_up(grams, np.ones(len(at), np.int64))
    return ids[grams.astype(np.int64)] if len(ids) else np.empty((n, 0), np.uint64), counts.astype(np.int64)


def _count_grams(rows: DataFrame, n: int, seed: int, width: int, shard_bits: int, least: int, maps: list) -> DataFrame:
    """(ids, uses, place) of all phrases of n words with at least ``least`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, held, size = [m.value for m in maps], [], 0

        def out(limbs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = qf.by_shard(limbs, counts, width, shard_bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in found], pa.int32()), pa.array([f for _, f in found], pa.binary())], ["shard", "filter"]
            )

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return qf.add_up(np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held]))

        for texts in _by_lang(batches):
            for lang, some in texts.items():
                limbs, counts = _local_grams(tokens(some), lang, seed, width, n, bitmaps)
                held.append((qf.permute(limbs, width), counts))
                size += len(counts)
            if size > HELD:
                held = [joined()]
                size = len(held[0][1])
                if size > HELD // 2:
                    yield from out(*held[0])
                    held, size = [], 0
        if size:
            yield from out(*joined())

    def merge(key: tuple, filters: pa.Table) -> pa.Table:
        limbs, counts = qf.merge(filters.column("filter").to_pylist(), key[0].as_py())
        often = counts >= least
        limbs, counts = qf.permute(limbs[:, often], width, back=True), counts[often]
        places = qf.gram_hash(limbs) >> np.uint64(64 - BITMAP_BITS)
        cuts = pa.array(np.arange(0, limbs.size + 1, n, dtype=np.int32))
        ids = pa.ListArray.from_arrays(cuts, pa.array(limbs.T.reshape(-1).astype(np.int64)))
        return pa.table({"ids": ids, "uses": pa.array(counts), "place": pa.array(places.astype(np.int64))})

    filters = rows.mapInArrow(count, "shard int, filter binary")
    return filters.groupBy("shard").applyInArrow(merge, "ids array<bigint>, uses bigint, place bigint")


def _with_uses(asked: DataFrame, table: DataFrame, on: str, value: str) -> DataFrame:
    """``asked`` with the value of its key, which ``table`` has once; keys may be hot."""
    often = asked.groupBy(on).agg(F.count(F.lit(1)).alias("__asked"))
    known = stage(often.join(table.select(on, value), on), "asked")
    return hot_cold_join(asked, known, on, "__asked", share=1 / 1_000, how="inner").drop("__asked")


def mine(df: DataFrame, least: int = 30, top: int = 2_000, covered: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at
    spaces and tabs. Phrases of 2 to 4 words with ``a >= least`` occurrences are candidates; the cut with the
    lowest floor(2000000 * a / (l + r)) counts, ties go to the shortest first part; a candidate that stands
    inside a longer one with at least ``covered`` percent of its occurrences goes. Ranks order by score, then
    ``a``, both descending, then phrase in byte order.

    A null text is empty, a null language is ``und`` and counts with rows that say so; repeated rows count
    each; very long texts and words are taken whole; other columns are ignored whatever their names; an empty
    table gives no rows.
    """
    docs = df.select(F.coalesce(df[lang].cast("string"), F.lit("und")).alias("lang"), blank(df[text]).alias("text"))
    words = stage(
        docs.mapInArrow(_count_words, "lang string, word string, uses bigint").groupBy("lang", "word").agg(F.sum("uses").alias("uses")), "words"
    )
    sizes = words.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("distinct")).first()
    width = min(63, max(32, 2 * sizes["distinct"].bit_length() + 4))
    shard_bits = min(24, max(4, math.ceil(math.log2(sizes["all"] / SHARD_WORDS + 1))))
    mask = 2**width - 1
    seed = 0
    while True:
        keyed = words.withColumn("hash", _word_hash(seed)).withColumn("place", F.shiftrightunsigned("hash", 64 - BITMAP_BITS))
        keyed = keyed.withColumn("id", F.col("hash").bitwiseAND(F.lit(mask)))
        often = keyed.where(F.col("uses") >= least)
        passing = keyed.join(often.select("place").distinct(), "place", "left_semi")
        if passing.groupBy("id").count().where("count > 1").isEmpty():
            break
        seed += 1
    sc = df.sparkSession.sparkContext
    dictionary = stage(often.select("lang", "word", "id", "uses", "place"), "dictionary")
    maps = [sc.broadcast(_bitmap(dictionary, "place"))]
    counted = [dictionary.select(F.array("id").alias("ids"), "uses")]
    for n in range(2, LONGEST + 1):
        grams = stage(_count_grams(docs, n, seed, width, shard_bits, least, maps), f"grams-{n}")
        maps.append(sc.broadcast(_bitmap(grams, "place")))
        counted.append(grams.select("ids", "uses"))

    known = counted[0]
    for grams in counted[1:]:
        known = known.union(grams)
    candidates = known.where(F.size("ids") > 1)
    inside = candidates.where(F.size("ids") > 2).select(
        "uses", F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), s -> transform(sequence(1, size(ids) - s + 1), i -> slice(ids, i, s))))")).alias("ids")
    ).groupBy("ids").agg(F.max("uses").alias("longer"))
    kept = candidates.join(inside, "ids", "left").where(F.coalesce(F.col("longer") * 100 < F.col("uses") * covered, F.lit(True)))
    kept = stage(kept.select("ids", F.col("uses").alias("a")), "kept")

    cuts = kept.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    sides = cuts.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("first"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"))
    with_left = _with_uses(sides, known.select(F.col("ids").alias("first"), F.col("uses").alias("l")), "first", "l")
    with_both = _with_uses(with_left, known.select(F.col("ids").alias("rest"), F.col("uses").alias("r")), "rest", "r")
    wide = "cast({} AS decimal(38, 0))".format
    score = F.expr(f"{wide('a')} * 2000000 div ({wide('l')} + {wide('r')})").cast("long")
    best = with_both.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    best = stage(best.select("ids", "a", "best.score", "best.l", "best.r"), "best")

    spelt = best.select("ids", F.posexplode("ids").alias("at", "id"))
    table = dictionary.select("id", F.struct("lang", "word").alias("spelling"))
    spelt = _with_uses(spelt, table, "id", "spelling").groupBy("ids").agg(
        F.array_sort(F.collect_list(F.struct("at", "spelling"))).alias("words")
    )
    named = best.join(spelt, "ids").select(
        F.expr("words[0].spelling.lang").alias("lang"), F.expr("concat_ws(' ', transform(words, w -> w.spelling.word))").alias("phrase"), "a", "l", "r", "score"
    )
    named = stage(named, "named")
    groups = min(1_024, named.count() // RANKED + 1)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = named.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("uses").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
