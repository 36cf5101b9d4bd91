"""Interpolated modified Kneser-Ney byte model, trained on trusted text, as a quality classifier.

Windows of ``ORDER`` bytes are counted over trusted and all text in one shuffle. Continuation counts,
discounts and context totals are aggregates of that table, and the probability of every window that
occurs anywhere is built order by order through joins sharded on the window and on its context. Texts
meet these probabilities by window: the windows with at least ``HOT_SHARE`` of all occurrences are
broadcast (at most 1/HOT_SHARE), the others are joined as (row, window, count) rows, so every window of
every text counts. A text's perplexity per byte is held against a quantile of its language, learnt
from the fifth of all trusted rows that did not train the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blank, pack_windows, released, row_key, stage
from tidemark.llm.grams import WindowCounter, batches_of

ORDER = 4
HOT_SHARE = 1 / 262_144
#: A fifth of all trusted rows is set aside and sets the thresholds; all others train the model.
SET_ASIDE = 5
#: So many ids of training rows are broadcast at most, counted first; beyond, texts are shuffled to meet them.
BROADCAST_IDS = 5_000_000
#: The quantile of trusted perplexity, and the factor above it from which a text is rejected. A language
#: with fewer rows than LEAST_ROWS uses the quantile over all languages.
QUANTILE, MARGIN, LEAST_ROWS = 0.99, 1.15, 50
#: Texts up to this many bytes have a quantile of their own, learnt from LEAST_ROWS trusted ones or none.
LEAST_BYTES = 100
#: Rank error of a quantile, as one part of so many.
RANKS = 100_000
PAD, END = b"\n", b"\x00"


def trusted_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label_id: str = "doc_id") -> DataFrame:
    """(trusted_id, train): all ids labelled quality 1 and not toxic; all that are not set aside, by hash, train."""
    clean = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(label_id).isNotNull())
    known = docs.select(F.col(doc_id).alias("trusted_id"))
    ids = clean.select(F.col(label_id).alias("trusted_id")).distinct().join(known, "trusted_id", "left_semi")
    return ids.select("trusted_id", (F.pmod(F.hash("trusted_id"), F.lit(SET_ASIDE)) != 0).alias("train"))


def count_windows(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, seen, learnt) from (text, train): occurrences in all rows and in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = WindowCounter(order), WindowCounter(order)

        def drained(which: int) -> Iterator[pa.RecordBatch]:
            keys, n = both[which].drain()
            learnt = n if which else np.zeros_like(n)
            yield from batches_of(["gram", "seen", "learnt"], keys.view(np.int64), n, learnt)

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1), strict=True):
                both[bool(train.as_py())].add(text.as_py().encode() + END, PAD * (order - 1))
            for which in (0, 1):
                if both[which].full():
                    yield from drained(which)
        yield from drained(0)
        yield from drained(1)

    counted = rows.select("text", "train").mapInArrow(released(run), "gram bigint, seen bigint, learnt bigint")
    return counted.groupBy("gram").agg(F.sum("seen").alias("seen"), F.sum("learnt").alias("learnt"))


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of an order, from how many windows have counts 1 to 4."""
    n = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not all(n.get(i) for i in (1, 2, 3, 4)):
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]


def probabilities(windows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, seen, p) for every window of ``windows``: interpolated over all orders."""
    mask = lambda k: F.lit((1 << 8 * k) - 1)
    counts = {order: stage(windows.where("learnt > 0").select("gram", F.col("learnt").alias("c")), "kn-counts")}
    for k in range(order - 1, 0, -1):
        # How many different bytes a window was seen after.
        counts[k] = stage(counts[k + 1].groupBy(F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.count("*").alias("c")), "kn-counts")
    below = windows.select(F.col("gram").bitwiseAND(mask(1)).alias("gram")).distinct().withColumn("p", F.lit(1 / 256))
    for k in range(1, order + 1):
        d = discounts(counts[k])
        table = counts[k].withColumn("context", F.shiftright("gram", 8))
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = table.groupBy("context").agg(F.sum("c").alias("all"), F.sum(taken).alias("freed"))
        wanted = windows.select(F.col("gram").bitwiseAND(mask(k)).alias("gram")).distinct() if k < order else windows.select("gram", "seen")
        wanted = wanted.withColumn("context", F.shiftright("gram", 8)).withColumn("shorter", F.col("gram").bitwiseAND(mask(max(k - 1, 1))))
        lower = below.select(F.col("gram").alias("shorter"), F.col("p").alias("lower"))
        found = (
            wanted.join(table.select("gram", "c", taken.alias("taken")), "gram", "left")
            .join(contexts, "context", "left").join(lower, "shorter", "left")
        )
        own = F.greatest(F.coalesce(F.col("c") - F.col("taken"), F.lit(0.0)), F.lit(0.0))
        p = F.when(F.col("all").isNull(), F.col("lower")).otherwise((own + F.col("freed") * F.col("lower")) / F.col("all"))
        below = stage(found.select("gram", *(["seen"] if k == order else []), p.alias("p")), "kn-probabilities")
    return below


def perplexities(rows: DataFrame, table: DataFrame, order: int = ORDER, hot_share: float = HOT_SHARE) -> DataFrame:
    """(row_key, ..., n_bytes, copies, log10): per distinct (row_key, doc_id, lang) of ``rows``.

    ``rows`` has (row_key, doc_id, lang, text); ``table`` is (gram, seen, p) and holds every window.
    """
    total = table.agg(F.sum("seen")).first()[0] or 0
    is_hot = F.col("seen") >= F.lit(max(2.0, total * hot_share))
    hot = table.where(is_hot).select("gram", F.log10("p").alias("lp")).toPandas().sort_values("gram")
    shipped = rows.sparkSession.sparkContext.broadcast((hot["gram"].to_numpy(np.int64).view(np.uint64), hot["lp"].to_numpy(np.float64)))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "lang")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shipped.value
        names = ["row_key", "doc_id", "lang", "gram", "n", "log10", "n_bytes"]
        for whole in batches:
            for at in range(0, len(whole), 1_000):
                batch = whole.slice(at, 1_000)
                keys, sums, sizes, far = batch.column(0).to_pylist(), [], [], []
                for key, text in zip(keys, batch.column(3), strict=True):
                    data = text.as_py().encode() + END
                    grams, n = np.unique(pack_windows(np.frombuffer(PAD * (order - 1) + data, np.uint8), order), return_counts=True)
                    place = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
                    hit = known[place] == grams if len(known) else np.zeros(len(grams), bool)
                    sums.append(float((logs[place[hit]] * n[hit]).sum()) if len(known) else 0.0)
                    sizes.append(len(data))
                    far.append((np.full((~hit).sum(), key, np.int64), grams[~hit].view(np.int64), n[~hit]))
                # A marker's gram is negative, which no window is; its key spreads markers over the join.
                spread = (np.array(keys, np.int64) | np.int64(-1 << 63))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), batch.column(1), batch.column(2), pa.array(spread), pa.array([1] * len(keys), pa.int32()), pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())], names)
                key, gram, n = (np.concatenate([f[i] for f in far]) if far else np.empty(0, np.int64) for i in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.nulls(len(key), batch.schema.field(1).type), pa.nulls(len(key), batch.schema.field(2).type), pa.array(gram), pa.array(n.astype(np.int32)), pa.nulls(len(key), pa.float64()), pa.nulls(len(key), pa.int64())], names)

    parts = rows.select("row_key", "doc_id", "lang", "text").mapInArrow(
        run, f"row_key bigint, doc_id {kinds['doc_id']}, lang {kinds['lang']}, gram bigint, n int, log10 double, n_bytes bigint")
    joined = parts.join(table.where(~is_hot).select("gram", "p"), "gram", "left")
    marker = F.col("n_bytes").isNotNull()
    return joined.groupBy("row_key").agg(
        F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("copies"),
        (F.max("log10") + F.sum(F.when(marker, 0.0).otherwise(F.col("n") * F.log10("p"))) / F.count("n_bytes")).alias("log10"),
    )


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(row_key, doc_id, lang, n_bytes, perplexity, threshold, kept), a row per row.

    Rows that agree in id, text and language share their results; each judges and teaches as one row.
    Very long texts are scored whole, equal perplexities are judged alike, other columns are ignored.

    Null texts are empty; empty texts are kept. A language that is null or has too few trusted rows has
    the threshold of all languages; without any trusted row everything is kept. Short texts (up to
    LEAST_BYTES bytes) have thresholds of their own, and none if too few trusted ones are as short.
    """
    ids = stage(trusted_rows(docs, labels, doc_id, "doc_id"), "kn-trusted-rows")
    learnt = ids.where("train")
    if learnt.count() <= BROADCAST_IDS:
        learnt = F.broadcast(learnt)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), blank(text).alias("text"), F.xxhash64(row_key(doc_id, text), F.col(lang)).alias("row_key"))
    rows = rows.join(learnt, rows["doc_id"] == learnt["trusted_id"], "left").withColumn("train", F.coalesce("train", F.lit(False)))
    table = probabilities(stage(count_windows(rows), "kn-windows"))
    scored = perplexities(rows, table).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10") / F.col("n_bytes")))
    scored = stage(scored.select("row_key", "doc_id", "lang", "n_bytes", "perplexity", "copies"), "kn-scores")
    scored = scored.withColumn("short", F.col("n_bytes") <= LEAST_BYTES)
    judges = scored.where("n_bytes > 1").join(ids.where(~F.col("train")), F.col("doc_id") == F.col("trusted_id"), "left_semi")
    level = (F.percentile_approx("perplexity", F.lit(QUANTILE), F.lit(RANKS)) * F.lit(MARGIN)).alias("own")
    overall = {r["short"]: r["own"] for r in judges.groupBy("short").agg(level, F.count("*").alias("rows")).collect() if not r["short"] or r["rows"] >= LEAST_ROWS}
    per_lang = judges.groupBy("lang", "short").agg(level, F.count("*").alias("rows")).where(F.col("rows") >= LEAST_ROWS).where("lang IS NOT NULL")
    limits = F.broadcast(per_lang.select(F.col("lang").alias("of_lang"), F.col("short").alias("of_short"), "own"))  # two rows per language
    others = F.when(F.col("short"), overall.get(True, math.inf)).otherwise(overall.get(False, math.inf))
    out = scored.join(limits, (F.col("lang") == F.col("of_lang")) & (F.col("short") == F.col("of_short")), "left").withColumn("threshold", F.coalesce("own", others))
    kept = (F.col("perplexity") <= F.col("threshold")) | (F.col("n_bytes") <= 1)
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("row_key", "doc_id", "lang", "n_bytes", "perplexity", "threshold", kept.alias("kept"))
