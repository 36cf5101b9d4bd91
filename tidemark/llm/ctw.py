"""Context-tree weighting over bytes, and a unigram baseline.

A text is scored as its lower-cased words joined by one blank and closed by a line feed (which no word
contains), so the score is a probability of the sequence of words, like the baseline. Each byte is
eight binary decisions; a decision node's contexts of 0 to ``depth`` bytes form a tree, each context
has the Krichevsky-Trofimov estimate of its decisions, and a context weighs its own estimate against
the product of its longer contexts by how well either codes the training text. The mixture over all
depths, the path's posterior weights, is what predicts.

All windows are counted by one shuffle. Every context that training text has at least ``LEAST`` times
stands in the tree; what lies below a rarer one is one more branch of its parent. Contexts of three bytes
and more are weighted where the windows that end in the same three bytes lie; the sums of their weights
meet the contexts of up to two bytes, of which there are at most 65,793, on the driver. With those every window of any text gets
its probability, which texts meet by window: the most frequent ones are broadcast, the others joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blank, pack_windows, row_key, stage
from tidemark.llm.grams import WindowCounter, batches_of, count_words, words_of

END = "\n"
#: Context bytes (3 to 6), and how often training text has a context that stands in the tree.
DEPTH, LEAST = 6, 2
#: Context bytes that the driver weighs, windows that a task works on at once, and windows that are broadcast.
TOP, CHUNK, HOT_WINDOWS = 2, 60_000, 2_000_000
#: Words with at least this share of all training words are broadcast with their counts.
HOT_WORDS = 1 / 1_048_576
_LOG_PI, _LOG_2 = math.log(math.pi), math.log(2)


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; x > 0."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    inverse = 1 / y
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 / 1260))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _nodes(counts: np.ndarray) -> np.ndarray:
    """Totals of the 256 leaves and of the decision nodes 1..255 above them."""
    total = np.zeros((len(counts), 512))
    total[:, 256:] = counts
    for p in range(255, 0, -1):
        total[:, p] = total[:, 2 * p] + total[:, 2 * p + 1]
    return total


def _kt(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log KT block probability and predictive probability of a one, per decision node."""
    zero, one = total[:, 0:512:2][:, :256], total[:, 1:512:2][:, :256]
    block = log_gamma(zero + 0.5) + log_gamma(one + 0.5) - log_gamma(zero + one + 1) - _LOG_PI
    return np.where(zero + one > 0, block, 0.0), (one + 0.5) / (zero + one + 1)


def _slices(n: int, size: int = 1_024) -> list[slice]:
    return [slice(a, min(a + size, n)) for a in range(0, n, size)]


class ContextTree:
    """Log10 probabilities of the next byte for every context of a small tree, held in memory as a whole."""

    def __init__(self, depth: int, keys: list[np.ndarray], counts: list[np.ndarray]):
        """``keys[d]`` are sorted contexts of d bytes (latest lowest), closed under shortening.

        Levels are worked through in slices and kept in single precision.
        """
        self.depth = depth
        parents = [np.searchsorted(keys[d - 1], keys[d] & np.uint64((1 << 8 * (d - 1)) - 1)) if d else None for d in range(len(keys))]
        weigh, below = self._weights(counts, parents)
        first = np.cumsum([0, *map(len, keys)])
        self.log10 = np.zeros((first[-1], 256), np.float32)
        self.longer = np.full((first[-1], 256), -1, np.int32)
        above = tuple(np.full((1, 256), x, np.float32) for x in (0.0, 1.0, 0.5))
        for d in range(len(keys)):
            up = parents[d] if d else np.zeros(len(keys[0]), np.int64)
            if d:
                self.longer[first[d - 1] + up, (keys[d] >> np.uint64(8 * (d - 1))).astype(np.int64)] = np.arange(first[d], first[d + 1])
            level = tuple(np.empty((len(keys[d]), 256), np.float32) for _ in range(3))
            for at in _slices(len(keys[d])):
                total = _nodes(counts[d][at])
                own, seen = _kt(total)[1], total[:, :256] > 0
                mixed, left, final = (x[up[at]].astype(np.float64) for x in above)
                stop = weigh[d][at].astype(np.float64)
                mixed += left * stop * own
                left *= 1 - stop
                # Below a cut the one more branch predicts; nodes it never met are left to this context.
                rest = below[d][at].astype(np.float64)
                final = np.where(seen, mixed + left * np.where(np.isnan(rest), own, rest), final)
                for x, y in zip(level, (mixed, left, final), strict=True):
                    x[at] = y
                self.log10[first[d] + at.start : first[d] + at.stop] = _byte_logs(final)
            above, counts[d], weigh[d], below[d] = level, None, None, None

    @staticmethod
    def _weights(counts, parents):
        """Posterior weight of stopping at each node, and what the cut-off branch predicts (NaN: never met)."""
        weigh, below, deeper = [None] * len(counts), [None] * len(counts), None
        for d in range(len(counts) - 1, -1, -1):
            n = len(counts[d])
            weigh[d], below[d], after = np.ones((n, 256), np.float32), np.full((n, 256), np.nan, np.float32), np.empty((n, 256))
            inner = d < len(counts) - 1
            if inner:
                rest, split = counts[d].copy(), np.zeros((n, 256))
                np.subtract.at(rest, parents[d + 1], counts[d + 1])
                np.add.at(split, parents[d + 1], deeper)
            for at in _slices(n):
                own, _ = _kt(_nodes(counts[d][at]))
                if inner:
                    total = _nodes(rest[at])
                    block, ones = _kt(total)
                    both = np.logaddexp(own, split[at] + block)
                    weigh[d][at] = np.exp(own - both)
                    below[d][at] = np.where(total[:, :256] > 0, ones, np.nan)
                    own = both - _LOG_2
                after[at] = own
            deeper = after
        return weigh, below

    def logs(self, data: np.ndarray) -> np.ndarray:
        """Log10 probability of data[i] after its ``depth`` predecessors, for i >= depth."""
        n = len(data) - self.depth
        state, alive = np.zeros(n, np.int32), np.arange(n)
        longer = self.longer.ravel()
        for d in range(1, self.depth + 1):
            step = longer[state[alive].astype(np.int64) * 256 + data[alive + (self.depth - d)]]
            alive, step = alive[step >= 0], step[step >= 0]
            state[alive] = step
        return self.log10.ravel()[state.astype(np.int64) * 256 + data[self.depth :]].astype(np.float64)


def _byte_logs(ones: np.ndarray) -> np.ndarray:
    logs = np.zeros((len(ones), 512))
    one, zero = np.log10(ones), np.log10(1 - ones)
    for p in range(1, 256):
        logs[:, 2 * p] = logs[:, p] + zero[:, p]
        logs[:, 2 * p + 1] = logs[:, p] + one[:, p]
    return logs[:, 256:]


def _path(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decision nodes of each byte, and what it decides there."""
    places = np.arange(8)
    byte = byte.astype(np.int64)[:, None]
    return (1 << places) | (byte >> (8 - places)), (byte >> (7 - places)) & 1


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of each of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _block(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    block = log_gamma(zero + 0.5) + log_gamma(one + 0.5) - log_gamma(zero + one + 1) - _LOG_PI
    return np.where(zero + one > 0, block, 0.0)


def _latest_first(context: np.ndarray, depth: int) -> np.ndarray:
    """Contexts with the latest byte highest, so that shorter contexts are prefixes."""
    out = np.zeros(len(context), np.int64)
    for i in range(depth):
        out |= (context >> 8 * i & 255) << 8 * (depth - 1 - i)
    return out


class Levels:
    """Contexts of ``first`` to ``last`` bytes, by (context, node) of the nodes that were met."""

    def __init__(self, first: int, last: int, context: np.ndarray, byte: np.ndarray, n: np.ndarray, under=None, least: int = LEAST):
        """``context`` has ``last`` bytes, latest highest. ``under`` is what longer contexts hand up, None without any.

        All windows of a context of ``first`` bytes must be there.
        """
        self.first, self.last, self.levels = first, last, []
        learnt = n > 0
        key, n = _sums(context[learnt] << 8 | byte[learnt], n[learnt].astype(np.float64))
        for d in range(last, first - 1, -1):
            if d < last:
                key, n = _sums(key >> 16 << 8 | key & 255, n)
            known, total = _sums(key >> 8, n)
            keep = (total >= least)[np.searchsorted(known, key >> 8)] if d else np.ones(len(key), bool)
            nodes, bits = _path(key[keep] & 255)
            weight = n[keep][:, None]
            keys, zero, one = _sums((key[keep][:, None] >> 8 << 8 | nodes).ravel(), (weight * (1 - bits)).ravel(), (weight * bits).ravel())
            after, own = _block(zero, one), (one + 0.5) / (zero + one + 1)
            stop, rest = np.ones(len(keys)), own
            if under is not None:
                split, more_zero, more_one = np.zeros(len(keys)), zero.copy(), one.copy()
                at = np.searchsorted(keys, under[0])
                split[at] = under[1]
                more_zero[at] -= under[2]
                more_one[at] -= under[3]
                both = np.logaddexp(after, split + _block(more_zero, more_one))
                stop, after = np.exp(after - both), both - _LOG_2
                # Below a cut the one more branch predicts; nodes it never met are left to this context.
                rest = np.where(more_zero + more_one > 0, (more_one + 0.5) / (more_zero + more_one + 1), own)
            self.levels.insert(0, (keys, own, stop, rest))
            under = _sums(keys >> 16 << 8 | keys & 255, after, zero, one)
        self.up = under

    def predict(self, context: np.ndarray, byte: np.ndarray, state=None):
        """Mixture so far, weight left, and probability of a one, at the eight nodes of each byte."""
        nodes, _ = _path(byte)
        mixed, left, final = state or (np.zeros(nodes.shape), np.ones(nodes.shape), np.full(nodes.shape, 0.5))
        for d, (keys, own, stop, rest) in enumerate(self.levels, self.first):
            if not len(keys):
                break
            want = (context >> 8 * (self.last - d) << 8)[:, None] | nodes
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            mixed = np.where(hit, mixed + left * stop[at] * own[at], mixed)
            left = np.where(hit, left * (1 - stop[at]), left)
            final = np.where(hit, mixed + left * rest[at], final)
        return mixed, left, final


def count_windows(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, seen, learnt) from (text, held_out): occurrences in all rows and in those that are not held out."""
    pad = END.encode() * depth

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WindowCounter(depth + 1)

        def drained() -> Iterator[pa.RecordBatch]:
            keys, n = counter.drain()
            at, mark = 0, np.uint64(1)
            while at < len(keys):
                end = min(at + 500_000, len(keys))
                end += int(end < len(keys) and keys[end] >> mark == keys[end - 1] >> mark)
                part, counted = keys[at:end], n[at:end]
                gram = (part >> mark).view(np.int64)
                first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
                learnt = np.add.reduceat(np.where(part & mark, 0, counted), first)
                yield from batches_of(["gram", "seen", "learnt"], gram[first], np.add.reduceat(counted, first), learnt)
                at = end

        for batch in batches:
            for t, out in zip(batch.column(0), batch.column(1), strict=True):
                counter.add(b" ".join(words_of(t.as_py())) + END.encode(), pad, int(out.as_py()))
            if counter.full():
                yield from drained()
        yield from drained()

    grams = rows.select("text", "held_out").mapInArrow(count, "gram bigint, seen bigint, learnt bigint")
    return grams.groupBy("gram").agg(F.sum("seen").alias("seen"), F.sum("learnt").alias("learnt"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of runs of at least CHUNK rows that end where the first column changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append([c.to_numpy() for c in batch.columns])
        if sum(len(h[0]) for h in held) < CHUNK:
            continue
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
        if cut:
            yield [c[:cut] for c in whole]
        held = [[c[cut:] for c in whole]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def probabilities(windows: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(gram, seen, log10) for every window of ``windows``: the log10 probability of its last byte after the others."""
    near = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * (TOP + 1)) - 1)).alias("near")
    together = lambda rows: rows.repartition("near").sortWithinPartitions("near")

    def lower(gram: np.ndarray, learnt: np.ndarray) -> tuple[Levels, np.ndarray, np.ndarray]:
        context, byte = _latest_first(gram >> 8, depth), gram & 255
        return Levels(TOP + 1, depth, context, byte, learnt, least=least), context, byte

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, gram, learnt in _chunks(batches):
            yield from batches_of(["key", "split", "zero", "one"], *lower(gram, learnt)[0].up)

    handed = together(windows.where("learnt > 0").select(near, "gram", "learnt")).mapInArrow(weigh, "key bigint, split double, zero double, one double")
    # At most 255 nodes, and 256 bytes, of each context of TOP bytes.
    handed = handed.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("split", "zero", "one"))).toArrow().sort_by("key")
    short = windows.where("learnt > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (TOP + 1)) - 1)).alias("gram")).agg(F.sum("learnt").alias("n")).toArrow()
    gram = short.column("gram").to_numpy()
    under = tuple(handed.column(c).to_numpy() for c in ("key", "split", "zero", "one"))
    upper = Levels(0, TOP, _latest_first(gram >> 8, TOP), gram & 255, short.column("n").to_numpy().astype(np.float64), under, least)
    shipped = windows.sparkSession.sparkContext.broadcast(upper)
    # The driver needs none of this any more; the broadcast is kept in a file.
    del handed, short, gram, under, upper

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, gram, seen, learnt in _chunks(batches):
            tree, context, byte = lower(gram, learnt)
            for at in range(0, len(gram), CHUNK):
                c, b = context[at : at + CHUNK], byte[at : at + CHUNK]
                ones = tree.predict(c, b, shipped.value.predict(c >> 8 * (depth - TOP), b))[2]
                logs = np.log10(np.where(_path(b)[1] == 1, ones, 1 - ones)).sum(axis=1)
                yield from batches_of(["gram", "seen", "log10"], gram[at : at + CHUNK], seen[at : at + CHUNK], logs)

    return together(windows.select(near, "gram", "seen", "learnt")).mapInArrow(predict, "gram bigint, seen bigint, log10 double")


class WindowTable:
    """Values of windows, found by the highest bits of their scattered keys and a few steps from there.

    A search by halves in two million keys waits for memory twenty times, this one two or three times. Of
    windows with the same highest bits those that were given first are looked at first.
    """

    SCATTER = np.uint64(0x9E3779B97F4A7C15)  # odd, so that no two windows share a key

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        keys = grams.view(np.uint64) * self.SCATTER
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        part = keys >> self.shift
        order = np.argsort(part, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.starts = np.searchsorted(part[order], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Where the value of each window stands, -1 for windows that are not held."""
        if not len(self.keys):
            return np.full(len(grams), -1, np.int32)
        keys = grams.view(np.uint64) * self.SCATTER
        part = (keys >> self.shift).astype(np.int64)
        out = self.starts.take(part)
        left = np.flatnonzero(self.keys.take(out, mode="clip") != keys)
        at, end, want = out[left], self.starts.take(part[left] + 1), keys[left]
        out[left] = -1
        while len(left):
            at += 1
            inside = at < end
            left, at, end, want = left[inside], at[inside], end[inside], want[inside]
            hit = self.keys.take(at) == want
            out[left[hit]] = at[hit]
            left, at, end, want = left[~hit], at[~hit], end[~hit], want[~hit]
        return out


def window_scores(rows: DataFrame, table: DataFrame, depth: int = DEPTH, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """(row_key, score): rows whose sum is the log10 probability of the texts of that key. ``table`` holds every window."""
    size = F.floor(F.log2("seen") * 8).cast("int").alias("size")
    edge, room = 512, hot_windows
    for r in table.groupBy(size).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
        room -= r["n"]
        if room < 0:
            break
        edge = r["size"]
    is_hot = F.floor(F.log2("seen") * 8) >= F.lit(edge)
    hot = table.where(is_hot).select("gram", "seen", "log10").toArrow()  # at most ``hot_windows`` rows of 24 bytes, as Arrow: rows of Python objects would be far larger
    hot = hot.sort_by([("seen", "descending"), ("gram", "ascending")])
    shipped = rows.sparkSession.sparkContext.broadcast(WindowTable(hot.column("gram").to_numpy(), hot.column("log10").to_numpy()))
    del hot
    end = END.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        names = ["row_key", "gram", "n", "score"]
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.slice(start, 512)
                keys = batch.column(0).to_numpy()
                texts = [b" ".join(words_of(t.as_py())) + end for t in batch.column(1)]
                sums = np.zeros(len(keys))
                for owner, grams in _windows(texts, end * depth):
                    at = known.find(grams)
                    hit = at >= 0
                    sums += np.bincount(owner[hit], known.values[at[hit]], len(keys))
                    own, cold = owner[~hit], grams[~hit]
                    order = np.lexsort((cold, own))
                    own, cold = own[order], cold[order]
                    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (cold[1:] != cold[:-1])]) if len(own) else np.empty(0, np.int64)
                    n = np.diff(np.r_[first, len(own)]).astype(np.int32)
                    yield from batches_of(names, keys[own[first]], cold[first].view(np.int64), n, np.zeros(len(first)))
                # A gram below zero is none; its key spreads these rows over the join.
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys | np.int64(-1 << 63)), pa.array(np.zeros(len(keys), np.int32)), pa.array(sums)], names)

    parts = rows.select("row_key", "text").mapInArrow(run, "row_key bigint, gram bigint, n int, score double")
    joined = parts.join(table.where(~is_hot).select("gram", "log10"), "gram", "left")
    return joined.select("row_key", (F.col("score") + F.col("n") * F.coalesce("log10", F.lit(0.0))).alias("score"))


def _windows(texts: list[bytes], pad: bytes, size: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, window) of every byte of the texts, of about ``size`` bytes at once."""
    owners: list[int] = []
    held: list[bytes] = []

    def packed() -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in held])
        inside = np.ones(lengths.sum(), bool)
        for back in range(1, len(pad) + 1):  # windows that would reach into the next piece
            inside[np.cumsum(lengths) - back] = False
        grams = pack_windows(np.frombuffer(b"".join(held), np.uint8), len(pad) + 1)
        return np.repeat(owners, lengths - len(pad)), grams[inside[: len(grams)]]

    for i, piece in _pieces(texts, pad, size):
        owners.append(i)
        held.append(piece)
        if sum(map(len, held)) >= size:
            yield packed()
            owners, held = [], []
    if held:
        yield packed()


def _pieces(texts: list[bytes], pad: bytes, size: int = 1_000_000) -> Iterator[tuple[int, bytes]]:
    """The texts after ``pad``, in parts that overlap by its length."""
    for i, text in enumerate(texts):
        whole = pad + text
        for at in range(0, len(text), size):
            yield i, whole[at : at + size + len(pad)]


def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2,
    depth: int = DEPTH, least: int = LEAST,
) -> DataFrame:
    """One row per row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte).

    Rows whose crc32(doc_id) mod ``folds`` is ``fold`` teach nothing; a null id is never held out. A null
    text is empty and has one token, the end. Rows that agree in id and text share their scores and have a row
    each. Very long texts are scored whole; other columns are ignored whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), blank(text).alias("text"), held_out(doc_id, folds, fold).alias("held_out"), row_key(doc_id, text).alias("row_key"))
    learn = rows.where(~F.col("held_out")).select("text")
    words = learn.mapInArrow(lambda batches: count_words(batches, END), "word string, n bigint")
    words = stage(words.groupBy("word").agg(F.sum("n").alias("n")), "ctw-words")
    size = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, vocabulary = size["n"] or 0, size["v"]
    log_all = math.log10(n_all + vocabulary + 1)
    table = stage(probabilities(stage(count_windows(rows, depth), "ctw-windows"), depth, least), "ctw-probabilities")
    # At most 1 / HOT_WORDS words reach the driver and the workers.
    hot_rows = words.where(F.col("n") >= F.lit(max(2.0, n_all * HOT_WORDS))).toPandas()
    hot = {w.encode(): math.log10(n + 1) - log_all for w, n in zip(hot_rows["word"], hot_rows["n"], strict=True)}
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                yield from _score_batch(whole.slice(at, 512), shipped.value)

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInArrow(run, f"row_key bigint, doc_id {kind}, word string, n int, held_out boolean, n_tokens bigint, n_known bigint, own_base double, n_bytes bigint")
    cold = words.where(F.col("n") < F.lit(max(2.0, n_all * HOT_WORDS))).select("word", F.col("n").alias("c"))
    joined = parts.join(cold, "word", "left").withColumn("score", F.lit(0.0))
    # Rows of window scores have no word and count nothing else.
    scored = window_scores(rows, table, depth).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("row_key", "score") else F.col(f.name) for f in joined.schema))
    joined = joined.unionByName(scored)
    marker = F.col("n_tokens").isNotNull()
    unknown = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1) - F.lit(log_all)
    # Plain columns, which a hash aggregate holds: a struct would have every row sorted.
    summed = joined.groupBy("row_key").agg(
        F.max("doc_id").alias("doc_id"), F.count(F.when(marker, 1)).alias("copies"), *(F.max(c).alias(c) for c in ("held_out", "n_tokens", "n_known", "own_base", "n_bytes")),
        F.sum(F.when(marker, 0).otherwise(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("known"),
        F.sum(F.when(marker, 0.0).otherwise(F.col("n") * unknown)).alias("base"), F.sum("score").alias("score"),
    )
    each = summed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + (F.col("known") / F.col("copies")).cast("long")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("own_base") + F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"), "n_bytes", (-F.col("score") / F.col("copies") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _score_batch(batch: pa.RecordBatch, hot: dict[bytes, float]) -> Iterator[pa.RecordBatch]:
    """One marker row per text with what needs no join, and a row per text and word that is not hot."""
    end = END.encode()
    keys = batch.column(3).to_pylist()
    texts = [words_of(t.as_py()) for t in batch.column(1)]
    markers, cold_keys, cold_words, cold_counts = [], [], [], []
    for i, (tokens, out) in enumerate(zip(texts, batch.column(2).to_pylist(), strict=True)):
        base, known = 0.0, 0
        for w, n in Counter(tokens).items():
            x = hot.get(w)
            if x is None:
                cold_keys.append(keys[i])
                cold_words.append(w)
                cold_counts.append(n)
            else:
                base, known = base + n * x, known + n
        if end in hot:
            base, known = base + hot[end], known + 1
        else:
            cold_keys.append(keys[i])
            cold_words.append(end)
            cold_counts.append(1)
        markers.append((out, len(tokens) + 1, known, base, len(b" ".join(tokens)) + len(end)))
    names, kinds = ["held_out", "n_tokens", "n_known", "own_base", "n_bytes"], [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    # A marker's word holds a blank, which no word does; the key in it spreads markers over the join.
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), batch.column(0), pa.array([f"own {k}" for k in keys]), pa.array([1] * len(keys), pa.int32()),
         *(pa.array([m[i] for m in markers], k) for i, k in enumerate(kinds))],
        ["row_key", "doc_id", "word", "n", *names],
    )
    yield pa.RecordBatch.from_arrays(
        [pa.array(cold_keys, pa.int64()), pa.nulls(len(cold_keys), batch.schema.field(0).type), pa.array(cold_words, pa.string()), pa.array(cold_counts, pa.int32()),
         *(pa.nulls(len(cold_keys), k) for k in kinds)],
        ["row_key", "doc_id", "word", "n", *names],
    )
