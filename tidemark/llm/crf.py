"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so tokens are labelled first: a word, or the first letters of a word, that
many toxic and hardly any other training documents hold marks its tokens in toxic documents. The
chain learns emission weights of such words and beginnings, a bias and transitions from these tokens.
Scoring runs forward-backward over every token of every text; the marginals say which tokens offend,
and a logistic curve over their expected number, fitted on the training documents, is the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blank, released, stage

#: Bounds on the labelled rows of either class that are learnt from, and on those whose tokens fit the chain.
LABELLED_ROWS, CHAIN_ROWS = 10_000, 600
#: A marking feature stands in this share of toxic documents, in LEAST_DOCS at least, and is this many
#: times likelier there than in others.
LEAST_SHARE, LEAST_DOCS, LEAST_RATIO = 0.004, 3, 20.0
BEGINNINGS = (5, 4)
PUNCTUATION = ".,;:!?\"'()[]{}<>|*%$#&-"
CHUNK = 128
#: Marginals below this are not added up.
DOUBT = 0.1
_TOKEN = re.compile(r"\S+")


def tokens_of(text: str) -> list[str]:
    """Lower-cased tokens without outer punctuation, one for each run of non-blank characters."""
    return [t.strip(PUNCTUATION) for t in text.lower().split()]


def forward_backward(odds: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray):
    """Marginals of state 1 for chains laid end to end, and the expected transitions.

    ``odds`` are the emission log-odds of state 1, ``first`` marks the first token of each chain,
    ``start`` and ``move`` are positive start and transition weights. The chains are cut into equal
    chunks which advance together: products of each chunk, then the states between chunks, then the
    tokens inside.
    """
    n = len(odds)
    if n == 0:
        return np.empty(0), np.zeros((2, 2))
    chunks = -(-n // CHUNK)
    wide = chunks * CHUNK
    grown, begin = np.ones(wide), np.ones(wide, bool)
    grown[:n], begin[:n] = np.exp(np.clip(odds, -30, 30)), first
    x = np.ascontiguousarray(grown.reshape(chunks, CHUNK).T)
    b = np.ascontiguousarray(begin.reshape(chunks, CHUNK).T)
    m00, m10 = np.where(b, start[0], move[0, 0]), np.where(b, start[0], move[1, 0])
    m01, m11 = np.where(b, start[1], move[0, 1]) * x, np.where(b, start[1], move[1, 1]) * x
    p00, p01, p10, p11 = np.ones(chunks), np.zeros(chunks), np.zeros(chunks), np.ones(chunks)
    for t in range(CHUNK):
        p00, p01 = p00 * m00[t] + p01 * m10[t], p00 * m01[t] + p01 * m11[t]
        p10, p11 = p10 * m00[t] + p11 * m10[t], p10 * m01[t] + p11 * m11[t]
        norm = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / norm, p01 / norm, p10 / norm, p11 / norm
    product = np.stack([p00, p01, p10, p11], axis=1).tolist()
    into, out = [], [(0.5, 0.5)]
    a0, a1 = 0.5, 0.5
    for q00, q01, q10, q11 in product:
        into.append((a0, a1))
        a0, a1 = a0 * q00 + a1 * q10, a0 * q01 + a1 * q11
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    for q00, q01, q10, q11 in reversed(product[1:]):
        c0, c1 = out[-1]
        c0, c1 = q00 * c0 + q01 * c1, q10 * c0 + q11 * c1
        out.append((c0 / (c0 + c1), c1 / (c0 + c1)))
    f0, f1 = np.empty_like(x), np.empty_like(x)
    a0, a1 = (np.array(v) for v in zip(*into, strict=True))
    for t in range(CHUNK):
        a0, a1 = a0 * m00[t] + a1 * m10[t], a0 * m01[t] + a1 * m11[t]
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
        f0[t], f1[t] = a0, a1
    c0, c1 = (np.array(v[::-1]) for v in zip(*out, strict=True))
    g0, g1 = np.empty_like(x), np.empty_like(x)
    for t in range(CHUNK - 1, -1, -1):
        g0[t], g1[t] = c0, c1
        c0, c1 = m00[t] * c0 + m01[t] * c1, m10[t] * c0 + m11[t] * c1
        c0, c1 = c0 / (c0 + c1), c1 / (c0 + c1)
    flat = lambda a: a.T.ravel()[:n]
    f0, f1, g0, g1, m00, m01, m10, m11 = map(flat, (f0, f1, g0, g1, m00, m01, m10, m11))
    one = f1 * g1 / (f0 * g0 + f1 * g1)
    inner = np.flatnonzero(~first)
    q = [[f0[inner - 1] * m00[inner] * g0[inner], f0[inner - 1] * m01[inner] * g1[inner]], [f1[inner - 1] * m10[inner] * g0[inner], f1[inner - 1] * m11[inner] * g1[inner]]]
    every = q[0][0] + q[0][1] + q[1][0] + q[1][1]
    return one, np.array([[(q[i][j] / every).sum() for j in (0, 1)] for i in (0, 1)])


@dataclass
class ToxicChain:
    """Weights of the chain and of the curve from expected toxic tokens to a score."""

    words: dict[str, float]
    beginnings: dict[str, float]
    bias: float
    start: np.ndarray
    move: np.ndarray
    curve: tuple[float, float]

    def odds(self, tokens: list[str]) -> np.ndarray:
        words, short = self.words, self.beginnings
        long_, brief = BEGINNINGS
        return np.array([words.get(t, 0.0) + (short.get(t[:long_]) or short.get(t[:brief], 0.0)) for t in tokens], np.float64) + self.bias

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        sizes = [len(t) for t in texts]
        first = np.zeros(sum(sizes), bool)
        cuts = np.cumsum([0, *sizes])
        first[cuts[:-1][np.array(sizes, int) > 0]] = True
        odds = np.concatenate([self.odds(t) for t in texts]) if texts else np.empty(0)
        one, _ = forward_backward(odds, first, self.start, self.move)
        return np.split(one, cuts[1:-1]) if texts else []

    @staticmethod
    def expected(marginals: np.ndarray) -> float:
        """Log of the expected toxic tokens among those worth a doubt, so that length alone adds nothing."""
        return math.log(marginals[marginals >= DOUBT].sum() + 1e-2)

    def score(self, marginals: np.ndarray) -> float:
        slope, shift = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, slope * self.expected(marginals) + shift))))


#: What scores without any toxic label to learn from: nothing is toxic.
NOTHING = ToxicChain({}, {}, -20.0, np.ones(2), np.ones((2, 2)), (0.0, -20.0))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, held_out: Column) -> DataFrame:
    """(text, toxic): training rows, at most LABELLED_ROWS of either class, chosen by hash.

    Copies say nothing new and would make rare words of a copied text look like marks, so of texts that
    agree in either of two minhashes over 3-word shingles one stays.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    picked = [marked.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS) for c in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("labelled_id"), "toxic")
    rows = docs.select(F.col(doc_id).alias("id"), blank(text).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("labelled_id"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [[], []]
            for text in batch.column(0).to_pylist():
                words = text.lower().split()
                shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
                for seed in (0, 1):
                    least[seed].append(min(xxhash.xxh64_intdigest(x, seed) for x in shingles) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(h, pa.int64()) for h in least)], ["text", "toxic", "id", "h0", "h1"])

    kind = rows.schema["id"].dataType.simpleString()
    marked = rows.select("text", F.col("toxic").cast("int").alias("toxic"), "id").mapInArrow(hashed, f"text string, toxic int, id {kind}, h0 bigint, h1 bigint")
    # The least id stands for near copies, however the rows are dealt.
    first = marked.groupBy("h0").agg(F.min(F.struct("id", "h1", "text", "toxic")).alias("r")).select("r.*")
    first = first.groupBy("h1").agg(F.min(F.struct("id", "text", "toxic")).alias("r")).select("r.text", "r.toxic")
    return stage(first, "toxic-sample")


def fit(sample: DataFrame) -> ToxicChain:
    """Learn from (text, toxic); a sample without either class gives the chain that finds nothing."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return NOTHING

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(tokens_of(text))
                held[toxic].update("w" + w for w in words)
                held[toxic].update({"b" + w[:k] for w in words for k in BEGINNINGS if len(w) >= k})
        for toxic in (0, 1):
            yield pa.RecordBatch.from_pydict({"feature": list(held[toxic]), "toxic": [toxic] * len(held[toxic]), "n": list(held[toxic].values())})

    counted = sample.mapInArrow(count, "feature string, toxic bigint, n bigint").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * sizes[1]))
    ratio = (F.col("pos") / sizes[1]) / ((F.col("neg") + 1) / (sizes[0] + 1))
    # Each kept feature is in LEAST_SHARE of the toxic rows, so there are at most 1/LEAST_SHARE times
    # the features of a mean text.
    found = {r["feature"]: r["pos"] for r in counted.where((F.col("pos") >= least) & (ratio >= LEAST_RATIO)).select("feature", "pos").collect()}
    # A beginning that one marking word accounts for would only spread that word's mark to others.
    owned = {f"b{f[1 : 1 + k]}": n for f, n in sorted(found.items(), key=lambda x: x[1]) if f[0] == "w" for k in BEGINNINGS}
    chosen = sorted(f for f, n in found.items() if 2 * owned.get(f, 0) <= n)
    marks = {f: i + 1 for i, f in enumerate(chosen)}
    rows = [sample.where(F.col("toxic") == c).orderBy(F.xxhash64("text"), "text").limit(CHAIN_ROWS).collect() for c in (1, 0)]
    texts = [(tokens_of(r["text"]), r["toxic"]) for part in rows for r in part]
    chain = _fit_chain(texts, marks)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [chain.expected(m) for m in chain.marginals([tokens_of(t) for t in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), batch.column(1)], ["x", "toxic"])

    points = sample.mapInArrow(expect, "x double, toxic int").toPandas()  # at most twice LABELLED_ROWS rows
    chain.curve = _fit_curve(points["x"].to_numpy(), points["toxic"].to_numpy())
    return chain


def _fit_chain(texts: list[tuple[list[str], int]], marks: dict[str, int], steps: int = 60, rate: float = 0.1, ridge: float = 1e-5) -> ToxicChain:
    """Maximum likelihood of the token labels by gradient ascent with adaptive steps."""
    long_, brief = BEGINNINGS
    word = np.array([marks.get("w" + w, 0) for t, _ in texts for w in t], np.int64)
    short = np.array([marks.get("b" + w[:long_], 0) or marks.get("b" + w[:brief], 0) for t, _ in texts for w in t], np.int64)
    toxic = np.array([y for t, y in texts for _ in t], bool)
    first = np.zeros(len(word), bool)
    sizes = np.array([len(t) for t, _ in texts])
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    label = ((word > 0) | (short > 0)) & toxic
    n, inner = len(marks) + 1, np.flatnonzero(~first)
    seen_move = np.array([[np.sum((label[inner - 1] == i) & (label[inner] == j)) for j in (0, 1)] for i in (0, 1)], float)
    seen_start = np.bincount(label[first].astype(int), minlength=2).astype(float)
    # Start where marks speak for toxic tokens and all else against.
    theta = np.concatenate([np.full(2 * n, 6.0), [-6.0], np.zeros(6)])
    theta[[0, n]] = 0
    first_moment, second_moment = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, b, bias, start, move = theta[:n], theta[n : 2 * n], theta[2 * n], theta[2 * n + 1 : 2 * n + 3], theta[2 * n + 3 :].reshape(2, 2)
        one, moved = forward_backward(w[word] + b[short] + bias, first, np.exp(start), np.exp(move))
        residual = label - one
        grad = np.concatenate([
            np.bincount(word, residual, n), np.bincount(short, residual, n), [residual.sum()],
            seen_start - [(1 - one[first]).sum(), one[first].sum()], (seen_move - moved).ravel(),
        ]) / max(1, len(texts)) - ridge * theta
        grad[[0, n]] = 0  # no mark, no weight
        first_moment = 0.9 * first_moment + 0.1 * grad
        second_moment = 0.99 * second_moment + 0.01 * grad**2
        theta += rate * (first_moment / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-8)
    w, b = theta[:n], theta[n : 2 * n]
    return ToxicChain(
        {f[1:]: float(w[i]) for f, i in marks.items() if f[0] == "w"}, {f[1:]: float(b[i]) for f, i in marks.items() if f[0] == "b"},
        float(theta[2 * n]), np.exp(theta[2 * n + 1 : 2 * n + 3]), np.exp(theta[2 * n + 3 :].reshape(2, 2)), (1.0, 0.0),
    )


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic regression of one variable, both classes weighing the same, by Newton steps."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - ridge * len(y) * beta * [1, 0]
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([ridge * len(y), 1e-6])
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def tag(docs: DataFrame, chain: ToxicChain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(row, score, toxic_tokens, spans): the whole input row as a struct, and what the chain finds in its text.

    ``spans`` are (start, end, probability) of tokens with a marginal of at least ``threshold``, as
    character offsets into the text. Null and empty texts have no tokens and score what none scores.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(chain)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shipped.value
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts = batch.column(1).to_pylist()
                found = chain.marginals([tokens_of(t) for t in texts])
                spans = []
                for t, m in zip(texts, found, strict=True):
                    hits = set(np.flatnonzero(m >= threshold).tolist())
                    spans.append([{"start": x.start(), "end": x.end(), "probability": float(m[k])} for k, x in enumerate(_TOKEN.finditer(t)) if k in hits] if hits else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([chain.score(m) for m in found], pa.float64()), pa.array([float(m.sum()) for m in found], pa.float64()), pa.array(spans, span)],
                    ["row", "score", "toxic_tokens", "spans"],
                )

    rows = docs.select(F.struct("*").alias("row"), blank(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"row {kind}, score double, toxic_tokens double, spans array<struct<start:int, end:int, probability:double>>")


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``tag`` with a chain learnt from the labelled rows whose crc32(doc_id) mod ``folds`` is not ``fold``.

    A row is toxic by label if any of its labels says so; null labels and ids teach nothing.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold
    return tag(docs, fit(labelled_sample(docs, labels, doc_id, text, held)), text)
