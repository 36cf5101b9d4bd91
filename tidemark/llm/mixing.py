"""Mixing documents to target domain weights with soft membership. DataFrame operations only.

Domains are the languages of labelled clean rows. Their marking words, and how often texts of each
domain use the words of each domain, are learnt from a bounded sample of the labelled table; a text's
posterior over domains follows from its counts of marking words. A document's rate then solves the
nonnegative least-squares problem that expected domain tokens, the sum over documents of rate times
tokens times posterior, match the targets: projected gradient steps in the metric of the documents'
tokens, each one aggregate over a narrow table that returns one number per domain. A document's rate is
the fold of the residuals so far, so no rates are kept between steps.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blank, row_key, stage

#: Expected labelled rows per domain at most (a row enters by its hash), and bounds on domains and marking words per domain.
LABELLED_ROWS, DOMAINS, MARKS = 1_000, 16, 150
#: Marking words beyond this many say nothing more, which keeps memberships soft.
EVIDENCE = 4.0
#: Share of a text's words that any domain may have put there.
BLUR = 0.02
#: Most steps, and the largest residual share at which they end.
STEPS, CLOSE = 60, 1e-4
#: Wanted shares of tokens of the four languages in ``documents``.
TARGETS = {"en": 0.50, "de": 0.20, "fr": 0.20, "es": 0.10}


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def learn(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, domain: str, domains: list[str]) -> tuple[list[list[str]], np.ndarray]:
    """Marking words per domain, and the share of each domain's words per bin (domains, then all other words).

    A repeated id counts once per domain, with its smallest text.
    """
    clean = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    ids = clean.select(F.col("doc_id").alias("labelled_id")).distinct()
    # A row's hash decides whether it is looked at, by the rows of its domain: no domain is ordered or gathered.
    chance = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(domain).alias("domain")).where(F.col("domain").isin(domains)).distinct()
    per_domain = narrow.join(ids, F.col("id") == F.col("labelled_id"), "left_semi").groupBy("domain").agg(F.count("*").alias("n")).collect()
    looked_at = F.lit(False)
    for r in per_domain:
        looked_at = looked_at | ((F.col("domain") == r["domain"]) & (chance < LABELLED_ROWS / r["n"]))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(domain).alias("domain"), blank(text).alias("text")).where(looked_at)
    rows = rows.groupBy("id", "domain").agg(F.min("text").alias("text")).join(ids, F.col("id") == F.col("labelled_id"), "left_semi")
    counted = rows.select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word <> ''").groupBy("word", "domain").agg(F.count("*").alias("n"))
    counted = stage(counted, "mix-words")
    totals = {r["domain"]: r["n"] for r in counted.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    share = {d: totals.get(d, 0) for d in domains}
    wide = counted.groupBy("word").agg(*(F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)))
    rate = [F.col(f"n{i}") / max(1, share[d]) for i, d in enumerate(domains)]
    marks = []
    for i in range(len(domains)):
        rest = [r for j, r in enumerate(rate) if j != i]
        other = F.greatest(*rest) if len(rest) > 1 else rest[0] if rest else F.lit(0.0)
        top = wide.where(rate[i] > 4 * other + F.lit(1e-6)).orderBy((rate[i] - other).desc(), "word").limit(MARKS)
        marks.append([r["word"] for r in top.select("word").collect()])
    use = np.zeros((len(domains), len(domains) + 1))
    bins = [F.sum(F.when(F.col("word").isin(m), F.col("n")).otherwise(0)).alias(f"b{i}") if m else F.lit(0).alias(f"b{i}") for i, m in enumerate(marks)]
    for r in counted.groupBy("domain").agg(*bins, F.sum("n").alias("all")).collect():
        own = [r[f"b{i}"] for i in range(len(domains))]
        use[domains.index(r["domain"])] = [*own, r["all"] - sum(own)]
    share = (use + 0.5) / (use + 0.5).sum(axis=1, keepdims=True)
    return marks, (1 - BLUR) * share + BLUR / (len(domains) + 1)


def posteriors(docs: DataFrame, marks: list[list[str]], use: np.ndarray, doc_id: str, text: str, domain: str) -> DataFrame:
    """(row_key, doc_id, tokens, p): posterior per domain, uniform where a text has no marking word."""
    k = len(marks)
    rows = docs.select(row_key(doc_id, text).alias("row_key"), F.col(doc_id).alias("doc_id"), _words(blank(text)).alias("words"))
    among = lambda m: lambda w: w.isin(m)
    hits = [F.size(F.filter("words", among(m))) if m else F.lit(0) for m in marks]
    tokens = F.size(F.filter("words", lambda w: w != ""))
    counted = rows.select("row_key", "doc_id", tokens.cast("long").alias("tokens"), *(h.alias(f"c{i}") for i, h in enumerate(hits)))
    logs = np.log(use)
    marked = sum((F.col(f"c{i}") for i in range(k)), F.lit(0))
    damp = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(marked, F.lit(1)))
    scores = [damp * sum((F.col(f"c{i}") * F.lit(float(logs[d, i])) for i in range(k)), F.lit(0.0)) for d in range(k)]
    counted = counted.withColumns({f"s{d}": s for d, s in enumerate(scores)})
    top = F.greatest(*(F.col(f"s{d}") for d in range(k))) if k > 1 else F.col("s0")
    counted = counted.withColumns({f"e{d}": F.exp(F.col(f"s{d}") - top) for d in range(k)})
    every = sum((F.col(f"e{d}") for d in range(k)), F.lit(0.0))
    return counted.select("row_key", "doc_id", "tokens", F.array(*(F.col(f"e{d}") / every for d in range(k))).alias("p"))


def rate_of(residuals: list[list[float]], step: float) -> Column:
    """Rate of a row with posteriors ``p``: 1 at first, then projected steps against the residuals."""
    if not residuals:
        return F.lit(1.0)
    history = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in residuals))
    dot = lambda r: F.aggregate(F.zip_with("p", r, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(history, F.lit(1.0), lambda rate, r: F.greatest(F.lit(0.0), rate - F.lit(step) * dot(r)))


def fit_rates(table: DataFrame, targets: list[float]) -> tuple[list[list[float]], float]:
    """Residuals of all steps and the step length, for (tokens, p) and wanted shares of all tokens."""
    k = len(targets)
    weight = F.col("tokens")
    gram = table.agg(F.sum(weight).alias("all"), *(F.sum(weight * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
    total = gram["all"] or 0
    if not total:
        return [], 0.0
    matrix = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    step = 1.0 / max(float(np.linalg.eigvalsh(matrix)[-1]), 1e-9)
    residuals: list[list[float]] = []
    for _ in range(STEPS):
        rate = rate_of(residuals, step)
        reached = table.select("tokens", "p", rate.alias("rate")).agg(*(F.sum(F.col("tokens") * F.col("rate") * F.col("p")[i]).alias(f"t{i}") for i in range(k))).first()
        residual = [reached[f"t{i}"] / total - targets[i] for i in range(k)]
        if max(map(abs, residual)) < CLOSE:
            break
        residuals.append(residual)
    return residuals, step


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0,
    doc_id: str = "doc_id", text: str = "text", domain: str = "lang",
) -> DataFrame:
    """(row_key, doc_id, tokens, p_<domain>..., rate, copies) per row.

    ``targets`` are wanted shares of tokens (scaled to sum to 1), ``budget`` the wanted tokens as a share of
    all. ``copies`` is the rate rounded up or down by a hash of the row, so its expectation is the rate.
    Empty and null texts have no tokens; without marking words a text belongs to all domains alike. An
    empty table, or one without tokens, gives every row rate 1. Repeated rows get equal results.
    """
    wanted = TARGETS if targets is None else targets
    if not 1 <= len(wanted) <= DOMAINS:
        raise ValueError(f"1 to {DOMAINS} domains are handled")
    domains, scale = sorted(wanted), sum(wanted.values())
    marks, use = learn(docs, labels, doc_id, text, domain, domains)
    table = stage(posteriors(docs, marks, use, doc_id, text, domain), "mix-posteriors")
    residuals, step = fit_rates(table, [budget * wanted[d] / scale for d in domains])
    rated = table.withColumn("rate", rate_of(residuals, step))
    chance = F.pmod(F.xxhash64(F.lit(17), "row_key"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.select("row_key", "doc_id", "tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), "rate", copies.cast("int").alias("copies"))
