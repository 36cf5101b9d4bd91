"""Entropy, Gini, Simpson and burst statistics over category counts.

The input is one row per (key, category) with its count ``n``. ``ranked_histogram`` folds that to
one row per (key, distinct count) with its multiplicity ``m``: a key with S events has at most
about sqrt(2 S) such rows however many categories it touched, so ordering them per key stays small
even for a key that owns a third of the log. Every statistic is then a plain sum over those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio


def category_counts(
    df: DataFrame, key: str, dims: Sequence[str], **sums: Column
) -> DataFrame:
    """Count rows per (key, value) of several dimensions in one pass over ``df``.

    Returns ``key, dim, n`` + the given sums, the dimension columns (only the one named by ``dim``
    is set). Grouping sets let each task combine its rows for all dimensions before the shuffle.
    """
    sets = [[key, d] for d in dims]
    counts = df.groupingSets(sets, key, *dims).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(name) for name, c in sums.items()],
    )
    width = len(dims)
    dim = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        # grouping_id has a 1 bit for every key that is aggregated away, first dim highest.
        gid = (2**width - 1) - 2 ** (width - 1 - i)
        dim = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(dim)
    return counts.withColumn("dim", dim).drop("_gid")


def ranked_histogram(
    counts: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), place_by: str | None = None
) -> DataFrame:
    """Rows (keys, n, m, below, kinds): m categories have count n, ``below`` have a smaller one.

    ``place_by`` names the key to partition by when the caller aggregates by that key next, so
    that the ranking and the aggregate share one exchange.
    """
    hist = counts.groupBy(*keys, "n").agg(
        F.count(F.lit(1)).alias("m"), *[F.sum(s).alias(s) for s in sums]
    )
    if place_by is not None:
        hist = hist.repartition(place_by)
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn(
        "below", F.coalesce(F.sum("m").over(before), F.lit(0))
    ).withColumn("kinds", F.sum("m").over(per_key))


def _only(cond: Column | None, value: Column) -> Column:
    return value if cond is None else F.when(cond, value)


def _mass() -> Column:
    return (F.col("m") * F.col("n")).cast("double")


def entropy_from_sums(total: Column, n_log_n: Column, kinds: Column) -> Column:
    """Shannon entropy in bits from S, sum(n log2 n) and the number of non-empty categories."""
    bits = F.log2(total) - n_log_n / total
    return F.when(
        total > 0, F.when(kinds <= 1, F.lit(0.0)).otherwise(F.greatest(bits, F.lit(0.0)))
    )


def simpson_from_sums(total: Column, squares: Column) -> Column:
    return F.when(total > 0, 1.0 - squares / (total * total))


def n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


# Aggregates over ranked_histogram rows. ``cond`` restricts them to some rows, so that statistics
# of several dimensions come out of one groupBy.


def entropy(cond: Column | None = None) -> Column:
    return entropy_from_sums(
        F.sum(_only(cond, _mass())),
        F.sum(_only(cond, F.col("m") * n_log_n(F.col("n")))),
        F.coalesce(F.sum(_only(cond, F.when(F.col("n") > 0, F.col("m")))), F.lit(0)),
    )


def simpson(cond: Column | None = None) -> Column:
    return simpson_from_sums(
        F.sum(_only(cond, _mass())), F.sum(_only(cond, _mass() * F.col("n")))
    )


def gini(cond: Column | None = None) -> Column:
    """(2 sum(i x_i) - (k+1) S) / (k S), x ascending; ties share a block of ranks."""
    m, below = F.col("m").cast("double"), F.col("below")
    ranks = m * below + m * (m + 1) / 2
    total = F.sum(_only(cond, _mass()))
    k = F.sum(_only(cond, F.col("m"))).cast("double")
    weighted = F.sum(_only(cond, ranks * F.col("n")))
    return F.when(total > 0, (2 * weighted - (k + 1) * total) / (k * total))


def median(cond: Column | None = None) -> Column:
    """Exact median of the counts (mean of the two middle ones)."""
    upto = F.col("below") + F.col("m")

    def at(rank: Column) -> Column:
        hit = upto >= rank
        return F.min(F.when(hit if cond is None else hit & cond, F.col("n")))

    lower = at(F.floor((F.col("kinds") + 1) / 2))
    upper = at(F.floor((F.col("kinds") + 2) / 2))
    return (lower + upper) / 2.0


def burst(cond: Column | None = None) -> Column:
    """Largest count over the median count; null without counts or with a zero median."""
    mid = median(cond)
    return F.when(mid > 0, ratio(F.max(_only(cond, F.col("n"))), mid))


def kinds(cond: Column | None = None) -> Column:
    return F.coalesce(F.sum(_only(cond, F.col("m"))), F.lit(0))


def count_statistics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All statistics of one dimension, one row per key."""
    return (
        ranked_histogram(counts, keys)
        .groupBy(*keys)
        .agg(
            kinds().alias("kinds"),
            entropy().alias("entropy"),
            gini().alias("gini"),
            simpson().alias("simpson"),
            burst().alias("burst"),
        )
    )
