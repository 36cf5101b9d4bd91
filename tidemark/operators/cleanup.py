"""Column clean-up: which columns of a wide table carry nothing, repeat others or leak the label."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.rules import LEAKAGE_COLUMNS

SALTS = 32


@dataclass(frozen=True)
class CleanupThresholds:
    high_null: float = 0.95
    quasi_constant: float = 0.95
    corr_intermediate: float = 0.99
    corr_aggressive: float = 0.95


def _missing(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _candidates(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(exclude)]


def null_shares(df: DataFrame, exclude: Sequence[str] = ("user_id",)) -> DataFrame:
    """(column, null_share): one aggregate over all columns, turned on its side."""
    cols = _candidates(df, exclude)
    wide = df.agg(*[F.avg(_missing(df, c).cast("double")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "null_share")


def high_null_columns(shares: dict[str, float], threshold: float) -> list[str]:
    return sorted(c for c, s in shares.items() if s is not None and s > threshold)


def top_value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, top_share) by counting every value; for thresholds no majority can be shown for."""
    text = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    long = df.select(*text).unpivot([], list(columns), "column", "value").where("value is not null")
    return (
        long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg((F.max("n") / F.sum("n")).alias("top_share"))
    )


def majority_shares(df: DataFrame, columns: Sequence[str], above: float = 0.95) -> DataFrame:
    """(column, top_share) of exactly the columns where one value has more than ``above``.

    Counting all values of all columns would shuffle the whole table once per column. A value
    held by more than ``above`` of the rows is held by more than ``above`` of some group of any
    partition of the rows, and there both quartiles are that value. So one pass takes quartiles of
    the hashed columns per row group (at most SALTS candidates per column), and a second pass
    counts the candidates exactly.
    """
    if above < 0.80:
        return top_value_shares(df, columns).where(F.col("top_share") > above)
    value = {c: F.when(~_missing(df, c), F.col(f"`{c}`")) for c in columns}
    # 52 bits: the quantile sketch keeps its values as doubles.
    hashed = {
        c: F.when(v.isNotNull(), F.xxhash64(v).bitwiseAND(F.lit(2**52 - 1)))
        for c, v in value.items()
    }
    groups = (
        df.select(
            F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_g"),
            *[h.alias(c) for c, h in hashed.items()],
        )
        .groupBy("_g")
        .agg(*[
            F.percentile_approx(f"`{c}`", F.array(F.lit(0.25), F.lit(0.75)), F.lit(100)).alias(c)
            for c in columns
        ])
        .collect()
    )
    wanted = [
        (c, h)
        for c in columns
        for h in sorted({r[c][0] for r in groups if r[c] and r[c][0] == r[c][1]})
    ]
    spark = df.sparkSession
    schema = "column string, top_share double"
    if not wanted:
        return spark.createDataFrame([], schema)
    # One row: how often each candidate occurs, and whether its hash names a single value.
    aggs = [F.count(value[c]).alias(f"n_{i}") for i, (c, _) in enumerate(wanted)]
    for i, (c, h) in enumerate(wanted):
        hit = hashed[c] == h
        text = F.when(hit, value[c].cast("string"))
        aggs += [F.count_if(hit).alias(f"k_{i}"),
                 (F.min(text) == F.max(text)).alias(f"one_{i}")]
    counted = df.agg(*aggs).first()
    shares: dict[str, float] = {}
    mixed = set()
    for i, (c, _) in enumerate(wanted):
        if counted[f"one_{i}"] is False:
            mixed.add(c)
        elif counted[f"n_{i}"]:
            shares[c] = max(shares.get(c, 0.0), counted[f"k_{i}"] / counted[f"n_{i}"])
    if mixed:  # two values with one hash: count that column's values
        for r in top_value_shares(df, sorted(mixed)).collect():
            shares[r["column"]] = r["top_share"]
    return spark.createDataFrame([(c, s) for c, s in shares.items() if s > above], schema)


def numeric_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    kinds = (T.NumericType, T.BooleanType)
    return sorted(
        c for c in _candidates(df, exclude) if isinstance(df.schema[c].dataType, kinds)
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr) of every column pair over the rows where both are present.

    Each task multiplies its rows' matrix with itself (one product per moment) and emits one row of
    sums per pair; Spark adds them up. Columns are centred and scaled first, so that the sums of
    squares keep their precision.
    """
    cols = sorted(columns)
    k = len(cols)
    as_double = df.select(*[
        F.when(~_missing(df, c), F.col(f"`{c}`").cast("double")).alias(c) for c in cols
    ])
    moments = as_double.agg(
        *[F.avg(f"`{c}`").alias(f"m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(f"`{c}`").alias(f"s_{i}") for i, c in enumerate(cols)],
    ).first()
    centre = np.array([moments[f"m_{i}"] or 0.0 for i in range(k)])
    scale = np.array([moments[f"s_{i}"] or 1.0 for i in range(k)])
    upper = np.triu_indices(k, 1)

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((5, k, k))
        for batch in batches:
            x = (batch.to_numpy(dtype=float) - centre) / scale
            seen = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([
                seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x, seen.T @ (x * x),
            ])
        n, sx, sxx, sxy, syy = total
        yield pd.DataFrame({
            "a": upper[0], "b": upper[1], "n": n[upper], "sx": sx[upper], "sy": sx.T[upper],
            "sxx": sxx[upper], "syy": syy[upper], "sxy": sxy[upper],
        })

    sums = as_double.mapInPandas(
        partial_sums,
        "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double",
    ).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    var_y = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    # A column that is constant on the shared rows has no correlation; rounding must not invent one.
    varies = (n > 1) & (var_x > F.col("sxx") * 1e-12) & (var_y > F.col("syy") * 1e-12)
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(
        F.get(names, F.col("a")).alias("col_a"), F.get(names, F.col("b")).alias("col_b"),
        F.when(varies, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cov / F.sqrt(var_x * var_y))))
        .alias("corr"),
    )


def prune_correlated(
    pairs: Sequence[tuple[str, str, float]], shares: dict[str, float]
) -> tuple[list[str], list[tuple[str, str, float]]]:
    """Greedy choice over the strong pairs (a < b, alphabetical): the one with more nulls goes.

    On equal null shares the second goes. A column already dropped opens no comparisons; one that
    is dropped during its own comparisons finishes them.
    """
    dropped: set[str] = set()
    used = []
    for a, group in groupby(sorted(pairs), key=lambda p: p[0]):
        if a in dropped:
            continue
        for _, b, r in group:
            if b in dropped:
                continue
            dropped.add(a if shares[b] < shares[a] else b)
            used.append((a, b, r))
    return sorted(dropped), used


@dataclass
class CleanupPlan:
    thresholds: CleanupThresholds
    high_null: list[str] = field(default_factory=list)
    quasi_constant: list[str] = field(default_factory=list)
    leakage: list[str] = field(default_factory=list)
    corr_intermediate: list[str] = field(default_factory=list)
    corr_aggressive: list[str] = field(default_factory=list)
    pairs_intermediate: list[tuple[str, str, float]] = field(default_factory=list)
    pairs_aggressive: list[tuple[str, str, float]] = field(default_factory=list)

    def drops(self, variant: str) -> set[str]:
        out = {*self.high_null, *self.quasi_constant, *self.leakage}
        if variant in ("v2_intermediate", "v3_aggressive"):
            out |= set(self.corr_intermediate)
        if variant == "v3_aggressive":
            out |= set(self.corr_aggressive)
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """(feature, reason, threshold): the thresholds really used."""
        t = self.thresholds
        rows = [
            (c, reason, value)
            for reason, cols, value in (
                ("high_nan", self.high_null, t.high_null),
                ("quasi_constant", self.quasi_constant, t.quasi_constant),
                ("target_leakage", self.leakage, None),
                ("corr_99", self.corr_intermediate, t.corr_intermediate),
                ("corr_95", self.corr_aggressive, t.corr_aggressive),
            )
            for c in cols
        ]
        return spark.createDataFrame(rows, "feature string, reason string, threshold double")


VARIANTS = ("v1_conservative", "v2_intermediate", "v3_aggressive")


def plan_cleanup(
    df: DataFrame, targets: Sequence[str] = (), id_column: str = "user_id",
    thresholds: CleanupThresholds | None = None, leakage: Sequence[str] = LEAKAGE_COLUMNS,
) -> CleanupPlan:
    """Decide all drops of a table. ``df`` is scanned five times: hand in a staged table."""
    t = thresholds or CleanupThresholds()
    keep = [c for c in (id_column, *targets) if c in df.columns]
    shares = {r["column"]: r["null_share"] for r in null_shares(df, keep).collect()}
    plan = CleanupPlan(t, high_null=high_null_columns(shares, t.high_null))
    constant = majority_shares(df, _candidates(df, keep), t.quasi_constant)
    plan.quasi_constant = sorted(r["column"] for r in constant.collect())
    plan.leakage = sorted(c for c in leakage if c in df.columns)
    left = [c for c in numeric_columns(df, keep) if c not in plan.drops("v1_conservative")]
    if len(left) < 2:
        return plan
    floor_ = min(t.corr_intermediate, t.corr_aggressive)
    strong = [
        (r["col_a"], r["col_b"], r["strength"])
        for r in correlations(df, left)
        .select("col_a", "col_b", F.abs("corr").alias("strength"))
        .where(F.col("strength") >= floor_).collect()  # at most one row per column pair
    ]
    plan.corr_intermediate, plan.pairs_intermediate = prune_correlated(
        [p for p in strong if p[2] >= t.corr_intermediate], shares
    )
    gone = set(plan.corr_intermediate)
    plan.corr_aggressive, plan.pairs_aggressive = prune_correlated(
        [p for p in strong
         if p[2] >= t.corr_aggressive and p[0] not in gone and p[1] not in gone], shares
    )
    return plan


def apply_cleanup(df: DataFrame, plan: CleanupPlan) -> dict[str, DataFrame]:
    return {v: df.drop(*plan.drops(v)) for v in VARIANTS}
