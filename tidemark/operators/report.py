"""Summaries and report tables over the final predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio, round_half_even
from tidemark.functions.order_stats import percentiles
from tidemark.operators.segment import archetype_name
from tidemark.operators.taste import TASTE_COLUMNS
from tidemark.rules import AXES, TARGETS, RuleBook

UNNAMED = "Sin clasificar"
SCORE_PARTS = ("live", "oof", "delta", "source", "final")


def score_columns(targets: Sequence[str] = TARGETS) -> list[str]:
    return [f"{t}_{p}" for t in targets for p in SCORE_PARTS]


def full_predictions(
    scores: DataFrame, archetypes: DataFrame, taste: DataFrame, rules: RuleBook,
    targets: Sequence[str] = TARGETS,
) -> DataFrame:
    """The technical layer: scores, archetype, every axis and the action (28 columns)."""
    joined = scores.join(archetypes.select("user_id", "archetype_n1"), "user_id", "left").join(
        taste.select("user_id", *TASTE_COLUMNS), "user_id", "left"
    )
    named = joined.withColumn("archetype_name", archetype_name(F.col("archetype_n1"), rules))
    return named.select(
        "user_id", *score_columns(targets), "archetype_n1", "archetype_name", *TASTE_COLUMNS
    )


def without_archetypes(scores: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """The same columns when archetypes or taste could not be computed."""
    kinds = {"has_tier2": "int"}
    return scores.select(
        "user_id", *score_columns(targets), F.lit(None).cast("int").alias("archetype_n1"),
        F.lit("N/A").alias("archetype_name"),
        *[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in TASTE_COLUMNS],
    )


def business_predictions(full: DataFrame) -> DataFrame:
    """The business layer: the full table without the axes (20 columns)."""
    return full.drop("has_tier2", *AXES)


def share_of_all(n: Column, digits: int) -> Column:
    """Percent of the total over the (few) grouped rows."""
    total = F.sum(n).over(Window.partitionBy())
    return round_half_even(100.0 * n / total, digits)


def target_summary(predictions: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Per target: source counts, mean and median final score, spread of the delta."""
    # One scan: every player row opens into one row per target.
    long = predictions.select(F.inline(F.array(*[
        F.struct(
            F.lit(t).alias("target"), F.col(f"{t}_source").alias("source"),
            F.col(f"{t}_final").alias("final"), F.col(f"{t}_delta").alias("delta"),
        )
        for t in targets
    ])))
    # The median is an exact order statistic over all players, so it gets its own passes.
    finals = long.select("target", "final").where("final is not null").persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        middle = percentiles(finals, "final", [0.5], by="target")
    finally:
        finals.unpersist()
    median = F.lit(None).cast("double")
    for t, (value,) in middle.items():
        median = F.when(F.col("target") == t, F.lit(value)).otherwise(median)
    return (
        long.groupBy("target").agg(
            *[F.count_if(F.col("source") == s).alias(f"n_{s}")
              for s in ("oof_stable", "live_drift", "live_new")],
            F.avg("final").alias("final_mean"),
            F.avg("delta").alias("delta_mean"), F.stddev_samp("delta").alias("delta_std"),
            F.min("delta").alias("delta_min"), F.max("delta").alias("delta_max"),
            F.count("delta").alias("n_observed"),
        )
        .withColumn("final_median", median)
    )


def distribution(predictions: DataFrame) -> DataFrame:
    """(kind, value, n, pct): archetype names, action codes and recent-activity counts."""
    cols = {
        "archetype": F.col("archetype_name"),
        "action": F.col("contramedida_primaria_cod"),
        "tier2": F.col("has_tier2").cast("string"),
    }
    wide = predictions.select(*[c.alias(k) for k, c in cols.items()])
    counts = wide.unpivot([], list(cols), "kind", "value").groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy("kind"))
    return counts.select(
        "kind", "value", "n", round_half_even(100.0 * F.col("n") / total, 2).alias("pct")
    )


def high_risk(predictions: DataFrame, rules: RuleBook, targets: Sequence[str] = TARGETS) -> DataFrame:
    """(horizon, n, pct) of players at or above the high-risk threshold."""
    wide = predictions.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col(f"{t}_final") >= rules.high_risk).alias(t.removeprefix("churn_"))
          for t in targets],
    )
    return wide.unpivot(["_all"], [t.removeprefix("churn_") for t in targets], "horizon", "n").select(
        "horizon", "n", round_half_even(ratio(100 * F.col("n"), F.col("_all")), 1).alias("pct")
    )


def kpis(predictions: DataFrame, rules: RuleBook) -> DataFrame:
    """One row: players, high risk at 14 days, archetypes in use."""
    at_risk = F.count_if(F.col("churn_14d_final") >= rules.high_risk)
    n = F.count(F.lit(1))
    # Two-level distinct: the codes are folded per task before they are counted.
    return predictions.agg(
        n.alias("n_users"), at_risk.alias("n_high_risk"),
        F.coalesce(round_half_even(ratio(100 * at_risk, n), 1), F.lit(0.0)).alias("pct_high_risk"),
        F.count_distinct("archetype_n1").alias("n_archetypes"),
    )


def archetype_table(predictions: DataFrame, rules: RuleBook) -> DataFrame:
    """Per archetype: size, share, mean 14 day score, share at high risk and its class."""
    score = F.col("churn_14d_final")
    name = F.coalesce(F.col("archetype_name"), F.lit(UNNAMED)).alias("archetype_name")
    # A missing score is not at high risk, but its player still counts.
    risky = F.avg(F.coalesce(score >= rules.high_risk, F.lit(False)).cast("double"))
    grouped = predictions.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_users"), F.avg(score).alias("mean_prob"),
        round_half_even(100.0 * risky, 1).alias("pct_high_risk"),
    )
    level = F.col("pct_high_risk")
    return grouped.select(
        "archetype_name", "n_users", share_of_all(F.col("n_users"), 1).alias("pct"), "mean_prob",
        "pct_high_risk",
        F.when(level >= 50, "risk-high").when(level >= 25, "risk-medium").otherwise("risk-low")
        .alias("risk_class"),
    ).orderBy(F.desc("pct"), "archetype_name")


def action_table(predictions: DataFrame) -> DataFrame:
    """Players per action, most frequent first; players without action count in the total only."""
    cod, label = "contramedida_primaria_cod", "contramedida_primaria_label"
    grouped = predictions.groupBy(cod, label).agg(F.count(F.lit(1)).alias("n_users"))
    return (
        grouped.withColumn("pct", share_of_all(F.col("n_users"), 1))
        .where(F.col(cod).isNotNull())
        .select(F.col(cod).alias("cod"), F.coalesce(label, F.lit("")).alias("label"), "n_users", "pct")
        .orderBy(F.desc("n_users"), "cod")
    )


RANKED_COLUMNS = (
    "user_id", "archetype_name", "churn_7d_final", "churn_14d_final", "churn_30d_final",
    "contramedida_primaria_cod", "contramedida_primaria_label",
)


def ranked_players(predictions: DataFrame) -> DataFrame:
    """Players by archetype, then by falling 30 day score (missing last): a range-partitioned sort,
    so a large archetype spans many tasks."""
    name = F.coalesce(F.col("archetype_name"), F.lit(UNNAMED))
    return (
        predictions.withColumn("archetype_name", name).select(*RANKED_COLUMNS)
        .orderBy("archetype_name", F.desc_nulls_last("churn_30d_final"), "user_id")
    )


def top_players(predictions: DataFrame, k: int) -> DataFrame:
    """The k most endangered players of each archetype. The rank filter is applied per task before
    the shuffle (window group limit), so at most k rows per archetype and task move."""
    name = F.coalesce(F.col("archetype_name"), F.lit(UNNAMED))
    w = Window.partitionBy("archetype_name").orderBy(
        F.desc_nulls_last("churn_30d_final"), "user_id"
    )
    return (
        predictions.withColumn("archetype_name", name).select(*RANKED_COLUMNS)
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    )
