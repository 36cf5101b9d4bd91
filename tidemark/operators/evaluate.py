"""Classifier metrics from exact ranks of the scores.

Ranking metrics need, per distinct score, how many rows lie above it. Scores are folded to distinct
values, so a score that many rows share is one row, and these are sorted by range. Every sorted part
gets its offset from the totals of the parts before it (a table of one row per part), so how scores
are spread does not decide how the work is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.sources.staging import stage

CLIP = 1e-15
METRICS = (
    "n", "positives", "auc_roc", "auc_pr", "brier", "log_loss", "precision_50", "recall_50",
    "f1_50", "accuracy_50", "best_f1", "best_threshold",
)


def score_ranks(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, s, pos, neg, pos_above, neg_above, all_pos) per distinct score of each group of ``by``.

    Rows without a label or a score are ignored.
    """
    hist = (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("s"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )
    order = [*by, F.desc("s")]
    ranged = hist.repartitionByRange(*order).sortWithinPartitions(*order)
    # The running number holds the part in its upper bits and the place in the part in the others.
    placed = stage(ranged.withColumn("seq", F.monotonically_increasing_id()), "ranks")
    placed = placed.withColumn("part", F.shiftright("seq", 33))
    groups = Window.partitionBy(*by)
    earlier = groups.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    offsets = totals.select(
        *by, "part", F.sum("p").over(groups).alias("all_pos"),
        F.coalesce(F.sum("p").over(earlier), F.lit(0)).alias("p_off"),
        F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("q_off"),
    )
    inside = Window.partitionBy(*by, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sorted part and group, whatever the data.
    return placed.join(F.broadcast(offsets), [*by, "part"]).select(
        *by, "s", "pos", "neg", "all_pos",
        (F.col("p_off") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("pos_above"),
        (F.col("q_off") + F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("neg_above"),
    )


def metrics_of(ranks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of METRICS, or one per group of ``by``."""
    s, pos, neg = F.col("s"), F.col("pos"), F.col("neg")
    tp, fp = pos + F.col("pos_above"), neg + F.col("neg_above")
    hit = s >= 0.5
    f1 = ratio(2 * tp, tp + fp + F.col("all_pos"))
    p = F.when(s < CLIP, F.lit(CLIP)).when(s > 1 - CLIP, F.lit(1 - CLIP)).otherwise(s)
    sums = ranks.groupBy(*by).agg(
        F.sum(pos).alias("P"), F.sum(neg).alias("N"),
        # pairs (positive above negative), ties count half
        F.sum(neg * (F.col("pos_above") + pos / 2.0)).alias("won"),
        F.sum(pos * ratio(tp, tp + fp)).alias("precise"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("square"),
        F.sum(-(pos * F.log(p) + neg * F.log(1 - p))).alias("loss"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("tp50"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("fp50"),
        # the lowest cut among equally good ones
        F.max(F.struct(f1.alias("f1"), (-s).alias("cut"))).alias("best"),
    )
    n = F.col("P") + F.col("N")
    return sums.select(
        *by, n.alias("n"), F.col("P").alias("positives"),
        ratio(F.col("won"), F.col("P").cast("double") * F.col("N")).alias("auc_roc"),
        ratio(F.col("precise"), F.col("P")).alias("auc_pr"),
        ratio(F.col("square"), n).alias("brier"), ratio(F.col("loss"), n).alias("log_loss"),
        ratio(F.col("tp50"), F.col("tp50") + F.col("fp50")).alias("precision_50"),
        ratio(F.col("tp50"), F.col("P")).alias("recall_50"),
        ratio(2 * F.col("tp50"), F.col("tp50") + F.col("fp50") + F.col("P")).alias("f1_50"),
        ratio(F.col("tp50") + F.col("N") - F.col("fp50"), n).alias("accuracy_50"),
        F.col("best.f1").alias("best_f1"), (-F.col("best.cut")).alias("best_threshold"),
    )


def evaluate(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row of METRICS."""
    return metrics_of(score_ranks(df, score, label))


def evaluate_each(
    df: DataFrame, pairs: dict[str, tuple[str, str]], parts: dict[str, str] | None = None
) -> DataFrame:
    """One row of METRICS for each name of ``{name: (score, label)}`` as ``target``.

    With ``parts`` ({name: column}) there is one for each value of that column as well, as ``split``. All
    are ranked in one pass over ``df``. A name or part without labelled rows has no row.
    """
    keys = ("target",) if parts is None else ("target", "split")
    each = []
    for name, (score, label) in pairs.items():
        split = [] if parts is None else [F.col(parts[name]).alias("split")]
        each.append(F.struct(
            F.lit(name).alias("target"), *split, F.col(score).cast("double").alias("score"), F.col(label).alias("label")
        ))
    long = df.select(F.inline(F.array(*each)))
    return metrics_of(score_ranks(long, "score", "label", keys), keys)
