"""Wall time per headline query; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_QUERIES
(comma-separated subset). A query's time covers planning, every helper job and a full evaluation of
its result into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidemark.operators.models import ChurnModels  # noqa: E402
from tidemark.plans import registry  # noqa: E402
from tidemark.plans.master import churn_master  # noqa: E402

HEADLINE = (
    "log_window_scan", "sample_derive", "feat_users", "feat_characters", "feat_devices",
    "feat_iaps", "feat_rewards", "feat_items", "feat_collection", "feat_feedback", "feat_derived",
    "feat_currency", "feat_fights", "feat_arena", "master_churn", "master_taste", "stat_entropy",
    "stat_gini", "threshold_fit", "target_encode_fit", "target_encode_apply", "stratified_split",
    "cleanup_high_null", "cleanup_quasi_constant", "cleanup_corr_pairs", "cleanup_report",
    "eval_metrics", "archetype_assign", "nearest_centroid", "cluster_quality", "drift_reconcile",
    "churn_splits", "oof_encodings", "document_rules",
    "cross_segment", "taste_profile", "predictions_full", "summary_targets",
    "summary_distribution", "report_kpis", "report_archetypes", "report_actions",
    "report_ranked_players", "report_top_players", "stream_daily_counts", "stream_fight_features",
)
# Fitting the three forests, and scoring every player with the saved ones; together this is ``churn_score``.
MODELS = ("churn_fit", "churn_score")


def fit_and_score(spark: SparkSession, folder: str) -> dict[str, float]:
    """Seconds of a fit that ends with saved models, and of scoring from them, master included."""
    times = {}
    with tempfile.TemporaryDirectory() as models:
        start = time.perf_counter()
        _, fitted, _ = registry.fitted(registry.Inputs(spark, folder), calibrate=True)
        fitted.save(models)
        times["churn_fit"] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
        i = registry.Inputs(spark, folder)
        loaded = ChurnModels.load(spark, models, fitted.version)
        loaded.score(churn_master(i.tables, i.ctx, rules=i.rules)).write.format("noop").mode("overwrite").save()
        times["churn_score"] = round(time.perf_counter() - start, 3)
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or [*HEADLINE, *MODELS]
    partitions = str(os.cpu_count() or 8) if cpus == "*" else cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture costs two JVM round trips per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.run("sample_derive", spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in (n for n in names if n not in MODELS):
        start = time.perf_counter()
        registry.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    if set(MODELS) & set(names):
        times |= fit_and_score(spark, folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
