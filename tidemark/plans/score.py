"""End-to-end scoring: tables in, prediction tables and summaries out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.operators import report
from tidemark.operators.dictionary import dictionary
from tidemark.operators.models import ArchetypeModel, ChurnModels
from tidemark.operators.reconcile import reconcile
from tidemark.operators.sample import run_context
from tidemark.operators.taste import taste_profile
from tidemark.plans.master import churn_columns, taste_master
from tidemark.plans.resume import StagedRun
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables
from tidemark.sources.readers import oof_scores
from tidemark.sources.staging import discard, stage, write_document, write_table


@dataclass
class ScoringRun:
    context: RunContext
    scores: DataFrame
    full: DataFrame
    profile_status: str
    profile_error: str | None
    staged: list[str] = field(default_factory=list)

    @property
    def business(self) -> DataFrame:
        return report.business_predictions(self.full)


def score_players(
    spark: SparkSession, tables: Tables, models: ChurnModels,
    archetypes: ArchetypeModel | None = None, stored_oof: DataFrame | None = None,
    rules: RuleBook | None = None, ctx: RunContext | None = None, staged: StagedRun | None = None,
) -> ScoringRun:
    """Build the masters once, score, reconcile, profile.

    The master is staged because three forests, the archetype model and the axes read it. If the
    archetype or taste step fails, the run keeps its scores and the output keeps its columns. Tables that
    ``staged`` already holds are taken from there; without it they are written for this run alone.
    """
    rules = rules or RuleBook()
    ctx = ctx or run_context(tables.users)
    written: list[str] = []

    def keep(label: str, build: Callable[[], DataFrame]) -> DataFrame:
        return stage(build(), label, written) if staged is None else staged.table(label, build)

    def score() -> DataFrame:
        live = models.score(master.select(*churn_columns(master.columns)))
        return reconcile(live, oof_scores(spark, stored_oof), rules.drift_threshold, models.targets)

    try:
        master = keep("master", lambda: taste_master(tables, ctx, rules=rules))
        scores = keep("scores", score)
    except BaseException:
        discard(spark, written)
        raise
    try:
        if archetypes is None:
            raise LookupError("no archetype model")
        codes = keep("archetypes", lambda: archetypes.assign(master))
        profile = keep("taste", lambda: taste_profile(master, codes, rules))
        full = report.full_predictions(scores, codes, profile, rules, models.targets)
        status, error = "ok", None
    except Exception as e:  # scores are worth delivering without a profile
        full = report.without_archetypes(scores, models.targets)
        status, error = "skipped", repr(e)
    return ScoringRun(ctx, scores, full, status, error, written)


def run_metadata(
    full: DataFrame, ctx: RunContext, rules: RuleBook, targets: tuple[str, ...], status: str
) -> DataFrame:
    """One row that describes a run."""
    return full.agg(F.count(F.lit(1)).alias("n_users")).select(
        F.lit(str(ctx.reference_date)).alias("reference_date"),
        F.lit(str(ctx.cutoff_date)).alias("cutoff_date"), "n_users",
        F.lit(",".join(targets)).alias("churn_targets"),
        F.lit(rules.drift_threshold).alias("drift_threshold"),
        F.lit(status).alias("stage_6_status"),
    )


def summary_document(run: ScoringRun, rules: RuleBook, targets: tuple[str, ...]) -> dict:
    """The summary: a handful of aggregate rows, whatever the number of players."""
    per_target = {}
    for r in report.target_summary(run.scores, targets).collect():
        row = r.asDict()
        per_target[row.pop("target")] = row
    out = {
        "n_users": run.full.count(), "churn_targets": list(targets),
        "drift_threshold": rules.drift_threshold, "stage_6_status": run.profile_status,
        "per_target": per_target,
    }
    if run.profile_status == "ok":
        groups: dict[str, dict] = {}
        for r in report.distribution(run.full).collect():
            groups.setdefault(r["kind"], {})[r["value"]] = r["n"]
        covered = sum(n for code, n in groups["action"].items() if code is not None)
        out |= {
            "archetype_distribution": groups["archetype"],
            "countermeasure_distribution": groups["action"],
            "countermeasure_coverage_pct": round(100 * covered / max(1, out["n_users"]), 2),
            "n_tier2": groups["tier2"].get("1", 0),
        }
    return out


def write_run(
    spark: SparkSession, run: ScoringRun, models: ChurnModels, folder: str,
    rules: RuleBook | None = None, started: float | None = None,
) -> None:
    """All sinks of a run; its staged tables go once everything is written.

    Parquet keeps the literal 'null' axis value apart from a missing one. The other sinks read the
    written predictions instead of computing them again.
    """
    try:
        _write_sinks(spark, run, models, folder, rules or RuleBook(), started)
    finally:
        discard(spark, run.staged)


def _write_sinks(
    spark: SparkSession, run: ScoringRun, models: ChurnModels, folder: str, rules: RuleBook, started: float | None
) -> None:
    write_table(run.full, f"{folder}/predictions_full")
    full = run.full = spark.read.parquet(f"{folder}/predictions_full")
    write_table(full, f"{folder}/predictions_full_csv", "csv")
    write_table(run.business, f"{folder}/predictions")
    write_table(run.business, f"{folder}/predictions_csv", "csv")
    write_table(report.ranked_players(full), f"{folder}/ranked_players", by="archetype_name")
    write_document(spark, summary_document(run, rules, models.targets), f"{folder}/summary")
    write_document(spark, dictionary(rules, models.version), f"{folder}/dictionary")
    meta = run_metadata(full, run.context, rules, models.targets, run.profile_status)
    began = started or time.time()
    write_document(spark, meta.first().asDict() | {
        "started_at": datetime.fromtimestamp(began, timezone.utc).isoformat(),
        "elapsed_seconds": round(time.time() - began, 1),
        "stage_6_error": run.profile_error,
        "models": [r.asDict() for r in models.summary(spark).collect()],
    }, f"{folder}/run_metadata")
    run.scores = full.select("user_id", *report.score_columns(models.targets))
