"""One scoring job from folders to folders, for ``spark-submit`` or a notebook."""

from __future__ import annotations

import time
import traceback
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.models import (
    ArchetypeModel, ChurnModels, ForestParams, fit_archetypes, fit_churn,
)
from tidemark.operators.sample import churn_labels, derive_sample, run_context
from tidemark.operators.thresholds import (
    FITTED_COLUMNS, fit_thresholds, load_thresholds, save_thresholds,
)
from tidemark.plans.master import churn_columns, taste_master
from tidemark.plans.resume import StagedRun, fingerprint, run_key
from tidemark.plans.score import ScoringRun, score_players, write_run
from tidemark.rule_document import load_rules
from tidemark.rules import TARGETS, RuleBook, TasteThresholds
from tidemark.sources.canonical import Tables
from tidemark.sources.identify import table_headers, validation_report
from tidemark.sources.readers import list_files, pick_tables, read_table
from tidemark.sources.staging import discard, stage, write_document


class InvalidInput(ValueError):
    """The input folder lacks a table or column no run can do without."""


def read_inputs(spark: SparkSession, input_dir: str) -> dict[str, DataFrame]:
    """The files of an input folder, if they can be scored."""
    files = {n: read_table(spark, p) for n, p in list_files(spark, input_dir).items()}
    errors = validation_report(table_headers(spark, files)).where(F.col("severity") == "error")
    messages = [r["message"] for r in errors.collect()]
    if messages:
        raise InvalidInput("; ".join(messages))
    return files


def fit_job(
    spark: SparkSession, input_dir: str, model_dir: str, churn_version: str, archetype_version: str,
    thresholds_path: str, rules: RuleBook | None = None, params: dict[str, ForestParams] | None = None,
    calibrate: bool = True,
) -> TasteThresholds:
    """Fit thresholds, churn forests and archetypes on an input folder and save what ``run_job`` loads.

    Thresholds come first, since the features of the archetypes read one of them. Existing versions are
    replaced.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rules = rules or RuleBook()
    tables = Tables(spark, pick_tables(spark, read_inputs(spark, input_dir)))
    ctx = run_context(tables.users)
    written: list[str] = []
    try:
        wanted = tuple(FITTED_COLUMNS)
        narrow = taste_master(tables, ctx, rules=rules, wanted=wanted)
        thresholds = fit_thresholds(narrow, tables.characters, derive_sample(tables.users, ctx))
        rules = replace(rules, thresholds=thresholds)
        master = stage(taste_master(tables, ctx, rules=rules), "fit-master", written)
        labels = churn_labels(tables.users, ctx)
        labels = labels.where(F.coalesce(*TARGETS).isNotNull())
        models, _ = fit_churn(
            master.select(*churn_columns(master.columns)), labels, churn_version, params=params, calibrate=calibrate
        )
        models.save(model_dir)
        fit_archetypes(master, archetype_version).save(model_dir)
        save_thresholds(spark, thresholds, thresholds_path)
    finally:
        discard(spark, written)
    return thresholds


def run_job(
    spark: SparkSession, input_dir: str, output_dir: str, model_dir: str, churn_version: str | None = None,
    archetype_version: str | None = None, oof_path: str | None = None,
    rules: RuleBook | None = None, thresholds_path: str | None = None, rules_path: str | None = None,
    resume_dir: str | None = None,
) -> ScoringRun:
    """Validate, load the chosen model versions, rules and fitted thresholds, score, write.

    Versions that are not named come from the ``active`` part of the rules, which a document at
    ``rules_path`` may hold. With ``resume_dir``, tables that a failed run with the same inputs, models and
    rules has finished are read from there instead of being built again. A failed run leaves its traceback
    in ``<output>/pipeline_error`` and raises.
    """
    started = time.time()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        files = read_inputs(spark, input_dir)
        if rules_path is not None:
            rules = load_rules(spark, rules_path)
        active = rules.active if rules is not None else {}
        churn_version = churn_version or active.get("churn")
        archetype_version = archetype_version or active.get("archetypes")
        if churn_version is None:
            raise ValueError("no churn version: name one, or state it under active in the rules")
        models = ChurnModels.load(spark, model_dir, churn_version)
        archetypes = None
        if archetype_version is not None:
            archetypes = ArchetypeModel.load(spark, model_dir, archetype_version)
        stored = read_table(spark, oof_path) if oof_path else None
        if thresholds_path is not None:
            fitted = load_thresholds(spark, thresholds_path)
            rules = replace(rules or RuleBook(), thresholds=fitted)
        tables = Tables(spark, pick_tables(spark, files))
        staged = None
        if resume_dir is not None:
            marks = [fingerprint(spark, p) for p in (input_dir, oof_path, thresholds_path) if p]
            versions = [fingerprint(spark, f"{model_dir}/{v}") for v in (churn_version, archetype_version) if v]
            staged = StagedRun(spark, resume_dir, run_key(*marks, *versions, rules))
        run = score_players(spark, tables, models, archetypes, stored, rules, staged=staged)
        write_run(spark, run, models, output_dir, rules, started)
        if staged is not None:
            staged.clear()
        return run
    except Exception as e:
        failure = {"error": repr(e), "traceback": traceback.format_exc()}
        write_document(spark, failure, f"{output_dir}/pipeline_error")
        raise
