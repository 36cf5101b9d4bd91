"""Fit, save, load and score; a failed run goes on where it stopped."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.models import ForestParams
from tidemark.operators.thresholds import load_thresholds
from tidemark.plans import job, score
from tidemark.plans.job import fit_job, run_job
from tidemark.plans.resume import StagedRun, fingerprint, run_key
from tidemark.rule_document import parse_rules, save_rules
from tidemark.rules import TARGETS, TasteThresholds
from tidemark.sources.catalog import FILE_NAMES, SCHEMAS
from tidemark.sources.retail import Retail
from tidemark.sources.staging import read_document

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


def exports(spark, folder):
    retail = Retail(spark, FOLDER)
    for name, usual in FILE_NAMES.items():
        export = retail.exports()[name]
        for c in SCHEMAS[name].optional if name in SCHEMAS else ():
            if c not in export.columns:
                export = export.withColumn(c, F.lit(None).cast("string"))
        export.write.parquet(f"{folder}/{usual.replace('.csv', '.parquet')}")


def test_a_staged_run_is_taken_only_for_the_same_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x")
    first = fingerprint(spark, str(tmp_path / "in"))
    assert fingerprint(spark, str(tmp_path / "in")) == first
    (tmp_path / "in" / "b.csv").write_text("y")
    assert fingerprint(spark, str(tmp_path / "in")) != first
    with pytest.raises(FileNotFoundError):
        fingerprint(spark, str(tmp_path / "none"))
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    run = StagedRun(spark, str(tmp_path / "stages"), run_key(first, "v1"))
    assert run.table("t", build).count() == run.table("t", build).count() == 3 and len(built) == 1
    (Path(run.root) / "t" / "_SUCCESS").unlink()  # a write that did not finish
    assert run.table("t", build).count() == 3 and len(built) == 2
    assert StagedRun(spark, str(tmp_path / "stages"), run_key(first, "v2")).finished("t") is False
    run.clear()
    assert not run.finished("t")


@needs_data
def test_fit_save_load_score_and_resume(spark, tmp_path, monkeypatch):
    folders = {k: str(tmp_path / k) for k in ("in", "models", "thresholds", "out", "resume", "rules")}
    exports(spark, folders["in"])
    small = dict.fromkeys(TARGETS, ForestParams(trees=3, depth=3))
    fitted = fit_job(spark, folders["in"], folders["models"], "v1", "a1", folders["thresholds"], params=small)
    assert load_thresholds(spark, folders["thresholds"]) == fitted != TasteThresholds()
    assert fitted.build_t33 <= fitted.build_t67
    save_rules(spark, parse_rules({"active": {"churn": "v1", "archetypes": "a1"}, "drift_threshold": 0.5}), folders["rules"])

    built = []
    real = score.taste_master
    monkeypatch.setattr(score, "taste_master", lambda *a, **b: built.append("master") or real(*a, **b))
    stopped = job.write_run
    monkeypatch.setattr(job, "write_run", lambda *a, **b: 1 / 0)
    args = {"rules_path": folders["rules"], "thresholds_path": folders["thresholds"], "resume_dir": folders["resume"]}
    with pytest.raises(ZeroDivisionError):
        run_job(spark, folders["in"], folders["out"], folders["models"], **args)
    assert "ZeroDivisionError" in read_document(spark, f"{folders['out']}/pipeline_error")["error"]
    left = {p.name for p in Path(folders["resume"]).glob("*/*")}
    assert left == {"master", "scores", "archetypes", "taste"} and built == ["master"]

    monkeypatch.setattr(job, "write_run", stopped)
    run_job(spark, folders["in"], folders["out"], folders["models"], **args)
    assert built == ["master"]  # read, not built again
    assert list(Path(folders["resume"]).glob("*")) == []
    full = spark.read.parquet(f"{folders['out']}/predictions_full")
    meta = read_document(spark, f"{folders['out']}/run_metadata")
    assert full.count() == 150 and meta["drift_threshold"] == 0.5 and {m["version"] for m in meta["models"]} == {"v1"}
    share = full.where("estilo_build = 'agresivo'").count() / full.where("estilo_build is not null").count()
    assert 0.2 < share < 0.5  # the terciles come from these players


def test_a_run_needs_a_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(job, "read_inputs", lambda *a: {})
    with pytest.raises(ValueError, match="no churn version"):
        run_job(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path))
