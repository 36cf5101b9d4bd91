import os
import sys

import pytest
from pyspark.sql import functions as F

from tests.conftest import by_key, oid
from tidemark.operators import report
from tidemark.operators.models import ForestParams, fit_archetypes, fit_churn
from tidemark.operators.sample import churn_labels
from tidemark.plans import registry
from tidemark.plans.job import InvalidInput, run_job
from tidemark.plans.master import churn_columns, taste_master
from tidemark.plans.score import score_players, summary_document, write_run
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables, prepare
from tidemark.sources.catalog import FILE_NAMES, SCHEMAS
from tidemark.sources.retail import Retail
from tidemark.sources.staging import read_document, stage
from tidemark.streaming.daily_counts import (
    currency_table, daily_counters, features_from_counters, read_log_stream, start_counters,
)

FOLDER = "/root/testdata/sf0.001"
BOOK = RuleBook()
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@needs_data
def test_end_to_end(spark, ctx, tmp_path):
    retail = Retail(spark, FOLDER)
    t = Tables(spark, retail.exports())
    from tidemark.operators.sample import run_context

    when = run_context(t.users)
    master = stage(taste_master(t, when), "m")
    labels = churn_labels(t.users, when).where("churn_7d is not null")
    small = ForestParams(trees=3, depth=3)
    models, _ = fit_churn(master.select(*churn_columns(master.columns)), labels, "v1",
                          params=dict.fromkeys(("churn_7d", "churn_14d", "churn_30d"), small))
    archetypes = fit_archetypes(master, "a1")
    run = score_players(spark, t, models, archetypes, retail.stored_scores())
    write_run(spark, run, models, str(tmp_path))
    full = spark.read.parquet(str(tmp_path / "predictions_full"))
    business = spark.read.parquet(str(tmp_path / "predictions"))
    assert len(full.columns) == 28 and len(business.columns) == 20 and full.count() == 150
    assert not any(c.startswith(("risk", "priority")) for c in full.columns)
    bad = full.where("churn_30d_final not between 0 and 1 or (churn_7d_source = 'live_new') <> (churn_7d_oof is null) "
                     "or contramedida_primaria_cod is null or archetype_n1 not between 0 and 5")
    assert bad.count() == 0
    csv = spark.read.option("header", True).csv(str(tmp_path / "predictions_full_csv"))
    assert csv.where("perfil_oro = 'null'").count() == full.where("perfil_oro = 'null'").count() > 0
    summary = read_document(spark, str(tmp_path / "summary"))
    assert summary["n_users"] == 150 and summary["countermeasure_coverage_pct"] == 100.0
    assert set(summary["per_target"]) == {"churn_7d", "churn_14d", "churn_30d"}
    meta = read_document(spark, str(tmp_path / "run_metadata"))
    assert meta["stage_6_status"] == "ok" and meta["reference_date"] == "2001-08-01" and len(meta["models"]) == 3
    assert spark.read.parquet(str(tmp_path / "ranked_players")).count() == 150

    models.save(str(tmp_path / "models"))
    archetypes.save(str(tmp_path / "models"))
    for name, usual in FILE_NAMES.items():
        export = retail.exports()[name]
        for c in SCHEMAS[name].optional if name in SCHEMAS else ():
            if c not in export.columns:
                export = export.withColumn(c, F.lit(None).cast("string"))
        export.write.parquet(str(tmp_path / "in" / usual.replace(".csv", ".parquet")))
    retail.stored_scores().write.parquet(str(tmp_path / "oof.parquet"))
    args = (str(tmp_path / "in"), str(tmp_path / "job"), str(tmp_path / "models"), "v1", "a1")
    job = run_job(spark, *args, oof_path=str(tmp_path / "oof.parquet"))
    again = spark.read.parquet(str(tmp_path / "job" / "predictions_full"))
    assert again.exceptAll(full).count() == 0 and full.exceptAll(again).count() == 0
    assert job.staged == [] and job.full.count() == 150
    (tmp_path / "nothing").mkdir()
    with pytest.raises(InvalidInput, match="no input tables"):
        run_job(spark, str(tmp_path / "nothing"), str(tmp_path / "bad"), *args[2:])
    assert "no input tables" in read_document(spark, str(tmp_path / "bad" / "pipeline_error"))["error"]

    broken = score_players(spark, t, models, None, None, ctx=when)
    assert broken.profile_status == "skipped" and "no archetype model" in broken.profile_error
    assert broken.full.columns == full.columns and broken.business.columns == business.columns
    row = broken.full.first()
    assert row["archetype_name"] == "N/A" and row["perfil_oro"] is None and row["churn_7d_source"] == "live_new"
    assert "action" not in summary_document(broken, BOOK, models.targets)


def predictions(spark, n=100):
    rows = [(oid(i), *[.5 - .1 * h + (i % 50) / 100 for h in range(3)], i % 6, f"arch{i % 6}" if i % 10 else None,
             f"CM{i % 12 + 1:02d}" if i else None, "x", i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id string, churn_7d_final double, churn_14d_final double, churn_30d_final double, "
                                     "archetype_n1 int, archetype_name string, contramedida_primaria_cod string, "
                                     "contramedida_primaria_label string, has_tier2 int")
    return df


def test_report_tables(spark):
    p = predictions(spark)
    risk = by_key(report.high_risk(p, BOOK), "horizon")
    for h, base in (("7d", .5), ("14d", .4), ("30d", .3)):
        n = sum(base + (i % 50) / 100 >= 0.65 for i in range(100))
        assert abs(risk[h]["n"] - n) <= 2 and risk[h]["pct"] == float(risk[h]["n"])
    k = report.kpis(p, BOOK).first()
    assert (k["n_users"], k["n_archetypes"]) == (100, 6) and k["n_high_risk"] == risk["14d"]["n"]
    arch = report.archetype_table(p, BOOK).collect()
    assert {r["archetype_name"] for r in arch} == {*(f"arch{i}" for i in range(6)), "Sin clasificar"}
    assert sum(r["n_users"] for r in arch) == 100 and [r["pct"] for r in arch] == sorted((r["pct"] for r in arch), reverse=True)
    actions = report.action_table(p).collect()
    assert sum(r["n_users"] for r in actions) == 99 and actions[0]["n_users"] >= actions[-1]["n_users"]
    ranked = report.ranked_players(p).collect()
    assert ranked == sorted(ranked, key=lambda r: (r["archetype_name"], -r["churn_30d_final"], r["user_id"]))
    top = report.top_players(p, 3)
    assert top.count() == 21 and top.agg(F.max("rank")).first()[0] == 3
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    dist = {(r["kind"], r["value"]): (r["n"], r["pct"]) for r in report.distribution(p).collect()}
    assert dist[("tier2", "1")] == (50, 50.0) and dist[("action", None)] == (1, 1.0)


LOG = "user_id string, concept string, currency string, quantity double, created_at timestamp"


def test_stream_equals_batch(spark, ctx, tmp_path):
    from datetime import datetime, timedelta

    rows = [(oid(i % 5), f"c{i % 3}", None if i % 7 == 0 else f"k{i % 2}", float(i % 4 - 1),
             datetime(2026, 3, 10) + timedelta(hours=5 * i)) for i in range(100)]
    rows += [(oid(1), "c1", "k1", 1.0, datetime(2026, 4, 4) + timedelta(seconds=s)) for s in (0, 1)]  # the edge of the window
    src, folder, check = (str(tmp_path / n) for n in ("src", "table", "check"))
    table = currency_table(spark, folder, compact_every=3)
    for part in range(4):
        spark.createDataFrame(rows[part::5], LOG).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema

    def run():
        start_counters(read_log_stream(spark, src, schema, files_per_batch=1), table, check).awaitTermination()
        return {tuple(r) for r in table.read().collect()}

    def batch():
        log = prepare("currency_transactions", spark.read.parquet(src))
        return {tuple(r) for r in daily_counters(log).select(*table.read().columns).collect()}

    assert run() == batch()
    spark.createDataFrame(rows[4::5], LOG).write.mode("append").parquet(src)
    assert run() == batch()  # resumes from the checkpoint, adds only the new files

    got = by_key(features_from_counters(table, ctx))
    from tidemark.operators.logs import currency_counts, currency_features

    want = by_key(currency_features(currency_counts(prepare("currency_transactions", spark.read.parquet(src)), ctx), ctx))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


@needs_data
@pytest.mark.parametrize("names", [
    ("id_normalize", "schema_match", "schema_report", "referential_subset", "log_window_scan"),
    ("master_taste", "predictions_full"), ("cleanup_report", "target_encode_apply", "threshold_fit"),
])
def test_queries_match_their_sql(spark, names):
    sys.path.insert(0, "tools")
    import __spark_entry__ as entry
    from tools.check import compare, duck, rows_of

    con = duck(FOLDER)
    for name in names:
        df = entry.queries()[name](spark, FOLDER)
        rel = con.sql(entry.oracle_sql()[name])
        assert compare(rows_of(df.columns, df.collect()), rows_of(list(rel.columns), rel.fetchall())) is None, name


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    weak = set(registry.QUERIES) - set(entry.oracle_sql())
    assert weak == {"churn_score", "churn_fit_eval", "feature_importance", "oof_predictions", "archetype_fit"}
