import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import by_key, oid
from tidemark.operators.thresholds import fit_level, load_thresholds, save_thresholds
from tidemark.rules import TasteThresholds
from tidemark.sources import identify as I
from tidemark.sources.canonical import Tables, prepare
from tidemark.sources.catalog import SCHEMAS
from tidemark.sources.readers import list_files, read_directory, read_table
from tidemark.sources.staging import read_document, shared_folder, stage, write_document, write_table
from tidemark.sources.subset import subset


def headers(spark, files):
    return spark.createDataFrame([(f, c) for f, cols in files.items() for c in cols], "file string, column string")


def full(name):
    return [*SCHEMAS[name].required, *SCHEMAS[name].optional]


def test_identification(spark):
    got = by_key(I.identify(headers(spark, {
        "a.csv": full("users"), "b.csv": full("characters"), "junk.csv": [f"x{i}" for i in range(6)],
        "weak.csv": full("user_items")[1:8],
    })), "file")
    assert got["a.csv"]["schema"] == "users" and got["a.csv"]["score"] == 1.0
    assert got["b.csv"]["schema"] == "characters"
    assert got["junk.csv"]["schema"] is None and got["junk.csv"]["score"] == 0.0
    assert got["weak.csv"]["schema"] is None


def test_conflict_goes_to_the_better_then_first_file(spark):
    base = full("devices")
    got = by_key(I.identify(headers(spark, {"b": base, "a": base, "c": [*base, "x"]})), "file")
    assert got["a"]["schema"] == "devices" and got["b"]["schema"] is None and got["c"]["schema"] is None
    got = by_key(I.identify(headers(spark, {"a": [*base, "x"], "b": base})), "file")
    assert got["b"]["schema"] == "devices" and got["a"]["schema"] is None


def test_validation_report(spark):
    ok = I.validation_report(headers(spark, {"u": full("users"), "c": full("characters")}))
    rows = ok.collect()
    assert I.is_valid(ok) and sum(r["severity"] == "warning" for r in rows) == 7
    assert not I.is_valid(I.validation_report(headers(spark, {"c": full("characters")})))
    lacking = [c for c in full("users") if c != "created_at"]
    rows = I.validation_report(headers(spark, {"u": lacking, "c": full("characters")})).where("severity = 'error'").collect()
    assert [(r["schema"], r["message"]) for r in rows] == [("users", "missing required columns: created_at")]
    empty = I.validation_report(spark.createDataFrame([], "file string, column string")).collect()
    assert [(r["severity"], r["message"]) for r in empty] == [("error", "no input tables")]


def test_csv_directory(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    u = full("users")
    values = {"_id": f"ObjectId('{oid(1)}')", "created_at": "2025-01-01T00:00:00.000Z", "last_login_date": "1767398400.0",
              "country": "Spain", "gold": "12"}
    (folder / "players.csv").write_text(",".join(u) + "\n" + ",".join(values.get(c, "") for c in u) + "\n"
                                        + ",".join({"_id": "bad"}.get(c, "") for c in u) + "\n")
    (folder / "currency_transactions.csv").write_text(
        "user_id,concept,currency,quantity,created_at,extra\n" + f"{oid(1)},a,gold,nan,2025-01-01,z\n")
    t = read_directory(spark, str(folder))
    row = t.users.collect()
    assert len(row) == 1 and row[0]["user_id"] == oid(1) and row[0]["gold"] == 12.0
    assert str(row[0]["last_login_ts"]) == "2026-01-03 00:00:00" and row[0]["tutorial_done"] is None
    log = t.currency_transactions.collect()
    assert len(log) == 1 and log[0]["quantity"] is None
    assert t.devices.count() == 0 and "platform" in t.devices.columns
    assert list_files(spark, str(tmp_path / "nowhere")) == {}


def test_formats_and_time_coercion(spark, tmp_path):
    df = spark.createDataFrame([("a", "2025-01-02 03:04:05"), ("b", "2025/01/02 03:04:05"), ("c", "no")],
                               "user_id string, created_at string").withColumn("feedback_type", F.lit("LIKE"))
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / f"t.{fmt}")
        write_table(df, path, fmt)
        got = by_key(prepare("support_feedback", read_table(spark, path)))
        assert str(got["a"]["created_at"]) == str(got["b"]["created_at"]) == "2025-01-02 03:04:05"
        assert got["c"]["created_at"] is None


def test_parquet_filters_reach_the_scan(spark, tmp_path):
    from datetime import datetime

    path = str(tmp_path / "items.parquet")
    rows = [(oid(1), 1, 0.5, 1.0, 1.0, 2, datetime(2025, 1, 1), "x" * 50)]
    spark.createDataFrame(rows, "user_id string, item_definition_excel_id int, c_base_critical_chance double, "
                                "c_base_attack_enhanced double, c_base_defense_enhanced double, enhance_level int, "
                                "created_at timestamp, wide string").write.parquet(path)
    t = Tables(spark, {"user_items": read_table(spark, path)})
    from datetime import date

    from tidemark.context import RunContext
    from tidemark.operators import items
    from tidemark.operators.block import CHURN
    from tidemark.rules import RuleBook

    built = items.build(t, RunContext(date(2026, 4, 4)), RuleBook(), CHURN)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(created_at" in plan and "IsNotNull(user_id)" in plan
    assert "wide" not in plan and "SortAggregate" not in plan


def test_subset_keeps_references(spark):
    raw = {
        "users": spark.createDataFrame([(oid(i), "x") for i in (3, 1, 2)], "_id string, v string"),
        "characters": spark.createDataFrame([(f"ObjectId('{oid(10 + i)}')", oid(i)) for i in (1, 2, 3)], "_id string, user_id string"),
        "devices": spark.createDataFrame([(f"ObjectId('{oid(1)}')",), (oid(3),)], "user_id string"),
        "fights_log": spark.createDataFrame([(oid(11),), (oid(13),)], "player_id string"),
    }
    got = {n: df.count() for n, df in subset(raw, 2).items()}
    assert got == {"users": 2, "characters": 2, "devices": 1, "fights_log": 1}
    assert subset(raw, 2)["devices"].columns == ["user_id"]


def test_staging_and_documents(spark, tmp_path):
    assert shared_folder(spark) == shared_folder(spark)
    df = stage(spark.range(5).withColumn("k", F.col("id") % 2), "t")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()
    write_document(spark, {"a": 1, "ñ": [1.5, None]}, str(tmp_path / "doc"))
    assert read_document(spark, str(tmp_path / "doc")) == {"a": 1, "ñ": [1.5, None]}
    write_table(df, str(tmp_path / "by"), by="k")
    assert spark.read.parquet(str(tmp_path / "by")).where("k = 1").count() == 2


def test_thresholds_are_persisted(spark, tmp_path):
    chars = spark.createDataFrame([(oid(1), float(v)) for v in range(1, 12)] + [(oid(9), 99.0), (oid(1), None)],
                                  "user_id string, level double")
    sample = spark.createDataFrame([(oid(1),)], "user_id string")
    assert fit_level(chars, sample) == {"level_p50": 6.0, "level_p75": 8.5, "level_p90": 10.0}
    t = TasteThresholds(level_p75=8.5)
    save_thresholds(spark, t, str(tmp_path / "t"))
    assert load_thresholds(spark, str(tmp_path / "t")) == t
    json.dumps(t.__dict__)
    with pytest.raises(AttributeError):
        Tables(spark, {}).nothing


def test_lines_travel_to_their_orders_with_the_columns_of_the_table_only(spark, tmp_path):
    from tidemark.sources.retail import Retail

    day = "timestamp'1998-01-02 00:00:00'"
    spark.sql(
        "select id as l_orderkey, id * 3 as l_partkey, cast(id % 2 + 1 as int) as l_linenumber, cast(if(id = 2, 13, 50) as double) as l_quantity, "
        f"10.5D as l_extendedprice, 0.05D as l_discount, 0.04D as l_tax, {day} as l_shipdate from range(1, 4)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select id as o_orderkey, id * 7 as o_custkey from range(1, 4)").write.parquet(f"{tmp_path}/orders.parquet")
    retail = Retail(spark, str(tmp_path))
    own = retail.user_items_collection().select("user_id", "item_definition_excel_id", "created_at")
    above = own._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "l_quantity" not in above and "l_shipdate" not in above
    assert sorted((r.item_definition_excel_id, r.created_at is None) for r in own.collect()) == [(3, False), (6, True), (9, False)]
    items = {r.item_definition_excel_id: r for r in retail.user_items().collect()}
    assert (items[3].c_base_critical_chance, items[3].c_base_attack_enhanced, items[3].c_base_defense_enhanced, items[3].enhance_level) == (5.0, 10, 95000.0, 4)
    assert items[3].created_at == items[3].updated_at and items[6].created_at is not None
