import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import by_key, one, oid
from tidemark.functions import diversity, ids, numbers, times
from tidemark.functions.order_stats import column_percentiles, percentiles, ranked_values


def test_three_id_rules(spark):
    a = oid(10)
    raw = [f"ObjectId('{a}')", f"ObjectId({a})", a, "guest", f"x {a} y", a.upper(), "ObjectId(", None,
           f"a\nObjectId('{a}')\n"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, c string").select(
        "i", ids.wrapped_or_raw(F.col("c")).alias("raw"),
        ids.wrapped_or_strict(F.col("c")).alias("strict"),
        ids.first_hex_run(F.col("c")).alias("hex"),
    )
    got = by_key(df, "i")
    assert [got[i]["raw"] for i in range(9)] == [a, a, a, "guest", f"x {a} y", a.upper(), "ObjectId(",
                                                 None, a]
    assert [got[i]["strict"] for i in range(9)] == [a, a, a, None, None, None, None, None, a]
    assert [got[i]["hex"] for i in range(9)] == [a, a, a, None, a, None, None, None, a]


def test_day_ages_round_half_to_even(spark, ctx):
    df = spark.sql("""SELECT * FROM VALUES (1, timestamp'2026-01-01 12:00:00'),
        (2, timestamp'2026-01-02 12:00:00'), (3, timestamp'2026-01-06'), (4, NULL) AS t(i, t)""")
    got = by_key(df.select(
        "i", times.days_ago(F.col("t"), ctx.cutoff()).alias("ago"),
        times.days_since(F.col("t"), ctx.cutoff()).alias("since"),
        times.whole_days(F.col("t"), ctx.cutoff()).alias("whole"),
    ), "i")
    assert [got[i]["ago"] for i in (1, 2, 3, 4)] == [2, 2, None, None]
    assert [got[i]["since"] for i in (1, 2, 3, 4)] == [2, 2, 0, None]
    assert [got[i]["whole"] for i in (1, 2, 3, 4)] == [2, 1, -2, None]


def test_null_safe_numbers(spark):
    row = one(spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, 0.0D AS z, 2.5D AS h").select(
        numbers.clip(F.col("x"), 0, 1).alias("clip"), numbers.ratio(F.lit(1), F.col("z")).alias("zero"),
        numbers.flag(F.col("x") > 1).alias("flag"), numbers.round_half_even(F.col("h")).alias("even"),
        numbers.no_nan(F.lit(float("nan"))).alias("nan"),
    ))
    assert row == {"clip": None, "zero": None, "flag": 0, "even": 2.0, "nan": None}


COUNTS = {
    "four": [10, 10, 10, 10], "single": [100], "skew": [1, 1, 1, 97], "days": [30, 10, 10],
    "zeros": [0, 0, 10], "five": [5, 5, 5, 5],
}


def test_count_statistics(spark):
    rows = [(k, n) for k, ns in COUNTS.items() for n in ns]
    got = by_key(diversity.count_statistics(spark.createDataFrame(rows, "k string, n bigint"), ["k"]), "k")
    assert got["four"]["entropy"] == pytest.approx(2.0)
    assert got["single"]["entropy"] == 0.0 and got["single"]["simpson"] == 0.0
    assert got["five"]["simpson"] == pytest.approx(0.75)
    assert got["four"]["gini"] == pytest.approx(0.0) and got["skew"]["gini"] > 0.5
    assert got["four"]["burst"] == 1.0 and got["days"]["burst"] == 3.0 and got["zeros"]["burst"] is None


def test_count_statistics_against_brute_force(spark):
    rng = random.Random(7)
    data = {k: [rng.randint(1, 12) for _ in range(rng.randint(1, 40))] for k in range(60)}
    rows = [(k, n) for k, ns in data.items() for n in ns]
    got = by_key(diversity.count_statistics(spark.createDataFrame(rows, "k int, n bigint"), ["k"]), "k")
    for k, ns in data.items():
        x = np.sort(np.array(ns, dtype=float))
        p, n, s = x / x.sum(), len(x), x.sum()
        assert got[k]["entropy"] == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9)
        assert got[k]["simpson"] == pytest.approx(1 - (p * p).sum())
        gini = sum(2 * (i + 1) * v for i, v in enumerate(x)) / (n * s) - (n + 1) / n
        assert got[k]["gini"] == pytest.approx(gini)
        assert got[k]["burst"] == pytest.approx(x.max() / np.median(x))


def test_category_counts_in_one_pass(spark):
    rows = [(1, "a", "x", 5.0), (1, "a", "y", -1.0), (1, None, "y", 2.0), (2, "b", "x", None)]
    df = spark.createDataFrame(rows, "u int, p string, q string, v double")
    got = {
        (r["u"], r["dim"], r["p"], r["q"]): (r["n"], r["pos"])
        for r in diversity.category_counts(df, "u", ("p", "q"), pos=numbers.flag(F.col("v") > 0)).collect()
    }
    assert got == {
        (1, "p", "a", None): (2, 1), (1, "p", None, None): (1, 1), (2, "p", "b", None): (1, 0),
        (1, "q", None, "x"): (1, 1), (1, "q", None, "y"): (2, 1), (2, "q", None, "x"): (1, 0),
    }


@pytest.mark.parametrize("values", [
    [float(i % 7) for i in range(1000)],
    [1e-300, 1.0, 1e300, -5.0, 2.0, 2.0],
    [3.0] * 900 + [float(i) for i in range(100)],
    [random.Random(3).gauss(0, 1) for _ in range(5000)],
    [4.5],
    [-1.7e308, 1.7e308, 0.0, 1e308, -1e308],
    [0.0, 5e-324, 5e-324],
])
def test_percentiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    probs = [0.0, 0.1, 0.33, 0.5, 0.67, 0.75, 0.9, 1.0]
    assert percentiles(df, "v", probs)[None] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, float("inf")],
    [float("-inf"), 0.0, 1.0, 2.0, float("inf"), float("inf"), 5.0],
    [float("-inf"), float("inf")],
])
def test_ranks_and_percentiles_with_infinities(spark, values):
    """Between equal values lies the value; numpy says NaN between two infinities, so ranks are the measure."""
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranked_values(df, "v", {None: list(range(1, len(values) + 1))})
    assert [got[(None, r)] for r in range(1, len(values) + 1)] == sorted(values)
    steps = [i / (len(values) - 1) for i in range(len(values))]
    assert percentiles(df, "v", steps)[None] == pytest.approx(sorted(values))


def test_percentiles_per_group_and_without_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 7.0), ("c", None)], "g string, v double")
    assert percentiles(df, "v", [0.5], by="g") == {"a": [1.5], "b": [7.0], "c": [None]}


def test_columns_and_groups_share_their_passes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(("x", "y", None)[i % 3], rng.gauss(0, 1), rng.getrandbits(58), i % 4 or None, rng.gauss(0, 1e9)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, a double, b bigint, c int, d double")
    passes = []
    real = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: passes.append(1) or real(self))
    probs = {"a": [0.1, 0.5], "b": [0.75], "c": [0.0, 0.33, 1.0], "d": [0.5, 0.9]}
    got = column_percentiles(df, probs, by="g")
    shared = len(passes)
    passes.clear()
    alone = [column_percentiles(df, {c: p}) and (len(passes), passes.clear())[0] for c, p in probs.items()]
    assert shared <= max(alone) + 1 < sum(alone)
    for i, column in enumerate("abcd", 1):
        for g in ("x", "y", None):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None]
            assert got[(column, g)] == pytest.approx(list(np.quantile(np.array(values, float), probs[column])), rel=1e-12)


def test_ranks_of_large_integers(spark):
    values = sorted({random.Random(i).getrandbits(60) for i in range(3000)})
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = ranked_values(df, "v", {None: [1, 17, 1500, len(values)]})
    assert [got[(None, r)] for r in (1, 17, 1500, len(values))] == [
        values[0], values[16], values[1499], values[-1]]
