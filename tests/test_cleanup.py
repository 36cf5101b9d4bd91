import random

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import cleanup as C


def shares(df):
    return {r["column"]: r["null_share"] for r in C.null_shares(df).collect()}


def test_null_share_boundary(spark):
    rows = [(str(i), None if i < 95 else 1.0, None if i < 96 else 1.0, float("nan") if i < 96 else 2.0)
            for i in range(100)]
    df = spark.createDataFrame(rows, "user_id string, at double, above double, nan double")
    assert C.high_null_columns(shares(df), 0.95) == ["above", "nan"]


def test_majority_matches_counting(spark):
    rng = random.Random(1)
    rows = [(str(i), "x" if rng.random() < 0.97 else str(i), 0 if i % 20 else i + 1, None if i % 3 else True,
             rng.random(), None, "a" if i % 2 else "b") for i in range(2000)]
    schema = "user_id string, s string, n int, b boolean, d double, e int, half string"
    df = spark.createDataFrame(rows, schema).repartition(7)
    cols = [c for c in df.columns if c != "user_id"]
    full = {r["column"]: r["top_share"] for r in C.top_value_shares(df, cols).collect()}
    for above in (0.95, 0.80, 0.45):
        got = {r["column"]: r["top_share"] for r in C.majority_shares(df, cols, above).collect()}
        assert got == {c: pytest.approx(s) for c, s in full.items() if s > above}
    assert "n" not in {r["column"] for r in C.majority_shares(df, cols, 0.95).collect()}  # exactly 0.95


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(5)
    n = 400
    base = rng.normal(size=n)
    data = pd.DataFrame({
        "a": base, "b": base * 3 + 1e9, "c": base + rng.normal(size=n), "d": np.where(rng.random(n) < 0.3, np.nan, -base),
        "k": 7.0, "e": rng.normal(size=n) * 1e-8,
    })
    data["sparse"] = np.where(np.arange(n) < 2, 1.0, np.nan)
    data["flag"] = data["a"] > 0
    df = spark.createDataFrame(
        [(str(i), *[None if isinstance(v, float) and np.isnan(v) else v for v in r]) for i, r in
         enumerate(data.astype(object).values.tolist())],
        "user_id string, a double, b double, c double, d double, k double, e double, sparse double, flag boolean",
    ).repartition(5)
    cols = C.numeric_columns(df, ["user_id"])
    want = data.astype(float)[cols].corr()
    for r in C.correlations(df, cols).collect():
        w = want.loc[r["col_a"], r["col_b"]]
        if r["corr"] is None:
            assert np.isnan(w) or "k" in (r["col_a"], r["col_b"]) or "sparse" in (r["col_a"], r["col_b"])
        else:
            assert r["corr"] == pytest.approx(w, abs=1e-6)
    assert len(cols) == 8


def test_greedy_pruning():
    # b goes by name; b then opens nothing, so c stays although it is close to b
    assert C.prune_correlated([("a", "b", 1.0), ("b", "c", 1.0)], dict.fromkeys("abc", 0.0))[0] == ["b"]
    # a has more nulls: it goes, but its own comparisons continue (c goes as the second on a tie)
    dropped, used = C.prune_correlated(
        [("a", "b", 1.0), ("a", "c", 0.99), ("b", "c", 0.5)], {"a": 0.2, "b": 0.1, "c": 0.2})
    assert dropped == ["a", "b", "c"] or dropped == ["a", "c"]
    assert used[0] == ("a", "b", 1.0)


def brute_greedy(cols, corr, nulls, t):
    gone = []
    for i, a in enumerate(cols):
        if a in gone:
            continue
        for b in cols[i + 1:]:
            if b not in gone and corr[(a, b)] >= t:
                gone.append(a if nulls[b] < nulls[a] else b)
    return sorted(set(gone))


def test_greedy_against_all_pairs():
    for seed in range(200):
        rng = random.Random(seed)
        cols = list("abcdefg")
        corr = {(a, b): rng.choice([0.5, 0.96, 1.0]) for i, a in enumerate(cols) for b in cols[i + 1:]}
        nulls = {c: rng.choice([0.0, 0.1]) for c in cols}
        strong = [(a, b, r) for (a, b), r in corr.items() if r >= 0.95]
        assert C.prune_correlated(strong, nulls)[0] == brute_greedy(cols, corr, nulls, 0.95)


def test_plan_report_and_variants(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        x, y = float(rng.normal()), float(rng.normal())
        rows.append((str(i), x, 2 * x, x + 0.25 * y, y, None if i else 1.0, 0, 5.0 * i, i % 2))
    df = spark.createDataFrame(rows, "user_id string, a double, b double, c double, y double, empty double, "
                                     "zero int, user_gold double, churn_30d int")
    plan = C.plan_cleanup(df, targets=["churn_30d"])
    # one filled value is 100 % of the non-null rows, so the empty column is constant as well
    assert plan.high_null == ["empty"] and plan.quasi_constant == ["empty", "zero"]
    assert plan.leakage == ["user_gold"] and plan.corr_intermediate == ["b"] and plan.corr_aggressive == ["c"]
    out = C.apply_cleanup(df, plan)
    assert out["v1_conservative"].columns == ["user_id", "a", "b", "c", "y", "churn_30d"]
    assert out["v2_intermediate"].columns == ["user_id", "a", "c", "y", "churn_30d"]
    assert out["v3_aggressive"].columns == ["user_id", "a", "y", "churn_30d"]
    strict = C.plan_cleanup(df, thresholds=C.CleanupThresholds(corr_intermediate=1.1, corr_aggressive=1.1))
    got = {(r["feature"], r["reason"]): r["threshold"] for r in strict.report(spark).collect()}
    assert got[("empty", "high_nan")] == 0.95 and got[("user_gold", "target_leakage")] is None
    assert ("b", "corr_99") not in got
