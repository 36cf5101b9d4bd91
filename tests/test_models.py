import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import by_key, oid, one
from tidemark.operators import clusters, models as fitting
from tidemark.operators.archetypes import CentroidArchetypes
from tidemark.operators.encode import TargetEncoder, fit_encoder
from tidemark.operators.evaluate import evaluate, evaluate_each, score_ranks
from tidemark.operators.models import (
    ArchetypeModel, ChurnModels, ForestParams, align, encoded_columns, evaluate_splits, fit_archetypes, fit_churn,
    fold_encoders, fold_frame, fold_of, out_of_fold,
)
from tidemark.operators.split import part_sizes, stratified_split
from tidemark.sources.staging import stage

SMALL = ForestParams(trees=5, depth=4)


def test_split_sizes_are_exact_and_stable(spark):
    rows = [(oid(i), i % 3 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "user_id string, y boolean")
    first = by_key(stratified_split(df, "y"))
    again = by_key(stratified_split(df.repartition(7), "y"))
    assert {k: v["split"] for k, v in first.items()} == {k: v["split"] for k, v in again.items()}
    for label in (True, False):
        mine = [v["split"] for v in first.values() if v["y"] is label]
        test, val = part_sizes(len(mine))
        assert (mine.count("test"), mine.count("val")) == (test, val)
    assert {k: v["split"] for k, v in by_key(stratified_split(df, "y", seed=1)).items()} != {
        k: v["split"] for k, v in first.items()}


def test_encoder(spark, tmp_path):
    rows = [("ES", True, 1), ("ES", False, 1), ("FR", None, 0), (None, True, 0)]
    df = spark.createDataFrame(rows, "country string, has_user_rated_app boolean, y int")
    enc = fit_encoder(df, ["y"], ("country", "has_user_rated_app"))
    assert enc.global_means == {"y": 0.5}
    new = spark.createDataFrame([(1, "ES", True, "k"), (2, "XX", None, "k"), (3, None, False, "k")],
                                "i int, country string, has_user_rated_app boolean, other string")
    got = by_key(enc.apply(new, ["y"], in_place=True), "i")
    assert got[1]["country"] == pytest.approx((2 + 5) / 12) and got[2]["country"] == 0.5
    assert got[3]["country"] == pytest.approx(5 / 11) and got[2]["has_user_rated_app"] == pytest.approx(5 / 11)
    assert got[1]["has_user_rated_app"] == pytest.approx(6 / 12) and got[1]["other"] == "k"
    assert enc.apply(new, ["y"]).columns == [*new.columns, "country__y", "has_user_rated_app__y"]
    with pytest.raises(KeyError):
        enc.apply(new, ["z"])
    enc.save(str(tmp_path / "enc"))
    back = TargetEncoder.load(spark, str(tmp_path / "enc"))
    assert by_key(back.apply(new, ["y"], in_place=True), "i") == got
    with pytest.raises(ValueError, match="without a y label"):
        fit_encoder(df.withColumn("y", F.lit(None).cast("int")), ["y"], ("country",))


def test_metrics_against_brute_force(spark):
    rng = random.Random(2)
    data = [(round(rng.random(), 1 if i % 2 else 6), int(rng.random() < 0.4)) for i in range(400)] + [(0.0, 1), (1.0, 0)]
    m = one(evaluate(spark.createDataFrame(data, "s double, y int"), "s", "y"))
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    assert m["auc_roc"] == pytest.approx(
        sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)))
    cuts = sorted({s for s, _ in data})
    tp = {c: sum(p >= c for p in pos) for c in cuts}
    fp = {c: sum(q >= c for q in neg) for c in cuts}
    f1 = {c: 2 * tp[c] / (tp[c] + fp[c] + len(pos)) for c in cuts}
    assert m["best_f1"] == pytest.approx(max(f1.values()))
    assert m["best_threshold"] == min(c for c in cuts if f1[c] == max(f1.values()))
    steps, last, ap = sorted(cuts, reverse=True), 0, 0.0
    for c in steps:
        ap += (tp[c] - last) / len(pos) * tp[c] / (tp[c] + fp[c])
        last = tp[c]
    assert m["auc_pr"] == pytest.approx(ap)
    assert m["brier"] == pytest.approx(sum((s - y) ** 2 for s, y in data) / len(data))
    clip = [(min(max(s, 1e-15), 1 - 1e-15), y) for s, y in data]
    assert m["log_loss"] == pytest.approx(-sum(math.log(s if y else 1 - s) for s, y in clip) / len(data))
    assert m["accuracy_50"] == pytest.approx(sum((s >= 0.5) == bool(y) for s, y in data) / len(data))
    assert m["n"] == len(data) and m["positives"] == len(pos)


def training(spark, n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x = rng.random()
        rows.append((oid(i), x, None if i % 9 == 0 else rng.random(), "ES" if x > 0.6 else "FR", bool(i % 2), int(x > 0.5)))
    df = spark.createDataFrame(rows, "user_id string, x double, z double, country string, is_google_play boolean, churn_30d int")
    return df.drop("churn_30d"), df.select("user_id", "churn_30d")


FEATS = ("x", "z", "country", "is_google_play")


def test_churn_models(spark, tmp_path):
    master, labels = training(spark)
    models, rows = fit_churn(master, labels, "v9", ("churn_30d",), FEATS, {"churn_30d": SMALL}, calibrate=True)
    scored = models.score(master)
    got = by_key(scored)
    assert len(got) == 240 and scored.columns == ["user_id", "churn_prob_30d", "source"]
    assert all(0 <= v["churn_prob_30d"] <= 1 and v["source"] == "live_model" for v in got.values())
    metrics = {r["split"]: r for r in evaluate_splits(models, rows).collect()}
    assert set(metrics) == {"train", "val", "test"} and metrics["test"]["auc_roc"] > 0.9
    imp = models.importances(spark, "churn_30d").collect()
    assert [r["feature"] for r in imp][0] in ("x", "country") and len(imp) == 4
    models.save(str(tmp_path))
    back = ChurnModels.load(spark, str(tmp_path), "v9")
    again = by_key(back.score(master))
    assert all(again[k]["churn_prob_30d"] == pytest.approx(v["churn_prob_30d"]) for k, v in got.items())
    row = one(back.summary(spark))
    assert (row["version"], row["n_features"], row["has_calibrator"]) == ("v9", 4, True)
    with pytest.raises(ValueError, match="missing"):
        align(master, ["nope"], "m")


def test_out_of_fold(spark):
    master, labels = training(spark)
    # Not every player has both labels.
    known = F.crc32(F.col("user_id").cast("binary")) % 7 > 0
    rows = master.join(labels, "user_id").withColumn("churn_7d", F.when(known, 1 - F.col("churn_30d")))
    targets = ("churn_7d", "churn_30d")
    got = out_of_fold(rows, targets, FEATS, folds=3, params=SMALL).collect()
    want = {(r.user_id, r.target): r.fold for r in fold_frame(rows, targets, 3).collect()}
    assert {(r.user_id, r.target): r.fold for r in got} == want and len(got) == len(want)
    assert {r.fold for r in got} == {0, 1, 2} and all(0 <= r.p <= 1 for r in got)
    # One forest by hand, with an encoder that has not seen the fold.
    train = rows.where(fold_of(F.col("user_id"), 3) != 1)
    encoder = fit_encoder(train, ["churn_30d"], encoded_columns(rows, FEATS))
    alone, _ = fold_encoders(rows.withColumn("fold", fold_of(F.col("user_id"), 3)), targets, encoder.columns, 3)
    key = lambda r: (r["column"], r["category"])
    mine = {key(r): (r["n"], r["encoded"]) for r in alone.where("target = 'churn_30d' and fold = 1").collect()}
    assert mine == {key(r): (r["n"], pytest.approx(r["encoded"])) for r in encoder.mappings.collect()}


def test_archetypes(spark, tmp_path):
    master, _ = training(spark)
    model = fit_archetypes(master, "k", k=3, features=FEATS)
    got = by_key(model.assign(master))
    assert {v["archetype_n1"] for v in got.values()} == {0, 1, 2}
    model.save(str(tmp_path))
    assert by_key(ArchetypeModel.load(spark, str(tmp_path), "k").assign(master)) == got
    given = CentroidArchetypes.of(model)
    given.save(spark, str(tmp_path))
    loaded = CentroidArchetypes.load(spark, str(tmp_path), "k")
    assert loaded == given and by_key(loaded.assign(master).drop("distance")) == got
    unseen = master.limit(5).withColumns({"country": F.lit("nowhere"), "x": F.lit(None).cast("double")})
    assert by_key(loaded.assign(unseen).drop("distance")) == by_key(model.assign(unseen))
    with pytest.raises(ValueError, match="must have"):
        CentroidArchetypes(given.document | {"centroids": [{"code": 7, "vector": [1.0]}]})
    quality = one(clusters.cluster_quality(model.transform(master), "vector", "archetype_n1"))
    assert quality["clusters"] == 3 and -1 <= quality["silhouette"] <= 1 and quality["davies_bouldin"] > 0


def test_nearest_centroid_brute_force(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(200, 5)), rng.normal(size=(4, 5))
    x[0] = (c[1] + c[2]) / 2
    c[3] = c[1]  # a tie goes to the lower code
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<float>").repartition(3)
    cs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "code int, centroid array<double>")
    got = by_key(clusters.nearest_centroid(df, "v", cs), "i")
    x32 = x.astype(np.float32).astype(float)
    for i in range(200):
        d = ((x32[i] - c) ** 2).sum(axis=1)
        assert got[i]["archetype_n1"] == int(np.argmin(d)) and got[i]["distance"] == pytest.approx(d.min())
    assert not any(v["archetype_n1"] == 3 for v in got.values())


def test_close_scores_spread_and_groups_are_ranked_in_one_pass(spark):
    rng = random.Random(9)
    # All scores within what one bucket of equal width would hold, one of them on half of the rows.
    data = [(0.5 + (0 if i % 2 else rng.random() * 1e-5), rng.random(), int(rng.random() < 0.4), None if i % 10 == 0 else i % 2, "ab"[i % 3 == 0]) for i in range(3_000)]
    df = spark.createDataFrame(data, "s double, r double, y int, z int, part string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is tiny
    try:
        ranks = score_ranks(df, "s", "y")
        parts = ranks.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 1_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r.target, r.split): r.asDict() for r in evaluate_each(df, {"one": ("s", "y"), "two": ("r", "z")}, {"one": "part", "two": "part"}).collect()}
    assert set(got) == {(t, p) for t in ("one", "two") for p in "ab"}
    for (target, part), found in got.items():
        score, label = {"one": ("s", "y"), "two": ("r", "z")}[target]
        want = one(evaluate(df.where(F.col("part") == part), score, label))
        assert {k: found[k] for k in want} == pytest.approx(want)
    rows = sorted((s for s, *_ in data), reverse=True)
    above = {r.s: r.pos_above + r.neg_above for r in ranks.collect()}
    assert all(above[s] == rows.index(s) for s in set(rows))


def test_more_centroids_than_one_block(spark):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(300, 6)).astype(np.float32).astype(float), rng.normal(size=(1_500, 6))
    c[1_400:] = c[:100]  # ties across blocks
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [1.0])]
    cs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "code int, centroid array<double>").repartition(5)
    df = spark.createDataFrame(rows, "i int, v array<float>")
    for block_bytes in (9_000, 64_000_000):
        got = by_key(clusters.nearest_centroid(df, "v", cs, block_bytes=block_bytes), "i")
        square = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert [got[i]["archetype_n1"] for i in range(300)] == square.argmin(axis=1).tolist()
        assert np.allclose([got[i]["distance"] for i in range(300)], square.min(axis=1))
        assert all(got[i]["archetype_n1"] is None and got[i]["distance"] is None for i in (300, 301))


def test_quality_of_many_clusters_in_blocks(spark):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 60, size=500)
    labels[0] = 999  # alone
    centre = rng.normal(size=(1_000, 4)) * 3
    x = centre[labels] + rng.normal(size=(500, 4))
    rows = [(int(n), v.tolist()) for n, v in zip(labels, x)] + [(None, [0.0] * 4), (1, None)]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    kinds = sorted(set(labels.tolist()))
    mean = np.array([x[labels == k].mean(axis=0) for k in kinds])
    spread = np.array([np.sqrt(((x[labels == k] - m) ** 2).sum(axis=1)).mean() for k, m in zip(kinds, mean)])
    apart = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    want = ((spread[:, None] + spread[None]) / apart).max(axis=1).mean()
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    widths = []
    for i in range(500):
        to = {k: square[i][labels == k].sum() / max(1, (labels == k).sum() - (labels[i] == k)) for k in kinds}
        a, b = to[labels[i]], min(v for k, v in to.items() if k != labels[i])
        widths.append(0.0 if (labels == labels[i]).sum() == 1 else (b - a) / max(a, b))
    for block_bytes in (400, 64_000_000):
        got = one(clusters.cluster_quality(df, "v", "label", block_bytes))
        assert got["clusters"] == len(kinds) and got["davies_bouldin"] == pytest.approx(want)
        assert got["silhouette"] == pytest.approx(np.mean(widths))


def test_split_of_many_labels_and_null(spark):
    rows = [(f"{i:024x}", None if i % 151 == 150 else i % 151) for i in range(151 * 20)]
    got = stratified_split(spark.createDataFrame(rows, "user_id string, y int"), "y").groupBy("y", "split").count().collect()
    sizes = {(r["y"], r["split"]): r["count"] for r in got}
    test, val = part_sizes(20)
    for label in (*range(150), None):
        assert sizes[(label, "test")] == test
        assert sizes[(label, "val")] == val
        assert sizes[(label, "train")] == 20 - test - val


def test_training_rows_are_dealt_over_the_cores(spark):
    rows = stage(spark.range(12_000).select(F.col("id").cast("string").alias("user_id")).coalesce(1), "one-file")
    dealt = fitting.spread(rows)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.distinct().count() == 12_000
    assert fitting.spread(rows.where("user_id < '2'").limit(100)).rdd.getNumPartitions() == 1


def test_the_forests_of_all_targets_are_fitted_side_by_side(spark, monkeypatch):
    together, fit = threading.Barrier(3, timeout=120), fitting._fit_encoded
    monkeypatch.setattr(fitting, "_fit_encoded", lambda *a: (together.wait(), fit(*a))[1])
    rng = random.Random(5)
    rows = [(oid(i), rng.choice(["ES", "FR"]), float(i % 7)) for i in range(120)]
    master = spark.createDataFrame(rows, "user_id string, country string, gold double")
    targets = ("a", "b", "c")
    labels = spark.createDataFrame([(oid(i), *(int(i % 7 > k) for k in (1, 3, 5))) for i in range(120)], "user_id string, a int, b int, c int")
    models, _ = fit_churn(master, labels, "v", targets, ("country", "gold"), {t: ForestParams(trees=2, depth=2) for t in targets})
    assert list(models.forests) == list(models.fills) == list(targets)


def test_rows_are_scored_in_several_tasks_a_core(spark, monkeypatch):
    monkeypatch.setattr(fitting, "TASK_ROWS", 20)
    master, labels = training(spark, 600)
    master = stage(master.coalesce(1), "one-file")
    models, rows = fit_churn(master, labels, "v", ("churn_30d",), FEATS, {"churn_30d": SMALL}, calibrate=True)
    dealt = fitting.scattered(master)
    assert dealt.rdd.getNumPartitions() == 16 and fitting.scattered(master.limit(20)).rdd.getNumPartitions() == 1
    assert by_key(models.score(dealt)) == by_key(models.score(master))
    tasks, score = [], ChurnModels.score
    monkeypatch.setattr(ChurnModels, "score", lambda self, df: (tasks.append(df.rdd.getNumPartitions()), score(self, df))[1])
    metrics = {r["split"]: r["n"] for r in evaluate_splits(models, rows).collect()}
    assert tasks == [16] and sum(metrics.values()) == 600


def test_fits_at_once_share_the_cores(spark, monkeypatch):
    rows = stage(spark.range(30_000).select(F.col("id").cast("string").alias("user_id")).repartition(4), "four-files")
    monkeypatch.setattr(fitting, "MOST_ROWS", 6_000)
    assert fitting.spread(rows, 1).rdd.getNumPartitions() == 5
    monkeypatch.setattr(fitting, "MOST_ROWS", 30_000)
    monkeypatch.setattr(fitting, "TASK_ROWS", 4_000)
    shared = fitting.spread(rows.repartition(4), 3)
    assert shared.rdd.getNumPartitions() == 2 and shared.distinct().count() == 30_000
    # Few rows stay as they are read.
    assert fitting.spread(rows.limit(4_000).repartition(4), 3).rdd.getNumPartitions() == 4


def test_many_rows_are_fitted_with_small_groups_of_nodes(spark, monkeypatch):
    groups, make = [], fitting.RandomForestClassifier
    monkeypatch.setattr(fitting, "RandomForestClassifier", lambda **k: (groups.append(k["maxMemoryInMB"]), make(**k))[1])
    master, labels = training(spark)
    first, _ = fit_churn(master, labels, "v", ("churn_30d",), FEATS, {"churn_30d": SMALL})
    monkeypatch.setattr(fitting, "TASK_ROWS", 50)
    second, rows = fit_churn(master, labels, "v", ("churn_30d",), FEATS, {"churn_30d": SMALL})
    assert groups == [256, 16]
    for forest in (first.forests["churn_30d"], second.forests["churn_30d"]):
        assert forest.getNumTrees == SMALL.trees and max(t.depth for t in forest.trees) == SMALL.depth
    assert {r["split"]: r["auc_roc"] for r in evaluate_splits(second, rows).collect()}["test"] > 0.9
