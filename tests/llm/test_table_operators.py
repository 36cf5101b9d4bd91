"""Sharding, search, mixing, vector near-duplicates, components and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import ODD, edge_docs, labels_of, make, prose
from tidemark.llm import kdtree, kmeans_tree, mixing, pca_tiles
from tidemark.llm.components import components

VECTORS = "vec_id bigint, embedding array<float>, label int, n_links string, rank string"


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "x", "y") for i, v, lab in rows], VECTORS)


ODD_VECTORS = [(9_001, None, 1), (9_002, [0.0] * 8, 1), (9_003, [float("nan")] * 8, 1), (9_004, [None] + [1.0] * 7, 1), (9_005, [float("inf")] * 8, 1), (9_006, [], 1)]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 140))
    assert found[301] == 300 and 200 not in found


def test_shards_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(4)
    rows = [(i, "w" * rng.randint(1, 400), rng.choice(["en", "de", None]), f"s{rng.randint(0, 3)}", None, 0.0, "r") for i in range(4_000)]
    rows += [(10_000 + i, "copy of one text", "en", f"s{i % 4}", None, 0.0, "r") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size double, shard string")
    out = kdtree.shard(docs, leaves=10).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == 5_500 and len(sizes) == 10 and sizes.max() - sizes.min() < 0.03 * sizes.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    again = kdtree.shard(docs, leaves=10).toPandas()
    assert out.sort_values("doc_id").shard.tolist() == again.sort_values("doc_id").shard.tolist()


def test_small_groups_of_copies_share_a_shard(spark):
    texts = prose(600, words=30)
    docs = make(spark, [t for t in texts for _ in (0, 1)])
    out = kdtree.shard(docs, target_bytes=60_000).toPandas()
    assert out.shard.nunique() > 2 and (out.groupby("text_crc32").shard.nunique() == 1).mean() > 0.98


def test_shards_of_odd_rows(spark):
    out = kdtree.shard(edge_docs(spark), leaves=3).toPandas()
    assert len(out) == len(ODD) + 2 and out["size"].min() == 16
    assert kdtree.shard(make(spark, []), leaves=3).count() == 0
    assert kdtree.shard(make(spark, ["one"]), leaves=5).toPandas().slot.tolist() == [0]


def test_search_reaches_recall_and_orders_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3_000, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + ODD_VECTORS
    got = kmeans_tree.search(make_vectors(spark, rows)).toPandas()
    hits = 0
    for q in range(0, 3_000, 20):
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine.vec_id)
        score = x.astype(float) @ x[q].astype(float)
        assert np.allclose(mine.score, score[mine.vec_id])
        assert mine[["score", "vec_id"]].apply(tuple, axis=1).tolist() == sorted(mine[["score", "vec_id"]].apply(tuple, axis=1).tolist(), key=lambda t: (-t[0], t[1]))
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(mine.vec_id)) if not 100 <= q < 160 else 20
    assert hits / (150 * 20) >= 0.9


def test_search_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (7, [0.5, 0.5], None), (20, [1.0, 0.0], 1)]
    got = kmeans_tree.search(make_vectors(spark, rows)).toPandas()
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [20, 20, 7]
    assert got[got.query_id == 20].vec_id.tolist() == [0, 7]
    assert kmeans_tree.search(make_vectors(spark, ODD_VECTORS)).count() == 0


@pytest.mark.parametrize("tile", [16, 512])
def test_vector_links_match_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(pca_tiles, "TILE", tile)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base[rng.integers(0, 40, 260)] + 0.15 * rng.normal(size=(260, 8)), np.repeat(base[:1], 30, axis=0)]).astype(np.float32)
    labels = [int(v) if v < 3 else None for v in rng.integers(0, 4, 260)] + [1] * 30
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels, strict=True))]
    got = pca_tiles.near_duplicates(make_vectors(spark, rows + ODD_VECTORS)).toPandas().set_index("vec_id")
    assert len(got) == 290 + len(ODD_VECTORS)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = y @ y.T >= 0.93
    root = list(range(290))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * 290
    for i in range(290):
        for j in range(290):
            if i != j and labels[i] is not None and labels[i] == labels[j] and near[i, j]:
                links[i] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert [got.n_links[i] for i in range(290)] == links
    assert [got.component_id[i] for i in range(290)] == [find(i) for i in range(290)]
    assert all(got.n_links[i] == 0 and got.kept[i] for i, _, _ in ODD_VECTORS)
    assert pca_tiles.near_duplicates(make_vectors(spark, [])).count() == 0


def plain_links(rows):
    """{place: (n_links, component)} of (id, vector, label) by all pairs."""
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x, lx) in enumerate(rows):
        for j, (_, y, ly) in enumerate(rows[:i]):
            if lx is not None and lx == ly and len(x) == len(y) and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        least[find(i)] = min(vec_id, least.get(find(i), vec_id))
    return sorted((vec_id, links[i], least[find(i)]) for i, (vec_id, _, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["double", "date", "boolean", "decimal(9, 2)", "string"])
def test_repeated_ids_many_dimensions_and_any_label(spark, kind):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(160):
        dim = 2 + i % 70
        x = np.ones(dim) + rng.normal(size=dim) * 0.4
        rows.append((i % 90, x.tolist(), [0, 1, None][i % 3] if i % 5 else 0))
    rows += [(5, rows[0][1], 0), (5, rows[0][1], 1), (5, rows[0][1], 1), (3, rows[4][1], 1)]
    label = {"double": "cast(label AS double)", "date": "date_add(date'2020-01-01', label)", "boolean": "label = 1", "decimal(9, 2)": "cast(label AS decimal(9, 2))", "string": "cast(label AS string)"}[kind]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, label int, node int, kept int")
    got = pca_tiles.near_duplicates(df.withColumn("label", F.expr(label))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def bilingual(n, seed):
    rng = random.Random(seed)
    stock = {"en": ["the", "of", "and", "river", "stone"], "de": ["der", "und", "von", "fluss", "stein"]}
    rows = []
    for i in range(n):
        lang = "en" if i % 4 else "de"
        rows.append((i, " ".join(rng.choices(stock[lang], k=rng.randint(5, 60))), lang, "s", None, 0.0, "r"))
    return rows


def test_mixing_meets_targets_and_rates_are_nonnegative(spark):
    docs = spark.createDataFrame(bilingual(800, 1), "doc_id bigint, text string, lang string, source string, n_chars bigint, rate double, copies string")
    labels = labels_of(spark, [(i, 1, 0) for i in range(0, 800, 2)])
    out = mixing.mix(docs, labels, {"en": 1.0, "de": 1.0}).toPandas()
    total = out.tokens.sum()
    for lang in ("en", "de"):
        assert abs((out.tokens * out.rate * out[f"p_{lang}"]).sum() / total - 0.5) < 2e-3
    assert (out.rate >= 0).all() and np.allclose(out.p_en + out.p_de, 1)
    assert ((out.copies == np.floor(out.rate)) | (out.copies == np.ceil(out.rate))).all()
    assert abs((out.tokens * out.copies * out.p_de).sum() / total - 0.5) < 0.08


def test_rates_solve_the_least_squares_problem(spark):
    """Targets out of reach: the solution sits on the border, as a plain projected gradient finds it."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 50)
    tokens = rng.integers(1, 50, 50)
    table = spark.createDataFrame([(int(t), v.tolist()) for t, v in zip(tokens, p, strict=True)], "tokens bigint, p array<double>")
    residuals, step = mixing.fit_rates(table, [0.9, 0.05, 0.05])
    got = np.array([r.rate for r in table.withColumn("rate", mixing.rate_of(residuals, step)).collect()])
    want, w = np.ones(50), tokens / tokens.sum()
    for _ in range(len(residuals)):
        want = np.maximum(0, want - step * p @ ((w * want) @ p - [0.9, 0.05, 0.05]))
    assert np.allclose(got, want)
    best = want.copy()
    for _ in range(20_000):
        best = np.maximum(0, best - step * p @ ((w * best) @ p - [0.9, 0.05, 0.05]))
    loss = [np.square((w * r) @ p - [0.9, 0.05, 0.05]).sum() for r in (got, best, np.ones(50))]
    assert loss[0] <= loss[1] + 0.01 * loss[2]


def test_mixing_of_odd_rows(spark):
    out = mixing.mix(edge_docs(spark), labels_of(spark, [])).collect()
    assert len(out) == len(ODD) + 2 and all(abs(sum(r[f"p_{d}"] for d in mixing.TARGETS) - 1) < 1e-9 for r in out)
    assert mixing.mix(make(spark, []), labels_of(spark, [])).count() == 0


def test_pipeline_stages_on_planted_rows(spark, tmp_path):
    import corpus_pipeline

    texts = prose(240, seed=11, words=120)
    for i in range(0, 240, 8):
        texts[i] = texts[i].replace(" ", " zarquon ", 1)
    texts += [texts[1], texts[2].replace(" ", " other ", 1), "@@## %% $$ ZZQX!! " * 20, None, ""]
    docs = make(spark, texts).withColumn("lang", F.lit("en"))
    labels = labels_of(spark, [(i, 1, int(i % 8 == 0)) for i in range(240)] + [(242, 0, 0)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows, kept = docs, {}
    for name, apply in corpus_pipeline.STAGES:
        assert apply(spark, rows.limit(0), str(tmp_path)).count() == 0
        rows = corpus_pipeline.stage(apply(spark, rows, str(tmp_path)), name)
        kept[name] = {r.doc_id for r in rows.select("doc_id").collect()}
        assert name == "encode" or rows.columns == docs.columns
    assert not kept["toxicity"] & set(range(0, 240, 8)) and set(range(1, 8)) <= kept["toxicity"]
    assert 242 not in kept["quality"] and len(kept["toxicity"] - kept["quality"]) <= 6
    assert not {240, 241} & kept["near_duplicates"] and {1, 2} <= kept["near_duplicates"]
    assert len({243, 244} & kept["near_duplicates"]) == 1
    assert kept["mix"] == kept["encode"]
