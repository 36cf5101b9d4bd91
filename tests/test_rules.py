import pytest
from pyspark.sql import functions as F

from tests.conftest import by_key
from tidemark import rules as R
from tidemark.operators.dictionary import action_dim, archetype_dim, axis_dim, dictionary, source_dim
from tidemark.operators.reconcile import reconcile
from tidemark.operators.report import without_archetypes
from tidemark.operators.segment import archetype_name, cross, priority, risk_level, segmentation
from tidemark.operators.taste import RECENT_FEATURES, UNIVERSAL_FEATURES, taste_profile
from tidemark.rules import RuleBook
from tidemark.sources.readers import oof_scores

BOOK = RuleBook()
LIVE = "user_id string, churn_prob_7d double, churn_prob_14d double, churn_prob_30d double, source string"
OOF = "user_id string, p_churn_7d double, p_churn_14d double, p_churn_30d double, split string"


@pytest.mark.parametrize("live,oof,source,final", [
    (0.55, 0.50, "oof_stable", 0.50), (0.30, 0.70, "live_drift", 0.30), (0.85, None, "live_new", 0.85),
    (0.60, 0.50, "oof_stable", 0.50), (0.80, 0.70, "live_drift", 0.80),
])
def test_drift(spark, live, oof, source, final):
    scores = spark.createDataFrame([("a", live, 0.2, 0.9, "live_model")], LIVE)
    stored = spark.createDataFrame([("a", oof, 0.18, 0.2, "x")], OOF)
    row = by_key(reconcile(scores, oof_scores(spark, stored)))["a"]
    assert (row["churn_7d_source"], row["churn_7d_final"]) == (source, final)
    assert row["churn_14d_source"] == "oof_stable" and row["churn_14d_final"] == 0.18
    assert row["churn_30d_source"] == "live_drift" and row["churn_30d_final"] == 0.9


def test_drift_without_stored_table_and_with_old_names(spark):
    scores = spark.createDataFrame([("a", 0.1, 0.2, 0.3, "m")], LIVE)
    row = by_key(reconcile(scores, oof_scores(spark, None)))["a"]
    assert row["churn_7d_oof"] is None and row["churn_7d_source"] == "live_new"
    old = spark.createDataFrame([("a", 0.15, float("nan"))], "user_id string, prob_churn_7d_oof double, prob_churn_14d_oof double")
    row = by_key(reconcile(scores, oof_scores(spark, old)))["a"]
    assert row["churn_7d_source"] == "oof_stable" and row["churn_14d_source"] == "live_new"
    assert row["churn_30d_oof"] is None


@pytest.mark.parametrize("p,band", [
    (0.0, "very_low"), (0.19, "very_low"), (0.2, "low"), (0.4, "medium"), (0.65, "high"),
    (0.85, "critical"), (1.0, "critical"), (None, "very_low"), (1.2, "very_low"),
])
def test_risk_bands(spark, p, band):
    df = spark.createDataFrame([(p,)], "p double").select(risk_level(F.col("p"), BOOK).alias("r"))
    assert df.first()["r"] == band


@pytest.mark.parametrize("risk,code,expected", [
    ("critical", 2, "P0"), ("critical", 4, "P3"), ("high", 5, "P1"), ("critical", 0, "P1"), ("high", 0, "P1"),
    ("high", 4, "P4"), ("medium", 4, "P2"), ("low", 1, "P4"), ("critical", None, "P4"), ("medium", None, "P2"),
])
def test_priorities(spark, risk, code, expected):
    df = spark.createDataFrame([(risk, code)], "r string, c int")
    assert df.select(priority(F.col("r"), F.col("c"), BOOK).alias("p")).first()["p"]["priority"] == expected


def test_crossing_is_an_inner_join(spark):
    scores = spark.createDataFrame([("a", 0.1, 0.2, 0.9, "m"), ("b", 0.1, 0.2, 0.3, "m")], LIVE)
    codes = spark.createDataFrame([("a", 9), ("c", 1)], "user_id string, archetype_n1 int")
    rows = by_key(segmentation(cross(scores, codes, BOOK)))
    assert list(rows) == ["a"] and rows["a"]["segment"] == "Unknown" and rows["a"]["priority"] == "P4"
    names = spark.createDataFrame([(None,), (2,), (77,)], "c int").select(archetype_name(F.col("c"), BOOK).alias("n"))
    assert [r["n"] for r in names.collect()] == ["N/A", "Hardcore End-Game", "Unknown"]


NEUTRAL = dict(
    char_class_main=0, items_attack_defense_ratio=1.10, iap_trial_only=0, iap_is_payer=0, reward_has_ad=0.0,
    items_max_enhance_level=1.0, pct_items_high_enhance=0.0, items_redundancy_ratio=1.0, coll_total_items=10,
    fights_pct_pvp=None, fights_pct_won=None, currency_pct_inflow=None, currency_pct_outflow=None,
)
FEATURES = ("user_id string, char_class_main int, items_attack_defense_ratio double, iap_trial_only int, "
            "iap_is_payer int, reward_has_ad double, items_max_enhance_level double, "
            "pct_items_high_enhance double, items_redundancy_ratio double, coll_total_items int, "
            "fights_pct_pvp double, fights_pct_won double, currency_pct_inflow double, currency_pct_outflow double")
PLAYERS = [
    (2, dict(iap_trial_only=1, iap_is_payer=1), "CM03"), (2, dict(iap_is_payer=1), "CM01"),
    (1, dict(iap_is_payer=1), "CM02"), (None, dict(iap_is_payer=1), "CM02"),
    (4, dict(currency_pct_inflow=0.92, currency_pct_outflow=0.05), "CM10"),
    (1, dict(fights_pct_pvp=0.5, fights_pct_won=0.1), "CM11"), (0, dict(items_max_enhance_level=5.0), "CM12"),
    (5, {}, "CM04"), (1, dict(coll_total_items=100), "CM06"), (4, dict(items_max_enhance_level=5.0), "CM05"),
    (1, dict(items_attack_defense_ratio=1.30), "CM07"), (1, dict(reward_has_ad=1.0), "CM08"), (4, {}, "CM09"),
    (1, {}, "CM04"), (None, {}, "CM04"),
    (4, dict(items_attack_defense_ratio=None, items_max_enhance_level=None, pct_items_high_enhance=0.5), "CM05"),
]


def profile(spark, players, book=BOOK):
    rows = [(str(i), *(NEUTRAL | change).values()) for i, (_, change, _) in enumerate(players)]
    codes = [(str(i), code) for i, (code, _, _) in enumerate(players)]
    return by_key(taste_profile(
        spark.createDataFrame(rows, FEATURES), spark.createDataFrame(codes, "user_id string, archetype_n1 int"), book))


def test_one_player_per_action(spark):
    got = profile(spark, PLAYERS)
    assert [got[str(i)]["contramedida_primaria_cod"] for i in range(len(PLAYERS))] == [p[2] for p in PLAYERS]
    assert all(got[k]["contramedida_primaria_label"] == R.ACTIONS[got[k]["contramedida_primaria_cod"]] for k in got)
    assert got["4"]["perfil_oro"] == "acumulador" and got["4"]["pvp_perfil"] == "pve_focus"
    assert got["7"]["perfil_oro"] == got["7"]["pvp_perfil"] == "null" and got["7"]["has_tier2"] == 0
    assert got["15"]["estilo_build"] == "equilibrado"
    for row in got.values():
        assert all(row[axis] in values for axis, (_, values) in R.AXES.items())


def test_configured_order_and_unknown_codes(spark):
    book = RuleBook(action_order=("CM99", "CM09"), action_fallback="CM77")
    got = profile(spark, [(4, {}, ""), (1, {}, "")], book)
    assert got["0"]["contramedida_primaria_cod"] == "CM09"
    assert got["1"]["contramedida_primaria_cod"] == "CM77"
    assert got["1"]["contramedida_primaria_label"] == "desconocida"


def test_thresholds_are_inclusive(spark):
    t = BOOK.thresholds
    got = profile(spark, [(1, dict(items_attack_defense_ratio=x), "") for x in (t.build_t67, t.build_t33)])
    assert got["0"]["estilo_build"] == "agresivo" and got["1"]["estilo_build"] == "tanque"


def test_taste_without_log_columns(spark):
    df = spark.createDataFrame([("a", *NEUTRAL.values())], FEATURES).drop(*RECENT_FEATURES)
    codes = spark.createDataFrame([("a", 4)], "user_id string, archetype_n1 int")
    row = by_key(taste_profile(df, codes, BOOK))["a"]
    assert row["has_tier2"] == 0 and row["perfil_oro"] == "null"
    assert len(UNIVERSAL_FEATURES) == 9


def test_dictionary(spark):
    doc = dictionary(BOOK, "v1")
    assert sorted(doc["countermeasures"]) == [f"CM{i:02d}" for i in range(1, 13)]
    assert sorted(c["prioridad"] for c in doc["countermeasures"].values()) == list(range(1, 13))
    assert len(doc["archetype_n1"]) == 6 and len(doc["ejes_gusto"]) == 7 and len(doc["source_codes"]) == 3
    assert set(R.ACTION_ORDER) == set(R.ACTIONS) and R.ACTION_FALLBACK in R.ACTIONS
    assert action_dim(spark, BOOK).count() == 12 and archetype_dim(spark, BOOK).count() == 6
    assert axis_dim(spark).count() == 7 and source_dim(spark).count() == 3
    assert len(R.CHURN_FEATURES) == 62 and len(R.ARCHETYPE_FEATURES) == 78
    assert sum(len(v) for v in R.FEEDBACK_CATEGORIES.values()) == 25


def test_a_missing_live_score_is_unknown(spark):
    live = spark.createDataFrame([("a", None), ("b", 0.4), ("c", None)], "user_id string, churn_prob_7d double")
    stored = spark.createDataFrame([("a", 0.5), ("b", 0.45)], "user_id string, churn_prob_7d_oof double")
    rows = by_key(reconcile(live, stored, targets=["churn_7d"]))
    assert {k: r["churn_7d_source"] for k, r in rows.items()} == {"a": "unknown", "b": "oof_stable", "c": "live_new"}
    assert rows["a"]["churn_7d_final"] is None and rows["b"]["churn_7d_final"] == 0.45


@pytest.mark.parametrize("targets", [["churn_30d"], ["churn_7d", "churn_30d"]])
def test_outputs_carry_the_targets_of_the_model(spark, targets):
    live = spark.createDataFrame([("a", 0.1, 0.2)], "user_id string, churn_prob_7d double, churn_prob_30d double")
    stored = spark.createDataFrame([], "user_id string, churn_prob_7d_oof double, churn_prob_30d_oof double")
    out = without_archetypes(reconcile(live, stored, targets=targets), targets)
    assert out.count() == 1 and [c for c in out.columns if c.endswith("_final")] == [f"{t}_final" for t in targets]
