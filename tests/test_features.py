import pytest
from pyspark.errors import PySparkException

from tests.conftest import by_key, oid, one
from tidemark.operators import characters, collection, items
from tidemark.operators.block import BOTH, CHURN, TASTE
from tidemark.operators.characters import character_owners
from tidemark.operators.sample import churn_labels, derive_sample, run_context
from tidemark.plans import master as plans
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables

USERS = "_id string, created_at string, last_login_date double, country string"
DAY = 86400
REF = 1775260800  # 2026-04-04
CUT = 1767484800  # 2026-01-04


def users(*rows):
    return [(oid(i), created, None if login is None else float(login), "ES") for i, created, login in rows], USERS


TWO = users((1, "2025-12-01T00:00:00Z", CUT - DAY), (2, "2025-12-01T12:00:00Z", REF + 3600.0))


def sample_of(t, ctx):
    return derive_sample(t.users, ctx)


def test_reference_date_and_sample(tables):
    t = tables(users=users(
        (1, "2025-12-01T00:00:00Z", CUT - DAY), (2, "2025-12-02T12:00:00Z", REF + 3600.0),
        (3, "bad", None), (4, "2026-02-01", REF * 1.0),
    ))
    ctx = run_context(t.users)
    assert str(ctx.reference_date) == "2026-04-04" and str(ctx.cutoff_date) == "2026-01-04"
    got = by_key(sample_of(t, ctx))
    assert got[oid(1)]["player_lifespan_days"] == 33 and got[oid(1)]["days_since_last_login"] == 1
    # 32.5 days up to the cutoff round half to even
    assert got[oid(2)]["player_lifespan_days"] == 32 and got[oid(2)]["days_since_last_login"] == 0
    assert got[oid(3)]["player_lifespan_days"] is None and got[oid(3)]["has_corrupted_dates"]
    assert got[oid(3)]["days_since_last_login"] is None
    assert got[oid(4)]["has_corrupted_dates"] and got[oid(4)]["player_lifespan_days"] < 0


def test_labels(tables, ctx):
    t = tables(users=users(
        (1, None, CUT * 1.0), (2, None, CUT + 7.0 * DAY), (3, None, CUT + 8.0 * DAY),
        (4, None, CUT + 31.0 * DAY), (5, None, None),
    ))
    got = by_key(churn_labels(t.users, ctx))
    assert [got[oid(i)]["churn_7d"] for i in range(1, 6)] == [1, 1, 0, 0, None]
    assert [got[oid(i)]["churn_30d"] for i in range(1, 6)] == [1, 1, 1, 0, None]


CHARS = ("_id string, user_id string, class int, level double, experience double, "
         "arena_category double, medals double, created_at string, updated_at string, is_npc boolean, "
         "is_customized string, helmEqObj string, hairIcon double, total_talent_points double, "
         "spent_talent_points double, c_total_critical_chance double")


def char(i, user, klass, level, exp, created="2025-12-01", **kw):
    base = dict(arena=None, medals=None, updated="2025-12-05", npc=None, custom=None, helm=None,
                hair=None, talent=10.0, spent=5.0, crit=None) | kw
    return (oid(i), f"ObjectId('{oid(user)}')", klass, level, exp, base["arena"], base["medals"], created,
            base["updated"], base["npc"], base["custom"], base["helm"], base["hair"], base["talent"],
            base["spent"], base["crit"])


def test_characters(tables, ctx):
    rows = [
        char(12, 1, 2, 10.0, 50.0, crit=3.9, helm="x", hair=2.0, arena=0.0),
        char(11, 1, 1, 10.0, 50.0, talent=0.0, custom="Yes"),  # full tie: smaller id is the main one
        char(13, 1, 0, None, 99.0, medals=7.0, created="2025-11-01"),
        char(14, 1, 3, 99.0, 1.0, created="2026-02-01", arena=2.0),  # after the cutoff
        char(15, 1, 3, 99.0, 1.0, npc=True),
        char(16, 2, None, 5.0, float("nan")),
    ]
    t = tables(users=TWO, characters=(rows, CHARS))
    got = by_key(plans.features("characters", sample_of(t, ctx), t, ctx, part=BOTH))
    a, b = got[oid(1)], got[oid(2)]
    assert a["char_count"] == 3 and a["char_classes_unique"] == 3 and a["char_has_multiple"] == 1
    assert a["char_class_main"] == 1 and a["char_level_max"] == 10.0 and a["char_talent_pct_spent"] == 0.0
    assert a["char_equip_slots_filled_max"] == 0 and a["char_is_customized"] == 1
    assert a["char_level_mean"] == 10.0 and a["char_medals_max"] == 7.0
    assert a["char_has_arena"] == 1 and a["char_arena_category_max"] == 0.0
    assert a["char_first_created_days_ago"] == 64 and a["char_last_updated_days_ago"] == 30
    # the shares look at every character that is no NPC, whenever it was created
    assert a["pct_chars_arena_active"] == 0.25 and a["pct_chars_high_level"] == 0.25
    assert b["char_class_main"] == 0 and b["char_experience_max"] == 0.0
    assert b["char_talent_pct_spent"] == 0.5 and b["char_critical_chance_max"] == 0


def test_main_character_equipment(tables, ctx):
    t = tables(users=TWO, characters=([char(1, 1, 2, 3.0, 1.0, helm="x", hair=2.0, crit=3.9)], CHARS))
    got = by_key(plans.features("characters", sample_of(t, ctx), t, ctx, part=CHURN))
    assert got[oid(1)]["char_equip_slots_filled_max"] == 1 and got[oid(1)]["char_cosmetic_score"] == 1
    assert got[oid(1)]["char_critical_chance_max"] == 3
    empty = got[oid(2)]
    assert empty["char_count"] == 0 and empty["char_level_mean"] == 0.0
    assert empty["char_first_created_days_ago"] is None


def test_device_platform_tie_is_alphabetical(tables, ctx):
    schema = "user_id string, platform string, device_model string, created_at string, updated_at string"
    rows = [(oid(1), p, m, "2025-12-01", u) for p, m, u in (
        ("ios", "a", "2026-03-01"), ("android", "a", None), (None, "b", None), (None, None, None),
        (None, "c", None))]
    t = tables(users=TWO, devices=(rows, schema))
    got = by_key(plans.features("devices", sample_of(t, ctx), t, ctx))
    a, b = got[oid(1)], got[oid(2)]
    assert a["device_primary_platform"] == "android" and a["device_records_total"] == 5
    assert a["device_platform_count"] == 2 and a["device_unique_models"] == 3
    assert a["device_is_multi_platform"] == 1 and a["device_days_since_last_active"] == 0
    assert b["device_primary_platform"] == "none" and b["device_days_since_last_active"] == 9999


def test_purchases(tables, ctx):
    cons = [(oid(1), "gems_1", CUT - 10.0 * DAY), (oid(1), "gems_1", CUT - 100.0 * DAY),
            (oid(1), "sword", CUT + 5.0 * DAY)]
    subs = [(oid(2), "subs_3_months", CUT - 100.0 * DAY, CUT - 0.5 * DAY, 1.0),
            (oid(2), "subs_monthly", CUT - 200.0 * DAY, None, None)]
    t = tables(
        users=TWO,
        iaps_consumables=(cons, "user_id string, product_id string, purchase_time double"),
        iaps_subscriptions=(subs, "user_id string, product_id string, purchase_time double, "
                                  "end_date double, is_trial double"),
    )
    got = by_key(plans.features("purchases", sample_of(t, ctx), t, ctx, part=BOTH))
    a, b = got[oid(1)], got[oid(2)]
    assert a["iap_consumables_count"] == 2 and a["iap_consumables_unique_products"] == 1
    assert a["iap_gems_packs_count"] == 2 and a["iap_consumables_days_since_last"] == 10
    assert a["iap_is_payer"] == a["iap_is_current_payer"] == a["iap_paid_last_30d"] == 1
    assert a["iap_days_since_subscription_end"] == 9999 and a["iap_n_distinct_products"] == 2
    assert a["iap_paid_last_90d_at_ref"] == 1 and b["iap_paid_last_90d_at_ref"] == 0
    assert b["iap_days_since_subscription_end"] == 1 and b["iap_is_subscription_active"] == 0
    assert b["iap_subscription_active_last_7d"] == 1 and b["iap_trial_only"] == 1
    assert b["iap_has_quarterly"] == b["iap_has_monthly"] == 1 and b["iap_has_annual"] == 0
    assert b["iap_is_payer"] == 1 and b["iap_is_current_payer"] == 0 and b["iap_paid_last_90d"] == 0
    only = by_key(plans.features("purchases", sample_of(t, ctx), t, ctx, part=CHURN))
    assert all(only[k][c] == got[k][c] for k in got for c in only[k])


def test_rewards_latest_row(tables, ctx):
    schema = ("_id string, user_id string, created_at string, updated_at string, set int, current_day int, "
              "sets_completed int, last_claimed_reward_day int, last_claimed_reward_time double, "
              "last_claimed_premium_reward_day int, last_claimed_ad_reward_day int")
    rows = [
        (oid(1), oid(1), "2025-12-01", None, 1, 0, 9, 9, 0.0, 9, 9),
        (oid(2), oid(1), "2025-12-02", "2025-12-03", 1, 8, 1, 3, CUT - 2.0 * DAY, 1, 3),
        (oid(3), oid(1), "2025-12-04", "2025-12-02", 1, 4, 2, 0, None, 0, 0),
        (oid(4), oid(2), "2026-03-01", None, 1, 5, 0, 5, None, 0, 0),
    ]
    t = tables(users=TWO, daily_rewards=(rows, schema))
    got = by_key(plans.features("rewards", sample_of(t, ctx), t, ctx, part=BOTH))
    a, b = got[oid(1)], got[oid(2)]
    assert a["reward_records_total"] == 3.0 and a["reward_claim_rate"] == 1.0
    assert a["reward_premium_days_max"] == 9.0 and a["reward_last_claim_days_ago"] == 2
    assert a["reward_pct_premium_track"] == 0.25 and a["claim_consistency_60d"] == pytest.approx(33 / 60)
    assert a["reward_register_age_days"] == 123
    # no row before the cutoff: zeros, but the latest state counts; premium + ad = 0 has no share
    assert b["reward_records_total"] == 0.0 and b["reward_first_created_days_ago"] is None
    assert b["reward_pct_premium_track"] is None and b["claim_consistency_60d"] == pytest.approx(5 / 60)


def test_items_and_collection(tables, ctx):
    items = ("user_id string, item_definition_excel_id int, c_base_critical_chance double, "
             "c_base_attack_enhanced double, c_base_defense_enhanced double, enhance_level int, "
             "created_at string")
    rows = [(oid(1), 101, None, 10.0, 0.0, 1, "2025-12-01"), (oid(1), 101, 0.0, 20.0, None, 4, "2025-12-31"),
            (oid(1), 205, 0.5, 30.0, 0.0, 5, "2026-03-20"), (oid(1), 7, None, 1.0, 1.0, 0, None)]
    coll = [(oid(1), d, c) for _, d, _, _, _, _, c in rows] + [(oid(1), -7, "2025-12-31 12:00:00")]
    t = tables(users=TWO, user_items=(rows, items),
               user_items_collection=(coll, "user_id string, item_definition_excel_id int, created_at string"))
    s = sample_of(t, ctx)
    a = by_key(plans.features("items", s, t, ctx, part=BOTH))
    assert a[oid(1)]["items_total_instances"] == 2 and a[oid(1)]["items_redundancy_ratio"] == 2.0
    assert a[oid(1)]["items_attack_defense_ratio"] is None and a[oid(1)]["items_max_enhance_level"] == 4.0
    assert a[oid(1)]["pct_items_critical_build"] == 0.25 and a[oid(1)]["pct_items_high_enhance"] == 0.25
    assert a[oid(1)]["entropy_items_family"] == pytest.approx(1.5)
    assert a[oid(1)]["simpson_items_family"] == pytest.approx(1 - (0.25 + 2 / 16))
    assert a[oid(1)]["items_creation_velocity_30d"] == 1
    assert a[oid(2)]["items_days_since_last_item"] == 9999 and a[oid(2)]["items_mean_attack"] is None
    assert a[oid(2)]["pct_items_critical_build"] is None and a[oid(2)]["items_creation_velocity_30d"] == 0
    c = by_key(plans.features("collection", s, t, ctx, part=BOTH))[oid(1)]
    assert c["coll_total_items"] == 3 and c["coll_unique_families"] == 2  # floor(-7 / 100) is -1
    assert c["coll_items_last_30d"] == 2 and c["coll_collection_span_days"] == 30
    assert c["coll_pct_recent_30d"] == 0.25 and c["coll_items_recent_90d"] == 1


def test_feedback_counts_bugs_as_negative(tables, ctx):
    rows = [(oid(1), k, "2026-01-01 12:00:00") for k in ("CRASHES", "DONT_LIKE", "LIKE", "PAY_TO_WIN", "??", None)]
    t = tables(users=TWO, support_feedback=(rows, "user_id string, feedback_type string, created_at string"))
    a = by_key(plans.features("feedback", sample_of(t, ctx), t, ctx))
    assert (a[oid(1)]["feedback_total"], a[oid(1)]["feedback_n_negative"], a[oid(1)]["feedback_n_positive"],
            a[oid(1)]["feedback_n_monetization"]) == (6, 2, 1, 1)
    assert a[oid(1)]["feedback_days_since_last"] == 2 and a[oid(2)]["feedback_days_since_last"] == 9999


CURRENCY = "user_id string, concept string, currency string, quantity double, created_at string"


def test_currency(tables, ctx):
    at = "2026-04-03T10:00:00Z"
    rows = [(f"ObjectId('{oid(1)}')", c, k, q, at) for c, k, q in (
        ("bought", "gold", 10.0), ("bought", "gold", 20.0), ("bought", "gems", 5.0),
        ("sold", "gold", -100.0), ("sold", "gems", -50.0))]
    rows += [(oid(1), "bought", "gold", 1.0, "2025-01-01T00:00:00Z"), ("nobody", "x", "y", 1.0, at),
             (oid(1), "late", "gold", 1.0, "2026-04-04T00:00:01Z"), (oid(1), "x", "gold", 1.0, "bad")]
    t = tables(users=TWO, currency_transactions=(rows, CURRENCY))
    got = by_key(plans.features("currency", sample_of(t, ctx), t, ctx, part=TASTE))
    a = got[oid(1)]
    h = 0.9709505944546686  # entropy of 3 : 2
    assert a["n_distinct_concepts_used"] == 2
    assert a["entropy_currency_concept"] == pytest.approx(h) and a["entropy_currency_type"] == pytest.approx(h)
    assert a["pct_days_active_currency_30d"] == pytest.approx(1 / 30) and a["weekend_pct_currency"] == 0.0
    assert a["currency_pct_inflow"] == 0.6 and a["currency_pct_outflow"] == 0.4
    assert a["binge_index_currency"] == 1.0 and a["gini_currency_concept"] == pytest.approx(0.1)
    assert all(v is None for c, v in got[oid(2)].items() if c != "user_id")


def test_currency_without_concepts(tables, ctx):
    rows = [(oid(1), None, None, None, "2026-03-28T10:00:00Z")]
    t = tables(users=TWO, currency_transactions=(rows, CURRENCY))
    a = by_key(plans.features("currency", sample_of(t, ctx), t, ctx, part=TASTE))[oid(1)]
    assert a["n_distinct_concepts_used"] == 0 and a["entropy_currency_concept"] is None
    assert a["weekend_pct_currency"] == 1.0 and a["currency_pct_inflow"] == 0.0


def test_fights_and_arena_follow_the_character(tables, ctx):
    chars = [char(11, 1, 1, 1.0, 1.0), char(12, 1, 1, 1.0, 1.0)]
    chars.append(("garbage", *chars[0][1:]))
    fights = [(f"ObjectId('{oid(11)}')", "FIGHT_TYPE_ARENA", 1.0, REF - 2.0 * DAY),
              (oid(12), "FIGHT_TYPE_ARENA", 0.0, REF - 2.0 * DAY), (oid(12), "X", None, REF - 3.0 * DAY),
              (oid(12), None, 1.0, REF - 3.0 * DAY), (oid(12), "X", 1.0, REF - 31.0 * DAY),
              (oid(99), "X", 1.0, REF - 1.0 * DAY)]
    arena = [(oid(11), REF - 1.0 * DAY), (oid(11), REF - 2.0 * DAY), ("garbage", REF - 2.0 * DAY)]
    t = tables(users=TWO, characters=(chars, CHARS),
               fights_log=(fights, "player_id string, fight_type string, fight_winner double, start_time double"),
               arena_log=(arena, "attacker_id string, time_attacked double"))
    s = sample_of(t, ctx)
    a = by_key(plans.features("fights", s, t, ctx, part=TASTE))
    assert a[oid(1)]["fights_pct_pvp"] == 0.5 and a[oid(1)]["fights_pct_won"] == 0.5
    assert a[oid(1)]["entropy_fights_type"] == pytest.approx(0.9182958340544896)
    assert a[oid(1)]["binge_index_fights"] == 1.0 and a[oid(2)]["fights_pct_pvp"] is None
    b = by_key(plans.features("arena", s, t, ctx, part=TASTE))
    assert (b[oid(1)]["is_arena_player"], b[oid(2)]["is_arena_player"]) == (1, 0)


def test_latest_owner_of_a_repeated_character(tables):
    rows = [char(1, 1, 1, 1.0, 1.0, created="2025-01-01"), char(1, 2, 1, 1.0, 1.0, created="2025-06-01")]
    t = tables(characters=(rows, CHARS))
    assert one(character_owners(t.characters)) == {"char_id": oid(1), "user_id": oid(2)}


def test_master_with_missing_tables(tables, ctx):
    t = tables(users=TWO, characters=([char(1, 1, 1, 1.0, 1.0)], CHARS))
    taste, churn = plans.taste_master(t, ctx), plans.churn_master(t, ctx)
    assert len(churn.columns) == 113 and len(taste.columns) == 145
    assert plans.churn_columns(taste.columns) == churn.columns
    got = by_key(taste)
    assert set(got) == {oid(1), oid(2)}
    assert got[oid(1)]["is_arena_player"] == 0 and got[oid(1)]["currency_pct_inflow"] is None
    assert got[oid(2)]["items_days_since_last_item"] == 9999
    own = derive_sample(t.users, ctx).limit(1)
    assert plans.churn_master(t, ctx, sample=own).count() == 1


def test_duplicate_players_fail(spark, ctx):
    rows, schema = users((1, "2025-12-01", CUT * 1.0), (1, "2025-12-02", CUT * 1.0))
    t = Tables(spark, {"users": spark.createDataFrame(rows, schema)})
    with pytest.raises(PySparkException, match="duplicate player id"):
        plans.churn_master(t, ctx).collect()


def test_one_player_owns_a_third_of_the_rows(tables, ctx, spark):
    """A hot player, checked against plain counting; and nothing is keyed by the player alone first."""
    import math
    from collections import Counter

    schema = "user_id string, item_definition_excel_id int, enhance_level int, created_at string"
    rows = [(oid(1), i * i % 301, i % 7, "2025-12-01") for i in range(1500)]
    rows += [(oid(2 + i % 900), i % 11, i % 3, "2025-12-02") for i in range(3000)]
    t = tables(users=TWO, user_items=(rows, schema))
    got = by_key(plans.features("items", sample_of(t, ctx), t, ctx, part=BOTH))
    for user in (1, 2):
        mine = [r for r in rows if r[0] == oid(user)]
        counts, n = Counter(r[1] for r in mine), len(mine)
        row = got[oid(user)]
        assert row["items_total_instances"] == n and row["items_unique_definitions"] == len(counts)
        assert row["entropy_items_family"] == pytest.approx(
            -sum(c / n * math.log2(c / n) for c in counts.values()))
        assert row["simpson_items_family"] == pytest.approx(1 - sum((c / n) ** 2 for c in counts.values()))
        assert row["items_total_enhance_invested"] == sum(r[2] for r in mine)
    built = plans.ALL_BLOCKS["items"].build(t, ctx, plans.RuleBook(), BOTH)
    plan = built._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "item_definition_excel_id" in exchanges[-1] and "partial_" in plan


def test_wide_rollups_send_their_rows_once(tables, ctx):
    """Items and collections are dealt as rows, not as rollups of one row each; characters travel in one exchange."""
    at = "2025-06-01 00:00:00"
    t = tables(
        user_items=([(oid(1), i % 7, at) for i in range(20)], "user_id string, item_definition_excel_id int, created_at string"),
        user_items_collection=([(oid(1), i * 50, at) for i in range(20)], "user_id string, item_definition_excel_id int, created_at string"),
        characters=([(oid(i), oid(1), i % 3, at) for i in range(5)], "_id string, user_id string, class int, created_at string"),
    )
    built = {b.name: b.build(t, ctx, RuleBook(), CHURN) for b in (items.BLOCK, collection.BLOCK, characters.BLOCK)}
    for name, df in built.items():
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        dealt = [x for x in lines if "Exchange hashpartitioning" in x]
        assert len(dealt) == (1 if name == "characters" else 2), name
        if name != "characters":
            below = lines[max(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x):]
            assert not any("Aggregate" in x for x in below), name
    assert one(built["items"])["items_unique_definitions"] == 7
    assert one(built["collection"])["coll_unique_families"] == 10
    assert one(built["characters"])["char_classes_unique"] == 3
