"""Feature blocks in SQL, one row per customer each. FEATURES[name] = (needs, select, doubles)."""

from __future__ import annotations

from oracle.tables import days, days_ago, days_since, half_even, rounded_days, uid, whole_days

ID = uid("u.c_custkey") + " AS user_id"

USERS = f"""SELECT {uid('c')} AS user_id, country, lower(substr(c_mktsegment, 1, 2)) AS language,
  c % 2 = 0 AS is_google_play, c % 4 <> 0 AS tutorial_done,
  CASE WHEN c % 5 <> 0 THEN c % 5 = 1 END AS has_user_rated_app,
  CASE WHEN c_acctbal >= 0 THEN CASE WHEN c % 2 = 0 THEN 'pve' ELSE 'pvp' END END AS focus,
  {uid('c + 1')} AS user_current_character,
  CASE WHEN c % 25 = 0 THEN (c % 9)::DOUBLE END AS user_current_session, 0.0::DOUBLE AS user_dark_steel,
  c_acctbal AS user_gold, floor(c_acctbal / 100)::DOUBLE AS user_gems, (c % 50)::DOUBLE AS user_runes,
  '1.' || (c % 3) AS user_game_version, (c % 12)::DOUBLE AS user_last_completed_tutorial_block,
  n_orders::DOUBLE AS user_num_logins, c_mktsegment AS user_store_where_published,
  TRUE AS user_template_item_stats_augment_update_done,
  strftime(created, '%Y-%m-%d %H:%M:%S') AS user_created_at,
  strftime(login, '%Y-%m-%d %H:%M:%S') AS user_updated_at,
  (epoch_us(login) / 1e6)::DOUBLE AS user_last_login_date,
  {days_ago('created', 'cut')} AS user_created_at_days_ago,
  {days_ago('login', 'cut')} AS user_last_login_days_ago
FROM users, tm"""

CHARS = f"""SELECT {ID},
  coalesce(n, 0) AS char_count, coalesce(classes, 0) AS char_classes_unique,
  coalesce(level_mean, 0.0) AS char_level_mean, coalesce(exp_mean, 0.0) AS char_experience_mean,
  (coalesce(n, 0) > 1)::INT AS char_has_multiple, coalesce(m.class, 0) AS char_class_main,
  coalesce(m.level, 0)::DOUBLE AS char_level_max, coalesce(m.experience, 0.0) AS char_experience_max,
  coalesce(m.attack, 0)::DOUBLE AS char_attack_max, coalesce(m.defense, 0)::DOUBLE AS char_defense_max,
  coalesce(m.attack + m.defense, 0)::DOUBLE AS char_attack_defense_sum_max,
  coalesce(trunc(m.critical), 0)::BIGINT AS char_critical_chance_max,
  coalesce(m.talent, 0)::DOUBLE AS char_talent_total_max,
  coalesce(m.spent, 0)::DOUBLE AS char_talent_spent_max,
  coalesce(m.slots, 0)::INT AS char_equip_slots_filled_max,
  coalesce(m.looks, 0)::INT AS char_cosmetic_score,
  coalesce({half_even('m.spent::DOUBLE / nullif(m.talent, 0)', 2)}, 0.0) AS char_talent_pct_spent,
  coalesce(arena_max, 0)::DOUBLE AS char_arena_category_max,
  coalesce(medals_max, 0)::DOUBLE AS char_medals_max, coalesce(has_arena, 0) AS char_has_arena,
  coalesce(a.custom, 0) AS char_is_customized,
  {days_ago('first_created', 'cut')} AS char_first_created_days_ago,
  {days_ago('last_updated', 'cut')} AS char_last_updated_days_ago
FROM customer u CROSS JOIN tm
LEFT JOIN (SELECT c, count(*) AS n, count(DISTINCT class) AS classes, avg(level) AS level_mean,
    avg(experience) AS exp_mean, max(arena) AS arena_max, max(medals) AS medals_max,
    (count(arena) > 0)::INT AS has_arena, max(coalesce(custom, FALSE)::INT) AS custom,
    min(created) AS first_created, max(updated) AS last_updated
  FROM chars, tm WHERE created <= cut GROUP BY c) a ON a.c = u.c_custkey
LEFT JOIN (SELECT chars.* FROM chars, tm WHERE created <= cut QUALIFY row_number() OVER (
    PARTITION BY c ORDER BY level DESC NULLS LAST, experience DESC NULLS LAST, k) = 1) m
  ON m.c = u.c_custkey"""

DEVICES = f"""SELECT {ID}, coalesce(n, 0) AS device_records_total, coalesce(models, 0) AS device_unique_models,
  coalesce(platforms, 0) AS device_platform_count, coalesce(droid, 0) AS device_has_android,
  coalesce(ios, 0) AS device_has_ios, (coalesce(droid, 0) + coalesce(ios, 0) = 2)::INT
    AS device_is_multi_platform, coalesce(p.platform, 'none') AS device_primary_platform,
  {days_ago('first_seen', 'cut')} AS device_first_seen_days_ago,
  {days_since('last_active', 'cut')} AS device_days_since_last_active
FROM customer u CROSS JOIN tm
LEFT JOIN (SELECT c, count(*) AS n, count(DISTINCT model) AS models,
    count(DISTINCT platform) AS platforms, max((coalesce(platform, '') = 'android')::INT) AS droid,
    max((coalesce(platform, '') = 'ios')::INT) AS ios, min(created) AS first_seen,
    max(CASE WHEN updated > cut THEN cut ELSE updated END) AS last_active
  FROM devices, tm WHERE created <= cut GROUP BY c) a ON a.c = u.c_custkey
LEFT JOIN (SELECT c, platform FROM devices, tm WHERE created <= cut AND platform IS NOT NULL
  GROUP BY c, platform
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, platform) = 1) p
  ON p.c = u.c_custkey"""

IAPS = f"""SELECT {ID},
  (nc > 0 OR ns > 0)::INT AS iap_is_payer,
  (coalesce(s_end >= cut, FALSE) OR coalesce(c_last >= cut - INTERVAL 30 DAY, FALSE))::INT
    AS iap_is_current_payer,
  coalesce(greatest(c_last, s_last) >= cut - INTERVAL 30 DAY, FALSE)::INT AS iap_paid_last_30d,
  coalesce(greatest(c_last, s_last) >= cut - INTERVAL 90 DAY, FALSE)::INT AS iap_paid_last_90d,
  nc AS iap_consumables_count, coalesce(c_kinds, 0) AS iap_consumables_unique_products,
  (nc > 0)::INT AS iap_has_consumables, coalesce(gems, 0) AS iap_gems_packs_count,
  {days_since('c_last', 'cut')} AS iap_consumables_days_since_last,
  ns AS iap_subscriptions_count, (ns > 0)::INT AS iap_has_subscription_ever,
  coalesce(m1, 0) AS iap_has_monthly, coalesce(m3, 0) AS iap_has_quarterly,
  coalesce(m12, 0) AS iap_has_annual, coalesce(s_end >= cut, FALSE)::INT AS iap_is_subscription_active,
  coalesce(s_end >= cut - INTERVAL 7 DAY, FALSE)::INT AS iap_subscription_active_last_7d,
  CASE WHEN s_end IS NULL THEN 9999 WHEN s_end >= cut THEN 0
    ELSE greatest(1, trunc({days('s_end', 'cut')})::INT) END AS iap_days_since_subscription_end,
  coalesce(trial_mean = 1.0, FALSE)::INT AS iap_trial_only,
  {days_ago('c_first', 'cut')} AS iap_first_consumable_days_ago,
  {days_ago('s_first', 'cut')} AS iap_first_subscription_days_ago
FROM (SELECT u.c_custkey, tm.*, coalesce(a.n, 0) AS nc, coalesce(b.n, 0) AS ns, a.*, b.* FROM customer u CROSS JOIN tm
LEFT JOIN (SELECT c, count(*) AS n, count(DISTINCT product) AS c_kinds,
    count(*) FILTER (product LIKE 'gems%') AS gems, min(bought) AS c_first, max(bought) AS c_last
  FROM cons, tm WHERE bought <= cut GROUP BY c) a ON a.c = u.c_custkey
LEFT JOIN (SELECT c, count(*) AS n, max((product = 'subs_monthly')::INT) AS m1,
    max((product = 'subs_3_months')::INT) AS m3, max((product = 'subs_12_months')::INT) AS m12,
    max(ends) AS s_end, avg(trial) AS trial_mean, min(bought) AS s_first, max(bought) AS s_last
  FROM subs, tm WHERE bought <= cut GROUP BY c) b ON b.c = u.c_custkey) u"""

REWARDS = f"""SELECT {ID}, coalesce(n, 0)::DOUBLE AS reward_records_total,
  coalesce(sets_max, 0)::DOUBLE AS reward_sets_completed_max,
  coalesce(cur_max, 0)::DOUBLE AS reward_current_day_max,
  coalesce({half_even('least(1.0, greatest(0.0, claimed_max::DOUBLE / nullif(cur_max, 0)))', 2)}, 0.0)
    * CASE WHEN claimed_max IS NULL OR coalesce(cur_max, 0) = 0 THEN 0 ELSE 1 END AS reward_claim_rate,
  coalesce(has_prem, 0)::DOUBLE AS reward_has_premium, coalesce(has_ad, 0)::DOUBLE AS reward_has_ad,
  coalesce(prem_max, 0)::DOUBLE AS reward_premium_days_max,
  coalesce(ad_max, 0)::DOUBLE AS reward_ad_days_max,
  {days_ago('first_created', 'cut')} AS reward_first_created_days_ago,
  {days_ago('last_claim', 'cut')} AS reward_last_claim_days_ago
FROM customer u CROSS JOIN tm
LEFT JOIN (SELECT c, count(*) AS n, max(sets) AS sets_max, max(cur) AS cur_max,
    max(claimed) FILTER (claimed > 0) AS claimed_max, max((coalesce(prem, 0) > 0)::INT) AS has_prem,
    max((coalesce(ad, 0) > 0)::INT) AS has_ad, max(prem) FILTER (prem > 0) AS prem_max,
    max(ad) FILTER (ad > 0) AS ad_max, min(created) AS first_created, max(claim_time) AS last_claim
  FROM rewards, tm WHERE created <= cut GROUP BY c) a ON a.c = u.c_custkey"""

ITEMS = f"""SELECT {ID}, coalesce(n, 0) AS items_total_instances, coalesce(defs, 0) AS items_unique_definitions,
  enh_mean AS items_mean_enhance_level, enh_max::DOUBLE AS items_max_enhance_level,
  coalesce(enh_sum, 0)::BIGINT AS items_total_enhance_invested, atk AS items_mean_attack,
  dfn AS items_mean_defense, crit AS items_mean_critical,
  CASE WHEN dfn > 0 THEN atk / dfn END AS items_attack_defense_ratio,
  n::DOUBLE / defs AS items_redundancy_ratio,
  {days_since('last_item', 'cut')} AS items_days_since_last_item,
  {days_ago('first_item', 'cut')} AS items_first_item_days_ago
FROM customer u CROSS JOIN tm
LEFT JOIN (SELECT c, count(*) AS n, count(DISTINCT def) AS defs, avg(enhance) AS enh_mean,
    max(enhance) AS enh_max, sum(enhance) AS enh_sum, avg(attack) AS atk, avg(defense) AS dfn,
    avg(critical) AS crit, min(created) AS first_item, max(created) AS last_item
  FROM items, tm WHERE created <= cut GROUP BY c) a ON a.c = u.c_custkey"""

COLL = f"""SELECT {ID}, coalesce(n, 0) AS coll_total_items,
  coalesce(n30, 0) AS coll_items_last_30d, coalesce(n90, 0) AS coll_items_last_90d,
  coalesce(fams, 0) AS coll_unique_families,
  coalesce({rounded_days(days('first_item', 'last_item'))}, 0) AS coll_collection_span_days,
  {days_since('last_item', 'cut')} AS coll_days_since_last_item,
  {days_ago('first_item', 'cut')} AS coll_first_item_days_ago
FROM customer u CROSS JOIN tm
LEFT JOIN (SELECT c, count(*) AS n, count(DISTINCT floor(def / 100.0)) AS fams,
    count(*) FILTER (created >= cut - INTERVAL 30 DAY) AS n30,
    count(*) FILTER (created >= cut - INTERVAL 90 DAY) AS n90,
    min(created) AS first_item, max(created) AS last_item
  FROM coll, tm WHERE created <= cut GROUP BY c) a ON a.c = u.c_custkey"""

FEEDBACK = f"""SELECT {ID}, coalesce(n, 0) AS feedback_total, (coalesce(n, 0) > 0)::INT AS feedback_has_any,
  coalesce(neg, 0) AS feedback_n_negative, coalesce(pos, 0) AS feedback_n_positive,
  coalesce(mon, 0) AS feedback_n_monetization, {days_since('last_at', 'cut')} AS feedback_days_since_last
FROM customer u CROSS JOIN tm
LEFT JOIN (SELECT c, count(*) AS n, count(*) FILTER (kind IN ('click', 'error')) AS neg,
    count(*) FILTER (kind = 'view') AS pos, count(*) FILTER (kind = 'purchase') AS mon,
    max(created) AS last_at FROM feedback, tm WHERE created <= cut GROUP BY c) a
  ON a.c = u.c_custkey"""

LEVEL_P75 = 11.0
DERIVED = f"""SELECT {ID}, {whole_days('us.created', 'ref')} AS user_account_age_days,
  {whole_days('co.first_item', 'ref')} AS coll_age_days, coalesce(co.n30, 0) AS coll_items_recent_30d,
  coalesce(co.n90, 0) AS coll_items_recent_90d, co.n30::DOUBLE / co.n AS coll_pct_recent_30d,
  co.n60::DOUBLE / co.n AS coll_pct_recent_60d,
  {whole_days('rw.created', 'ref')} AS reward_register_age_days,
  coalesce(rw.prem, 0)::DOUBLE / nullif(coalesce(rw.prem, 0) + coalesce(rw.ad, 0), 0)
    AS reward_pct_premium_track,
  CASE WHEN rw.c IS NOT NULL THEN least(60, rw.sets * 30 + rw.claimed) / 60.0::DOUBLE END
    AS claim_consistency_60d,
  coalesce(ip.recent, 0) AS iap_paid_last_90d_at_ref, coalesce(ip.kinds, 0) AS iap_n_distinct_products,
  coalesce(ch.arena, 0.0) AS pct_chars_arena_active, coalesce(ch.high, 0.0) AS pct_chars_high_level,
  it.crit AS pct_items_critical_build, it.he AS pct_items_high_enhance,
  fam.ent AS entropy_items_family, fam.simp AS simpson_items_family,
  coalesce(it.n30, 0) AS items_creation_velocity_30d
FROM customer u CROSS JOIN tm LEFT JOIN users us ON us.c = u.c_custkey
LEFT JOIN (SELECT c, count(*) AS n, min(created) AS first_item,
    count(*) FILTER (created >= ref - INTERVAL 30 DAY) AS n30,
    count(*) FILTER (created >= ref - INTERVAL 60 DAY) AS n60,
    count(*) FILTER (created >= ref - INTERVAL 90 DAY) AS n90 FROM coll, tm GROUP BY c) co
  ON co.c = u.c_custkey
LEFT JOIN (SELECT * FROM rewards QUALIFY row_number() OVER (PARTITION BY c
    ORDER BY updated DESC NULLS LAST, k DESC) = 1) rw ON rw.c = u.c_custkey
LEFT JOIN (SELECT c, max((bought >= ref - INTERVAL 90 DAY)::INT) AS recent,
    count(DISTINCT product) AS kinds FROM (SELECT c, bought, product FROM cons UNION ALL
    SELECT c, bought, product FROM subs), tm GROUP BY c) ip ON ip.c = u.c_custkey
LEFT JOIN (SELECT c, count(*) FILTER (arena > 0)::DOUBLE / count(*) AS arena,
    count(*) FILTER (level >= {LEVEL_P75})::DOUBLE / count(*) AS high FROM chars GROUP BY c) ch
  ON ch.c = u.c_custkey
LEFT JOIN (SELECT c, nullif(count(*) FILTER (critical > 0), 0)::DOUBLE / count(*) AS crit,
    nullif(count(*) FILTER (enhance >= 5), 0)::DOUBLE / count(*) AS he,
    count(*) FILTER (created >= ref - INTERVAL 30 DAY) AS n30 FROM items, tm GROUP BY c) it
  ON it.c = u.c_custkey
LEFT JOIN (SELECT c, -sum(n / s * log2(n / s)) AS ent, 1 - sum((n / s) * (n / s)) AS simp FROM
    (SELECT c, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY c))::DOUBLE AS s FROM
      (SELECT c, def, count(*) AS n FROM items GROUP BY c, def)) GROUP BY c) fam
  ON fam.c = u.c_custkey"""

CURRENCY = f"""SELECT {ID}, ec.ent AS entropy_currency_concept, gc.gini AS gini_currency_concept,
  CASE WHEN t.c IS NOT NULL THEN coalesce(gc.kinds, 0) END AS n_distinct_concepts_used,
  et.ent AS entropy_currency_type, CASE WHEN t.days > 30 THEN 30 ELSE t.days END / 30.0::DOUBLE AS pct_days_active_currency_30d,
  t.weekend AS weekend_pct_currency, b.binge AS binge_index_currency, t.inflow AS currency_pct_inflow,
  t.outflow AS currency_pct_outflow
FROM customer u
LEFT JOIN (SELECT c, count(DISTINCT created::DATE) AS days,
    count(*) FILTER (isodow(created) >= 6)::DOUBLE / count(*) AS weekend,
    count(*) FILTER (quantity > 0)::DOUBLE / count(*) AS inflow,
    count(*) FILTER (quantity < 0)::DOUBLE / count(*) AS outflow FROM cur_w GROUP BY c) t
  ON t.c = u.c_custkey
LEFT JOIN (SELECT c, entropy(concept) AS ent FROM cur_w WHERE concept IS NOT NULL GROUP BY c) ec
  ON ec.c = u.c_custkey
LEFT JOIN (SELECT c, entropy(currency) AS ent FROM cur_w GROUP BY c) et ON et.c = u.c_custkey
LEFT JOIN (SELECT c, count(*) AS kinds,
    (2 * sum(i * n) - (count(*) + 1) * sum(n))::DOUBLE / (count(*) * sum(n)) AS gini FROM
    (SELECT c, n, row_number() OVER (PARTITION BY c ORDER BY n) AS i FROM
      (SELECT c, concept, count(*) AS n FROM cur_w WHERE concept IS NOT NULL GROUP BY c, concept))
    GROUP BY c) gc ON gc.c = u.c_custkey
LEFT JOIN (SELECT c, max(n) / median(n)::DOUBLE AS binge FROM (SELECT c, created::DATE AS d,
    count(*) AS n FROM cur_w GROUP BY c, d) GROUP BY c) b ON b.c = u.c_custkey"""

FIGHTS = f"""SELECT {ID}, e.ent AS entropy_fights_type, b.binge AS binge_index_fights,
  t.pvp AS fights_pct_pvp, t.won AS fights_pct_won
FROM customer u
LEFT JOIN (SELECT c, count(*) FILTER (kind = 'FIGHT_TYPE_ARENA')::DOUBLE / count(*) AS pvp,
    count(*) FILTER (won = 1)::DOUBLE / count(*) AS won FROM fight_w GROUP BY c) t
  ON t.c = u.c_custkey
LEFT JOIN (SELECT c, entropy(kind) AS ent FROM fight_w GROUP BY c) e ON e.c = u.c_custkey
LEFT JOIN (SELECT c, max(n) / median(n)::DOUBLE AS binge FROM (SELECT c, tsp::DATE AS d,
    count(*) AS n FROM fight_w GROUP BY c, d) GROUP BY c) b ON b.c = u.c_custkey"""

ARENA = f"""SELECT {ID}, (a.c IS NOT NULL)::INT AS is_arena_player FROM customer u
LEFT JOIN (SELECT DISTINCT c FROM fight_w WHERE flag = 'R') a ON a.c = u.c_custkey"""

SAMPLE = f"""SELECT {uid('c')} AS user_id,
  {rounded_days(days('created', 'CASE WHEN login > cut THEN cut ELSE login END'))} AS player_lifespan_days,
  CASE WHEN login IS NOT NULL THEN {rounded_days(f"greatest(0.0, {days('login', 'cut')})")} END
    AS days_since_last_login,
  coalesce({rounded_days(days('created', 'CASE WHEN login > cut THEN cut ELSE login END'))} < 0, TRUE)
    AS has_corrupted_dates
FROM users, tm"""

FEATURES = {
    "f_sample": (["users", "tm"], SAMPLE, []),
    "f_users": (["users", "tm"], USERS, []),
    "f_characters": (["chars", "tm"], CHARS, ["char_level_mean", "char_experience_mean"]),
    "f_devices": (["devices", "tm"], DEVICES, []),
    "f_iaps": (["cons", "subs", "tm"], IAPS, []),
    "f_rewards": (["rewards", "tm"], REWARDS, []),
    "f_items": (["items", "tm"], ITEMS, [
        "items_mean_enhance_level", "items_mean_attack", "items_mean_defense",
        "items_mean_critical", "items_attack_defense_ratio", "items_redundancy_ratio"]),
    "f_collection": (["coll", "tm"], COLL, []),
    "f_feedback": (["feedback", "tm"], FEEDBACK, []),
    "f_derived": (["users", "coll", "rewards", "cons", "subs", "chars", "items", "tm"], DERIVED, [
        "coll_pct_recent_30d", "coll_pct_recent_60d", "reward_pct_premium_track",
        "claim_consistency_60d", "pct_chars_arena_active", "pct_chars_high_level",
        "pct_items_critical_build", "pct_items_high_enhance", "entropy_items_family",
        "simpson_items_family"]),
    "f_currency": (["cur_w"], CURRENCY, [
        "entropy_currency_concept", "gini_currency_concept", "entropy_currency_type",
        "pct_days_active_currency_30d", "weekend_pct_currency", "binge_index_currency",
        "currency_pct_inflow", "currency_pct_outflow"]),
    "f_fights": (["fight_w"], FIGHTS, [
        "entropy_fights_type", "binge_index_fights", "fights_pct_pvp", "fights_pct_won"]),
    "f_arena": (["fight_w"], ARENA, []),
}
