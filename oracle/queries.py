"""ORACLE[name]: the DuckDB statement each registered query is compared with."""

from __future__ import annotations

from oracle.features import FEATURES
from oracle.tables import CTE, NEEDS, closure, half_even, rounded_days, uid

DEFS = CTE | {name: sql for name, (_, sql, _) in FEATURES.items()}
WANTS = NEEDS | {name: needs for name, (needs, _, _) in FEATURES.items()}


def stmt(needs: list[str], body: str, doubles: list[str] = ()) -> str:
    parts = [f"{n} AS ({DEFS[n]})" for n in closure(needs, DEFS, WANTS)]
    with_ = f"WITH RECURSIVE {', '.join(parts)} " if parts else ""
    if doubles:
        cols = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles)
        return f"{with_}SELECT * REPLACE ({cols}) FROM ({body})"
    return with_ + body


def feature(name: str) -> str:
    return stmt([name], f"SELECT * FROM {name}", FEATURES[name][2])


def doubles_of(*names: str) -> list[str]:
    return [c for n in names for c in FEATURES[n][2]]


# --- masters ----------------------------------------------------------------------------------------
CHURN_BLOCKS = ("f_users", "f_characters", "f_devices", "f_iaps", "f_rewards", "f_items",
                "f_collection", "f_feedback")
TASTE_BLOCKS = CHURN_BLOCKS + ("f_derived", "f_currency", "f_fights", "f_arena")
BASE = """(SELECT user_id, player_lifespan_days AS user_player_lifespan_days,
  days_since_last_login AS user_days_since_last_login, has_corrupted_dates AS user_has_corrupted_dates
  FROM f_sample)"""


def master(blocks: tuple[str, ...]) -> str:
    return f"SELECT * FROM {BASE} s " + " ".join(f"JOIN {b} USING (user_id)" for b in blocks)


DEFS |= {"m_churn": master(CHURN_BLOCKS), "m_taste": master(TASTE_BLOCKS)}
WANTS |= {"m_churn": ["f_sample", *CHURN_BLOCKS], "m_taste": ["f_sample", *TASTE_BLOCKS]}

# --- scores, labels, segments --------------------------------------------------------------------------
H = (("7d", "7"), ("14d", "14"), ("30d", "30"))
DEFS["scores"] = "SELECT " + uid("l.c") + " AS user_id, " + ", ".join(
    f"""p{n} AS churn_{h}_live, q{n} AS churn_{h}_oof, p{n} - q{n} AS churn_{h}_delta,
    CASE WHEN q{n} IS NULL THEN 'live_new' WHEN abs(p{n} - q{n}) <= 0.1::DOUBLE THEN 'oof_stable'
      ELSE 'live_drift' END AS churn_{h}_source,
    CASE WHEN abs(p{n} - q{n}) <= 0.1::DOUBLE THEN q{n} ELSE p{n} END AS churn_{h}_final"""
    for h, n in H
) + " FROM live l LEFT JOIN oof o ON o.c = l.c"
WANTS["scores"] = ["live", "oof"]
SCORE_DOUBLES = [f"churn_{h}_{p}" for h, _ in H for p in ("live", "oof", "delta", "final")]
NAMES = """CASE {c} WHEN 0 THEN 'Recién Llegado Explorador' WHEN 1 THEN 'Jugador Establecido Activo'
 WHEN 2 THEN 'Hardcore End-Game' WHEN 3 THEN 'Veterano Especializado' WHEN 4 THEN 'Casual Dormido'
 WHEN 5 THEN 'Veterano Inversor' ELSE {other} END"""


def risk(p: str) -> str:
    return f"""CASE WHEN {p} >= 0.85 THEN 'critical' WHEN {p} >= 0.65 THEN 'high'
      WHEN {p} >= 0.4 THEN 'medium' WHEN {p} >= 0.2 THEN 'low' ELSE 'very_low' END"""


DEFS["labels"] = "SELECT " + uid("c") + " AS user_id, " + ", ".join(
    f"(login <= cut + INTERVAL {n} DAY)::INT AS churn_{h}" for h, n in H
) + " FROM users, tm"
WANTS["labels"] = ["users", "tm"]
DEFS["seg"] = f"""SELECT {uid('l.c')} AS user_id, p7, p14, p30, code, {risk('p30')} AS risk
  FROM live l JOIN arch a ON a.c = l.c"""
WANTS["seg"] = ["live", "arch"]
PRIORITY = """CASE WHEN risk = 'critical' AND code IN (1, 2, 3, 5) THEN 'P0|Acción inmediata'
  WHEN risk = 'critical' AND code = 4 THEN 'P3|Re-engagement masivo (bajo coste)'
  WHEN risk = 'high' AND code IN (1, 2, 3, 5) THEN 'P1|Intervención focalizada'
  WHEN risk IN ('critical', 'high') AND code = 0 THEN 'P1|Refuerzo onboarding'
  WHEN risk = 'medium' THEN 'P2|Seguimiento preventivo' ELSE 'P4|Monitorización pasiva' END"""

# The rules of strict_rules.json: other bands, another drift threshold, another order of actions.
DEFS["strict"] = f"""SELECT c, user_id, source, final, CASE WHEN final >= 0.9 THEN 'critical' WHEN final >= 0.7 THEN 'high'
  WHEN final >= 0.5 THEN 'medium' WHEN final >= 0.25 THEN 'low' ELSE 'very_low' END AS risk
  FROM (SELECT l.c, {uid('l.c')} AS user_id, CASE WHEN q30 IS NULL THEN 'live_new'
    WHEN abs(p30 - q30) <= 0.02::DOUBLE THEN 'oof_stable' ELSE 'live_drift' END AS source,
    CASE WHEN abs(p30 - q30) <= 0.02::DOUBLE THEN q30 ELSE p30 END AS final
    FROM live l LEFT JOIN oof o ON o.c = l.c)"""
WANTS["strict"] = ["live", "oof"]

# --- taste -------------------------------------------------------------------------------------------
DEFS["axes"] = f"""SELECT m.user_id, {NAMES.format(c='code', other='NULL')} AS arquetipo_n1, code,
  (fights_pct_pvp IS NOT NULL OR currency_pct_inflow IS NOT NULL)::INT AS has_tier2,
  CASE char_class_main WHEN 1 THEN 'Asesino' WHEN 2 THEN 'Campeón' ELSE 'Caballero' END
    AS clase_favorita,
  CASE WHEN items_attack_defense_ratio >= 1.1703931334110416::DOUBLE THEN 'agresivo'
    WHEN items_attack_defense_ratio <= 1.0369783412572637::DOUBLE THEN 'tanque'
    ELSE 'equilibrado' END AS estilo_build,
  CASE WHEN iap_trial_only = 1 THEN 'trial_no_convertido' WHEN iap_is_payer = 1 THEN 'pagador'
    WHEN reward_has_ad = 1 THEN 'no_pagador_ads' ELSE 'no_pagador' END AS monetizacion,
  CASE WHEN items_max_enhance_level > 2 OR pct_items_high_enhance > 0 THEN 'inversor'
    ELSE 'no_inversor' END AS perfil_enhance,
  CASE WHEN items_redundancy_ratio > 1.5 OR coll_total_items > 42 THEN 'coleccionista'
    ELSE 'funcional' END AS perfil_coleccion,
  CASE WHEN fights_pct_pvp IS NULL AND currency_pct_inflow IS NULL THEN 'null'
    WHEN coalesce(fights_pct_pvp, 0) > 0.3 AND coalesce(fights_pct_won, 0) < 0.3
      THEN 'pvp_frustrado' ELSE 'pve_focus' END AS pvp_perfil,
  CASE WHEN fights_pct_pvp IS NULL AND currency_pct_inflow IS NULL THEN 'null'
    WHEN currency_pct_inflow > 0.85 THEN 'acumulador' WHEN currency_pct_outflow > 0.25
      THEN 'gastador' ELSE 'neutro' END AS perfil_oro
FROM m_taste m LEFT JOIN (SELECT {uid('c')} AS user_id, code FROM arch) a USING (user_id)"""
WANTS["axes"] = ["m_taste", "arch"]
DEFS["acted"] = """SELECT *, CASE WHEN monetizacion = 'trial_no_convertido' THEN 'CM03'
  WHEN monetizacion = 'pagador' AND code = 2 THEN 'CM01' WHEN monetizacion = 'pagador' THEN 'CM02'
  WHEN perfil_oro = 'acumulador' THEN 'CM10' WHEN pvp_perfil = 'pvp_frustrado' THEN 'CM11'
  WHEN code = 0 THEN 'CM12' WHEN code IN (3, 5) THEN 'CM04'
  WHEN perfil_coleccion = 'coleccionista' AND code = 1 THEN 'CM06'
  WHEN perfil_enhance = 'inversor' THEN 'CM05'
  WHEN estilo_build <> 'equilibrado' AND code IN (1, 2) THEN 'CM07'
  WHEN monetizacion = 'no_pagador_ads' THEN 'CM08' WHEN code = 4 THEN 'CM09' ELSE 'CM04' END AS cod
  FROM axes"""
WANTS["acted"] = ["axes"]
LABELS = """CASE cod WHEN 'CM01' THEN 'oferta_premium_clase' WHEN 'CM02' THEN 'oferta_premium_dirigida'
  WHEN 'CM03' THEN 'reconversion_trial' WHEN 'CM04' THEN 'skin_clase' WHEN 'CM05' THEN 'evento_enhance'
  WHEN 'CM06' THEN 'reto_coleccion' WHEN 'CM07' THEN 'drop_build' WHEN 'CM08' THEN 'recompensa_ad'
  WHEN 'CM09' THEN 'regalo_moneda' WHEN 'CM10' THEN 'oferta_conversion_oro'
  WHEN 'CM11' THEN 'ajuste_pvp' WHEN 'CM12' THEN 'reto_guiado_clase' END"""
AXES = """clase_favorita, estilo_build, monetizacion, perfil_enhance, perfil_coleccion, pvp_perfil,
  perfil_oro"""
CODED = f"cod AS contramedida_primaria_cod, {LABELS} AS contramedida_primaria_label"
DEFS["pred"] = f"""SELECT s.*, code AS archetype_n1,
  {NAMES.format(c='code', other="'N/A'")} AS archetype_name, has_tier2, {AXES}, {CODED}
  FROM scores s JOIN acted USING (user_id)"""
WANTS["pred"] = ["scores", "acted"]
DEFS["named"] = f"""SELECT s.*, code AS archetype_n1, {NAMES.format(c='code', other="'N/A'")}
  AS archetype_name FROM scores s JOIN (SELECT {uid('c')} AS user_id, code FROM arch) USING (user_id)"""
WANTS["named"] = ["scores", "arch"]

# --- splits and encoding --------------------------------------------------------------------------------
DEFS["draws"] = """SELECT *, ('0x' || substr(md5('42:' || user_id), 1, 15))::BIGINT AS draw
  FROM labels WHERE churn_7d IS NOT NULL"""
WANTS["draws"] = ["labels"]


def split(target: str) -> str:
    return f"""SELECT user_id, {target},
    CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + floor(0.176::DOUBLE * (n - nt) + 0.5) THEN 'val'
      ELSE 'train' END AS split FROM (SELECT *, floor(0.15::DOUBLE * n + 0.5) AS nt FROM (
        SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY draw) AS rn,
          count(*) OVER (PARTITION BY {target}) AS n FROM draws))"""


CATS = {
    "country": "country", "user_store_where_published": "user_store_where_published",
    "device_primary_platform": "device_primary_platform",
    "has_user_rated_app": "CASE WHEN has_user_rated_app THEN 'True' WHEN NOT has_user_rated_app "
                          "THEN 'False' END",
}
DEFS["cats"] = " UNION ALL ".join(
    f"SELECT user_id, '{c}' AS \"column\", coalesce({e}, '__missing__') AS category "
    f"FROM f_users JOIN f_devices USING (user_id)" for c, e in CATS.items()
)
WANTS["cats"] = ["f_users", "f_devices"]
DEFS["means"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS target, "column", category, count(*) AS n,
    (sum({t}) + 10.0::DOUBLE * g) / (count(*) + 10.0::DOUBLE) AS encoded
    FROM cats JOIN (SELECT * FROM ({split(t)}) WHERE split = 'train') USING (user_id),
      (SELECT avg({t}) AS g FROM ({split(t)}) WHERE split = 'train')
    GROUP BY "column", category, g""" for t in ("churn_7d", "churn_14d", "churn_30d")
)
WANTS["means"] = ["cats", "draws"]

# Folds by another draw, one row per labelled player and horizon.
FOLD = "(('0x' || substr(md5('43:' || user_id), 1, 15))::BIGINT % 5)::INT"
DEFS["folds"] = " UNION ALL ".join(
    f"SELECT user_id, '{t}' AS target, {FOLD} AS fold, {t}::DOUBLE AS label FROM labels WHERE {t} IS NOT NULL"
    for t in ("churn_7d", "churn_14d", "churn_30d")
)
WANTS["folds"] = ["labels"]

# --- clean-up --------------------------------------------------------------------------------------------
# Every master column as text (for shares) or number (for correlations), one row per player.
DEFS["texts"] = """SELECT * FROM (SELECT COLUMNS(* EXCLUDE (user_id))::VARCHAR FROM m_churn)
  UNPIVOT INCLUDE NULLS (v FOR "column" IN (*))"""
WANTS["texts"] = ["m_churn"]
TEXT_COLUMNS = """country, language, focus, user_current_character, user_game_version,
  user_store_where_published, user_created_at, user_updated_at, device_primary_platform"""
DEFS["nums"] = f"""SELECT * FROM (SELECT user_id, COLUMNS(* EXCLUDE (user_id, {TEXT_COLUMNS}))::DOUBLE
  FROM m_churn) UNPIVOT (v FOR "column" IN (* EXCLUDE (user_id)))"""
WANTS["nums"] = ["m_churn"]
DEFS["shares"] = """SELECT "column", avg((v IS NULL)::INT) AS null_share FROM texts GROUP BY "column" """
WANTS["shares"] = ["texts"]
DEFS["tops"] = """SELECT "column", max(n)::DOUBLE / sum(n) AS top_share FROM (SELECT "column", v,
  count(*) AS n FROM texts WHERE v IS NOT NULL GROUP BY "column", v) GROUP BY "column" """
WANTS["tops"] = ["texts"]
DEFS["pairs"] = """SELECT a."column" AS col_a, b."column" AS col_b, corr(a.v, b.v) AS corr
  FROM nums a JOIN nums b ON a.user_id = b.user_id AND a."column" < b."column" GROUP BY ALL
  HAVING count(*) > 1 AND var_pop(a.v) > 0 AND var_pop(b.v) > 0"""
WANTS["pairs"] = ["nums"]
LEAK = """('user_last_login_date', 'user_last_login_days_ago', 'user_days_since_last_login',
  'user_game_version', 'user_gold', 'user_gems', 'user_dark_steel', 'user_runes',
  'user_current_character', 'user_current_session', 'user_num_logins',
  'user_last_completed_tutorial_block', 'user_updated_at')"""
DEFS["v1"] = f"""SELECT "column", 'high_nan' AS reason, 0.95::DOUBLE AS threshold FROM shares
    WHERE null_share > 0.95
  UNION ALL SELECT "column", 'quasi_constant', 0.95 FROM tops WHERE top_share > 0.95
  UNION ALL SELECT "column", 'target_leakage', NULL FROM shares WHERE "column" IN {LEAK}"""
WANTS["v1"] = ["shares", "tops"]


def greedy(name: str, limit: str, before: list[str]) -> None:
    """The sequential choice over strong pairs as a recursion: state is the list dropped so far."""
    gone = " ".join(
        f'AND col_a NOT IN (SELECT "column" FROM {b}) AND col_b NOT IN (SELECT "column" FROM {b})'
        for b in before
    )
    DEFS[f"{name}_q"] = f"""SELECT row_number() OVER (ORDER BY col_a, col_b) AS i, col_a, col_b,
      sa.null_share AS na, sb.null_share AS nb FROM pairs JOIN shares sa ON sa."column" = col_a
      JOIN shares sb ON sb."column" = col_b WHERE abs(corr) >= {limit} {gone}"""
    WANTS[f"{name}_q"] = ["pairs", "shares", *before]
    DEFS[f"{name}_r"] = f"""SELECT 0::BIGINT AS i, []::VARCHAR[] AS dropped, ''::VARCHAR AS cur,
        FALSE AS shut
      UNION ALL SELECT q.i, CASE WHEN (CASE WHEN q.col_a = r.cur THEN r.shut
            ELSE list_contains(r.dropped, q.col_a) END) OR list_contains(r.dropped, q.col_b)
          THEN r.dropped
          ELSE list_append(r.dropped, CASE WHEN q.nb < q.na THEN q.col_a ELSE q.col_b END) END,
        q.col_a, CASE WHEN q.col_a = r.cur THEN r.shut ELSE list_contains(r.dropped, q.col_a) END
      FROM {name}_r r JOIN {name}_q q ON q.i = r.i + 1"""
    WANTS[f"{name}_r"] = [f"{name}_q"]
    DEFS[name] = f"""SELECT unnest(dropped) AS "column" FROM (SELECT dropped FROM {name}_r
      ORDER BY i DESC LIMIT 1)"""
    WANTS[name] = [f"{name}_r"]


greedy("c99", "0.99", ["v1"])
greedy("c95", "0.95", ["v1", "c99"])

# --- schema matching: headers of the twelve exports, and the declared columns ---------------------------
HEADERS = {
    "users": "_id created_at updated_at last_login_date country language focus is_google_play "
             "tutorial_done has_user_rated_app store_where_published gold gems dark_steel runes "
             "num_logins current_session last_completed_tutorial_block game_version "
             "current_character template_item_stats_augment_update_done",
    "characters": "_id user_id is_npc class level experience arena_category medals created_at "
                  "updated_at is_customized total_talent_points spent_talent_points c_total_attack "
                  "c_total_defense c_total_attack_defense_sum c_total_critical_chance rHandEqObj "
                  "lHandEqObj helmEqObj chestEqObj handsEqObj legsEqObj hairIcon beardIcon "
                  "eyebrowsIcon faceScarIcon facePaintIcon torsoScarIcon torsoPaintIcon",
    "devices": "user_id platform device_model created_at updated_at",
    "iaps_consumables": "user_id product_id purchase_time",
    "iaps_subscriptions": "user_id product_id purchase_time end_date is_trial",
    "daily_rewards": "_id user_id created_at updated_at set current_day sets_completed "
                     "last_claimed_reward_day last_claimed_reward_time "
                     "last_claimed_premium_reward_day last_claimed_ad_reward_day",
    "user_items": "user_id item_definition_excel_id c_base_critical_chance c_base_attack_enhanced "
                  "c_base_defense_enhanced enhance_level tempering_level max_enhance_level "
                  "created_at updated_at",
    "user_items_collection": "user_id item_definition_excel_id created_at updated_at",
    "support_feedback": "user_id feedback_type created_at",
    "currency_transactions": "user_id concept currency quantity created_at",
    "fights_log": "player_id fight_type fight_winner start_time",
    "arena_log": "attacker_id time_attacked",
}
EXPORT_ROWS = {
    "users": "customer", "characters": "orders", "devices": "orders", "iaps_consumables": "cons",
    "iaps_subscriptions": "subs", "daily_rewards": "orders", "user_items": "line",
    "user_items_collection": "line", "support_feedback": "events", "currency_transactions": "events",
    "fights_log": "lineitem", "arena_log": "(SELECT 1 FROM lineitem WHERE l_returnflag = 'R')",
}


def declared_values() -> str:
    from tidemark.sources.catalog import SCHEMAS

    return ", ".join(
        f"({i}, '{n}', '{c}', {str(req).upper()})"
        for i, (n, s) in enumerate(SCHEMAS.items())
        for cols, req in ((s.required, True), (s.optional, False)) for c in cols
    )


def header_values(headers: dict[str, str]) -> str:
    return ", ".join(f"('{f}', '{c}')" for f, cols in headers.items() for c in cols.split())


def matched(headers: dict[str, str]) -> str:
    return f"""WITH decl(place, schema, col, req) AS (VALUES {declared_values()}),
  head(file, col) AS (VALUES {header_values(headers)}),
  cell AS (SELECT f.file, s.schema, s.place,
      (SELECT count(*) FROM head h JOIN decl d USING (col) WHERE h.file = f.file AND d.schema = s.schema) AS both_,
      (SELECT count(*) FROM head h WHERE h.file = f.file) AS nh,
      (SELECT count(*) FROM decl d WHERE d.schema = s.schema) AS nd,
      (SELECT count(*) FROM decl d WHERE d.schema = s.schema AND req AND d.col NOT IN
        (SELECT col FROM head h WHERE h.file = f.file)) AS lacking
    FROM (SELECT DISTINCT file FROM head) f, (SELECT DISTINCT schema, place FROM decl) s),
  best AS (SELECT *, CASE WHEN lacking = 0 THEN least(1.0, both_::DOUBLE / (nh + nd - both_) + 0.1)
      ELSE both_::DOUBLE / (nh + nd - both_) END AS score FROM cell WHERE both_ > 0
    QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, place) = 1),
  won AS (SELECT *, score >= 0.75 AND row_number() OVER (
      PARTITION BY CASE WHEN score >= 0.75 THEN schema END ORDER BY score DESC, file) = 1 AS ok FROM best)
SELECT f.file, CASE WHEN ok THEN schema END AS schema, coalesce(score, 0.0::DOUBLE) AS score,
  coalesce(ok AND score < 0.85, FALSE) AS weak_match,
  CASE WHEN ok THEN lacking::INT END AS n_missing_required
FROM (SELECT DISTINCT file FROM head) f LEFT JOIN won w ON w.file = f.file"""


def row_counts(names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS file, count(*) AS n_rows FROM {EXPORT_ROWS[n]}" for n in names
    )


REPORT_HEADERS = {n: c for n, c in HEADERS.items() if n != "devices"}
REPORT_HEADERS["user_items"] = HEADERS["user_items"].replace(" enhance_level ", " ")

STAT_COUNTS = "SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2"
GOOD = "_all"
FIRST_USERS = f"SELECT c_custkey AS c FROM customer ORDER BY c_custkey LIMIT 100"


def metrics(h: str, n: str) -> str:
    return f"""SELECT 'churn_{h}' AS target, count(*) AS n, sum(y)::BIGINT AS positives,
  (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc_roc,
  sum(y * prec) / sum(y) AS auc_pr, avg((s - y) * (s - y)) AS brier,
  -avg(y * ln(cs) + (1 - y) * ln(1 - cs)) AS log_loss,
  sum(y) FILTER (s >= 0.5)::DOUBLE / count(*) FILTER (s >= 0.5) AS precision_50,
  sum(y) FILTER (s >= 0.5)::DOUBLE / sum(y) AS recall_50,
  2.0::DOUBLE * sum(y) FILTER (s >= 0.5) / (count(*) FILTER (s >= 0.5) + sum(y)) AS f1_50,
  avg(((s >= 0.5)::INT = y)::INT) AS accuracy_50, max(f1) AS best_f1,
  min(s) FILTER (f1 = top) AS best_threshold
FROM (SELECT *, max(f1) OVER () AS top FROM (
  SELECT *, greatest(1e-15, least(1 - 1e-15, s)) AS cs,
    avg(rn) OVER (PARTITION BY s) AS rk,
    (sum(y) OVER (ORDER BY s DESC RANGE UNBOUNDED PRECEDING))::DOUBLE
      / count(*) OVER (ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS prec,
    2.0::DOUBLE * sum(y) OVER (ORDER BY s DESC RANGE UNBOUNDED PRECEDING)
      / (count(*) OVER (ORDER BY s DESC RANGE UNBOUNDED PRECEDING) + sum(y) OVER ()) AS f1
  FROM (SELECT p{n} AS s, churn_{h} AS y, row_number() OVER (ORDER BY p{n}) AS rn
    FROM (SELECT {uid('c')} AS user_id, * FROM live) JOIN labels USING (user_id)
    WHERE churn_{h} IS NOT NULL)))"""


METRIC_DOUBLES = ["auc_roc", "auc_pr", "brier", "log_loss", "precision_50", "recall_50", "f1_50",
                  "accuracy_50", "best_f1", "best_threshold"]
SUMMARY = " UNION ALL ".join(
    f"""SELECT 'churn_{h}' AS target, count(*) FILTER (churn_{h}_source = 'oof_stable') AS n_oof_stable,
  count(*) FILTER (churn_{h}_source = 'live_drift') AS n_live_drift,
  count(*) FILTER (churn_{h}_source = 'live_new') AS n_live_new, avg(churn_{h}_final) AS final_mean,
  avg(churn_{h}_delta) AS delta_mean, stddev_samp(churn_{h}_delta) AS delta_std,
  min(churn_{h}_delta) AS delta_min, max(churn_{h}_delta) AS delta_max,
  count(churn_{h}_delta) AS n_observed, median(churn_{h}_final) AS final_median FROM scores"""
    for h, _ in H
)
RANKED = """user_id, archetype_name, churn_7d_final, churn_14d_final, churn_30d_final,
  contramedida_primaria_cod, contramedida_primaria_label"""
FINALS = ["churn_7d_final", "churn_14d_final", "churn_30d_final"]
MEAN_VECTORS = """(SELECT label AS code, list(x ORDER BY dim) AS centroid FROM (SELECT label, dim,
  avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim) GROUP BY label)"""
VEC = "e.embedding::DOUBLE[]"

ORACLE = {
    "id_normalize": f"""SELECT c_custkey,
  CASE WHEN c_custkey % 11 = 10 THEN NULL WHEN c_custkey % 5 = 4 THEN 'guest-' || c_custkey
    WHEN c_custkey % 7 = 6 AND c_custkey % 3 <> 0 THEN 'id=' || {uid('c_custkey')} || ';'
    ELSE {uid('c_custkey')} END AS id_raw,
  CASE WHEN c_custkey % 11 = 10 OR c_custkey % 5 = 4 OR (c_custkey % 7 = 6 AND c_custkey % 3 <> 0)
    THEN NULL ELSE {uid('c_custkey')} END AS id_strict,
  CASE WHEN c_custkey % 11 = 10 OR c_custkey % 5 = 4 THEN NULL ELSE {uid('c_custkey')} END AS id_hex
  FROM customer""",
    "scan_semi_sample": stmt(["items", "users"], f"""SELECT {uid('i.c')} AS user_id,
  def AS item_definition_excel_id, attack AS c_base_attack_enhanced, enhance::DOUBLE AS enhance_level,
  epoch_us(i.created) AS created_us FROM items i WHERE c IN (SELECT c FROM users WHERE c_acctbal >= 0)""",
                             ["c_base_attack_enhanced"]),
    "log_window_scan": stmt(["cur_w"], f"""SELECT {uid('c')} AS user_id, concept, currency, quantity,
  epoch_us(created) AS created_us FROM cur_w WHERE c IN (SELECT c_custkey FROM customer)""",
                            ["quantity"]),
    "schema_match": stmt(["cons", "subs", "line"], f"""SELECT * FROM ({matched(HEADERS)})
  JOIN ({row_counts(HEADERS)}) USING (file)""", ["score"]),
    "schema_report": stmt(["cons", "subs", "line"], f"""SELECT r.*, n_rows FROM (
  SELECT schema, file, score, CASE WHEN schema IS NULL THEN 'info' WHEN n_missing_required > 0 THEN 'error'
    WHEN weak_match THEN 'warning' ELSE 'ok' END AS severity,
    CASE WHEN schema IS NULL THEN 'not recognised'
    WHEN n_missing_required > 0 THEN 'missing required columns: enhance_level' WHEN weak_match THEN 'weak match'
    ELSE 'recognised' END AS message FROM ({matched(REPORT_HEADERS)})
  UNION ALL SELECT schema, NULL, NULL, CASE WHEN schema IN ('users', 'characters') THEN 'error'
    ELSE 'warning' END, 'table not found: ' || schema
  FROM (SELECT DISTINCT schema FROM (VALUES {declared_values()}) t(place, schema, col, req)) WHERE schema NOT IN
    (SELECT schema FROM ({matched(REPORT_HEADERS)}) WHERE schema IS NOT NULL)) r
  LEFT JOIN ({row_counts(REPORT_HEADERS)}) USING (file)""", ["score"]),
    "referential_subset": stmt(["cons", "subs", "line", "ord", "currency"], f"""SELECT * FROM (
  SELECT 'users' AS "table", count(*) AS n_rows FROM ({FIRST_USERS})
  {" ".join(f"UNION ALL SELECT '{n}', count(*) FROM {t} WHERE {k} IN ({FIRST_USERS})" for n, t, k in (
      ("characters", "ord", "c"), ("devices", "ord", "c"), ("iaps_consumables", "cons", "c"),
      ("iaps_subscriptions", "subs", "c"), ("daily_rewards", "ord", "c"), ("user_items", "line", "c"),
      ("user_items_collection", "line", "c"), ("support_feedback", "events", "user_id"),
      ("currency_transactions", "currency", "c"), ("fights_log", "line", "c")))}
  UNION ALL SELECT 'arena_log', count(*) FROM line WHERE l_returnflag = 'R' AND c IN ({FIRST_USERS}))"""),
    "reference_date": stmt(["tm"], "SELECT ref::DATE AS reference_date FROM tm"),
    "sample_derive": feature("f_sample"),
    "feat_users": feature("f_users"),
    "feat_characters": feature("f_characters"),
    "feat_devices": feature("f_devices"),
    "feat_iaps": feature("f_iaps"),
    "feat_rewards": feature("f_rewards"),
    "feat_items": feature("f_items"),
    "feat_collection": feature("f_collection"),
    "feat_feedback": feature("f_feedback"),
    "feat_derived": feature("f_derived"),
    "feat_currency": feature("f_currency"),
    "feat_fights": feature("f_fights"),
    "feat_arena": feature("f_arena"),
    "master_churn": stmt(["m_churn"], "SELECT * FROM m_churn", doubles_of(*CHURN_BLOCKS)),
    "master_taste": stmt(["m_taste"], "SELECT * FROM m_taste", doubles_of(*TASTE_BLOCKS)),
    "stat_entropy": stmt([], "SELECT user_id, entropy(event_type) AS entropy FROM events GROUP BY 1",
                         ["entropy"]),
    "stat_gini": stmt([], f"""SELECT user_id, (2 * sum(i * n) - (count(*) + 1) * sum(n))
  / (count(*) * sum(n)) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS i
  FROM ({STAT_COUNTS})) GROUP BY 1""", ["gini"]),
    "stat_simpson": stmt([], f"""SELECT user_id, 1 - sum(p * p) AS simpson FROM (SELECT user_id,
  n / sum(n) OVER (PARTITION BY user_id) AS p FROM ({STAT_COUNTS})) GROUP BY 1""", ["simpson"]),
    "stat_binge": stmt([], """SELECT user_id, max(n) / median(n)::DOUBLE AS binge FROM (SELECT user_id,
  ts::DATE AS d, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""", ["binge"]),
    "threshold_fit": stmt(["m_taste", "chars"], """SELECT 'build_t33' AS threshold,
  quantile_cont(items_attack_defense_ratio, 0.33) AS value FROM m_taste
  UNION ALL SELECT 'build_t67', quantile_cont(items_attack_defense_ratio, 0.67) FROM m_taste
  UNION ALL SELECT 'collection_p75', quantile_cont(coll_total_items::DOUBLE, 0.75) FROM m_taste
  UNION ALL SELECT 'level_p50', quantile_cont(level, 0.5) FROM chars
  UNION ALL SELECT 'level_p75', quantile_cont(level, 0.75) FROM chars
  UNION ALL SELECT 'level_p90', quantile_cont(level, 0.9) FROM chars""", ["value"]),
    "target_encode_fit": stmt(["means"], "SELECT * FROM means", ["encoded"]),
    "target_encode_apply": stmt(["means"], f"""SELECT user_id, {", ".join(
        f'max(e) FILTER ("column" = ' + f"'{c}') AS {c}" for c in CATS)}
  FROM (SELECT cats.user_id, "column", coalesce(encoded, g) AS e FROM cats JOIN draws USING (user_id)
    LEFT JOIN (SELECT * FROM means WHERE target = 'churn_30d') USING ("column", category),
    (SELECT avg(churn_30d) AS g FROM ({split('churn_30d')}) WHERE split = 'train')) GROUP BY user_id""",
                                list(CATS)),
    "stratified_split": stmt(["draws"], split("churn_30d")),
    "oof_folds": stmt(["folds"], "SELECT * FROM folds"),
    "oof_encodings": stmt(["folds", "cats"], """SELECT target, k AS fold, "column", category, count(*) AS n,
  (sum(label) + 10.0::DOUBLE * g) / (count(*) + 10.0::DOUBLE) AS encoded
  FROM (SELECT unnest(range(5))::INT AS k) JOIN folds f ON f.fold <> k JOIN cats USING (user_id)
  JOIN (SELECT target, j, avg(label) AS g FROM folds, (SELECT unnest(range(5))::INT AS j) WHERE fold <> j GROUP BY 1, 2) m
    USING (target) WHERE m.j = k GROUP BY target, k, "column", category, g""", ["encoded"]),
    "churn_splits": stmt(["draws"], " UNION ALL ".join(
        f"SELECT '{t}' AS target, split, count(*) AS n, sum({t})::BIGINT AS positives FROM ({split(t)}) GROUP BY split"
        for t in ("churn_7d", "churn_14d", "churn_30d"))),
    "cleanup_high_null": stmt(["shares"], """SELECT *, null_share > 0.95 AS dropped FROM shares""",
                              ["null_share"]),
    "cleanup_quasi_constant": stmt(["tops"], "SELECT * FROM tops WHERE top_share > 0.95",
                                   ["top_share"]),
    "cleanup_corr_pairs": stmt(["pairs"], "SELECT * FROM pairs WHERE abs(corr) >= 0.95", ["corr"]),
    "cleanup_report": stmt(["v1", "c99", "c95"], """SELECT "column" AS feature, reason, threshold FROM v1
  UNION ALL SELECT "column", 'corr_99', 0.99 FROM c99
  UNION ALL SELECT "column", 'corr_95', 0.95 FROM c95"""),
    "cleanup_apply": stmt(["v1", "c99", "c95"], """SELECT variant, (SELECT count(*) + 1 FROM shares
    WHERE "column" NOT IN (SELECT "column" FROM v1) AND (lvl < 2 OR "column" NOT IN (SELECT "column" FROM c99))
      AND (lvl < 3 OR "column" NOT IN (SELECT "column" FROM c95)))::INT AS n_columns,
  (SELECT count(*) FROM customer) AS n_rows
  FROM (VALUES ('v1_conservative', 1), ('v2_intermediate', 2), ('v3_aggressive', 3)) t(variant, lvl)"""),
    "churn_labels": stmt(["labels"], "SELECT * FROM labels"),
    "eval_metrics": stmt(["live", "labels"], " UNION ALL ".join(metrics(h, n) for h, n in H),
                         METRIC_DOUBLES),
    "nearest_centroid": stmt([], f"""SELECT vec_id, label, code, d AS distance FROM (SELECT vec_id, label,
  code, list_sum(list_transform(list_zip({VEC}, centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM embeddings e, {MEAN_VECTORS}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, code) = 1""",
                             ["distance"]),
    "cluster_quality": stmt([], f"""WITH m AS {MEAN_VECTORS},
  s AS (SELECT label AS code, avg(list_distance({VEC}, centroid)) AS sp FROM embeddings e JOIN m ON code = label GROUP BY 1),
  db AS (SELECT avg(w) AS davies_bouldin, count(*)::INT AS clusters FROM (SELECT a.code,
    max((sa.sp + sb.sp) / list_distance(a.centroid, b.centroid)) AS w FROM m a JOIN m b ON a.code <> b.code
    JOIN s sa ON sa.code = a.code JOIN s sb ON sb.code = b.code GROUP BY a.code)),
  sz AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
  d AS (SELECT a.vec_id, a.label AS own, b.label AS other,
    sum(power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)) AS t
    FROM embeddings a, embeddings b GROUP BY ALL),
  sil AS (SELECT vec_id, max(CASE WHEN own = other THEN t / nullif(n - 1, 0) END) AS ai,
    min(CASE WHEN own <> other THEN t / n END) AS bi FROM d JOIN sz ON sz.label = other GROUP BY vec_id)
  SELECT davies_bouldin, clusters, (SELECT avg((bi - ai) / greatest(ai, bi)) FROM sil) AS silhouette FROM db""",
                            ["davies_bouldin", "silhouette"]),
    "archetype_assign": stmt(["f_sample", "f_characters", "f_collection", "f_items", "f_iaps", "f_devices"], """SELECT user_id, c.code AS archetype_n1,
  power(a - c.x[1], 2) + power(b - c.x[2], 2) + power(d - c.x[3], 2) + power(e - c.x[4], 2) + power(f - c.x[5], 2)
    + power(g - c.x[6], 2) + power(h - c.x[7], 2) AS distance
  FROM (SELECT user_id, (coalesce(char_count, 0) - 10) / 5.0::DOUBLE AS a, (coalesce(char_level_max, 1) - 30) / 8.0::DOUBLE AS b,
      (coalesce(coll_total_items, 0) - 40) / 20.0::DOUBLE AS d, (coalesce(items_mean_attack, 30000) - 36000) / 4000.0::DOUBLE AS e,
      (coalesce(iap_is_payer, 0) - 0.5) / 0.5::DOUBLE AS f,
      ((device_primary_platform IS NOT DISTINCT FROM 'android')::INT - 0.5) / 0.5::DOUBLE AS g,
      ((device_primary_platform IS NOT DISTINCT FROM 'ios')::INT - 0.25) / 0.5::DOUBLE AS h
    FROM f_sample LEFT JOIN f_characters USING (user_id) LEFT JOIN f_collection USING (user_id) LEFT JOIN f_items USING (user_id)
      LEFT JOIN f_iaps USING (user_id) LEFT JOIN f_devices USING (user_id)) m,
    (VALUES (0, [-1.5, -1.5, -1.5, 0.0, -1.0, 0.0, 0.0]::DOUBLE[]), (1, [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, -0.5]),
      (2, [1.0, 1.0, 1.0, 0.5, 1.0, 0.0, 0.0]), (3, [0.5, 0.5, 0.0, -0.5, -1.0, -1.0, 1.5]),
      (4, [-0.5, -0.5, -0.5, 1.0, 0.0, -1.0, -0.5]), (5, [0.5, 1.0, 1.5, 0.0, 1.0, -1.0, 0.5])) c(code, x)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY distance, code) = 1""", ["distance"]),
    "drift_reconcile": stmt(["scores"], "SELECT * FROM scores", SCORE_DOUBLES),
    "risk_levels": stmt(["live"], f"""SELECT {uid('c')} AS user_id, {risk('p7')} AS risk_7d,
  {risk('p14')} AS risk_14d, {risk('p30')} AS risk_30d FROM live"""),
    "priority_rules": stmt(["seg"], f"""SELECT user_id, code AS archetype_n1,
  split_part({PRIORITY}, '|', 1) AS priority, split_part({PRIORITY}, '|', 2) AS label FROM seg"""),
    "document_rules": stmt(["strict", "arch", "axes"], f"""SELECT s.user_id, s.source AS churn_30d_source, s.risk,
  CASE WHEN risk = 'critical' AND code IN (2, 5) THEN 'P0' WHEN risk IN ('critical', 'high') THEN 'P1'
    WHEN risk = 'medium' AND code = 0 THEN 'P2' ELSE 'P5' END AS priority,
  CASE WHEN risk = 'critical' AND code IN (2, 5) THEN 'call today' WHEN risk IN ('critical', 'high') THEN 'write this week'
    WHEN risk = 'medium' AND code = 0 THEN 'watch newcomers' ELSE 'leave alone' END AS label,
  (final >= 0.7)::INT AS at_risk, act.cod AS contramedida_primaria_cod,
  CASE cod WHEN 'CM13' THEN 'vip_call' ELSE {LABELS} END AS contramedida_primaria_label
  FROM strict s JOIN arch ON arch.c = s.c LEFT JOIN (SELECT user_id, CASE
    WHEN monetizacion = 'pagador' AND arquetipo_n1 IS DISTINCT FROM 'Casual Dormido'
      AND (perfil_oro = 'gastador' OR perfil_enhance = 'inversor') THEN 'CM13'
    WHEN monetizacion = 'trial_no_convertido' THEN 'CM03'
    WHEN monetizacion = 'pagador' AND arquetipo_n1 = 'Hardcore End-Game' THEN 'CM01' WHEN monetizacion = 'pagador' THEN 'CM02'
    WHEN monetizacion = 'no_pagador_ads' THEN 'CM08' WHEN perfil_coleccion = 'coleccionista' THEN 'CM05' ELSE 'CM09' END AS cod
    FROM axes) act ON act.user_id = s.user_id"""),
    "cross_predictions": stmt(["seg"], f"""SELECT user_id, p7 AS churn_prob_7d, p14 AS churn_prob_14d,
  p30 AS churn_prob_30d, code AS archetype_n1, {NAMES.format(c='code', other="'?'")} AS archetype_name,
  'live_model' AS source FROM seg WHERE code IS NOT NULL""",
                              ["churn_prob_7d", "churn_prob_14d", "churn_prob_30d"]),
    "cross_segment": stmt(["seg"], f"""SELECT user_id, risk AS risk_level,
  {NAMES.format(c='code', other="'?'")} AS segment, split_part({PRIORITY}, '|', 1) AS priority,
  split_part({PRIORITY}, '|', 2) AS label FROM seg WHERE code IS NOT NULL"""),
    "taste_axes": stmt(["axes"], f"SELECT user_id, arquetipo_n1, has_tier2, {AXES} FROM axes"),
    "taste_profile": stmt(["acted"], f"""SELECT user_id, arquetipo_n1, has_tier2, {AXES}, {CODED}
  FROM acted"""),
    "countermeasure_assign": stmt(["acted"], f"SELECT user_id, {CODED} FROM acted"),
    "predictions_full": stmt(["pred"], "SELECT * FROM pred", SCORE_DOUBLES),
    "predictions_business": stmt(["pred"], f"SELECT * EXCLUDE (has_tier2, {AXES}) FROM pred",
                                 SCORE_DOUBLES),
    "summary_targets": stmt(["scores"], SUMMARY, ["final_mean", "final_median", "delta_mean",
                                                  "delta_std", "delta_min", "delta_max"]),
    "summary_distribution": stmt(["pred"], f"""SELECT kind, value, n,
  {half_even('100.0::DOUBLE * n / sum(n) OVER (PARTITION BY kind)', 2)} AS pct FROM (
  SELECT 'archetype' AS kind, archetype_name AS value, count(*) AS n FROM pred GROUP BY 2
  UNION ALL SELECT 'action', contramedida_primaria_cod, count(*) FROM pred GROUP BY 2
  UNION ALL SELECT 'tier2', has_tier2::VARCHAR, count(*) FROM pred GROUP BY 2)""", ["pct"]),
    "report_high_risk": stmt(["named"], " UNION ALL ".join(
        f"""SELECT '{h}' AS horizon, count(*) FILTER (churn_{h}_final >= 0.65) AS n,
  {half_even(f'100.0::DOUBLE * count(*) FILTER (churn_{h}_final >= 0.65) / count(*)', 1)} AS pct
  FROM named""" for h, _ in H), ["pct"]),
    "report_kpis": stmt(["named"], f"""SELECT count(*) AS n_users,
  count(*) FILTER (churn_14d_final >= 0.65) AS n_high_risk,
  {half_even('100.0::DOUBLE * count(*) FILTER (churn_14d_final >= 0.65) / count(*)', 1)} AS pct_high_risk,
  count(DISTINCT archetype_n1) AS n_archetypes FROM named""", ["pct_high_risk"]),
    "report_archetypes": stmt(["named"], f"""SELECT archetype_name, n_users,
  {half_even('100.0::DOUBLE * n_users / sum(n_users) OVER ()', 1)} AS pct, mean_prob, pct_high_risk,
  CASE WHEN pct_high_risk >= 50 THEN 'risk-high' WHEN pct_high_risk >= 25 THEN 'risk-medium'
    ELSE 'risk-low' END AS risk_class FROM (SELECT archetype_name, count(*) AS n_users,
  avg(churn_14d_final) AS mean_prob, {half_even('100.0::DOUBLE * avg((churn_14d_final >= 0.65)::INT)', 1)}
  AS pct_high_risk FROM named GROUP BY 1)""", ["pct", "mean_prob", "pct_high_risk"]),
    "report_actions": stmt(["pred"], f"""SELECT contramedida_primaria_cod AS cod,
  contramedida_primaria_label AS label, count(*) AS n_users,
  {half_even('100.0::DOUBLE * count(*) / sum(count(*)) OVER ()', 1)} AS pct FROM pred GROUP BY 1, 2""",
                           ["pct"]),
    "report_ranked_players": stmt(["pred"], f"SELECT {RANKED} FROM pred", FINALS),
    "report_top_players": stmt(["pred"], f"""SELECT {RANKED}, row_number() OVER (
  PARTITION BY archetype_name ORDER BY churn_30d_final DESC NULLS LAST, user_id)::INT AS rank FROM pred
  QUALIFY rank <= 20""", FINALS),
    "run_metadata": stmt(["tm"], """SELECT strftime(ref, '%Y-%m-%d') AS reference_date,
  strftime(cut, '%Y-%m-%d') AS cutoff_date, (SELECT count(*) FROM customer) AS n_users,
  'churn_7d,churn_14d,churn_30d' AS churn_targets, 0.1::DOUBLE AS drift_threshold,
  'ok' AS stage_6_status FROM tm"""),
    "stream_daily_counts": stmt(["currency"], f"""SELECT {uid('c')} AS user_id, created::DATE AS day,
  concept, currency, count(*) AS n, count(*) FILTER (quantity > 0) AS n_in,
  count(*) FILTER (quantity < 0) AS n_out FROM currency GROUP BY ALL"""),
    "stream_currency_features": stmt(["f_currency"], """SELECT * FROM f_currency
  WHERE currency_pct_inflow IS NOT NULL""", FEATURES["f_currency"][2]),
    "stream_fight_features": stmt(["f_fights"], """SELECT * FROM f_fights
  WHERE fights_pct_pvp IS NOT NULL""", FEATURES["f_fights"][2]),
}
