"""Rule catalogue: names, orders and thresholds that decide the outputs.

Everything under a "fixed values" comment is a contract with the consumers of the output tables,
so it is stated as plain text. A deployment passes its own ``RuleBook`` to change it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: prediction horizons ---------------------------------------------------------
HORIZONS = {"churn_7d": 7, "churn_14d": 14, "churn_30d": 30}
TARGETS = tuple(HORIZONS)


def probability(target: str) -> str:
    """The column of a target's live score."""
    return target.replace("churn_", "churn_prob_", 1)


# --- fixed values: archetypes (code -> name, business priority) ----------------------------------
ARCHETYPES = {
    0: ("Recién Llegado Explorador", "alta"),
    1: ("Jugador Establecido Activo", "alta"),
    2: ("Hardcore End-Game", "crítica"),
    3: ("Veterano Especializado", "alta"),
    4: ("Casual Dormido", "baja"),
    5: ("Veterano Inversor", "alta"),
}

# --- fixed values: class code -> favourite class -------------------------------------------------
CLASS_NAMES = {0: "Caballero", 1: "Asesino", 2: "Campeón", 3: "Caballero"}
CLASS_DEFAULT = "Caballero"

# --- fixed values: taste axes (name -> needs recent activity, legal values) -----------------------
AXES = {
    "clase_favorita": (False, ("Caballero", "Asesino", "Campeón")),
    "estilo_build": (False, ("tanque", "equilibrado", "agresivo")),
    "monetizacion": (False, ("trial_no_convertido", "pagador", "no_pagador_ads", "no_pagador")),
    "perfil_enhance": (False, ("inversor", "no_inversor")),
    "perfil_coleccion": (False, ("coleccionista", "funcional")),
    "pvp_perfil": (True, ("pvp_frustrado", "pve_focus", "null")),
    "perfil_oro": (True, ("acumulador", "gastador", "neutro", "null")),
}

# --- fixed values: actions (code -> label), in code order -----------------------------------------
ACTIONS = {
    "CM01": "oferta_premium_clase",
    "CM02": "oferta_premium_dirigida",
    "CM03": "reconversion_trial",
    "CM04": "skin_clase",
    "CM05": "evento_enhance",
    "CM06": "reto_coleccion",
    "CM07": "drop_build",
    "CM08": "recompensa_ad",
    "CM09": "regalo_moneda",
    "CM10": "oferta_conversion_oro",
    "CM11": "ajuste_pvp",
    "CM12": "reto_guiado_clase",
}
# fixed values: the order in which actions are tried, and the one for players without a match
ACTION_ORDER = (
    "CM03", "CM01", "CM02", "CM10", "CM11", "CM12",
    "CM04", "CM06", "CM05", "CM07", "CM08", "CM09",
)
ACTION_FALLBACK = "CM04"
ACTION_LABEL_DEFAULT = "desconocida"

# --- fixed values: score sources -------------------------------------------------------------------
SOURCE_CODES = {
    "oof_stable": "stored score kept: the fresh score is within the drift threshold",
    "live_drift": "fresh score served: it moved away from the stored one",
    "live_new": "fresh score served: no stored score for this player",
}

# --- fixed values: feedback type -> category (anything else is neutral) ----------------------------
FEEDBACK_CATEGORIES = {
    "positive": (
        "VERY_FUN", "LOVE_ITEMS", "GREAT_VISUALS", "LIKE", "FEM_CHARACTERS",
        "CHARACTER_LOOKS_GOOD", "LOVE_GAME", "BETTER_THAN_OTHERS", "NICE_COMMUNITY",
    ),
    "negative": (
        "TOO_MANY_HITS", "DIFFICULT_GAME", "DONT_LIKE", "OBTAIN_ITEMS_EASIER", "BAD_VISUALS",
        "TOO_EASY",
    ),
    "bug": ("OTHER_BUGS", "CHARACTER_BUGS", "GAMEPLAY_BUGS", "CRASHES", "VISUAL_BUGS"),
    "monetization": ("MEMBERSHIP_EXPENSIVE", "CANT_PAY", "WANT_REFUND", "PAY_TO_WIN"),
    "neutral": ("SUGGESTION",),
}

# --- fixed values: subscription products -----------------------------------------------------------
SUBSCRIPTION_FLAGS = {
    "iap_has_monthly": "subs_monthly",
    "iap_has_quarterly": "subs_3_months",
    "iap_has_annual": "subs_12_months",
}

# --- fixed values: columns that reveal the label, or show the state after the cutoff ----------------
LEAKAGE_COLUMNS = (
    "user_last_login_date", "user_last_login_days_ago", "user_days_since_last_login",
    "user_game_version", "user_gold", "user_gems", "user_dark_steel", "user_runes",
    "user_current_character", "user_current_session", "user_num_logins",
    "user_last_completed_tutorial_block", "user_updated_at",
)

# --- fixed values: encoded columns of the churn models ----------------------------------------------
ENCODED_COLUMNS = (
    "country", "has_user_rated_app", "user_store_where_published", "device_primary_platform",
)
MISSING_KEY = "__missing__"

# --- fixed values: what the churn models read --------------------------------------------------------
CHURN_FEATURES = (
    "user_player_lifespan_days", "country", "language", "is_google_play", "has_user_rated_app",
    "focus", "user_store_where_published", "user_created_at_days_ago",
    "char_count", "char_classes_unique", "char_level_mean", "char_experience_mean",
    "char_has_multiple", "char_class_main", "char_level_max", "char_experience_max",
    "char_attack_max", "char_defense_max", "char_attack_defense_sum_max",
    "char_critical_chance_max", "char_equip_slots_filled_max", "char_cosmetic_score",
    "char_talent_total_max", "char_talent_spent_max", "char_talent_pct_spent",
    "char_arena_category_max", "char_medals_max", "char_first_created_days_ago",
    "char_last_updated_days_ago",
    "device_records_total", "device_unique_models", "device_has_android", "device_has_ios",
    "device_primary_platform", "device_first_seen_days_ago", "device_days_since_last_active",
    "reward_records_total", "reward_current_day_max", "reward_claim_rate", "reward_has_ad",
    "reward_ad_days_max", "reward_first_created_days_ago", "reward_last_claim_days_ago",
    "items_total_instances", "items_unique_definitions", "items_mean_enhance_level",
    "items_max_enhance_level", "items_total_enhance_invested", "items_mean_attack",
    "items_mean_defense", "items_mean_critical", "items_attack_defense_ratio",
    "items_redundancy_ratio", "items_days_since_last_item", "items_first_item_days_ago",
    "coll_total_items", "coll_items_last_30d", "coll_items_last_90d", "coll_unique_families",
    "coll_collection_span_days", "coll_days_since_last_item", "coll_first_item_days_ago",
)

# --- fixed values: what the archetype model reads ----------------------------------------------------
ARCHETYPE_FEATURES = (
    "country", "language", "user_store_where_published", "user_account_age_days",
    "has_user_rated_app",
    "char_count", "char_classes_unique", "char_class_main", "char_level_max", "char_level_mean",
    "char_experience_max", "char_experience_mean", "char_attack_max", "char_critical_chance_max",
    "char_medals_max", "char_arena_category_max", "char_has_multiple", "char_has_arena",
    "char_equip_slots_filled_max", "char_talent_pct_spent",
    "items_total_instances", "items_total_enhance_invested", "items_max_enhance_level",
    "items_mean_enhance_level", "items_mean_attack", "items_mean_critical",
    "items_attack_defense_ratio", "items_redundancy_ratio",
    "coll_total_items", "coll_collection_span_days", "coll_age_days", "coll_items_recent_30d",
    "coll_items_recent_90d",
    "device_records_total", "device_has_android", "device_has_ios", "device_primary_platform",
    "reward_sets_completed_max", "reward_current_day_max", "reward_premium_days_max",
    "reward_ad_days_max", "reward_has_premium", "reward_has_ad", "reward_claim_rate",
    "reward_register_age_days",
    "iap_has_consumables", "iap_has_subscription_ever", "iap_is_payer", "iap_consumables_count",
    "iap_consumables_unique_products", "iap_subscriptions_count", "iap_trial_only",
    "iap_paid_last_90d_at_ref",
    "feedback_total", "feedback_n_positive", "feedback_n_negative",
    "pct_chars_arena_active", "pct_chars_high_level", "pct_items_critical_build",
    "pct_items_high_enhance", "coll_pct_recent_30d", "coll_pct_recent_60d",
    "reward_pct_premium_track", "entropy_items_family", "simpson_items_family",
    "entropy_currency_concept", "gini_currency_concept", "n_distinct_concepts_used",
    "entropy_currency_type", "entropy_fights_type", "claim_consistency_60d",
    "pct_days_active_currency_30d", "weekend_pct_currency", "binge_index_currency",
    "binge_index_fights", "items_creation_velocity_30d", "iap_n_distinct_products",
    "is_arena_player",
)


@dataclass(frozen=True)
class TasteThresholds:
    """Numbers fitted once on the training sample and only read afterwards."""

    build_t33: float = 1.0369783412572637
    build_t67: float = 1.1703931334110416
    collection_p75: float = 42.0
    level_p75: float = 11.0


@dataclass(frozen=True)
class RiskBand:
    name: str
    low: float
    high: float


@dataclass(frozen=True)
class PriorityRule:
    risks: tuple[str, ...]
    priority: str
    label: str
    archetypes: tuple[int, ...] | None = None


@dataclass(frozen=True)
class RuleBook:
    """All rules one run needs; the defaults are the fixed values of this file."""

    thresholds: TasteThresholds = field(default_factory=TasteThresholds)
    archetypes: dict = field(default_factory=lambda: dict(ARCHETYPES))
    class_names: dict = field(default_factory=lambda: dict(CLASS_NAMES))
    actions: dict = field(default_factory=lambda: dict(ACTIONS))
    action_order: tuple[str, ...] = ACTION_ORDER
    action_fallback: str = ACTION_FALLBACK
    drift_threshold: float = 0.10
    high_risk: float = 0.65
    # fixed values: risk bands, tried in this order
    risk_bands: tuple[RiskBand, ...] = (
        RiskBand("critical", 0.85, 1.00),
        RiskBand("high", 0.65, 0.85),
        RiskBand("medium", 0.40, 0.65),
        RiskBand("low", 0.20, 0.40),
        RiskBand("very_low", 0.00, 0.20),
    )
    risk_default: str = "very_low"
    # fixed values: priority rules, first match wins
    priority_rules: tuple[PriorityRule, ...] = (
        PriorityRule(("critical",), "P0", "Acción inmediata", (1, 2, 3, 5)),
        PriorityRule(("critical",), "P3", "Re-engagement masivo (bajo coste)", (4,)),
        PriorityRule(("high",), "P1", "Intervención focalizada", (1, 2, 3, 5)),
        PriorityRule(("critical", "high"), "P1", "Refuerzo onboarding", (0,)),
        PriorityRule(("medium",), "P2", "Seguimiento preventivo"),
        PriorityRule(("low", "very_low"), "P4", "Monitorización pasiva"),
    )
    priority_default: tuple[str, str] = ("P4", "Monitorización pasiva")
    # conditions of actions that a rule document states; the others keep their own (see operators.taste)
    action_conditions: dict = field(default_factory=dict)
    # the model versions a job loads, by kind ("churn", "archetypes")
    active: dict = field(default_factory=dict)

    def archetype_code(self, name: str) -> int | None:
        for code, (known, _) in self.archetypes.items():
            if known == name:
                return code
        return None


def literal_lookup(key: Column, table: dict) -> Column:
    """Map a column through a small fixed table without a join; unknown keys give null."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)
