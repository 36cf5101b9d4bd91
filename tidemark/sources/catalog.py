"""The input tables: declared columns, and which of them the operators read."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Schema:
    required: tuple[str, ...]
    optional: tuple[str, ...]
    on_missing: str = "warn"  # or "fail"


# --- fixed values: declared schemas, in matching order ------------------------------------------
SCHEMAS = {
    "users": Schema(
        ("_id", "created_at", "last_login_date"),
        (
            "own_id", "num_logins", "total_time_played", "session_mean_time", "game_version",
            "tutorial_done", "last_completed_tutorial_block", "show_arena_announcer",
            "show_new_arena_announcer", "show_village_announcer", "show_talents_announcer",
            "show_quests_announcer", "show_tower_event_announcer", "current_session", "country",
            "has_user_rated_app", "language", "focus", "gold", "gems", "dark_steel", "updated_at",
            "current_character", "is_google_play", "runes", "store_where_published",
            "template_item_stats_augment_update_done",
        ),
        "fail",
    ),
    "characters": Schema(
        (
            "user_id", "class", "level", "experience", "arena_category", "medals", "created_at",
            "updated_at",
        ),
        (
            "_id", "is_npc", "character_name", "slimChin", "eyeColor", "raceTrianglePos",
            "hairTrianglePos", "hairWhitePos", "wrinkles", "rHandEqObj", "lHandEqObj",
            "helmEqObj", "chestEqObj", "handsEqObj", "legsEqObj", "hairIcon", "beardIcon",
            "eyebrowsIcon", "faceScarIcon", "facePaintIcon", "torsoScarIcon", "torsoPaintIcon",
            "total_talent_points", "available_talent_points", "spent_talent_points",
            "ai_aggressivity", "ai_parry", "ai_intelligence", "pve_energy",
            "time_when_energy_is_full", "mana", "time_when_mana_is_full", "name_visible",
            "name_plain", "is_customized", "c_attack_multiplier_talents",
            "c_critical_chance_increment_talents", "c_defense_multiplier_talents",
            "c_total_attack", "c_total_attack_defense_sum", "c_total_critical_chance",
            "c_total_defense", "current_equipment_set",
        ),
        "fail",
    ),
    "devices": Schema(
        ("user_id", "platform", "device_model", "created_at", "updated_at"), ("_id",)
    ),
    "iaps_consumables": Schema(
        ("user_id", "product_id", "purchase_time"),
        (
            "_id", "transaction_id", "platform", "store", "purchase_state", "purchase_token",
            "reviewed", "given", "updated_at", "created_at",
        ),
    ),
    "iaps_subscriptions": Schema(
        ("user_id", "product_id", "purchase_time", "end_date"),
        (
            "_id", "transaction_id", "platform", "store", "is_trial", "purchase_token",
            "payment_state", "registry_updates", "status", "updated_at", "created_at",
        ),
    ),
    "daily_rewards": Schema(
        (
            "user_id", "created_at", "set", "current_day", "sets_completed",
            "last_claimed_reward_day", "last_claimed_reward_time",
            "last_claimed_premium_reward_day", "last_claimed_ad_reward_day",
        ),
        ("_id", "updated_at"),
    ),
    "user_items": Schema(
        (
            "user_id", "item_definition_excel_id", "c_base_critical_chance",
            "c_base_attack_enhanced", "c_base_defense_enhanced", "enhance_level",
            "tempering_level", "max_enhance_level", "updated_at", "created_at",
        ),
        ("_id",),
    ),
    "user_items_collection": Schema(
        ("user_id", "item_definition_excel_id", "updated_at", "created_at"), ("_id",)
    ),
    "support_feedback": Schema(
        ("user_id", "feedback_type", "created_at"),
        ("_id", "game_version", "platform", "state", "updated_at"),
    ),
}
MIN_MATCH_SCORE = 0.75
WARN_BELOW = 0.85

# --- fixed values: file names of the exports; the logs are known by name only -----------------------
FILE_NAMES = {
    "users": "users.csv",
    "characters": "characters.csv",
    "devices": "devices.csv",
    "iaps_consumables": "processed_consumables_iaps.csv",
    "iaps_subscriptions": "processed_subscriptions_iaps.csv",
    "daily_rewards": "user_daily_rewards.csv",
    "user_items": "user_items.csv",
    "user_items_collection": "user_items_collection.csv",
    "support_feedback": "support_user_feedback_by_type.csv",
    "currency_transactions": "currency_transactions.csv",
    "fights_log": "fights_log.csv",
    "arena_log": "arena_log.csv",
}
LOG_TABLES = ("currency_transactions", "fights_log", "arena_log")

EQUIP_COLUMNS = (
    "rHandEqObj", "lHandEqObj", "helmEqObj", "chestEqObj", "handsEqObj", "legsEqObj",
)
COSMETIC_COLUMNS = (
    "hairIcon", "beardIcon", "eyebrowsIcon", "faceScarIcon", "facePaintIcon", "torsoScarIcon",
    "torsoPaintIcon",
)

# --- what the operators read: column -> kind --------------------------------------------------------
# id_raw / id_strict / id_hex name the id rule; ts is an ISO time, unix is seconds since epoch.
READS = {
    "users": {
        "_id": "id_strict", "created_at": "keep", "updated_at": "keep", "last_login_date": "number",
        "country": "string", "language": "string", "is_google_play": "bool",
        "tutorial_done": "bool", "has_user_rated_app": "bool", "focus": "string",
        "current_character": "string", "current_session": "number", "dark_steel": "number",
        "gold": "number", "gems": "number", "runes": "number", "game_version": "string",
        "last_completed_tutorial_block": "number", "num_logins": "number",
        "store_where_published": "string", "template_item_stats_augment_update_done": "bool",
    },
    "characters": {
        "_id": "id_raw", "user_id": "id_raw", "is_npc": "bool", "class": "whole",
        "level": "number", "experience": "number", "arena_category": "number", "medals": "number",
        "created_at": "ts", "updated_at": "ts", "is_customized": "string",
        "total_talent_points": "number", "spent_talent_points": "number",
        "c_total_attack": "number", "c_total_defense": "number",
        "c_total_attack_defense_sum": "number", "c_total_critical_chance": "number",
        **{c: "string" for c in EQUIP_COLUMNS}, **{c: "number" for c in COSMETIC_COLUMNS},
    },
    "devices": {
        "user_id": "id_raw", "platform": "string", "device_model": "string",
        "created_at": "ts", "updated_at": "ts",
    },
    "iaps_consumables": {
        "user_id": "id_raw", "product_id": "string", "purchase_time": "unix",
    },
    "iaps_subscriptions": {
        "user_id": "id_raw", "product_id": "string", "purchase_time": "unix", "end_date": "unix",
        "is_trial": "number",
    },
    "daily_rewards": {
        "_id": "id_raw", "user_id": "id_raw", "created_at": "ts", "updated_at": "ts",
        "set": "number", "current_day": "number", "sets_completed": "number",
        "last_claimed_reward_day": "number", "last_claimed_reward_time": "unix_positive",
        "last_claimed_premium_reward_day": "number", "last_claimed_ad_reward_day": "number",
    },
    "user_items": {
        "user_id": "id_raw", "item_definition_excel_id": "whole",
        "c_base_critical_chance": "number", "c_base_attack_enhanced": "number",
        "c_base_defense_enhanced": "number", "enhance_level": "number", "created_at": "ts",
    },
    "user_items_collection": {
        "user_id": "id_raw", "item_definition_excel_id": "whole", "created_at": "ts",
    },
    "support_feedback": {"user_id": "id_raw", "feedback_type": "string", "created_at": "ts"},
    "currency_transactions": {
        "user_id": "id_hex", "concept": "string", "currency": "string", "quantity": "number",
        "created_at": "ts",
    },
    "fights_log": {
        "player_id": "id_hex", "fight_type": "string", "fight_winner": "number",
        "start_time": "unix",
    },
    "arena_log": {"attacker_id": "id_hex", "time_attacked": "unix"},
}
