"""Character block: the main character's values, totals over all characters, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.functions.ids import first_hex_run
from tidemark.functions.numbers import any_flag, count_where, flag, ratio, round_half_even
from tidemark.functions.times import days_ago
from tidemark.operators.block import AtCutoff, Block, Part
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables
from tidemark.sources.catalog import COSMETIC_COLUMNS, EQUIP_COLUMNS

# fixed values: texts that count as "customised"
TRUE_TEXTS = ("true", "1", "yes")

# Output name -> column of the main character.
MAIN_VALUES = {
    "char_class_main": "class",
    "char_level_max": "level",
    "char_experience_max": "experience",
    "char_attack_max": "c_total_attack",
    "char_defense_max": "c_total_defense",
    "char_attack_defense_sum_max": "c_total_attack_defense_sum",
    "char_critical_chance_max": "c_total_critical_chance",
    "char_talent_total_max": "total_talent_points",
    "char_talent_spent_max": "spent_talent_points",
}
CHURN_COLUMNS = (
    "char_count", "char_classes_unique", "char_level_mean", "char_experience_mean",
    "char_has_multiple", *MAIN_VALUES, "char_equip_slots_filled_max", "char_cosmetic_score",
    "char_talent_pct_spent", "char_arena_category_max", "char_medals_max", "char_has_arena",
    "char_is_customized", "char_first_created_days_ago", "char_last_updated_days_ago",
)
TASTE_COLUMNS = ("pct_chars_arena_active", "pct_chars_high_level")
WHOLE = ("char_class_main", "char_critical_chance_max")
FILLS = {
    c: 0.0 if c in ("char_level_mean", "char_experience_mean", "char_talent_pct_spent",
                    "char_arena_category_max", "char_medals_max")
    or (c in MAIN_VALUES and c not in WHOLE) else 0
    for c in CHURN_COLUMNS if not c.endswith("_days_ago")
} | dict.fromkeys(TASTE_COLUMNS, 0.0)


def build(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    at = AtCutoff(tables.characters, F.col("created_at") <= ctx.cutoff(), part)
    aggs = []
    if part.churn:
        equipped = count_where(F.col(c).isNotNull() for c in EQUIP_COLUMNS)
        cosmetic = count_where(F.col(c) > 0 for c in COSMETIC_COLUMNS)
        main = F.struct(
            *[F.col(src).alias(name) for name, src in MAIN_VALUES.items()],
            equipped.alias("char_equip_slots_filled_max"),
            cosmetic.alias("char_cosmetic_score"),
        )
        # Highest level, then experience (missing ones last), then the smallest character id.
        place = F.struct(
            F.coalesce(-F.col("level"), F.lit(float("inf"))).alias("level"),
            F.coalesce(-F.col("experience"), F.lit(float("inf"))).alias("experience"),
            F.col("_id"),
        )
        category = at("arena_category")
        aggs += [
            at.rows.alias("char_count"),
            # A distinct count beside the others would send every character's values twice.
            F.size(F.collect_set(at("class"))).cast("bigint").alias("char_classes_unique"),
            F.avg(at("level")).alias("char_level_mean"),
            F.avg(at("experience")).alias("char_experience_mean"),
            F.min_by(main, at(place)).alias("main"),
            F.max(category).alias("char_arena_category_max"),
            F.max(at("medals")).alias("char_medals_max"),
            any_flag(category.isNotNull()).alias("char_has_arena"),
            any_flag(at(F.lower("is_customized").isin(*TRUE_TEXTS))).alias("char_is_customized"),
            F.min(at("created_at")).alias("first_created"),
            F.max(at("updated_at")).alias("last_updated"),
        ]
    if part.taste:
        n = F.count(F.lit(1))
        level = rules.thresholds.level_p75
        aggs += [
            ratio(F.count_if(F.col("arena_category") > 0), n).alias("pct_chars_arena_active"),
            ratio(F.count_if(F.col("level") >= level), n).alias("pct_chars_high_level"),
        ]
    out = at.df.groupBy("user_id").agg(*aggs)
    if part.churn:
        for name in (*MAIN_VALUES, "char_equip_slots_filled_max", "char_cosmetic_score"):
            value = F.col(f"main.{name}")
            out = out.withColumn(name, value.cast("bigint") if name in WHOLE else value)
        spent = ratio(F.col("char_talent_spent_max"), F.col("char_talent_total_max"))
        out = out.withColumns({
            "char_has_multiple": flag(F.col("char_count") > 1),
            "char_talent_pct_spent": round_half_even(F.coalesce(spent, F.lit(0.0)), 2),
            "char_first_created_days_ago": days_ago(F.col("first_created"), ctx.cutoff()),
            "char_last_updated_days_ago": days_ago(F.col("last_updated"), ctx.cutoff()),
        })
    return out


BLOCK = Block("characters", CHURN_COLUMNS, TASTE_COLUMNS, build, FILLS)


def character_owners(characters: DataFrame) -> DataFrame:
    """(char_id, user_id), both as plain 24-hex ids; the latest row wins if an id repeats."""
    return (
        characters.select(
            first_hex_run(F.col("_id")).alias("char_id"),
            first_hex_run(F.col("user_id")).alias("owner"), "created_at",
        )
        .where(F.col("char_id").isNotNull() & F.col("owner").isNotNull())
        .groupBy("char_id")
        .agg(F.max_by("owner", F.struct("created_at", "owner")).alias("user_id"))
    )
