"""Item block. Rows fold to (player, definition) first and to players second: distinct counts,
entropy and the means all come from that one rollup. Rows are dealt once, by player and part of the
definitions, so a player who owns a third of the items is spread over a few tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.functions.diversity import entropy_from_sums, n_log_n, simpson_from_sums
from tidemark.functions.numbers import ratio
from tidemark.functions.times import NEVER, days_ago, days_since
from tidemark.operators.block import AtCutoff, Block, Part, dealt
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables

CHURN_COLUMNS = (
    "items_total_instances", "items_unique_definitions", "items_mean_enhance_level",
    "items_max_enhance_level", "items_total_enhance_invested", "items_mean_attack",
    "items_mean_defense", "items_mean_critical", "items_attack_defense_ratio",
    "items_redundancy_ratio", "items_days_since_last_item", "items_first_item_days_ago",
)
TASTE_COLUMNS = (
    "pct_items_critical_build", "pct_items_high_enhance", "entropy_items_family",
    "simpson_items_family", "items_creation_velocity_30d",
)
FILLS = {
    "items_total_instances": 0, "items_unique_definitions": 0,
    "items_total_enhance_invested": 0, "items_days_since_last_item": NEVER,
    "items_creation_velocity_30d": 0,
}
HIGH_ENHANCE = 5
MEANS = {
    "enhance_level": "items_mean_enhance_level",
    "c_base_attack_enhanced": "items_mean_attack",
    "c_base_defense_enhanced": "items_mean_defense",
    "c_base_critical_chance": "items_mean_critical",
}


def build(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    at = AtCutoff(tables.user_items, F.col("created_at") <= ctx.cutoff(), part)
    definition = "item_definition_excel_id"
    created_us = F.unix_micros("created_at")
    first = []
    if part.churn:
        first += [
            at.rows.alias("n"), F.max(at("enhance_level")).alias("max_enhance"),
            F.min(at(created_us)).alias("first_us"), F.max(at(created_us)).alias("last_us"),
        ]
        for c in MEANS:
            first += [F.sum(at(c)).alias(f"sum_{c}"), F.count(at(c)).alias(f"cnt_{c}")]
    if part.taste:
        first += [
            F.count(F.lit(1)).alias("n_all"),
            F.count_if(F.col("c_base_critical_chance") > 0).alias("n_critical"),
            F.count_if(F.col("enhance_level") >= HIGH_ENHANCE).alias("n_enhanced"),
            F.count_if(F.col("created_at") >= ctx.reference(30)).alias("n_recent"),
        ]
    narrow = at.df.select("user_id", definition, "created_at", *MEANS)
    per_definition = dealt(narrow, definition).groupBy("user_id", "_part", definition).agg(*first)

    known = F.col(definition).isNotNull()
    aggs = []
    if part.churn:
        aggs += [
            F.sum("n").alias("items_total_instances"),
            F.count_if(known & (F.col("n") > 0)).alias("items_unique_definitions"),
            F.max("max_enhance").alias("items_max_enhance_level"),
            F.sum("sum_enhance_level").cast("bigint").alias("items_total_enhance_invested"),
            F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        ]
        aggs += [
            ratio(F.sum(f"sum_{c}"), F.sum(f"cnt_{c}")).alias(name) for c, name in MEANS.items()
        ]
    if part.taste:
        n = F.when(known, F.col("n_all")).otherwise(F.lit(0))
        total = F.sum(n).cast("double")
        rows = F.sum("n_all")
        aggs += [
            # A player without any qualifying item has no share at all, rather than a zero one.
            ratio(F.nullif(F.sum("n_critical"), F.lit(0)), rows).alias("pct_items_critical_build"),
            ratio(F.nullif(F.sum("n_enhanced"), F.lit(0)), rows).alias("pct_items_high_enhance"),
            entropy_from_sums(total, F.sum(n_log_n(n)), F.count_if(known))
            .alias("entropy_items_family"),
            simpson_from_sums(total, F.sum(n.cast("double") * n)).alias("simpson_items_family"),
            F.sum("n_recent").alias("items_creation_velocity_30d"),
        ]
    out = per_definition.groupBy("user_id").agg(*aggs)
    if part.churn:
        attack, defense = F.col("items_mean_attack"), F.col("items_mean_defense")
        out = out.withColumns({
            "items_attack_defense_ratio": F.when(defense > 0, ratio(attack, defense)),
            "items_redundancy_ratio": ratio(
                F.col("items_total_instances"), F.col("items_unique_definitions")
            ),
            "items_days_since_last_item": days_since(
                F.timestamp_micros("last_us"), ctx.cutoff()
            ),
            "items_first_item_days_ago": days_ago(F.timestamp_micros("first_us"), ctx.cutoff()),
        })
    return out


BLOCK = Block("items", CHURN_COLUMNS, TASTE_COLUMNS, build, FILLS)
