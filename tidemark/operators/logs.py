"""Blocks from the transaction logs: currency, fights, arena.

Each log is read once. A task first combines its rows per (owner, category) for every category
dimension, so what is shuffled is bounded by owners x categories, not by log rows. Fight and arena
rows name a character; they are combined per character before the character is looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.functions import diversity
from tidemark.functions.numbers import flag, ratio
from tidemark.functions.times import is_weekend
from tidemark.operators.block import Block, Part
from tidemark.operators.characters import character_owners
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables

CURRENCY_COLUMNS = (
    "entropy_currency_concept", "gini_currency_concept", "n_distinct_concepts_used",
    "entropy_currency_type", "pct_days_active_currency_30d", "weekend_pct_currency",
    "binge_index_currency", "currency_pct_inflow", "currency_pct_outflow",
)
FIGHT_COLUMNS = ("entropy_fights_type", "binge_index_fights", "fights_pct_pvp", "fights_pct_won")
ARENA_COLUMNS = ("is_arena_player",)
PVP = "FIGHT_TYPE_ARENA"


def log_window(df: DataFrame, ctx: RunContext, time: str) -> DataFrame:
    return df.where(ctx.in_window(F.col(time)))


def currency_counts(log: DataFrame, ctx: RunContext) -> DataFrame:
    """(user_id, dim, category value, n, n_in, n_out) of the window: the mergeable counters."""
    rows = log_window(log, ctx, "created_at").select(
        "user_id", "concept", "currency", F.to_date("created_at").alias("day"), "quantity"
    )
    return diversity.category_counts(
        rows, "user_id", ("concept", "currency", "day"),
        n_in=flag(F.col("quantity") > 0), n_out=flag(F.col("quantity") < 0),
    )


def currency_features(counts: DataFrame, ctx: RunContext) -> DataFrame:
    is_day = F.col("dim") == "day"
    named = is_day | F.coalesce("concept", "currency").isNotNull()
    weekend = F.when(is_day & is_weekend(F.col("day")), F.col("n")).otherwise(F.lit(0))
    ready = counts.where(named).withColumn("n_weekend", weekend)
    hist = diversity.ranked_histogram(
        ready, ["user_id", "dim"], ("n_in", "n_out", "n_weekend"), place_by="user_id"
    )
    concept, currency = F.col("dim") == "concept", F.col("dim") == "currency"
    rows = F.sum(F.when(is_day, F.col("m") * F.col("n")))
    days = float(ctx.window_days)
    active = F.least(diversity.kinds(is_day).cast("double"), F.lit(days))

    def share(name: str):
        return ratio(F.sum(F.when(is_day, F.col(name))), rows)

    return hist.groupBy("user_id").agg(
        diversity.entropy(concept).alias("entropy_currency_concept"),
        diversity.gini(concept).alias("gini_currency_concept"),
        diversity.kinds(concept).alias("n_distinct_concepts_used"),
        diversity.entropy(currency).alias("entropy_currency_type"),
        (active / days).alias("pct_days_active_currency_30d"),
        share("n_weekend").alias("weekend_pct_currency"),
        diversity.burst(is_day).alias("binge_index_currency"),
        share("n_in").alias("currency_pct_inflow"),
        share("n_out").alias("currency_pct_outflow"),
    )


def build_currency(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    return currency_features(currency_counts(tables.currency_transactions, ctx), ctx)


def fight_counts(log: DataFrame, owners: DataFrame, ctx: RunContext) -> DataFrame:
    """(user_id, dim, category value, n, n_won) of the window."""
    rows = log_window(log, ctx, "start_time").select(
        F.col("player_id").alias("char_id"), "fight_type",
        F.to_date("start_time").alias("day"), "fight_winner",
    )
    per_char = diversity.category_counts(
        rows, "char_id", ("fight_type", "day"), n_won=flag(F.col("fight_winner") == 1.0)
    )
    return (
        per_char.join(owners, "char_id")
        .groupBy("user_id", "dim", "fight_type", "day")
        .agg(F.sum("n").alias("n"), F.sum("n_won").alias("n_won"))
    )


def fight_features(counts: DataFrame) -> DataFrame:
    is_day, is_type = F.col("dim") == "day", F.col("dim") == "fight_type"
    pvp = F.when(F.col("fight_type") == PVP, F.col("n")).otherwise(F.lit(0))
    ready = counts.where(is_day | F.col("fight_type").isNotNull()).withColumn("n_pvp", pvp)
    hist = diversity.ranked_histogram(
        ready, ["user_id", "dim"], ("n_won", "n_pvp"), place_by="user_id"
    )
    rows = F.sum(F.when(is_day, F.col("m") * F.col("n")))
    fought_pvp = F.coalesce(F.sum(F.when(is_type, F.col("n_pvp"))), F.lit(0))
    return hist.groupBy("user_id").agg(
        diversity.entropy(is_type).alias("entropy_fights_type"),
        diversity.burst(is_day).alias("binge_index_fights"),
        ratio(fought_pvp, rows).alias("fights_pct_pvp"),
        ratio(F.sum(F.when(is_day, F.col("n_won"))), rows).alias("fights_pct_won"),
    )


def build_fights(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    owners = character_owners(tables.characters)
    return fight_features(fight_counts(tables.fights_log, owners, ctx))


def build_arena(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    attackers = (
        log_window(tables.arena_log, ctx, "time_attacked")
        .select(F.col("attacker_id").alias("char_id")).distinct()
    )
    return (
        attackers.join(character_owners(tables.characters), "char_id")
        .select("user_id").distinct().withColumn("is_arena_player", F.lit(1))
    )


CURRENCY = Block("currency", (), CURRENCY_COLUMNS, build_currency)
FIGHTS = Block("fights", (), FIGHT_COLUMNS, build_fights)
ARENA = Block("arena", (), ARENA_COLUMNS, build_arena, {"is_arena_player": 0})
