"""Device block: platforms, models and the most used platform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.functions.numbers import any_flag, flag
from tidemark.functions.times import NEVER, days_ago, days_since
from tidemark.operators.block import Block, Part
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables

COLUMNS = (
    "device_records_total", "device_unique_models", "device_platform_count",
    "device_has_android", "device_has_ios", "device_is_multi_platform",
    "device_primary_platform", "device_first_seen_days_ago", "device_days_since_last_active",
)
FILLS = dict.fromkeys(COLUMNS[:6], 0) | {
    "device_primary_platform": "none", "device_days_since_last_active": NEVER,
}


def build(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    cutoff = ctx.cutoff()
    rows = tables.devices.where(F.col("created_at") <= cutoff)
    updated = F.when(F.col("updated_at") > cutoff, cutoff).otherwise(F.col("updated_at"))
    timed = rows.select(
        "user_id", "platform", "device_model",
        F.unix_micros("created_at").alias("first_us"), F.unix_micros(updated).alias("last_us"),
    )
    # Per (player, platform) and (player, model) first, so distinct counts and the mode are plain
    # aggregates over already combined rows. Times are carried as longs to stay in hash aggregates.
    counts = timed.groupingSets(
        [["user_id", "platform"], ["user_id", "device_model"]],
        "user_id", "platform", "device_model",
    ).agg(
        (F.grouping("device_model") == 1).alias("by_platform"),
        F.count(F.lit(1)).alias("n"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
    )
    known = F.col("by_platform") & F.col("platform").isNotNull()
    place = F.struct(-F.col("n"), F.col("platform"))
    out = counts.groupBy("user_id").agg(
        F.sum(F.when(F.col("by_platform"), F.col("n"))).alias("device_records_total"),
        F.count_if(F.col("device_model").isNotNull()).alias("device_unique_models"),
        F.count_if(known).alias("device_platform_count"),
        any_flag(F.col("platform") == "android").alias("device_has_android"),
        any_flag(F.col("platform") == "ios").alias("device_has_ios"),
        F.min_by("platform", F.when(known, place)).alias("device_primary_platform"),
        F.timestamp_micros(F.min("first_us")).alias("first_seen"),
        F.timestamp_micros(F.max("last_us")).alias("last_active"),
    )
    both = (F.col("device_has_android") == 1) & (F.col("device_has_ios") == 1)
    return out.withColumns({
        "device_is_multi_platform": flag(both),
        "device_first_seen_days_ago": days_ago(F.col("first_seen"), cutoff),
        "device_days_since_last_active": days_since(F.col("last_active"), cutoff),
    })


BLOCK = Block("devices", COLUMNS, (), build, FILLS)
