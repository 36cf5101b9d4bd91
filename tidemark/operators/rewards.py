"""Daily-reward block: maxima up to the cutoff, and the state of the latest row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.functions.numbers import any_flag, clip, ratio, round_half_even
from tidemark.functions.times import days_ago, whole_days
from tidemark.operators.block import AtCutoff, Block, Part
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables

CHURN_COLUMNS = (
    "reward_records_total", "reward_sets_completed_max", "reward_current_day_max",
    "reward_claim_rate", "reward_has_premium", "reward_has_ad", "reward_premium_days_max",
    "reward_ad_days_max", "reward_first_created_days_ago", "reward_last_claim_days_ago",
)
TASTE_COLUMNS = (
    "reward_register_age_days", "reward_pct_premium_track", "claim_consistency_60d",
)
FILLS = dict.fromkeys(CHURN_COLUMNS[:8], 0.0)
SET_DAYS, PROXY_DAYS = 30, 60


def build(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    at = AtCutoff(tables.daily_rewards, F.col("created_at") <= ctx.cutoff(), part)
    premium, ad = "last_claimed_premium_reward_day", "last_claimed_ad_reward_day"
    aggs = []
    if part.churn:

        def top_positive(name: str):
            return F.max(at(F.when(F.col(name) > 0, F.col(name))))

        aggs += [
            at.rows.cast("double").alias("reward_records_total"),
            F.max(at("sets_completed")).alias("reward_sets_completed_max"),
            F.max(at("current_day")).alias("reward_current_day_max"),
            top_positive("last_claimed_reward_day").alias("claimed"),
            any_flag(at(F.col(premium) > 0)).cast("double").alias("reward_has_premium"),
            any_flag(at(F.col(ad) > 0)).cast("double").alias("reward_has_ad"),
            top_positive(premium).alias("reward_premium_days_max"),
            top_positive(ad).alias("reward_ad_days_max"),
            F.min(at("created_at")).alias("first_created"),
            F.max(at("last_claimed_reward_time")).alias("last_claim"),
        ]
    if part.taste:
        state = F.struct(
            "created_at", "sets_completed", F.col(premium).alias("premium"),
            F.col(ad).alias("ad"), F.col("last_claimed_reward_day").alias("claimed_day"),
        )
        # A missing updated_at sorts lowest, so it only wins if the player has no dated row.
        place = F.struct("updated_at", "_id", "created_at")
        aggs.append(F.max_by(state, place).alias("latest"))
    out = at.df.groupBy("user_id").agg(*aggs)
    if part.churn:
        rate = clip(ratio(F.col("claimed"), F.col("reward_current_day_max")), 0.0, 1.0)
        out = out.withColumns({
            "reward_claim_rate": round_half_even(F.coalesce(rate, F.lit(0.0)), 2),
            "reward_first_created_days_ago": days_ago(F.col("first_created"), ctx.cutoff()),
            "reward_last_claim_days_ago": days_ago(F.col("last_claim"), ctx.cutoff()),
        })
    if part.taste:

        def latest(name: str):
            return F.coalesce(F.col(f"latest.{name}"), F.lit(0.0))

        tracks = latest("premium") + latest("ad")
        proxy = latest("sets_completed") * SET_DAYS + latest("claimed_day")
        out = out.withColumns({
            "reward_register_age_days": whole_days(F.col("latest.created_at"), ctx.reference()),
            "reward_pct_premium_track": ratio(latest("premium"), tracks),
            "claim_consistency_60d": F.least(proxy, F.lit(float(PROXY_DAYS))) / float(PROXY_DAYS),
        })
    return out


BLOCK = Block("rewards", CHURN_COLUMNS, TASTE_COLUMNS, build, FILLS)
