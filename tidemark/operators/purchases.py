"""Purchase block: consumables and subscriptions folded in one pass over both tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.functions.numbers import flag
from tidemark.functions.times import NEVER, days_ago, days_between, days_since
from tidemark.operators.block import AtCutoff, Block, Part
from tidemark.rules import SUBSCRIPTION_FLAGS, RuleBook
from tidemark.sources.canonical import Tables

CHURN_COLUMNS = (
    "iap_is_payer", "iap_is_current_payer", "iap_paid_last_30d", "iap_paid_last_90d",
    "iap_consumables_count", "iap_consumables_unique_products", "iap_has_consumables",
    "iap_gems_packs_count", "iap_consumables_days_since_last", "iap_subscriptions_count",
    "iap_has_subscription_ever", *SUBSCRIPTION_FLAGS, "iap_is_subscription_active",
    "iap_subscription_active_last_7d", "iap_days_since_subscription_end", "iap_trial_only",
    "iap_first_consumable_days_ago", "iap_first_subscription_days_ago",
)
TASTE_COLUMNS = ("iap_paid_last_90d_at_ref", "iap_n_distinct_products")
FILLS = {
    c: NEVER if c in ("iap_consumables_days_since_last", "iap_days_since_subscription_end") else 0
    for c in CHURN_COLUMNS if not c.endswith("_days_ago")
} | dict.fromkeys(TASTE_COLUMNS, 0)
GEM_PREFIX = "gems"


def _all_purchases(tables: Tables) -> DataFrame:
    common = ("user_id", "product_id", "purchase_time")
    cons = tables.iaps_consumables.select(
        *common, F.lit(True).alias("consumable"),
        F.lit(None).cast("timestamp").alias("end_date"), F.lit(None).cast("double").alias("is_trial"),
    )
    subs = tables.iaps_subscriptions.select(
        *common, F.lit(False).alias("consumable"), "end_date", "is_trial"
    )
    return cons.unionByName(subs)


def build(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    bought = F.col("purchase_time")
    at = AtCutoff(_all_purchases(tables), bought <= ctx.cutoff(), part)
    time_us, end_us = F.unix_micros(bought), F.unix_micros("end_date")
    is_cons = F.col("consumable")

    def of(kind, value):
        return at(F.when(kind, value))

    # Level 1: per (player, product). Distinct products become row counts of level 2.
    first = []
    if part.churn:
        for name, kind in (("cons", is_cons), ("subs", ~is_cons)):
            first += [
                F.count(of(kind, F.lit(1))).alias(f"{name}_n"),
                F.min(of(kind, time_us)).alias(f"{name}_first"),
                F.max(of(kind, time_us)).alias(f"{name}_last"),
            ]
        first += [
            F.max(at(end_us)).alias("subs_end"),
            F.sum(at("is_trial")).alias("trials"), F.count(at("is_trial")).alias("trial_rows"),
        ]
    if part.taste:
        first.append(F.max(time_us).alias("any_last"))
    products = at.df.groupBy("user_id", "product_id").agg(*first)

    named = F.col("product_id").isNotNull()
    aggs = []
    if part.churn:
        gems = F.startswith("product_id", F.lit(GEM_PREFIX))
        aggs += [
            F.sum("cons_n").alias("n_cons"), F.sum("subs_n").alias("n_subs"),
            F.count_if(named & (F.col("cons_n") > 0)).alias("iap_consumables_unique_products"),
            F.sum(F.when(gems, F.col("cons_n"))).alias("iap_gems_packs_count"),
            *[F.min(c).alias(c) for c in ("cons_first", "subs_first")],
            *[F.max(c).alias(c) for c in ("cons_last", "subs_last", "subs_end")],
            *[F.sum(c).alias(c) for c in ("trials", "trial_rows")],
            *[
                F.max(flag((F.col("subs_n") > 0) & (F.col("product_id") == product))).alias(name)
                for name, product in SUBSCRIPTION_FLAGS.items()
            ],
        ]
    if part.taste:
        aggs += [
            F.max("any_last").alias("any_last"),
            F.count_if(named).alias("iap_n_distinct_products"),
        ]
    out = products.groupBy("user_id").agg(*aggs)
    if part.churn:
        out = _state_at_cutoff(out, ctx)
    if part.taste:
        recent = F.timestamp_micros("any_last") >= ctx.reference(90)
        out = out.withColumn("iap_paid_last_90d_at_ref", flag(recent))
    return out


def _state_at_cutoff(out: DataFrame, ctx: RunContext) -> DataFrame:
    cutoff = ctx.cutoff()

    def ts(name: str):
        return F.timestamp_micros(F.col(name))

    cons_n, subs_n = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_cons", "n_subs"))
    last = F.timestamp_micros(F.greatest("cons_last", "subs_last"))
    active = ts("subs_end") >= cutoff
    ended = days_between(ts("subs_end"), cutoff).cast("int")  # truncates
    return out.withColumns({
        "iap_consumables_count": cons_n,
        "iap_has_consumables": flag(cons_n > 0),
        "iap_subscriptions_count": subs_n,
        "iap_has_subscription_ever": flag(subs_n > 0),
        "iap_is_payer": flag((cons_n > 0) | (subs_n > 0)),
        "iap_is_current_payer": flag(
            F.coalesce(active, F.lit(False))
            | F.coalesce(ts("cons_last") >= ctx.cutoff(30), F.lit(False))
        ),
        "iap_paid_last_30d": flag(last >= ctx.cutoff(30)),
        "iap_paid_last_90d": flag(last >= ctx.cutoff(90)),
        "iap_consumables_days_since_last": days_since(ts("cons_last"), cutoff),
        "iap_first_consumable_days_ago": days_ago(ts("cons_first"), cutoff),
        "iap_first_subscription_days_ago": days_ago(ts("subs_first"), cutoff),
        "iap_is_subscription_active": flag(active),
        "iap_subscription_active_last_7d": flag(ts("subs_end") >= ctx.cutoff(7)),
        "iap_days_since_subscription_end": F.when(active, F.lit(0)).otherwise(
            F.when(ended < 1, F.lit(1)).otherwise(ended)
        ),
        "iap_trial_only": flag(
            (F.col("trial_rows") > 0) & (F.col("trials") == F.col("trial_rows"))
        ),
    })


BLOCK = Block("purchases", CHURN_COLUMNS, TASTE_COLUMNS, build, FILLS)
