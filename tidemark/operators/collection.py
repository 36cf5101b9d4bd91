"""Collection block: (player, family) rollup, then players."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.functions.numbers import ratio
from tidemark.functions.times import NEVER, days_ago, days_between, days_since, round_days, whole_days
from tidemark.operators.block import AtCutoff, Block, Part, dealt
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables

CHURN_COLUMNS = (
    "coll_total_items", "coll_items_last_30d", "coll_items_last_90d", "coll_unique_families",
    "coll_collection_span_days", "coll_days_since_last_item", "coll_first_item_days_ago",
)
TASTE_COLUMNS = (
    "coll_age_days", "coll_items_recent_30d", "coll_items_recent_90d", "coll_pct_recent_30d",
    "coll_pct_recent_60d",
)
FILLS = dict.fromkeys(CHURN_COLUMNS[:5], 0) | {
    "coll_days_since_last_item": NEVER, "coll_items_recent_30d": 0, "coll_items_recent_90d": 0,
}
FAMILY_SIZE = 100


def build(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    created = F.col("created_at")
    dated = tables.user_items_collection.where(created.isNotNull()).withColumn(
        "family", F.floor(F.col("item_definition_excel_id") / F.lit(FAMILY_SIZE))
    )
    at = AtCutoff(dated, created <= ctx.cutoff(), part)
    us = F.unix_micros(created)

    def since(edge):
        return F.count_if(F.coalesce(at(created >= edge), F.lit(False)))

    first = []
    if part.churn:
        first += [
            at.rows.alias("n"), F.min(at(us)).alias("first_us"), F.max(at(us)).alias("last_us"),
            since(ctx.cutoff(30)).alias("cut_30"), since(ctx.cutoff(90)).alias("cut_90"),
        ]
    if part.taste:
        first += [F.count(F.lit(1)).alias("n_all"), F.min(us).alias("any_first_us")]
        first += [
            F.count_if(created >= ctx.reference(d)).alias(f"ref_{d}") for d in (30, 60, 90)
        ]
    rows = at.df.select("user_id", "family", "created_at")
    families = dealt(rows, "family").groupBy("user_id", "_part", "family").agg(*first)
    aggs = []
    if part.churn:
        aggs += [
            F.sum("n").alias("coll_total_items"),
            F.count_if(F.col("family").isNotNull() & (F.col("n") > 0)).alias("coll_unique_families"),
            F.timestamp_micros(F.min("first_us")).alias("first_item"),
            F.timestamp_micros(F.max("last_us")).alias("last_item"),
            F.sum("cut_30").alias("coll_items_last_30d"),
            F.sum("cut_90").alias("coll_items_last_90d"),
        ]
    if part.taste:
        n = F.sum("n_all")
        aggs += [
            F.timestamp_micros(F.min("any_first_us")).alias("any_first"),
            F.sum("ref_30").alias("coll_items_recent_30d"),
            F.sum("ref_90").alias("coll_items_recent_90d"),
            ratio(F.sum("ref_30"), n).alias("coll_pct_recent_30d"),
            ratio(F.sum("ref_60"), n).alias("coll_pct_recent_60d"),
        ]
    out = families.groupBy("user_id").agg(*aggs)
    if part.churn:
        cutoff = ctx.cutoff()
        first_item, last_item = F.col("first_item"), F.col("last_item")
        out = out.withColumns({
            "coll_collection_span_days": round_days(days_between(first_item, last_item)),
            "coll_days_since_last_item": days_since(last_item, cutoff),
            "coll_first_item_days_ago": days_ago(first_item, cutoff),
        })
    if part.taste:
        out = out.withColumn("coll_age_days", whole_days(F.col("any_first"), ctx.reference()))
    return out


BLOCK = Block("collection", CHURN_COLUMNS, TASTE_COLUMNS, build, FILLS)
