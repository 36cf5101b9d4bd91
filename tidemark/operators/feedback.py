"""Feedback block: support messages by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.functions.times import NEVER, days_since
from tidemark.operators.block import Block, Part
from tidemark.rules import FEEDBACK_CATEGORIES, RuleBook
from tidemark.sources.canonical import Tables

COLUMNS = (
    "feedback_total", "feedback_has_any", "feedback_n_negative", "feedback_n_positive",
    "feedback_n_monetization", "feedback_days_since_last",
)
FILLS = dict.fromkeys(COLUMNS[:5], 0) | {"feedback_days_since_last": NEVER}


def feedback_category(kind: Column) -> Column:
    out = F.lit("neutral")
    for category, kinds in FEEDBACK_CATEGORIES.items():
        out = F.when(kind.isin(*kinds), F.lit(category)).otherwise(out)
    return out


def build(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    rows = tables.support_feedback.where(F.col("created_at") <= ctx.cutoff())
    category = feedback_category(F.col("feedback_type"))
    out = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("feedback_total"),
        F.count_if(category.isin("negative", "bug")).alias("feedback_n_negative"),
        F.count_if(category == "positive").alias("feedback_n_positive"),
        F.count_if(category == "monetization").alias("feedback_n_monetization"),
        F.max("created_at").alias("last"),
    )
    return out.withColumns({
        "feedback_has_any": (F.col("feedback_total") > 0).cast("int"),
        "feedback_days_since_last": days_since(F.col("last"), ctx.cutoff()),
    })


BLOCK = Block("feedback", COLUMNS, (), build, FILLS)
