"""User block: a projection, no aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.functions.times import days_ago, whole_days
from tidemark.operators.block import Block, Part
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables

KEPT = (
    "country", "language", "is_google_play", "tutorial_done", "has_user_rated_app", "focus",
)
PREFIXED = (
    "current_character", "current_session", "dark_steel", "gold", "gems", "runes",
    "game_version", "last_completed_tutorial_block", "num_logins", "store_where_published",
    "template_item_stats_augment_update_done", "created_at", "updated_at", "last_login_date",
)
AGES = ("user_created_at_days_ago", "user_last_login_days_ago")


def user_columns(ctx: RunContext, part: Part) -> list:
    cols = []
    if part.churn:
        cols += [F.col(c) for c in KEPT]
        cols += [F.col(c).alias(f"user_{c}") for c in PREFIXED]
        cols.append(days_ago(F.col("created_ts"), ctx.cutoff()).alias(AGES[0]))
        cols.append(days_ago(F.col("last_login_ts"), ctx.cutoff()).alias(AGES[1]))
    if part.taste:
        age = whole_days(F.col("created_ts"), ctx.reference())
        cols.append(age.alias("user_account_age_days"))
    return cols


def build(tables: Tables, ctx: RunContext, rules: RuleBook, part: Part) -> DataFrame:
    return tables.users.select("user_id", *user_columns(ctx, part))


BLOCK = Block(
    "users", KEPT + tuple(f"user_{c}" for c in PREFIXED) + AGES, ("user_account_age_days",), build
)
