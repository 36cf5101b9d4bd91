"""The run's population: reference date and one row per player."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.functions.times import days_between, round_days
from tidemark.rules import HORIZONS

SAMPLE_COLUMNS = (
    "user_id", "player_lifespan_days", "days_since_last_login", "has_corrupted_dates",
)


def last_login_day(users: DataFrame) -> DataFrame:
    """One row: the date of the latest login."""
    return users.agg(F.to_date(F.max("last_login_ts")).alias("reference_date"))


def run_context(users: DataFrame, **options) -> RunContext:
    """Read the reference date once (one value), so that every later filter is a literal."""
    day = last_login_day(users).first()["reference_date"]
    if day is None:
        raise ValueError("no readable last_login_date in the users table")
    return RunContext(day, **options)


def sample_expressions(ctx: RunContext) -> dict[str, Column]:
    """The sample's columns as expressions over the users table."""
    cutoff = ctx.cutoff()
    login, created = F.col("last_login_ts"), F.col("created_ts")
    # CASE instead of least(): least ignores a null login and would invent a lifespan.
    seen_until = F.when(login > cutoff, cutoff).otherwise(login)
    lifespan = round_days(days_between(created, seen_until))
    idle = round_days(days_between(login, cutoff))
    return {
        "player_lifespan_days": lifespan,
        "days_since_last_login": F.when(idle < 0, F.lit(0)).otherwise(idle),
        "has_corrupted_dates": F.coalesce(lifespan < 0, F.lit(True)),
    }


def derive_sample(users: DataFrame, ctx: RunContext) -> DataFrame:
    return users.select("user_id", *[c.alias(n) for n, c in sample_expressions(ctx).items()])


def in_sample(df: DataFrame, sample: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows of the sample's players. Broadcast or shuffle is left to the size statistics."""
    ids = sample.select(F.col("user_id").alias(key))
    return df.join(ids, key, "left_semi")


def churn_labels(users: DataFrame, ctx: RunContext) -> DataFrame:
    """1 if the player was not seen later than h days after the cutoff, per horizon."""
    return users.select(
        "user_id",
        *[
            (F.col("last_login_ts") <= ctx.cutoff(-days)).cast("int").alias(target)
            for target, days in HORIZONS.items()
        ],
    )
