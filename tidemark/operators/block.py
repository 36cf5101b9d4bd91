"""How feature blocks are built and joined.

A block aggregates one or two tables to one row per player. The raw rows are never joined to the
sample first: the aggregate combines map-side, shuffles one row per player and task, and the left
join from the sample then drops players outside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.context import RunContext
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables


#: Tasks over which the rows of one player are spread at most.
PLAYER_PARTS = 4


@dataclass(frozen=True)
class Part:
    """Which halves of a block to compute: point-in-time at the cutoff, and at the reference."""

    churn: bool = True
    taste: bool = True


CHURN, TASTE, BOTH = Part(True, False), Part(False, True), Part(True, True)


@dataclass(frozen=True)
class Block:
    name: str
    churn: tuple[str, ...]
    taste: tuple[str, ...]
    build: Callable[[Tables, RunContext, RuleBook, Part], DataFrame]
    fills: dict = field(default_factory=dict)

    def columns(self, part: Part) -> tuple[str, ...]:
        return (self.churn if part.churn else ()) + (self.taste if part.taste else ())


class AtCutoff:
    """Restricts aggregates to rows up to the cutoff.

    If only the churn half is wanted the restriction is a row filter, which the scan can use;
    otherwise one scan serves both halves and the restriction moves into the aggregates.
    """

    def __init__(self, df: DataFrame, before: Column, part: Part) -> None:
        self._before = None if not part.taste else before
        self.df = df if part.taste else df.where(before)

    def __call__(self, value: Column | str) -> Column:
        c = F.col(value) if isinstance(value, str) else value
        return c if self._before is None else F.when(self._before, c)

    @property
    def rows(self) -> Column:
        return F.count(self(F.lit(1)))


def dealt(df: DataFrame, category: str) -> DataFrame:
    """Rows by player and part of the category, for a rollup to (user_id, _part, category) and then to players.

    Where few rows share a category, a map-side rollup sends as many rows as it reads, wider ones, and sends them
    again by player. Dealt once, rows travel narrow, and the second rollup sends PLAYER_PARTS rows a player at most.
    """
    part = F.pmod(F.xxhash64(category), F.lit(PLAYER_PARTS))
    return df.repartition("user_id", part).withColumn("_part", part)


def attach(left: DataFrame, block: Block, features: DataFrame, part: Part) -> DataFrame:
    """Left join a block and apply its fills; columns the left side already has win."""
    wanted = [c for c in block.columns(part) if c not in left.columns]
    joined = left.join(features.select("user_id", *wanted), "user_id", "left")
    return joined.select(*left.columns, *filled(wanted, block.fills))


def filled(columns: Iterable[str], fills: dict) -> list[Column]:
    return [
        F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c)
        for c in columns
    ]


def one_row_per_player(df: DataFrame) -> DataFrame:
    """Fail the query if a player occurs twice; the check rides on the key's own exchange."""
    others = [c for c in df.columns if c != "user_id"]
    counted = df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in others]
    )
    message = F.concat(F.lit("duplicate player id: "), F.col("user_id"))
    unique = F.when(F.col("_rows") == 1, F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean")
    )
    return counted.where(unique).select(*df.columns)
