"""The wide table: one row per player, every block left-joined on the player id.

Both sides of every join are already hash-partitioned by ``user_id``, so twelve blocks cost their
own aggregates' exchanges and none for the joins.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame

from tidemark.context import RunContext
from tidemark.operators import characters, collection, devices, feedback, items, logs, purchases
from tidemark.operators import rewards, users
from tidemark.operators.block import BOTH, CHURN, TASTE, Block, Part, attach, one_row_per_player
from tidemark.operators.sample import SAMPLE_COLUMNS, sample_expressions
from tidemark.operators.users import user_columns
from tidemark.rules import RuleBook
from tidemark.sources.canonical import Tables

SNAPSHOT_BLOCKS = (
    characters.BLOCK, devices.BLOCK, purchases.BLOCK, rewards.BLOCK, items.BLOCK,
    collection.BLOCK, feedback.BLOCK,
)
LOG_BLOCKS = (logs.CURRENCY, logs.FIGHTS, logs.ARENA)
ALL_BLOCKS = {b.name: b for b in (users.BLOCK, *SNAPSHOT_BLOCKS, *LOG_BLOCKS)}
# The derived features of the taste master, in output order.
DERIVED_COLUMNS = users.BLOCK.taste + sum(
    (b.taste for b in (
        collection.BLOCK, rewards.BLOCK, purchases.BLOCK, characters.BLOCK, items.BLOCK,
    )), ()
)


def features(
    name: str, sample: DataFrame, tables: Tables, ctx: RunContext, rules: RuleBook | None = None,
    part: Part = BOTH,
) -> DataFrame:
    """One block, completed to the sample."""
    block: Block = ALL_BLOCKS[name]
    part = Part(part.churn and bool(block.churn), part.taste and bool(block.taste))
    built = block.build(tables, ctx, rules or RuleBook(), part)
    return attach(sample.select("user_id"), block, built, part)


def derived_features(
    sample: DataFrame, tables: Tables, ctx: RunContext, rules: RuleBook | None = None
) -> DataFrame:
    """The reference-date features of the snapshot tables."""
    rules = rules or RuleBook()
    out = sample.select("user_id")
    for block in (users.BLOCK, *SNAPSHOT_BLOCKS):
        if block.taste:
            out = attach(out, block, block.build(tables, ctx, rules, TASTE), TASTE)
    return out.select("user_id", *DERIVED_COLUMNS)


def _base(tables: Tables, ctx: RunContext, part: Part, sample: DataFrame | None) -> DataFrame:
    """Sample and user columns. Without an own sample both come out of one users scan."""
    if sample is None:
        own = [c.alias(f"user_{n}") for n, c in sample_expressions(ctx).items()]
        return one_row_per_player(tables.users.select("user_id", *own, *user_columns(ctx, part)))
    prefixed = {c: f"user_{c}" for c in SAMPLE_COLUMNS if c != "user_id"}
    base = one_row_per_player(sample.withColumnsRenamed(prefixed))
    return attach(base, users.BLOCK, users.build(tables, ctx, RuleBook(), part), part)


def master(
    tables: Tables, ctx: RunContext, rules: RuleBook | None = None, part: Part = BOTH,
    sample: DataFrame | None = None, wanted: Collection[str] | None = None,
) -> DataFrame:
    """``part=CHURN`` gives the churn master, ``BOTH`` the taste master (a superset of it).

    With ``wanted`` only the blocks that supply one of these columns are planned at all.
    """
    rules = rules or RuleBook()

    def needed(block: Block, mine: Part) -> bool:
        return wanted is None or not set(wanted).isdisjoint(block.columns(mine))

    out = _base(tables, ctx, part, sample)
    for block in SNAPSHOT_BLOCKS:
        mine = Part(part.churn and bool(block.churn), part.taste and bool(block.taste))
        if (mine.churn or mine.taste) and needed(block, mine):
            out = attach(out, block, block.build(tables, ctx, rules, mine), mine)
    if part.taste:
        for block in (b for b in LOG_BLOCKS if needed(b, TASTE)):
            out = attach(out, block, block.build(tables, ctx, rules, TASTE), TASTE)
    return out


def churn_columns(master_columns: list[str]) -> list[str]:
    """The churn master's columns within a taste master."""
    taste = {c for b in ALL_BLOCKS.values() for c in b.taste}
    return [c for c in master_columns if c not in taste]


def churn_master(tables: Tables, ctx: RunContext, **options) -> DataFrame:
    return master(tables, ctx, part=CHURN, **options)


def taste_master(tables: Tables, ctx: RunContext, **options) -> DataFrame:
    return master(tables, ctx, part=BOTH, **options)
