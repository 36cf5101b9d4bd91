"""Incremental activity counters: the log features without rescanning the logs.

Every micro-batch is folded to daily counters, which are added to a ``CounterTable``. Sums of a
batch need no state between batches, and a late row adds to its own day however late it is, until
that day leaves the retention. The 30 day features read that compact table.

Fights name a character. A batch looks its characters up in the character table as it is then; the
counters of characters that are not there yet keep the character's id and are looked up when read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.context import RunContext
from tidemark.functions.numbers import flag
from tidemark.operators.logs import currency_features, fight_features
from tidemark.sources.canonical import prepare
from tidemark.sources.staging import staging_path
from tidemark.streaming.counter_table import CounterTable


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


CURRENCY_KEYS = _strings("user_id", "concept", "currency")
CURRENCY_COUNTS = ("n", "n_in", "n_out")
FIGHT_KEYS = _strings("user_id", "char_id", "fight_type")
FIGHT_COUNTS = ("n", "n_won")


def _with_midnight(counts: tuple[str, ...]) -> tuple[str, ...]:
    """Each count also over the rows of 00:00 sharp: the log window ends with that instant of its last day."""
    return (*counts, *(f"midnight_{c}" for c in counts))


def _counted(at: Column, **counts: Column) -> list[Column]:
    sharp = at == F.date_trunc("day", at)
    zero = F.lit(0).cast("bigint")
    return [F.sum(c).alias(n) for n, c in counts.items()] + [
        F.sum(F.when(sharp, c).otherwise(zero)).alias(f"midnight_{n}") for n, c in counts.items()
    ]


def daily_counters(log: DataFrame) -> DataFrame:
    """Counters of a prepared currency log."""
    return (
        log.groupBy("user_id", F.to_date("created_at").alias("day"), "concept", "currency")
        .agg(*_counted(
            F.col("created_at"), n=F.lit(1), n_in=flag(F.col("quantity") > 0), n_out=flag(F.col("quantity") < 0),
        ))
    )


def daily_fights(log: DataFrame, owners: DataFrame) -> DataFrame:
    """Counters of a prepared fight log: per owner, or per character while it has none.

    Rows are folded per character before the lookup, which shuffles characters, not fights.
    """
    per_char = (
        log.where(F.col("player_id").isNotNull())
        .groupBy(F.col("player_id").alias("char_id"), F.to_date("start_time").alias("day"), "fight_type")
        .agg(*_counted(F.col("start_time"), n=F.lit(1), n_won=flag(F.col("fight_winner") == 1.0)))
    )
    return owned_fights(per_char.withColumn("user_id", F.lit(None).cast("string")), owners)


def owned_fights(counters: DataFrame, owners: DataFrame) -> DataFrame:
    """Look up the characters of counters that have no owner yet."""
    known = owners.select(F.col("char_id").alias("owned"), F.col("user_id").alias("owner"))
    looked = counters.join(known, F.col("char_id") == F.col("owned"), "left")
    user = F.coalesce("user_id", "owner")
    return (
        looked.groupBy(user.alias("user_id"), F.when(user.isNull(), F.col("char_id")).alias("char_id"), "fight_type", "day")
        .agg(*[F.sum(c).alias(c) for c in _with_midnight(FIGHT_COUNTS)])
    )


def read_log_stream(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None, glob: str = "*"
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def currency_table(spark: SparkSession, folder: str, keep_days: int | None = None, compact_every: int = 8) -> CounterTable:
    return CounterTable(spark, folder, CURRENCY_KEYS, _with_midnight(CURRENCY_COUNTS), compact_every, keep_days)


def fight_table(spark: SparkSession, folder: str, keep_days: int | None = None, compact_every: int = 8) -> CounterTable:
    return CounterTable(spark, folder, FIGHT_KEYS, _with_midnight(FIGHT_COUNTS), compact_every, keep_days)


def _start(raw_stream: DataFrame, fold: Callable[[DataFrame], DataFrame], table: CounterTable, checkpoint: str) -> StreamingQuery:
    """Fold everything that is available and stop; rerun (or use another trigger) to go on."""
    return (
        raw_stream.writeStream.foreachBatch(lambda batch, number: table.add(fold(batch), number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def start_counters(raw_stream: DataFrame, table: CounterTable, checkpoint: str) -> StreamingQuery:
    """A raw currency log into its counters."""
    return _start(raw_stream, lambda b: daily_counters(prepare("currency_transactions", b)), table, checkpoint)


def start_fights(
    raw_stream: DataFrame, owners: Callable[[], DataFrame], table: CounterTable, checkpoint: str
) -> StreamingQuery:
    """A raw fight log into its counters. ``owners`` gives (char_id, user_id) as of each batch."""
    return _start(raw_stream, lambda b: daily_fights(prepare("fights_log", b), owners()), table, checkpoint)


def run_counters(spark: SparkSession, raw_stream: DataFrame, label: str) -> CounterTable:
    """One availableNow run of a currency log into a fresh table of the shared folder."""
    root = staging_path(spark, label)
    table = currency_table(spark, f"{root}/counters", compact_every=3)
    start_counters(raw_stream, table, f"{root}/checkpoint").awaitTermination()
    return table


def run_fights(
    spark: SparkSession, raw_stream: DataFrame, owners: DataFrame, label: str, keep_days: int | None = None
) -> CounterTable:
    root = staging_path(spark, label)
    table = fight_table(spark, f"{root}/counters", keep_days, compact_every=3)
    start_fights(raw_stream, lambda: owners, table, f"{root}/checkpoint").awaitTermination()
    return table


def _inside(table: CounterTable, ctx: RunContext, counts: tuple[str, ...]) -> DataFrame:
    """Counters of the closed log window: whole days, and the first instant of the reference day."""
    rows = table.read(ctx.reference_date - timedelta(days=ctx.window_days), ctx.reference_date)
    last = F.col("day") == F.lit(ctx.reference_date)
    inside = {c: F.when(last, F.col(f"midnight_{c}")).otherwise(F.col(c)) for c in counts}
    return rows.withColumns(inside).where(F.col("n") > 0)


def _per_dimension(counters: DataFrame, dims: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """(user_id, dim, category, sums): counters of every dimension in one pass."""
    sets = counters.groupingSets([["user_id", d] for d in dims], "user_id", *dims).agg(
        *[F.grouping(d).alias(f"no_{d}") for d in dims], *[F.sum(s).alias(s) for s in sums]
    )
    dim = F.lit(dims[-1])
    for d in reversed(dims[:-1]):
        dim = F.when(F.col(f"no_{d}") == 0, F.lit(d)).otherwise(dim)
    return sets.withColumn("dim", dim)


def features_from_counters(table: CounterTable, ctx: RunContext) -> DataFrame:
    """The currency features of the log window, from the counters alone."""
    sets = _per_dimension(_inside(table, ctx, CURRENCY_COUNTS), ("concept", "currency", "day"), CURRENCY_COUNTS)
    return currency_features(sets, ctx)


def fights_from_counters(table: CounterTable, owners: DataFrame, ctx: RunContext) -> DataFrame:
    """The fight features of the log window, from the counters and the characters as they are now."""
    owned = owned_fights(_inside(table, ctx, FIGHT_COUNTS), owners).where(F.col("user_id").isNotNull())
    return fight_features(_per_dimension(owned, ("fight_type", "day"), FIGHT_COUNTS))
