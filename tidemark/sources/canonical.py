"""Raw exports -> typed tables with clean ids and timestamps.

``prepare`` is a projection: a missing optional column becomes a typed null, NaN becomes null
(Spark orders NaN above every number, so it must never reach a comparison), times become
timestamps. Nothing is materialised; the scan keeps only the columns a query ends up using.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ids
from tidemark.functions.numbers import no_nan
from tidemark.functions.times import unix_seconds_to_ts
from tidemark.sources.catalog import READS

# Time formats tried after the ISO forms, in this order.
EXTRA_TIME_FORMATS = ("yyyy/MM/dd HH:mm:ss", "yyyyMMdd'T'HHmmss'Z'")

SQL_TYPES = {
    "string": "string", "keep": "string", "number": "double", "whole": "bigint",
    "bool": "boolean", "ts": "timestamp", "unix": "timestamp", "unix_positive": "timestamp",
    "id_raw": "string", "id_strict": "string", "id_hex": "string",
}


def _number(c: Column, have: T.DataType) -> Column:
    if isinstance(have, T.StringType):
        return no_nan(c.try_cast("double"))
    if isinstance(have, (T.DoubleType, T.FloatType)):
        return no_nan(c.cast("double"))
    return c.cast("double")


def _time(c: Column, have: T.DataType) -> Column:
    if isinstance(have, T.StringType):
        tries = [c.try_cast("timestamp")]
        tries += [F.try_to_timestamp(c, F.lit(f)) for f in EXTRA_TIME_FORMATS]
        return F.coalesce(*tries)
    return c.cast("timestamp")


def typed(c: Column, have: T.DataType, kind: str) -> Column:
    """One raw column as the kind the operators expect; unreadable values become null."""
    if kind == "keep":
        return c
    if kind == "string":
        return c.cast("string")
    if kind == "bool":
        return c.try_cast("boolean") if isinstance(have, T.StringType) else c.cast("boolean")
    if kind == "whole":
        if isinstance(have, T.IntegralType):
            return c.cast("bigint")
        return F.floor(_number(c, have)).cast("bigint")
    if kind == "number":
        return _number(c, have)
    if kind == "ts":
        return _time(c, have)
    if kind in ("unix", "unix_positive"):
        if isinstance(have, (T.TimestampType, T.TimestampNTZType)):
            return c.cast("timestamp")
        seconds = _number(c, have)
        if kind == "unix_positive":
            seconds = F.when(seconds > 0, seconds)
        return unix_seconds_to_ts(seconds)
    rule = {
        "id_raw": ids.wrapped_or_raw,
        "id_strict": ids.wrapped_or_strict,
        "id_hex": ids.first_hex_run,
    }[kind]
    return rule(c.cast("string"))


def prepare(name: str, raw: DataFrame) -> DataFrame:
    """The typed form of one input table."""
    have = {f.name: f.dataType for f in raw.schema.fields}
    cols = []
    for col, kind in READS[name].items():
        if col in have:
            cols.append(typed(F.col(f"`{col}`"), have[col], kind).alias(col))
        else:
            cols.append(F.lit(None).cast(SQL_TYPES[kind]).alias(col))
    if name == "users":
        return _users(raw, have, cols)
    # The raw null test reaches the scan. An id without a readable part becomes null here and
    # meets no player later; testing the cleaned id instead would clean every id twice.
    key = {"fights_log": "player_id", "arena_log": "attacker_id"}.get(name, "user_id")
    out = raw.where(F.col(key).isNotNull()).select(*cols)
    if name == "characters":
        out = out.where(~F.coalesce(F.col("is_npc"), F.lit(False)))
    return out


def _users(raw: DataFrame, have: dict, cols: list[Column]) -> DataFrame:
    if "_id" not in have:  # the first column holds the id then
        first = raw.columns[0]
        cols = [typed(F.col(f"`{first}`"), have[first], "id_strict").alias("_id"), *cols[1:]]
    times = []
    for col, kind in (("created_at", "ts"), ("updated_at", "ts"), ("last_login_date", "unix")):
        got = typed(F.col(col), have[col], kind) if col in have else F.lit(None).cast("timestamp")
        times.append(got.alias(col.replace("_at", "").replace("_date", "") + "_ts"))
    return (
        raw.select(*cols, *times).withColumnRenamed("_id", "user_id")
        .where(F.col("user_id").isNotNull())
    )


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A missing table: the full schema, no rows."""
    raw = spark.createDataFrame([], ", ".join(
        f"`{c}` {SQL_TYPES[k]}" for c, k in READS[name].items()
    ))
    return prepare(name, raw)


class Tables:
    """The twelve prepared inputs of a run, each built on first use and shared afterwards.

    A table that is missing from ``raw`` is an empty one with the full schema.
    """

    def __init__(self, spark: SparkSession, raw: Mapping[str, DataFrame]) -> None:
        self._spark, self._raw, self._ready = spark, raw, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in READS:
            raise AttributeError(name)
        if name not in self._ready:
            self._ready[name] = (
                prepare(name, self._raw[name]) if name in self._raw else empty(self._spark, name)
            )
        return self._ready[name]
