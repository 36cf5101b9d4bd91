"""Exact order statistics of any number of columns over any number of rows.

A global ``percentile`` holds every distinct value in one task. Here each pass counts rows in a
bounded number of value bins, and the next pass looks only inside the bin that holds the wanted
rank, until that bin has a single value. All columns and groups share their passes, so there are as
many as the hardest column needs. Only bin counts reach the driver (bins x brackets rows).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 2048


@dataclass(frozen=True)
class _Bracket:
    column: str
    group: object
    low: object
    high: object
    below: int  # rows of the group under ``low``


def _bin(v: Column, b: _Bracket) -> Column:
    """The bin of a value inside a bracket. An infinity has a bin of its own at either end.

    Values and bounds are halved before they are subtracted, so the spread of finite doubles stays finite.
    """
    if not isinstance(b.low, float):
        share = (v - F.lit(b.low)) / F.lit(float(b.high - b.low))
        return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
    finite = sys.float_info.max
    low, high = max(b.low, -finite), min(b.high, finite)
    half = high / 2 - low / 2
    if half:
        share = (v / 2 - F.lit(low / 2)) / F.lit(half)
        inner = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
    else:
        inner = F.when(v <= low, 0).otherwise(BINS - 1)
    return F.when(v == -math.inf, -1).when(v == math.inf, BINS).otherwise(inner)


@dataclass(frozen=True)
class Span:
    """The non-null rows of a column in a group, and its least and greatest value."""

    n: int
    low: object
    high: object


Key = tuple[str, object]  # (column, group); without groups the group is None


def spans_of(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict[Key, Span]:
    """The first pass of every selection, for all columns and groups at once."""
    aggs = [f(F.col(c)).alias(f"{i}{k}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    rows = df.agg(*aggs).collect() if by is None else df.groupBy(by).agg(*aggs).collect()
    return {
        (c, None if by is None else r[by]): Span(r[f"{i}n"], r[f"{i}lo"], r[f"{i}hi"])
        for r in rows for i, c in enumerate(columns)
    }


def ranked_columns(
    df: DataFrame, ranks: dict[Key, Sequence[int]], by: str | None = None, spans: dict[Key, Span] | None = None,
) -> dict[tuple[str, object, int], object]:
    """The values at the given 1-based ranks of every column and group of ``by`` (a handful of labels).

    Returns ``{(column, group, rank): value}``. Whole numbers stay whole, other columns are doubles.
    """
    columns = list(dict.fromkeys(c for c, _ in ranks))
    whole = {c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)}
    typed = [F.col(c).cast("bigint" if c in whole else "double").alias(f"_v{i}") for i, c in enumerate(columns)]
    values = df.select(*typed, *([F.col(by).alias("_by")] if by is not None else []))
    value = {c: F.col(f"_v{i}") for i, c in enumerate(columns)}
    spans = spans or spans_of(df, columns, by)
    found: dict[tuple[str, object, int], object] = {}
    open_: dict[_Bracket, list[int]] = {}

    def place(b: _Bracket, rank: int) -> None:
        if b.low == b.high:
            found[(b.column, b.group, rank)] = b.low
        else:
            open_.setdefault(b, []).append(rank)

    for (column, group), wanted in ranks.items():
        span = spans[(column, group)]
        kind = int if column in whole else float
        for r in wanted:
            if not 1 <= r <= span.n:
                raise ValueError(f"rank {r} outside 1..{span.n} of {column} for group {group!r}")
            place(_Bracket(column, group, kind(span.low), kind(span.high), 0), r)

    while open_:
        brackets = list(open_)
        cells = []
        for i, b in enumerate(brackets):
            v = value[b.column]
            inside = v.between(b.low, b.high)
            if by is not None:
                inside = inside & F.col("_by").eqNullSafe(F.lit(b.group))
            whole_value, other_value = (v, F.lit(None)) if b.column in whole else (F.lit(None), v)
            cells.append(F.when(inside, F.struct(
                F.lit(i).alias("b"), _bin(v, b).alias("s"), whole_value.cast("bigint").alias("w"), other_value.cast("double").alias("d")
            )))
        rows = (
            values.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
            .groupBy("c.b", "c.s")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min("c.w").alias("wlo"), F.max("c.w").alias("whi"), F.min("c.d").alias("dlo"), F.max("c.d").alias("dhi"),
            )
            .collect()
        )
        by_bracket: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r["s"]):
            low, high = (r["wlo"], r["whi"]) if r["wlo"] is not None else (r["dlo"], r["dhi"])
            by_bracket.setdefault(r["b"], []).append((r["n"], low, high))
        pending, open_ = open_, {}
        for i, b in enumerate(brackets):
            for rank in pending[b]:
                below = b.below
                for n, low, high in by_bracket[i]:
                    if rank <= below + n:
                        if (low, high) == (b.low, b.high) and len(by_bracket[i]) == 1:
                            raise ArithmeticError(f"no bin divides {b.low!r} to {b.high!r}")
                        place(_Bracket(b.column, b.group, low, high, below), rank)
                        break
                    below += n
    return found


def ranked_values(
    df: DataFrame, value: str, ranks: dict[object, Sequence[int]], by: str | None = None
) -> dict[tuple[object, int], object]:
    """``{(group, rank): value}`` of one column; without ``by`` the group is None."""
    found = ranked_columns(df, {(value, g): r for g, r in ranks.items()}, by)
    return {(g, r): v for (_, g, r), v in found.items()}


def column_percentiles(
    df: DataFrame, probs: dict[str, Sequence[float]], by: str | None = None
) -> dict[Key, list[float | None]]:
    """Percentiles with linear interpolation between neighbouring ranks, per column and group.

    The same values as exact ``percentile`` aggregates of the non-null values; None where there are none.
    ``df`` is scanned once per pass, so hand in staged or cached columns, not a long plan.
    """
    spans = spans_of(df, list(probs), by)
    ranks: dict[Key, set[int]] = {}
    for (column, group), span in spans.items():
        for p in probs[column] if span.n else ():
            pos = p * (span.n - 1)
            ranks.setdefault((column, group), set()).update({math.floor(pos) + 1, math.ceil(pos) + 1})
    values = ranked_columns(df, {k: sorted(r) for k, r in ranks.items()}, by, spans) if ranks else {}
    out: dict[Key, list[float | None]] = {}
    for (column, group), span in spans.items():
        row: list[float | None] = []
        for p in probs[column]:
            if not span.n:
                row.append(None)
                continue
            pos = p * (span.n - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            a, b = (float(values[(column, group, i + 1)]) for i in (lo, hi))
            row.append(a if lo == hi or a == b else (hi - pos) * a + (pos - lo) * b)
        out[(column, group)] = row
    return out


def percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: str | None = None
) -> dict[object, list[float | None]]:
    """``column_percentiles`` of one column, by group."""
    return {g: row for (_, g), row in column_percentiles(df, {value: probs}, by).items()}
