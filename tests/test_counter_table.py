"""Counters by micro-batches: late rows, repeated batches, compaction, retention, late characters."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import by_key, oid
from tidemark.operators.characters import character_owners
from tidemark.operators.logs import fight_counts, fight_features
from tidemark.sources.canonical import prepare
from tidemark.streaming.counter_table import CounterTable
from tidemark.streaming.daily_counts import (
    daily_fights, fight_table, fights_from_counters, read_log_stream, start_fights,
)

KEYS = T.StructType([T.StructField("user_id", T.StringType())])
DAY = date(2026, 3, 1)


def day(n: int) -> date:
    return DAY + timedelta(days=n)


@pytest.fixture
def counters(spark, tmp_path):
    def add(table, batch, rows):
        table.add(spark.createDataFrame(rows, "user_id string, n long, day date"), batch)

    def make(**options):
        return CounterTable(spark, str(tmp_path / "counters"), KEYS, ("n",), **options)

    return make, add


def held(table, **span):
    return {(r.user_id, r.day): r.n for r in table.read(**span).collect()}


def folders(table, kind):
    return {p.name for p in (Path(table.folder) / kind).glob("*=*")}


def test_batches_add_up_and_a_repeated_batch_replaces_itself(counters):
    make, add = counters
    table = make(compact_every=3)
    assert held(table) == {}
    add(table, 0, [("a", 1, day(0)), ("b", 2, day(0)), (None, 4, day(1)), ("c", 9, None)])
    add(table, 1, [("a", 5, day(0))])
    add(table, 1, [("a", 5, day(0))])
    want = {("a", day(0)): 6, ("b", day(0)): 2, (None, day(1)): 4}
    assert held(table) == want and folders(table, "base") == set()
    add(table, 2, [("a", 1, day(2))])  # the third delta folds all
    want[("a", day(2))] = 1
    assert held(table) == want and folders(table, "deltas") == set() and folders(table, "base") == {"upto=2"}
    add(table, 2, [("a", 1, day(2))])  # repeated after it was folded
    assert held(table) == want
    for batch in (3, 4, 5):
        add(table, batch, [("b", 1, day(0))])  # late rows touch their own day only
    want[("b", day(0))] = 5
    assert held(table) == want
    root = Path(table.folder) / "base"
    assert {p.name for p in (root / "upto=5").glob("day=*")} == {f"day={day(0)}"}
    assert {p.name for p in (root / "upto=2").glob("day=*")} == {f"day={day(1)}", f"day={day(2)}"}
    assert held(table, first=day(1), last=day(1)) == {(None, day(1)): 4}


def test_an_unfinished_write_is_not_read(counters):
    make, add = counters
    table = make(compact_every=2)
    add(table, 0, [("a", 1, day(0))])
    add(table, 1, [("a", 2, day(0))])
    add(table, 2, [("a", 4, day(0))])
    root = Path(table.folder)
    for half in ("deltas/batch=3", "base/upto=3/day=2026-03-01"):
        (root / half).mkdir(parents=True)
        (root / half / "part-0.parquet").write_bytes(b"torn")
    assert held(table) == {("a", day(0)): 7}
    add(table, 3, [("a", 8, day(0))])  # the batch comes again and folds over the torn files
    assert held(table) == {("a", day(0)): 15} and folders(table, "deltas") == set()


def test_days_leave_after_the_retention(counters):
    make, add = counters
    table = make(compact_every=2, keep_days=10)
    add(table, 0, [("a", 1, day(0)), ("a", 2, day(5))])
    add(table, 1, [("a", 3, day(9))])
    add(table, 2, [("a", 4, day(14)), ("a", 100, day(2))])
    assert held(table) == {("a", day(5)): 2, ("a", day(9)): 3, ("a", day(14)): 4}
    add(table, 3, [("a", 1, day(5))])
    assert held(table) == {("a", day(5)): 3, ("a", day(9)): 3, ("a", day(14)): 4}
    found = {p.name for p in (Path(table.folder) / "base").glob("*/day=*")}
    assert found == {f"day={day(n)}" for n in (5, 9, 14)}


FIGHTS = "player_id string, fight_type string, fight_winner double, start_time double"
CHARACTERS = "_id string, user_id string, is_npc boolean, created_at timestamp"


def test_fights_in_a_stream_equal_the_batch(spark, ctx, tmp_path):
    at = datetime(2026, 2, 25)
    rows = [
        (oid(i % 13) if i % 17 else None, ("FIGHT_TYPE_ARENA", "FIGHT_TYPE_TOWER", None)[i % 3], float(i % 2) if i % 5 else None,
         (at + timedelta(hours=9 * i)).timestamp())
        for i in range(120)
    ]
    rows += [(oid(i), "FIGHT_TYPE_TOWER", 1.0, datetime(2026, 4, 4, 0, 0, s).timestamp()) for i in (1, 2) for s in (0, 1)]  # the edge of the window
    rows.append((oid(3), "FIGHT_TYPE_TOWER", 1.0, (at + timedelta(days=9)).timestamp()))  # arrives last, long after its day
    people = [(oid(c), oid(100 + c % 4), c == 12, at) for c in range(13)]
    characters = prepare("characters", spark.createDataFrame(people, CHARACTERS))
    owners = character_owners(characters)
    early = owners.where(F.col("char_id") < oid(6))
    src = str(tmp_path / "src")
    for batch in (rows[0::3], rows[1::3], rows[2:120:3], rows[120:]):
        spark.createDataFrame(batch, FIGHTS).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    table = fight_table(spark, str(tmp_path / "table"), compact_every=2)
    seen = []
    query = start_fights(read_log_stream(spark, src, schema, files_per_batch=1), lambda: seen.append(1) or early, table, str(tmp_path / "check"))
    query.awaitTermination()
    assert len(seen) == 4  # the characters are read again for each batch
    log = prepare("fights_log", spark.read.parquet(src))
    stored = {r.asDict()["char_id"] for r in table.read().collect()}
    assert stored == {None, *(oid(c) for c in range(6, 13))}
    got = by_key(fights_from_counters(table, owners, ctx))
    want = by_key(fight_features(fight_counts(log, owners, ctx)))
    assert got.keys() == want.keys() == {oid(100 + c) for c in range(4)}
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_counters_of_no_fights(spark, ctx, tmp_path):
    owners = spark.createDataFrame([], "char_id string, user_id string")
    table = fight_table(spark, str(tmp_path / "table"))
    table.add(daily_fights(prepare("fights_log", spark.createDataFrame([], FIGHTS)), owners), 0)
    table.compact()
    assert fights_from_counters(table, owners, ctx).count() == 0
