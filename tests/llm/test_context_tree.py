"""The context tree held by windows against the whole tree in memory."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ctw


def whole_tree(texts, depth, least):
    counts = [Counter() for _ in range(depth + 1)]
    for t in texts:
        data = b"\n" * depth + b" ".join(t.encode().lower().split()) + b"\n"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                counts[d][int.from_bytes(data[i - d : i], "big"), data[i]] += 1
    keys, tables = [], []
    for d, c in enumerate(counts):
        total = Counter()
        for (context, _), n in c.items():
            total[context] += n
        own = sorted(k for k, n in total.items() if n >= least or not d)
        keys.append(np.array(own, np.uint64))
        tables.append(np.array([[c[k, b] for b in range(256)] for k in own], float))
    return ctw.ContextTree(depth, keys, tables)


def texts_of(n):
    rng = random.Random(6)
    return [" ".join(rng.choice(["ta", "kori", "men", "the", "of", "under"]) + rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(n)] + ["\u00e9\u4e2d zq"]


def test_chunks_end_where_the_first_column_changes(monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK", 4)
    near = np.array([1, 1, 2, 2, 2, 2, 2, 2, 3, 4, 4, 5])
    batches = [pa.RecordBatch.from_arrays([pa.array(near[a : a + 3]), pa.array(np.arange(a, a + 3))], ["near", "gram"]) for a in range(0, 12, 3)]
    found = list(ctw._chunks(batches))
    assert np.concatenate([c[1] for c in found]).tolist() == list(range(12)) and len(found) > 1
    assert all(a[0][-1] != b[0][0] for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_scores_match_the_whole_tree(spark, hot, monkeypatch):
    monkeypatch.setattr(ctw.window_scores, "__defaults__", (ctw.DEPTH, hot))
    texts = texts_of(60)
    rows = {r.doc_id: r for r in ctw.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    tree = whole_tree([t for i, t in enumerate(texts) if not rows[i].held_out], ctw.DEPTH, 2)
    for i, t in enumerate(texts):
        data = np.frombuffer(b"\n" * ctw.DEPTH + b" ".join(t.encode().lower().split()) + b"\n", np.uint8)
        assert math.isclose(rows[i].score, tree.logs(data).sum(), rel_tol=1e-4), i


def test_rare_contexts_of_a_large_corpus_stand_in_the_tree(spark):
    """Contexts seen 6 times among more than 6 x 65,536 bytes are mixed like any others."""
    rng = random.Random(2)
    words = ["".join(rng.choices("bcdghjkmqtvxyz", k=24)) for _ in range(12)]
    texts = ["filler words of no use " * 2_000] * 9 + [w for w in words for _ in range(6)] + [words[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in ctw.score(docs, folds=10**9, fold=10**8).collect()}[len(texts) - 1]
    data = np.frombuffer(b"\n" * ctw.DEPTH + words[0].encode() + b"\n", np.uint8)
    assert math.isclose(got, whole_tree(texts, ctw.DEPTH, 2).logs(data).sum(), rel_tol=1e-3)


def test_a_window_table_finds_what_it_holds_and_texts_share_no_windows():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 1 << 56, 5_000))
    for n in (0, 1, 7, 4_000):
        table = ctw.WindowTable(grams[:n], np.arange(n) / 2)
        at = table.find(grams.view(np.uint64))
        assert (at[:n] >= 0).all() and (at[n:] < 0).all() and (table.values[at[:n]] == np.arange(n) / 2).all()
    texts, pad = [b"x\n", b"abcdefghij" * 5 + b"\n", b"\n", b"yz\n"], b"\n" * 6
    want = [(i, int.from_bytes((pad + t)[k : k + 7], "big")) for i, t in enumerate(texts) for k in range(len(t))]
    for size in (1, 9, 10_000):
        got = [(int(i), int(g)) for owner, grams in ctw._windows(texts, pad, size) for i, g in zip(owner, grams, strict=True)]
        assert got == want


def test_window_rows_travel_together(spark, monkeypatch):
    """Rows of windows that are not broadcast leave a task in batches of many texts, not in one batch a text."""
    sent = []
    real = ctw.batches_of
    monkeypatch.setattr(ctw, "batches_of", lambda names, *columns: sent.append(len(columns[0])) or real(names, *columns))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(100))], "row_key bigint, text string")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, run, schema: [*run(iter(df.toArrow().to_batches()))] and spark.createDataFrame([], schema))
    ctw.window_scores(rows, spark.createDataFrame([], "gram bigint, seen bigint, log10 double"))
    assert len(sent) <= 8 and sum(sent) > 1_000


def test_windows_are_counted_in_training_and_in_all_text(spark):
    """A window is counted in all text and in training text, also where both have it."""
    rows = spark.createDataFrame([("the same words", False), ("the same words", True), ("others", True)], "text string, held_out boolean").coalesce(1)
    counted = ctw.count_windows(rows)
    found = {r.gram: (r.seen, r.learnt) for r in counted.collect()}
    data = b"\n" * 6 + b"the same words\n"
    for i in range(len(data) - 6):
        assert found[int.from_bytes(data[i : i + 7], "big")] == (2, 1)
    assert sorted(set(found.values())) == [(1, 0), (2, 1)]
