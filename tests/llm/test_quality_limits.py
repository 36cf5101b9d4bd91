"""Thresholds of rare languages and of short texts."""

from __future__ import annotations

import random

from tidemark.llm import kneser_ney


def test_a_rare_language_and_short_texts_have_their_own_thresholds(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney.trusted_rows, "__defaults__", (*kneser_ney.trusted_rows.__defaults__[:-1], 200))
    rng = random.Random(3)
    text = lambda stock, n: " ".join("".join(rng.choices(stock, k=3)) for _ in range(n))
    common, rare = ["ta", "ko", "ri", "men", "sol"], ["\u0436\u0443", "\u0448\u044b", "\u0449\u0430", "\u044d\u0444", "\u044e\u0446", "\u0431\u044a"]
    rows = [(i, text(common, 40), "en") for i in range(6_000)] + [(i, text(rare, 40), "xx") for i in range(6_000, 6_400)]
    rows += [(i, text(common, 6), "en") for i in range(6_400, 7_400)] + [(7_400, "@#%$ZQ!^&*" * 4, "en"), (7_401, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(7_400)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert len({got[0].threshold, got[6_000].threshold, got[6_400].threshold}) == 3
    assert sum(got[i].kept for i in range(6_000, 6_400)) >= 390
    assert sum(got[i].kept for i in range(6_400, 7_400)) >= 980
    assert not got[7_400].kept and got[7_401].kept


def test_all_trusted_rows_train_or_judge(spark):
    rows = [(i, f"text {i}", "en") for i in range(25_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25_000)], "doc_id bigint, quality int, toxic int")
    got = [r.train for r in kneser_ney.trusted_rows(docs, labels).collect()]
    assert len(got) == 25_000 and 4_500 < got.count(False) < 5_500


def test_ids_that_are_shuffled_give_the_same_verdicts(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices(["ta", "ko", "ri"], k=3)) for _ in range(20)), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    near = {r.doc_id: (round(r.perplexity, 9), r.kept) for r in kneser_ney.classify(docs, labels).collect()}
    monkeypatch.setattr(kneser_ney, "BROADCAST_IDS", 0)
    assert {r.doc_id: (round(r.perplexity, 9), r.kept) for r in kneser_ney.classify(docs, labels).collect()} == near
