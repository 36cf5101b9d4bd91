"""Rules from a document: defaults, changed thresholds, conditions, and every fault at once."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import by_key
from tidemark.operators.segment import priority, risk_level
from tidemark.operators.taste import assign_actions
from tidemark.rule_document import (
    RuleError, load_rules, packaged_rules, parse_rules, save_rules, to_document,
)
from tidemark.rules import RuleBook

BOOK = RuleBook()


def test_the_defaults_survive_a_document(spark, tmp_path):
    assert parse_rules({}) == BOOK
    assert parse_rules(json.loads(json.dumps(to_document(BOOK)))) == BOOK
    strict = packaged_rules("strict_rules.json")
    save_rules(spark, strict, str(tmp_path / "rules"))
    assert load_rules(spark, str(tmp_path / "rules")) == strict != BOOK
    (tmp_path / "by_hand.json").write_text(json.dumps({"high_risk": 0.8}, indent=2))
    assert load_rules(spark, str(tmp_path / "by_hand.json")).high_risk == 0.8


def test_a_changed_threshold_needs_no_code(spark):
    book = parse_rules({
        "risk_bands": [{"name": "high", "low": 0.5, "high": 1}, {"name": "low", "low": 0, "high": 0.5}],
        "risk_default": "low",
        "priority_rules": [{"risks": ["high"], "archetypes": [3], "priority": "A", "label": "a"}, {"risks": ["high"], "priority": "B", "label": "b"}],
        "priority_default": {"priority": "C", "label": "c"},
    })
    df = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate([(0.5, 3), (1.0, 1), (0.49, 3), (None, 3), (0.9, None)])], "i int, p double, c int")
    risk = risk_level(F.col("p"), book)
    got = by_key(df.select("i", risk.alias("risk"), priority(risk, F.col("c"), book).alias("r")), "i")
    assert [got[i]["risk"] for i in range(5)] == ["high", "high", "low", "low", "high"]
    assert [got[i]["r"].priority for i in range(5)] == ["A", "B", "C", "C", "B"]


def test_conditions_of_actions(spark):
    book = parse_rules({
        "actions": {"X1": "first", "X2": "second"}, "action_order": ["X1", "X2"], "action_fallback": "X2",
        "action_conditions": {"X1": {"any": [{"all": [{"monetizacion": ["pagador"]}, {"not": {"arquetipo_n1": ["a", "b"]}}]}, {"has_tier2": [1]}]},
                              "X2": {"perfil_oro": ["neutro"]}},
    })
    rows = [(0, "pagador", "c", 0), (1, "pagador", "a", 0), (2, "no_pagador", "c", 1), (3, "pagador", None, 0), (4, None, None, None)]
    axes = spark.createDataFrame(rows, "i int, monetizacion string, arquetipo_n1 string, has_tier2 int")
    for c in ("clase_favorita", "estilo_build", "perfil_enhance", "perfil_coleccion", "pvp_perfil", "perfil_oro"):
        axes = axes.withColumn(c, F.lit(None).cast("string"))
    got = by_key(assign_actions(axes, book), "i")
    assert [got[i]["contramedida_primaria_cod"] for i in range(5)] == ["X1", "X2", "X1", "X1", "X2"]
    assert got[0]["contramedida_primaria_label"] == "first"


@pytest.mark.parametrize(("document", "faults"), [
    ({"risk_bands": [{"name": "a", "low": 0, "high": 0.6}, {"name": "b", "low": 0.5, "high": 1}]},
     ["'a' and 'b' overlap", "no risk band is named 'very_low'", "the bands lack"]),
    ({"risk_bands": [{"name": "very_low", "low": 0.1, "high": 0.4}, {"name": "very_low", "low": 0.5, "high": 1.2}]},
     ["stands twice", "nothing covers 0.4 to 0.5", "must cover 0 to 1", "between 0 and 1"]),
    ({"risk_bands": []}, ["must not be empty"]),
    ({"priority_rules": [{"risks": ["mad"], "archetypes": [9], "priority": "P", "label": 3, "more": 1}]},
     ["named 'mad'", "code 9", "label: must be a text", "unknown entry 'more'"]),
    ({"action_order": ["CM01", "CM01", "CM77"], "action_fallback": "CM78"}, ["'CM77'", "twice", "'CM78'"]),
    ({"action_conditions": {"CM77": {"colour": ["red"]}, "CM01": {"perfil_oro": ["x"]}, "CM02": {"all": [], "any": []}, "CM03": {"not": {"has_tier2": []}}}},
     ["'CM77'", "named 'colour'", "'x' is no value", "exactly one entry", "must name a value"]),
    ({"drift_threshold": "0.1", "high_risk": 2, "thresholds": {"build_t33": 2, "other": 1}, "typo": {}},
     ["drift_threshold: must be a number", "high_risk: must be between", "build_t33 must not be above", "unknown entry 'other'", "unknown entry 'typo'"]),
    ({"active": {"churn": "", "other": "v"}, "archetypes": {"x": {}}, "class_names": []}, ["active.churn", "unknown entry 'other'", "'x' is no whole number", "class_names: must be an object"]),
    ([], ["document: must be an object"]),
])
def test_every_fault_is_named(document, faults):
    with pytest.raises(RuleError) as e:
        parse_rules(document)
    for text in faults:
        assert text in str(e.value)


def test_no_json(spark, tmp_path):
    (tmp_path / "rules.json").write_text("{")
    with pytest.raises(RuleError, match="no JSON"):
        load_rules(spark, str(tmp_path / "rules.json"))
