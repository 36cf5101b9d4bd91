"""Code tables for consumers of the outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.rules import AXES, SOURCE_CODES, RuleBook


def archetype_dim(spark: SparkSession, rules: RuleBook) -> DataFrame:
    rows = [(code, name, weight) for code, (name, weight) in rules.archetypes.items()]
    return spark.createDataFrame(rows, "code int, name string, business_priority string")


def action_dim(spark: SparkSession, rules: RuleBook) -> DataFrame:
    """Actions by priority: their place in the order of evaluation."""
    rows = [
        (code, rules.actions[code], place)
        for place, code in enumerate(rules.action_order, start=1) if code in rules.actions
    ]
    return spark.createDataFrame(rows, "cod string, label string, prioridad int")


def axis_dim(spark: SparkSession) -> DataFrame:
    rows = [(axis, tier2, list(values)) for axis, (tier2, values) in AXES.items()]
    return spark.createDataFrame(rows, "eje string, requiere_tier2 boolean, valores array<string>")


def source_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCE_CODES.items()), "code string, description string")


def dictionary(rules: RuleBook, model_version: str) -> dict:
    """The same tables as one document."""
    return {
        "version": "2.0",
        "model_version": model_version,
        "archetype_n1": {
            str(c): {"code": c, "name": n, "business_priority": w}
            for c, (n, w) in rules.archetypes.items()
        },
        "ejes_gusto": {
            a: {"requiere_tier2": t, "valores": list(v)} for a, (t, v) in AXES.items()
        },
        "countermeasures": {
            c: {"cod": c, "label": rules.actions[c], "prioridad": i}
            for i, c in enumerate(rules.action_order, start=1) if c in rules.actions
        },
        "source_codes": dict(SOURCE_CODES),
    }
