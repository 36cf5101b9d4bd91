"""Risk bands, priorities and the churn x archetype crossing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.rules import RuleBook, literal_lookup


def archetype_name(code: Column, rules: RuleBook) -> Column:
    names = {k: name for k, (name, _) in rules.archetypes.items()}
    return F.when(code.isNull(), "N/A").otherwise(
        F.coalesce(literal_lookup(code, names), F.lit("Unknown"))
    )


def risk_level(prob: Column, rules: RuleBook) -> Column:
    """Half-open bands; the top one is closed, so that certainty is critical."""
    top = max(b.high for b in rules.risk_bands)
    out = F.lit(rules.risk_default)
    for band in reversed(rules.risk_bands):
        inside = (prob >= band.low) & (
            prob <= band.high if band.high == top else prob < band.high
        )
        out = F.when(inside, F.lit(band.name)).otherwise(out)
    return out


def priority(risk: Column, code: Column, rules: RuleBook) -> Column:
    """struct(priority, label) of the first matching rule."""

    def outcome(name: str, label: str) -> Column:
        return F.struct(F.lit(name).alias("priority"), F.lit(label).alias("label"))

    def rule(rest: Column, r) -> Column:
        cond = risk.isin(*r.risks)
        if r.archetypes is not None:
            cond = cond & code.isin(*r.archetypes)
        return F.when(cond, outcome(r.priority, r.label)).otherwise(rest)

    return reduce(rule, reversed(rules.priority_rules), outcome(*rules.priority_default))


def cross(predictions: DataFrame, archetypes: DataFrame, rules: RuleBook) -> DataFrame:
    """Players with both a score and an archetype row, with every derived column."""
    code = F.col("archetype_n1")
    joined = predictions.join(archetypes.select("user_id", "archetype_n1"), "user_id")
    out = joined.withColumns({
        "archetype_name": archetype_name(code, rules),
        "risk_level": risk_level(F.col("churn_prob_30d"), rules),
    })
    return out.withColumn("_rule", priority(F.col("risk_level"), code, rules))


def crossed_predictions(crossed: DataFrame) -> DataFrame:
    probs = [c for c in crossed.columns if c.startswith("churn_prob_")]
    return crossed.select("user_id", *probs, "archetype_n1", "archetype_name", "source")


def segmentation(crossed: DataFrame) -> DataFrame:
    return crossed.select(
        "user_id", "risk_level", F.col("archetype_name").alias("segment"),
        F.col("_rule.priority").alias("priority"), F.col("_rule.label").alias("label"),
    )
