"""Taste axes and the recommended action: column rules over the taste master."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import flag
from tidemark.rules import (
    ACTION_LABEL_DEFAULT, AXES, CLASS_DEFAULT, RuleBook, literal_lookup,
)

UNIVERSAL_FEATURES = (
    "char_class_main", "items_attack_defense_ratio", "iap_trial_only", "iap_is_payer",
    "reward_has_ad", "items_max_enhance_level", "pct_items_high_enhance",
    "items_redundancy_ratio", "coll_total_items",
)
RECENT_FEATURES = (
    "fights_pct_pvp", "fights_pct_won", "currency_pct_inflow", "currency_pct_outflow",
)
TASTE_COLUMNS = (
    "has_tier2", *AXES, "contramedida_primaria_cod", "contramedida_primaria_label",
)
# fixed values: axis thresholds that are not fitted
ENHANCE_ABOVE, REDUNDANCY_ABOVE = 2, 1.5
PVP_SHARE_ABOVE, WON_SHARE_BELOW = 0.3, 0.3
INFLOW_ABOVE, OUTFLOW_ABOVE = 0.85, 0.25


def axis_expressions(rules: RuleBook) -> dict[str, Column]:
    """Every axis as an expression over the features and ``has_tier2``.

    Missing features are null here, never NaN, so an unknown comparison falls through a CASE.
    """
    t = rules.thresholds
    col = F.col
    recent = col("has_tier2") == 1
    class_code = F.coalesce(col("char_class_main"), F.lit(0)).cast("int")
    ratio_ = col("items_attack_defense_ratio")
    zero = F.lit(0.0)
    frustrated = (F.coalesce(col("fights_pct_pvp"), zero) > PVP_SHARE_ABOVE) & (
        F.coalesce(col("fights_pct_won"), zero) < WON_SHARE_BELOW
    )
    return {
        "clase_favorita": F.coalesce(
            literal_lookup(class_code, rules.class_names), F.lit(CLASS_DEFAULT)
        ),
        "estilo_build": F.when(ratio_ >= t.build_t67, "agresivo")
        .when(ratio_ <= t.build_t33, "tanque").otherwise("equilibrado"),
        "monetizacion": F.when(col("iap_trial_only") == 1, "trial_no_convertido")
        .when(col("iap_is_payer") == 1, "pagador")
        .when(col("reward_has_ad") == 1, "no_pagador_ads").otherwise("no_pagador"),
        "perfil_enhance": F.when(
            (col("items_max_enhance_level") > ENHANCE_ABOVE) | (col("pct_items_high_enhance") > 0),
            "inversor",
        ).otherwise("no_inversor"),
        "perfil_coleccion": F.when(
            (col("items_redundancy_ratio") > REDUNDANCY_ABOVE)
            | (col("coll_total_items") > t.collection_p75),
            "coleccionista",
        ).otherwise("funcional"),
        # 'null' is a legal value of these two axes: the player has no recent activity.
        "pvp_perfil": F.when(~recent, "null").when(frustrated, "pvp_frustrado")
        .otherwise("pve_focus"),
        "perfil_oro": F.when(~recent, "null")
        .when(col("currency_pct_inflow") > INFLOW_ABOVE, "acumulador")
        .when(col("currency_pct_outflow") > OUTFLOW_ABOVE, "gastador").otherwise("neutro"),
    }


def taste_axes(master: DataFrame, archetypes: DataFrame, rules: RuleBook) -> DataFrame:
    """user_id, arquetipo_n1 (name), has_tier2 and the seven axes."""
    for c in RECENT_FEATURES:
        if c not in master.columns:
            master = master.withColumn(c, F.lit(None).cast("double"))
    wanted = master.select("user_id", *UNIVERSAL_FEATURES, *RECENT_FEATURES)
    joined = wanted.join(archetypes.select("user_id", "archetype_n1"), "user_id", "left")
    names = {k: name for k, (name, _) in rules.archetypes.items()}
    return (
        joined.withColumns({
            "arquetipo_n1": literal_lookup(F.col("archetype_n1"), names),
            "has_tier2": flag(F.coalesce(*RECENT_FEATURES).isNotNull()),
        })
        .withColumns(axis_expressions(rules))
        .select("user_id", "arquetipo_n1", "has_tier2", *AXES)
    )


def action_rules(rules: RuleBook) -> dict[str, Column]:
    """Trigger per action code. Names missing from the rule book simply never match."""
    col = F.col
    name = {code: n for code, (n, _) in rules.archetypes.items()}
    newcomer, active, hardcore, specialist, dormant, investor = (name.get(i) for i in range(6))
    who, pays = col("arquetipo_n1"), col("monetizacion")

    def among(*names: str | None) -> Column:
        return F.coalesce(who.isin(*[n for n in names if n is not None]), F.lit(False))

    recent, payer = col("has_tier2") == 1, pays == "pagador"
    return {
        "CM01": among(hardcore) & payer,
        # A player without archetype is "not hardcore" too.
        "CM02": payer & ~among(hardcore),
        "CM03": pays == "trial_no_convertido",
        "CM04": among(specialist, investor) & ~payer,
        "CM05": col("perfil_enhance") == "inversor",
        "CM06": (col("perfil_coleccion") == "coleccionista") & among(active, specialist, investor),
        "CM07": col("estilo_build").isin("agresivo", "tanque") & among(active, hardcore),
        "CM08": pays == "no_pagador_ads",
        "CM09": among(dormant) & (pays == "no_pagador"),
        "CM10": recent & (col("perfil_oro") == "acumulador"),
        "CM11": recent & (col("pvp_perfil") == "pvp_frustrado"),
        "CM12": among(newcomer),
    }


def compile_condition(condition: dict) -> Column:
    """A condition of a rule document (see ``rule_document``) over the axes; unknown is false."""
    (name, part), = condition.items()
    if name == "all":
        return reduce(lambda a, b: a & b, map(compile_condition, part), F.lit(True))
    if name == "any":
        return reduce(lambda a, b: a | b, map(compile_condition, part), F.lit(False))
    if name == "not":
        return ~compile_condition(part)
    return F.coalesce(F.col(name).isin(*part), F.lit(False))


def assign_actions(
    axes: DataFrame, rules: RuleBook,
    triggers: Callable[[RuleBook], dict[str, Column]] = action_rules,
) -> DataFrame:
    """The first matching action in the configured order; the fallback covers the rest."""
    known = triggers(rules) | {code: compile_condition(c) for code, c in rules.action_conditions.items()}
    order = [c for c in rules.action_order if c in known]
    code = reduce(
        lambda rest, c: F.when(known[c], F.lit(c)).otherwise(rest), reversed(order),
        F.lit(rules.action_fallback),
    )
    label = F.coalesce(
        literal_lookup(F.col("contramedida_primaria_cod"), rules.actions),
        F.lit(ACTION_LABEL_DEFAULT),
    )
    return axes.withColumn("contramedida_primaria_cod", code).withColumn(
        "contramedida_primaria_label", label
    )


def taste_profile(master: DataFrame, archetypes: DataFrame, rules: RuleBook) -> DataFrame:
    return assign_actions(taste_axes(master, archetypes, rules), rules)
