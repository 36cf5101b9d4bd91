"""Rules of a run from a JSON document instead of code.

A document names only what differs from the defaults of ``RuleBook``::

    {"risk_bands": [{"name": "critical", "low": 0.9, "high": 1.0}, ...], "risk_default": "very_low",
     "priority_rules": [{"risks": ["critical"], "archetypes": [1, 2], "priority": "P0", "label": "..."}],
     "priority_default": {"priority": "P4", "label": "..."},
     "drift_threshold": 0.1, "high_risk": 0.65, "thresholds": {"level_p75": 11},
     "archetypes": {"0": {"name": "...", "priority": "alta"}}, "class_names": {"0": "..."},
     "actions": {"CM01": "label"}, "action_order": ["CM03", "CM01"], "action_fallback": "CM04",
     "action_conditions": {"CM05": {"all": [{"perfil_enhance": ["inversor"]}, {"not": {"has_tier2": [1]}}]}},
     "active": {"churn": "<version>", "archetypes": "<version>"}}

A condition is ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": condition}`` or ``{column: [values]}``. Tables
by key replace the entries they name; lists replace the whole list. Every fault of a document is reported
at once.
"""

from __future__ import annotations

import json
from dataclasses import asdict, fields, replace
from importlib import resources

from pyspark.sql import SparkSession

from tidemark.rules import AXES, PriorityRule, RiskBand, RuleBook, TasteThresholds
from tidemark.sources.staging import write_document

# Columns that conditions of actions may name.
CONDITION_COLUMNS = ("arquetipo_n1", "has_tier2", *AXES)
VERSION_KINDS = ("churn", "archetypes")


class RuleError(ValueError):
    """All faults of a rule document."""

    def __init__(self, faults: list[str]) -> None:
        super().__init__("; ".join(faults))
        self.faults = faults


class _Reader:
    """Typed access to a document that notes faults instead of raising."""

    def __init__(self, document: object) -> None:
        self.faults: list[str] = []
        self.document = self.table(document, "document") if document is not None else {}

    def fault(self, where: str, text: str) -> None:
        self.faults.append(f"{where}: {text}")

    def table(self, value: object, where: str) -> dict:
        if isinstance(value, dict):
            return value
        self.fault(where, "must be an object")
        return {}

    def items(self, value: object, where: str) -> list:
        if isinstance(value, (list, tuple)):
            return list(value)
        self.fault(where, "must be a list")
        return []

    def number(self, value: object, where: str, low: float | None = None, high: float | None = None) -> float:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
            self.fault(where, "must be a number")
            return 0.0
        if (low is not None and value < low) or (high is not None and value > high):
            self.fault(where, f"must be between {low} and {high}")
        return float(value)

    def text(self, value: object, where: str) -> str:
        if isinstance(value, str) and value:
            return value
        self.fault(where, "must be a text")
        return ""

    def keys(self, table: dict, where: str, allowed: tuple[str, ...], needed: tuple[str, ...] = ()) -> None:
        for k in sorted(table.keys() - set(allowed)):
            self.fault(where, f"unknown entry {k!r}")
        for k in needed:
            if k not in table:
                self.fault(where, f"{k!r} is missing")

    def coded(self, value: object, where: str) -> dict[int, object]:
        """A table whose keys are whole numbers."""
        out = {}
        for k, v in self.table(value, where).items():
            try:
                out[int(k)] = v
            except ValueError:
                self.fault(where, f"{k!r} is no whole number")
        return out


def _bands(r: _Reader, value: object) -> tuple[RiskBand, ...]:
    out = []
    for i, entry in enumerate(r.items(value, "risk_bands")):
        where = f"risk_bands[{i}]"
        band = r.table(entry, where)
        r.keys(band, where, ("name", "low", "high"), ("name", "low", "high"))
        low, high = (r.number(band.get(k, 0.0), f"{where}.{k}", 0, 1) for k in ("low", "high"))
        if low >= high:
            r.fault(where, "low must be below high")
        out.append(RiskBand(r.text(band.get("name"), f"{where}.name"), low, high))
    names = [b.name for b in out]
    for name in sorted({n for n in names if names.count(n) > 1}):
        r.fault("risk_bands", f"{name!r} stands twice")
    ranked = sorted(out, key=lambda b: b.low)
    for a, b in zip(ranked, ranked[1:]):
        if b.low < a.high:
            r.fault("risk_bands", f"{a.name!r} and {b.name!r} overlap")
        elif b.low > a.high:
            r.fault("risk_bands", f"nothing covers {a.high} to {b.low}")
    if out and (ranked[0].low > 0 or ranked[-1].high < 1):
        r.fault("risk_bands", "must cover 0 to 1")
    if not out:
        r.fault("risk_bands", "must not be empty")
    return tuple(out)


def _priorities(r: _Reader, value: object, risks: set[str], codes: set[int]) -> tuple[PriorityRule, ...]:
    out = []
    for i, entry in enumerate(r.items(value, "priority_rules")):
        where = f"priority_rules[{i}]"
        rule = r.table(entry, where)
        r.keys(rule, where, ("risks", "archetypes", "priority", "label"), ("risks", "priority", "label"))
        named = r.items(rule.get("risks", []), f"{where}.risks")
        for x in named:
            if x not in risks:
                r.fault(f"{where}.risks", f"no risk band is named {x!r}")
        chosen = rule.get("archetypes")
        if chosen is not None:
            chosen = r.items(chosen, f"{where}.archetypes")
            for x in chosen:
                if x not in codes:
                    r.fault(f"{where}.archetypes", f"no archetype has the code {x!r}")
        texts = [r.text(rule.get(k), f"{where}.{k}") for k in ("priority", "label")]
        out.append(PriorityRule(tuple(named), *texts, None if chosen is None else tuple(chosen)))
    return tuple(out)


def _check_condition(r: _Reader, value: object, where: str) -> None:
    condition = r.table(value, where)
    if len(condition) != 1:
        r.fault(where, "must have exactly one entry")
        return
    (name, part), = condition.items()
    if name in ("all", "any"):
        for i, c in enumerate(r.items(part, f"{where}.{name}")):
            _check_condition(r, c, f"{where}.{name}[{i}]")
    elif name == "not":
        _check_condition(r, part, f"{where}.not")
    elif name not in CONDITION_COLUMNS:
        r.fault(where, f"no column is named {name!r}")
    else:
        values = r.items(part, f"{where}.{name}")
        legal = AXES[name][1] if name in AXES else None
        for v in values:
            if legal is not None and v not in legal:
                r.fault(f"{where}.{name}", f"{v!r} is no value of the axis")
        if not values:
            r.fault(f"{where}.{name}", "must name a value")


def parse_rules(document: object, base: RuleBook | None = None) -> RuleBook:
    """The rule book of a document over the defaults. Raises ``RuleError`` with every fault."""
    base = base or RuleBook()
    r = _Reader(document)
    doc = r.document
    allowed = tuple(f.name for f in fields(RuleBook))
    r.keys(doc, "document", allowed)
    new: dict[str, object] = {}
    if "archetypes" in doc:
        given = {}
        for code, entry in r.coded(doc["archetypes"], "archetypes").items():
            where = f"archetypes.{code}"
            known = r.table(entry, where)
            r.keys(known, where, ("name", "priority"), ("name", "priority"))
            given[code] = tuple(r.text(known.get(k), f"{where}.{k}") for k in ("name", "priority"))
        new["archetypes"] = base.archetypes | given
    if "class_names" in doc:
        named = r.coded(doc["class_names"], "class_names")
        new["class_names"] = base.class_names | {k: r.text(v, f"class_names.{k}") for k, v in named.items()}
    if "thresholds" in doc:
        given = r.table(doc["thresholds"], "thresholds")
        r.keys(given, "thresholds", tuple(f.name for f in fields(TasteThresholds)))
        held = asdict(base.thresholds) | {k: r.number(v, f"thresholds.{k}") for k, v in given.items() if k in asdict(base.thresholds)}
        if held["build_t33"] > held["build_t67"]:
            r.fault("thresholds", "build_t33 must not be above build_t67")
        new["thresholds"] = TasteThresholds(**held)
    for name in ("drift_threshold", "high_risk"):
        if name in doc:
            new[name] = r.number(doc[name], name, 0, 1)
    if "risk_bands" in doc:
        new["risk_bands"] = _bands(r, doc["risk_bands"])
    risks = {b.name for b in new.get("risk_bands", base.risk_bands)}
    codes = set(new.get("archetypes", base.archetypes))
    new["risk_default"] = r.text(doc.get("risk_default", base.risk_default), "risk_default")
    if new["risk_default"] not in risks:
        r.fault("risk_default", f"no risk band is named {new['risk_default']!r}")
    if "priority_rules" in doc:
        new["priority_rules"] = _priorities(r, doc["priority_rules"], risks, codes)
    else:
        for rule in base.priority_rules:
            for x in sorted(set(rule.risks) - risks):
                r.fault("priority_rules", f"the default rules name the risk {x!r}, which the bands lack")
    if "priority_default" in doc:
        given = r.table(doc["priority_default"], "priority_default")
        r.keys(given, "priority_default", ("priority", "label"), ("priority", "label"))
        new["priority_default"] = tuple(r.text(given.get(k), f"priority_default.{k}") for k in ("priority", "label"))
    if "actions" in doc:
        given = r.table(doc["actions"], "actions")
        new["actions"] = base.actions | {k: r.text(v, f"actions.{k}") for k, v in given.items()}
    actions = new.get("actions", base.actions)
    if "action_conditions" in doc:
        given = r.table(doc["action_conditions"], "action_conditions")
        for code, condition in given.items():
            if code not in actions:
                r.fault("action_conditions", f"no action has the code {code!r}")
            _check_condition(r, condition, f"action_conditions.{code}")
        new["action_conditions"] = given
    if "action_order" in doc:
        order = r.items(doc["action_order"], "action_order")
        for code in order:
            if code not in actions:
                r.fault("action_order", f"no action has the code {code!r}")
        if len(set(map(str, order))) < len(order):
            r.fault("action_order", "an action stands twice")
        new["action_order"] = tuple(order)
    if "action_fallback" in doc:
        new["action_fallback"] = r.text(doc["action_fallback"], "action_fallback")
        if new["action_fallback"] not in actions:
            r.fault("action_fallback", f"no action has the code {new['action_fallback']!r}")
    if "active" in doc:
        given = r.table(doc["active"], "active")
        r.keys(given, "active", VERSION_KINDS)
        new["active"] = base.active | {k: r.text(v, f"active.{k}") for k, v in given.items()}
    if r.faults:
        raise RuleError(r.faults)
    return replace(base, **new)


def to_document(rules: RuleBook) -> dict:
    """A rule book as the document that ``parse_rules`` reads back to the same book."""
    doc = asdict(rules)
    doc["archetypes"] = {str(k): {"name": n, "priority": p} for k, (n, p) in rules.archetypes.items()}
    doc["class_names"] = {str(k): v for k, v in rules.class_names.items()}
    doc["priority_default"] = dict(zip(("priority", "label"), rules.priority_default, strict=True))
    return doc


def load_rules(spark: SparkSession, path: str, base: RuleBook | None = None) -> RuleBook:
    """Rules from a JSON file, or a folder that ``save_rules`` wrote, on any store Spark reads."""
    text = spark.read.text(path, wholetext=True).first()
    try:
        document = json.loads(text["value"] if text is not None else "")
    except json.JSONDecodeError as e:
        raise RuleError([f"document: no JSON ({e})"]) from e
    return parse_rules(document, base)


def packaged_rules(name: str) -> RuleBook:
    """Rules from a document that comes with the library; the driver reads it."""
    return parse_rules(json.loads(resources.files("tidemark.plans").joinpath(name).read_text("utf-8")))


def save_rules(spark: SparkSession, rules: RuleBook, path: str) -> None:
    write_document(spark, to_document(rules), path)
