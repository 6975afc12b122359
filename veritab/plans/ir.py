"""The closed KPI language: typed operations, their validation and their reading from JSON.

Nothing outside the eleven functions can be expressed; there are no free formulas.  Validation collects every error of a
plan instead of stopping at the first.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from typing import Any

AGGREGATES = ("sum", "mean", "median", "count", "nunique", "min", "max", "std")
FUNCTIONS = (*AGGREGATES, "growth", "correlation", "ratio")
TESTS = ("descriptive", "correlation", "trend", "anova")
ENUMS = {"method": ("pearson", "spearman"), "period": ("MoM", "YoY", "WoW"), "basis": ("previous_period", "start_of_period")}
#: field -> required?
SHAPES: dict[str, dict[str, bool]] = {
    **{f: {"column": True, "group_by": False, "filter": False} for f in AGGREGATES},
    "growth": {
        "column": True, "over_column": True, "period": False, "basis": False, "as_percent": False, "group_by": False, "filter": False,
    },
    "correlation": {"column_a": True, "column_b": True, "method": False, "filter": False},
    "ratio": {"numerator": True, "denominator": True},
}
#: Names of identifier columns; sums and means over them mean nothing.
IDENTIFIER = re.compile(r"(?:^|_)(?:id|uuid|guid|key|phone|mobile|zip|postcode|ssn|iban)$|^(?:id|uuid)_|(?:number|code)$", re.I)


@dataclass(frozen=True)
class Op:
    function: str
    column: str | None = None
    column_a: str | None = None
    column_b: str | None = None
    over_column: str | None = None
    method: str = "pearson"
    period: str = "MoM"
    basis: str = "previous_period"
    as_percent: bool = False
    group_by: tuple[str, ...] = ()
    filter: tuple[tuple[str, Any], ...] = ()
    numerator: Op | None = None
    denominator: Op | None = None

    @property
    def key(self) -> str:
        """Identity of the whole operation; equal operations have equal keys."""
        return hashlib.sha256(repr(self).encode()).hexdigest()[:16]

    def render_filter(self) -> str:
        return " & ".join(f"{c} in {list(v)}" if isinstance(v, tuple) else f"{c}=={v}" for c, v in self.filter)


@dataclass(frozen=True)
class Kpi:
    kpi_id: str
    name: str
    op: Op


@dataclass
class Plan:
    kpis: list[Kpi] = field(default_factory=list)
    tests: list[str] = field(default_factory=list)
    dropped: list[tuple[str, str]] = field(default_factory=list)


def validate(op: Any, at: str = "op") -> list[str]:
    """All errors of one operation given as JSON."""
    if not isinstance(op, dict):
        return [f"{at}: an operation is an object"]
    fn = op.get("function")
    if fn not in SHAPES:
        return [f"{at}: unknown function {fn!r}"]
    shape, given = SHAPES[fn], {k: v for k, v in op.items() if v is not None and k != "function"}
    errors = [f"{at}: {fn} needs {k}" for k, must in shape.items() if must and k not in given]
    errors += [f"{at}: {fn} does not take {k}" for k in given if k not in shape]
    for k, v in given.items():
        if k in ("column", "column_a", "column_b", "over_column") and not (isinstance(v, str) and v):
            errors.append(f"{at}: {k} is a column name")
        elif k in ENUMS and v not in ENUMS[k]:
            errors.append(f"{at}: {k} is one of {', '.join(ENUMS[k])}")
        elif k == "as_percent" and not isinstance(v, bool):
            errors.append(f"{at}: as_percent is true or false")
        elif k == "group_by" and not (isinstance(v, (list, tuple)) and v and all(isinstance(x, str) for x in v)):
            errors.append(f"{at}: group_by is a list of column names")
        elif k == "filter" and not isinstance(v, dict):
            errors.append(f"{at}: filter is an object")
        elif k in ("numerator", "denominator"):
            errors += validate(v, f"{at}.{k}")
            if isinstance(v, dict):
                if v.get("function") in ("growth", "ratio"):
                    errors.append(f"{at}.{k}: a ratio takes aggregates and correlations")
                if v.get("group_by"):
                    errors.append(f"{at}.{k}: a ratio takes ungrouped operations")
    return errors


def parse(op: dict) -> Op:
    errors = validate(op)
    if errors:
        raise ValueError("; ".join(errors))
    values = {k: v for k, v in op.items() if v is not None}
    for k in ("numerator", "denominator"):
        if k in values:
            values[k] = parse(values[k])
    if "group_by" in values:
        values["group_by"] = tuple(values["group_by"])
    if "filter" in values:
        values["filter"] = tuple((c, tuple(v) if isinstance(v, (list, tuple)) else v) for c, v in values["filter"].items())
    return Op(**values)


def is_identifier_name(name: str) -> bool:
    return bool(IDENTIFIER.search(name))


def blocked(op: Op) -> bool:
    """A value aggregate or correlation over an identifier; counting identifiers is fine."""
    if op.function == "ratio":
        return blocked(op.numerator) or blocked(op.denominator)
    if op.function == "correlation":
        return is_identifier_name(op.column_a) or is_identifier_name(op.column_b)
    return op.function not in ("count", "nunique") and is_identifier_name(op.column or "")


def build_plan(raw: str | dict) -> Plan:
    """A plan from JSON: invalid or blocked operations are dropped with the reason, ids and names get defaults."""
    data = json.loads(raw) if isinstance(raw, str) else raw
    plan = Plan()
    for i, item in enumerate(data.get("kpis", []), 1):
        kpi_id = item.get("kpi_id") or f"KPI-{i:03d}"
        errors = validate(item.get("operation"))
        if errors:
            plan.dropped.append((kpi_id, "; ".join(errors)))
            continue
        op = parse(item["operation"])
        if blocked(op):
            plan.dropped.append((kpi_id, "identifier columns have no meaningful values"))
            continue
        plan.kpis.append(Kpi(kpi_id, item.get("name") or f"{op.function} of {op.column or op.column_a or 'ratio'}", op))
    for test in data.get("tests", []):
        (plan.tests.append(test) if test in TESTS else plan.dropped.append((str(test), "unknown test")))
    return plan
