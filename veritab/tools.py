"""The library as tools for a program that speaks JSON: texts in, one JSON text out; an error is an answer, never an exception.

Tables are named by their paths (anything ``sources.files.read`` takes).  ``call(spark, name, **arguments)`` runs a tool; ``TOOLS`` lists them.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from veritab.operators import charts, cleaning, profiling, quality, report, statistics, understanding, verify
from veritab.plans import compile as kpi
from veritab.plans.ir import build_plan
from veritab.sources import files, xlsx

TOOLS: dict[str, Callable] = {}


def tool(f: Callable) -> Callable:
    TOOLS[f.__name__] = f
    return f


def call(spark: SparkSession, name: str, **arguments) -> str:
    """The tool's answer as JSON: its result, or {"error": ...}."""
    if name not in TOOLS:
        return json.dumps({"error": f"no tool {name}"})
    f = TOOLS[name]
    try:
        inspect.signature(f).bind(spark, **arguments)
        out = f(spark, **arguments)
        if isinstance(out, DataFrame):
            out = [r.asDict(recursive=True) for r in out.limit(1000).collect()]
        return json.dumps(understanding.json_safe(out))
    except Exception as e:  # noqa: BLE001 - the caller reads the reason
        return json.dumps({"error": f"{type(e).__name__}: {e}"[:2000]})


def _load(text) -> object:
    return json.loads(text) if isinstance(text, str) else text


def _roles(spark, path: str, roles=None) -> dict[str, str]:
    return _load(roles) if roles else {c: r.role for c, r in profiling.roles(files.read(spark, path)).items()}


def _of(roles: dict[str, str], *names: str) -> list[str]:
    return [c for c, r in roles.items() if r in names]


def _stored(df: DataFrame, out: str) -> dict:
    df.write.mode("overwrite").parquet(out)
    return {"path": out, "rows": df.sparkSession.read.parquet(out).count()}


# -- files -------------------------------------------------------------------------------------------------------------


@tool
def file_validator(spark, path: str):
    return {"problem": files.validate_file(path)}


@tool
def file_reader(spark, path: str):
    df = files.read(spark, path)
    return {"columns": dict(df.dtypes), "rows": df.count(), "sheets": xlsx.sheets(path) if path.lower().endswith(".xlsx") else None}


@tool
def file_sheet_extract(spark, path: str, sheet: str, folder: str):
    return {"path": xlsx.extract(path, sheet, folder)}


# -- profile and understanding ----------------------------------------------------------------------------------------


@tool
def pii_detector(spark, path: str):
    return profiling.pii_scan(files.read(spark, path))


@tool
def data_profiler(spark, path: str, redact: str = "[]"):
    df = profiling.redact(files.read(spark, path), _load(redact))
    return {"columns": [r.asDict() for r in profiling.profile(df).collect()], "duplicates": profiling.duplicates(df).first().asDict()}


@tool
def column_profiler(spark, path: str, proposed: str = "{}"):
    return {c.name: {"role": c.role, "distinct": c.distinct, "ordinal": c.ordinal, "unit": c.unit, "reason": c.reason} for c in understanding.understand(files.read(spark, path), _load(proposed)).columns}


@tool
def domain_classifier(spark, text: str):
    domain, confidence = understanding.domain_of(text)
    return {"domain": domain, "confidence": confidence}


@tool
def dsl_plan_builder(spark, plan: str):
    p = build_plan(plan)
    return {"kpis": [{"kpi_id": k.kpi_id, "name": k.name, "function": k.op.function} for k in p.kpis], "tests": p.tests, "dropped": p.dropped}


# -- quality ------------------------------------------------------------------------------------------------------------


@tool
def schema_checker(spark, path: str, columns: str):
    """``columns``: {name: role} as it was understood."""
    own = [understanding.Column(c, "", r, 0, True) for c, r in _load(columns).items()]
    return understanding.schema_findings(files.read(spark, path), understanding.Understanding(own))


@tool
def invalid_value_checker(spark, path: str, as_of: str, roles: str | None = None):
    df, own = files.read(spark, path), _roles(spark, path, roles)
    texts = [c for c in _of(own, "dimension", "free_text", "identifier") if df.schema[c].dataType.typeName() == "string"]
    return quality.validity(df, _of(own, "measure"), _of(own, "temporal"), texts, as_of).where("rows > 0")


@tool
def business_rules_checker(spark, path: str, rules: str):
    return quality.out_of_declared_range(files.read(spark, path), rules)


@tool
def missingness_analyzer(spark, path: str, roles: str | None = None):
    return quality.deep_missingness(files.read(spark, path), _roles(spark, path, roles))


@tool
def duplicate_detector(spark, path: str):
    return profiling.duplicates(files.read(spark, path))


@tool
def referential_integrity(spark, path: str, roles: str | None = None):
    return quality.referential_integrity(files.read(spark, path), _of(_roles(spark, path, roles), "identifier"))


@tool
def deterministic_repair(spark, path: str, out: str, roles: str | None = None):
    own = _roles(spark, path, roles)
    return _stored(cleaning.repair(files.read(spark, path), _of(own, "measure"), _of(own, "temporal")), out)


@tool
def contract_builder(spark, path: str, roles: str | None = None):
    own = _roles(spark, path, roles)
    return [c.__dict__ for c in quality.build_contracts(files.read(spark, path), _of(own, "measure"), _of(own, "identifier"), tuple(_of(own, "temporal")))]


@tool
def contract_validator(spark, path: str, contracts: str):
    own = [quality.Contract(**{**c, "forbidden": tuple(c.get("forbidden") or ())}) for c in _load(contracts)]
    return quality.contract_violations(files.read(spark, path), own)


# -- cleaning -----------------------------------------------------------------------------------------------------------


@tool
def cleaning_strategy(spark, path: str, roles: str | None = None, mechanisms: str = "{}"):
    df, why = files.read(spark, path), _load(mechanisms)
    missing = {r["column_name"]: (r["nulls"] / max(1, r["rows"]), why.get(r["column_name"], "MCAR")) for r in profiling.profile(df).collect()}
    return [s.__dict__ for s in cleaning.build_strategy(_roles(spark, path, roles), missing).steps]


@tool
def fillna(spark, path: str, column: str, action: str, out: str):
    return _stored(cleaning.FILLS[action](files.read(spark, path), [column]), out)


@tool
def flag_column(spark, path: str, column: str, out: str):
    return _stored(cleaning.flag_missing(files.read(spark, path), column), out)


@tool
def type_caster(spark, path: str, out: str, roles: str | None = None):
    return _stored(cleaning.cast_by_role(files.read(spark, path), _roles(spark, path, roles)), out)


@tool
def dedup(spark, path: str, out: str):
    df = files.read(spark, path)
    return _stored(cleaning.dedup(df, df.columns), out)


@tool
def iqr_outlier(spark, path: str, column: str, out: str, drop: bool = False):
    return _stored(cleaning.iqr_flag(files.read(spark, path), column, drop), out)


@tool
def dq_recheck(spark, path: str, as_of: str, roles: str | None = None):
    rows = invalid_value_checker(spark, path, as_of, roles).collect()
    high = [r["finding"] for r in rows if not r["finding"].endswith(("future", "mixed_units"))]
    return {"verdict": quality.gate([("high", f) for f in high]), "findings": high}


@tool
def impact(spark, before: str, after: str, measures: str):
    return cleaning.impact(files.read(spark, before), files.read(spark, after), _load(measures))


# -- analysis -----------------------------------------------------------------------------------------------------------


@tool
def dsl_executor(spark, path: str, plan: str):
    return kpi.execute_plan(files.read(spark, path), build_plan(plan))


@tool
def statistical_suite(spark, path: str, measures: str, dimension: str | None = None):
    df, own = files.read(spark, path), _load(measures)
    out = {"descriptive": [r.asDict() for r in statistics.descriptive(df, own).collect()], "correlation": [r.asDict() for r in statistics.correlation_tests(df, own).collect()]}
    for m in own if dimension else []:
        out[m] = {name: [r.asDict() for r in rows.collect()] for name, rows in statistics.compare_groups(df, m, dimension)}
    return out


@tool
def chart_planner(spark, path: str, plan: str):
    df, p = files.read(spark, path), build_plan(plan)
    sizes = {r["column_name"]: r["distinct_values"] for r in profiling.profile(df).collect()}
    found = [c for k in p.kpis for c in charts.plan_op(k.op, sizes.get(k.op.group_by[0], 0) if k.op.group_by else 0, 3)]
    return [c.__dict__ for c in charts.rank(found)[0]]


@tool
def chart_renderer(spark, path: str, plan: str, kind: str):
    k = build_plan(plan).kpis[0]
    svg, data = charts.draw(files.read(spark, path), k, charts.Chart(kind, (k.op.column or k.op.column_a,), "asked for"))
    return {"svg": svg, "data": data}


@tool
def evidence_registry(spark, entries: str, out: str):
    evidence = verify.Evidence()
    ids = [evidence.add(e["kind"], e.get("value"), e.get("evidence_id")) for e in _load(entries)]
    evidence.save(out)
    return ids


# -- claims, report, verdict ----------------------------------------------------------------------------------------------


@tool
def evidence_lookup(spark, ids: str, path: str):
    known = verify.Evidence.load(path).entries
    return {e: known.get(e) for e in _load(ids)}


@tool
def claim_validator(spark, claims: str, evidence: str):
    kept, notes = verify.validate_claims([verify.Claim(**c) for c in _load(claims)], verify.Evidence.load(evidence))
    return {"kept": [c.__dict__ for c in kept], "notes": notes}


@tool
def recommender(spark, claims: str):
    return [r.__dict__ for r in report.recommend([verify.Claim(**c) for c in _load(claims)])]


@tool
def review_logic(spark, claims: str, recommendations: str, evidence: str):
    own = [verify.Claim(**c) for c in _load(claims)]
    recs = [report.Recommendation(**r) for r in _load(recommendations)]
    return report.broken_references(verify.Evidence.load(evidence), [], own, recs, [], list(report.SECTIONS))


@tool
def load_report_artifacts(spark, folder: str):
    return {p.name: json.loads(p.read_text()) for p in sorted(Path(folder).glob("*.json"))}


@tool
def render_report_section(spark, section: str, lines: str):
    if section not in report.SECTIONS:
        raise ValueError(f"no section {section}")
    return {"html": report.page("", {section: _load(lines)}, [], []).split(f'<section id="{section}">')[1].split("</section>")[0]}


@tool
def render_full_report(spark, title: str, sections: str):
    return {"html": report.page(title, _load(sections), [], [])}


@tool
def save_report(spark, folder: str, html: str):
    Path(folder, "report.html").write_text(html)
    return {"path": str(Path(folder, "report.html"))}


@tool
def score_calculator(spark, critical: int, warnings: int = 0, infos: int = 0):
    return {"score": verify.score(critical, warnings, infos)}


@tool
def verdict(spark, critical: int, warnings: int = 0, reasons: str = "[]"):
    return {"verdict": verify.verdict(critical, warnings, tuple(_load(reasons)))}


@tool
def human_input(spark, prompt: str):
    answers, confidence = understanding.gather_context()
    return {"prompt": prompt, "answer": answers.get("goal"), "confidence": confidence}
