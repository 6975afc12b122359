"""From a table to a verdict: profile, gate, clean, analyse, claim, report, recompute.

Each stage is a Spark job group with a time limit, so a stage that runs too long is cancelled, not abandoned.  Only aggregates
reach the driver; the cleaned table is frozen as Parquet, and the verdict recomputes every KPI from it by the unfused path.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from veritab.operators import charts, cleaning, profiling, quality, report, statistics, understanding, verify
from veritab.plans import compile as kpi, recompute
from veritab.plans.ir import Kpi, Op, Plan, build_plan
from veritab.sources import files

@dataclass
class Config:
    max_seconds: float = 1800
    stage_seconds: float = 600
    max_charts: int = 20
    rechecks: int = 3
    as_of: str = "2024-01-01"
    negative_allowed: tuple[str, ...] = ()
    plan: dict | None = None
    #: Answers to the context dialog; ``rules`` may declare ranges.
    context: dict[str, str] = field(default_factory=dict)
    proposed_roles: dict[str, str] = field(default_factory=dict)
    chart_proposals: list = field(default_factory=list)
    #: Called with a prompt, gives (text, cost); without it nothing is asked and the deterministic texts stand.
    complete: Callable[[str], tuple[str, float]] | None = None
    max_cost: float = 5.0
    #: Called with the claims, gives those that are approved; unattended runs approve all.
    review: Callable[[list], list] | None = None
    #: Path of the result cache; a run whose input and configuration were approved before is not repeated.
    cache: str | None = None


@dataclass
class Run:
    verdict: str
    reasons: list[str]
    kpis: list[dict]
    claims: list[verify.Claim]
    folder: str
    score: float
    stages: dict[str, float] = field(default_factory=dict)
    recommendations: list[report.Recommendation] = field(default_factory=list)
    cached: bool = False


class Log:
    """One JSON object for each event."""

    def __init__(self, path: Path):
        self.file = path.open("a")

    def event(self, kind: str, **facts) -> None:
        self.file.write(json.dumps({"at": time.time(), "kind": kind, **facts}, default=str) + "\n")
        self.file.flush()

    def tool(self, name: str, seconds: float) -> None:
        self.event("tool", name=name, seconds=seconds)

    def llm(self, cost: float, total: float) -> None:
        self.event("llm", cost=cost, total=total)

    def info(self, text: str) -> None:
        self.event("info", text=text)

    def fallback(self, what: str, why: str) -> None:
        self.event("fallback", what=what, why=why)


class LimitExceeded(RuntimeError):
    pass


def staged(spark: SparkSession, name: str, seconds: float, work: Callable):
    """Run ``work`` as a job group and cancel its jobs when the time is over."""
    sc = spark.sparkContext
    sc.setJobGroup(f"veritab-{name}", name, interruptOnCancel=True)
    over = threading.Event()

    def stop() -> None:
        over.set()
        sc.cancelJobGroup(f"veritab-{name}")

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise LimitExceeded(f"{name}_time_limit_exceeded") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def new_folder(root: str) -> Path:
    """run-0001, run-0002, ...: ``mkdir`` decides, so two runs never share one."""
    base = Path(root)
    base.mkdir(parents=True, exist_ok=True)
    n = len(list(base.glob("run-*")))
    while True:
        n += 1
        try:
            (base / f"run-{n:04d}").mkdir()
            return base / f"run-{n:04d}"
        except FileExistsError:
            continue


def first_json(text: str) -> dict | None:
    """The first JSON object inside prose."""
    for m in re.finditer(r"\{", text):
        try:
            return json.JSONDecoder().raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def fmt(value: float | None) -> str:
    if value is None:
        return "n/a"
    return f"{value:,.0f}" if float(value).is_integer() else f"{value:,.2f}"


def default_plan(roles: dict[str, profiling.Role], facts: dict[str, dict]) -> dict:
    """Sum and mean of each measure, count of the first identifier, growth of the first measure, up to three correlations."""
    of = lambda role: [c for c, r in roles.items() if r.role == role]
    measures, ids, times, dims = of("measure"), of("identifier"), of("temporal"), of("dimension")
    ops = [{"function": f, "column": m} for m in measures for f in ("sum", "mean")]
    ops += [{"function": "count", "column": ids[0]}] if ids else []
    useful = [t for t in times if facts[t]["distinct"] < 0.8 * max(1, facts[t]["rows"])]
    ops += [{"function": "growth", "column": measures[0], "over_column": useful[0], "period": "YoY"}] if useful and measures else []
    ops += [{"function": "sum", "column": measures[0], "group_by": [dims[0]]}] if dims and measures else []
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i + 1 :]][:3]
    ops += [{"function": "correlation", "column_a": a, "column_b": b} for a, b in pairs]
    tests = ["descriptive"] * bool(measures) + ["correlation"] * bool(pairs) + ["trend"] * bool(useful and measures) + ["anova"] * bool(dims and measures)
    return {"kpis": [{"operation": op} for op in ops], "tests": tests}


def _findings(df: DataFrame, roles: dict[str, profiling.Role], cfg: Config) -> list[tuple[str, str, int]]:
    of = lambda *names: [c for c, r in roles.items() if r.role in names and c in df.columns]
    rows = quality.validity(df, of("measure"), of("temporal"), [c for c in of("dimension", "free_text", "identifier") if df.schema[c].dataType.typeName() == "string"], cfg.as_of, cfg.negative_allowed)
    found = [("medium" if r["finding"].endswith(("future", "mixed_units")) else "high", r["finding"], r["rows"]) for r in rows.collect() if r["rows"]]
    measures = of("measure")
    found += [("medium", f"{r['column_name']}:outliers_iqr", r["outliers"]) for r in (quality.iqr_outliers(df, measures).collect() if measures else []) if r["outliers"]]
    ids = of("identifier")
    if ids:
        found += [("medium", r["finding"], r["rows"]) for r in quality.identifier_nulls(df, ids).collect() if r["rows"]]
        found += [("medium", f"{r['column_name']}:orphans_of_{r['identifier']}", r["orphans"]) for r in quality.referential_integrity(df, ids).collect()]
    if cfg.context.get("rules"):
        found += [("high", f"{r['violation']}_declared", r["rows"]) for r in quality.out_of_declared_range(df, cfg.context["rules"]).collect()]
    found += [("medium", f"{b}:case_duplicate", 1) for b, _, why in understanding.schema_findings(df, understanding.Understanding([])) if why.startswith("case_")]
    repeats = profiling.duplicates(df).first()["duplicate_rows"]
    return found + ([("medium", "table:exact_duplicates", repeats)] if repeats else [])


def _mechanisms(df: DataFrame, row_id: str) -> dict[str, str]:
    """Why values of each column are missing (D8), by all columns of at most 20 values; MNAR only for numbers and at least 9 rows."""
    columns = [c for c in df.columns if c != row_id]
    rows = profiling.profile(df, columns).collect()
    gaps = [r["column_name"] for r in rows if r["nulls"]]
    few = [r["column_name"] for r in rows if r["distinct_values"] - (r["nulls"] > 0) <= 20]
    if not gaps:
        return {}
    if not few:
        df, few = df.withColumn("_all", F.lit(0)), ["_all"]
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)} if rows[0]["rows"] >= 9 else set()
    found = quality.missing_mechanism(df, gaps, few, row_id).collect()
    return {r["column_name"]: "MCAR" if r["mechanism"] == "MNAR" and r["column_name"] not in numeric else r["mechanism"] for r in found}


def _trends(df: DataFrame, measures: list[str], times: list[str], evidence: verify.Evidence) -> list[dict]:
    """Growth series, rolling means and seasonality of each measure over each time column, with their numbers of points."""
    out = []
    for m in measures:
        for t in times:
            for period in ("MoM", "YoY", "WoW"):
                n = kpi.growth_series(df, Op("growth", column=m, over_column=t, period=period)).count()
                if n:
                    out.append({"test": f"growth_{period}", "measure": m, "over": t, "points": n, "evidence": evidence.add("trend", n)})
            means = statistics.rolling_mean(df, m, t).orderBy("period").collect()
            if len(means) >= 3:
                season = statistics.seasonality(df, m, t).first()
                out.append({"test": "rolling_mean", "measure": m, "over": t, "points": len(means), "latest": means[-1]["rolling_mean"], "evidence": evidence.add("trend", means[-1]["rolling_mean"])})
                out.append({"test": "seasonality", "measure": m, "over": t, "points": len(means), "strength": season["strength"], "verdict": season["verdict"], "evidence": evidence.add("trend", season["strength"])})
    return out


def growth_points(df: DataFrame, op: Op) -> dict[str | None, int]:
    """The number of periods with a growth, for each label."""
    label = kpi.group_label(op.group_by) if op.group_by else F.lit(None).cast("string")
    return {r["label"]: r["n"] for r in kpi.growth_series(df, op).groupBy(label.alias("label")).agg(F.count("*").alias("n")).collect()}


def run(spark: SparkSession, source: DataFrame | str, root: str, cfg: Config = Config()) -> Run:  # noqa: B008
    folder = new_folder(root)
    log, began, took = Log(folder / "events.jsonl"), time.time(), {}
    reasons: list[str] = []

    def stage(name: str, work: Callable):
        if time.time() - began > cfg.max_seconds:
            raise LimitExceeded("run_time_limit_exceeded")
        t = time.time()
        out = staged(spark, name, cfg.stage_seconds, work)
        took[name] = round(time.time() - t, 3)
        log.event("stage", name=name, seconds=took[name])
        return out

    kpis: list[dict] = []
    claims: list[verify.Claim] = []
    recommendations: list[report.Recommendation] = []
    critical = warnings = infos = 0
    spent = 0.0
    store, key, name = None, None, source if isinstance(source, str) else "table"

    def ask(prompt: str, plain: str) -> str:
        """A text from the model if one is set and the cost allows, else the plain one."""
        nonlocal spent
        if cfg.complete is None:
            return plain
        try:
            text, cost = cfg.complete(prompt)
        except Exception as e:  # noqa: BLE001 - whatever the model's client raises, the run goes on without it
            log.fallback("text", str(e))
            return plain
        spent += cost
        log.llm(cost, spent)
        if spent > cfg.max_cost:
            raise LimitExceeded("cost_limit_exceeded")
        return text or plain

    try:
        if isinstance(source, str):
            problem = files.validate_file(source) if source.endswith((".csv", ".xlsx")) else None
            if problem:
                raise ValueError(problem)
            if cfg.cache and Path(source).is_file():
                store = files.ResultCache(cfg.cache)
                key = store.key(files.file_sha256(source), {k: v for k, v in cfg.__dict__.items() if not callable(v) and k != "cache"})
                before = store.get(key)
                if before:
                    log.info(f"taken from {before[0]}")
                    old = json.loads((Path(before[0]) / "results.json").read_text())
                    return Run(before[1], [], old["kpis"], [], before[0], 100.0, took, cached=True)
            source = stage("ingest", lambda: files.read(spark, source, str(folder / "cache"), sheet=cfg.context.get("sheet")))
        df: DataFrame = source
        facts = stage("understand", lambda: profiling.identifier_facts(df))
        roles = {c: profiling.infer_role(c, f) for c, f in facts.items()}
        for c, r in roles.items():
            r.role, _, why = understanding.override_role(r, facts[c]["kind"], cfg.proposed_roles.get(c))
            if c in cfg.proposed_roles:
                log.info(f"{c}: {why}")
        plan: Plan = build_plan(cfg.plan or default_plan(roles, facts))
        of = lambda *names: [c for c, r in roles.items() if r.role in names]

        found = stage("quality", lambda: _findings(df, roles, cfg))
        deep = stage("missingness", lambda: [r.asDict() for r in quality.deep_missingness(df, {c: r.role for c, r in roles.items()}).collect()])
        rows_before = facts[next(iter(facts))]["rows"] if facts else 0
        log.event("gate", verdict=quality.gate([(s, f) for s, f, _ in found]), findings=found)
        broken = quality.gate([(s, f) for s, f, _ in found]) != "passed"

        def order() -> tuple[DataFrame, dict[str, str]]:
            """The table, repaired if need be, and the mechanisms, which need the order of its rows."""
            rows = files.with_row_id(df.select("*"))
            if broken:
                rows = cleaning.repair(rows, of("measure"), of("temporal"), order="_row_id")
                rows = spark.read.parquet(files.write_attempt(rows, str(folder / "repaired"), 1))
                rows = files.with_row_id(rows.orderBy("_row_id").drop("_row_id"))
            rows = spark.read.parquet(files.write_attempt(rows, str(folder / "ordered"), 1))
            return rows.drop("_row_id"), _mechanisms(rows, "_row_id")

        df, mechanisms = stage("repair", order)
        log.event("missing", mechanisms=mechanisms)

        def clean() -> DataFrame:
            nonlocal df
            for attempt in range(1, cfg.rechecks + 1):
                row = profiling.profile(df).collect()
                missing = {r["column_name"]: (r["nulls"] / max(1, r["rows"]), mechanisms.get(r["column_name"], "MCAR")) for r in row}
                now = _findings(df, roles, cfg)
                negative = [f.split(":")[0] for _, f, _ in now if f.endswith(":negative")]
                unsafe = [f.split(":")[0] for _, f, _ in now if f.endswith(":sql_suspected")]
                outliers = [f.split(":")[0] for _, f, _ in now if f.endswith(":outliers_iqr")]
                strategy = cleaning.build_strategy({c: r.role for c, r in roles.items() if c in df.columns}, missing, negative, unsafe, outliers)
                df = cleaning.execute(df, strategy)
                df = spark.read.parquet(files.write_attempt(df, str(folder / "cleaned"), attempt))
                log.event("clean", attempt=attempt, steps=[(s.action, s.column) for s in strategy.steps])
                if not any(s == "high" for s, _, _ in _findings(df, roles, cfg)):
                    return df
            reasons.append("unresolved_dq")
            return df

        df = stage("clean", clean)
        result = stage("analyse", lambda: kpi.execute_plan(df, plan).collect())
        evidence = verify.Evidence()
        names = {k.kpi_id: k for k in plan.kpis}
        for r in sorted(result, key=lambda r: (r["kpi_id"], r["label"] or "")):
            op = names[r["kpi_id"]].op
            kind = "correlation" if op.function == "correlation" else "growth" if op.function == "growth" else "kpi"
            kpis.append({"kpi_id": r["kpi_id"], "name": names[r["kpi_id"]].name, "label": r["label"], "value": r["value"], "function": op.function, "column": op.column, "evidence": evidence.add(kind, r["value"], operation=op.key)})
        measures = [m for m in of("measure") if m in df.columns]

        def suite() -> tuple[list, list, list, list]:
            cors = [{**c.asDict(), "evidence": evidence.add("correlation", c["r"])} for c in statistics.correlation_tests(df, measures).collect()] if "correlation" in plan.tests and len(measures) > 1 else []
            comps, descr = [], statistics.descriptive(df, measures).collect() if "descriptive" in plan.tests and measures else []
            dims = [d for d in of("dimension", "categorical") if d in df.columns and 2 <= facts[d]["distinct"] <= 50]
            for m in measures if "anova" in plan.tests else []:
                for d in dims:
                    a = statistics.anova(df, m, d).first()
                    if a["p"] is not None:
                        comps.append({"measure": m, "dimension": d, "p": a["p"], "evidence": evidence.add("comparison", a["f"])})
            times = [t for t in of("temporal") if t in df.columns]
            series = _trends(df, measures, times, evidence) if "trend" in plan.tests else []
            return cors, comps, [r.asDict() for r in descr], series

        cors, comps, descr, series = stage("statistics", suite)
        points = stage("points", lambda: {k.kpi_id: growth_points(df, k.op) for k in plan.kpis if k.op.function == "growth" and any(x["kpi_id"] == k.kpi_id and x["value"] is not None for x in kpis)})
        trends = [{"measure": names[k["kpi_id"]].op.column, "latest": k["value"], "points": points[k["kpi_id"]].get(k["label"], 0), "evidence": k["evidence"]} for k in kpis if names[k["kpi_id"]].op.function == "growth" and k["value"] is not None]
        claims, notes = verify.validate_claims(verify.draft_claims([k for k in kpis if evidence.entries[k["evidence"]]["kind"] == "kpi"], cors, comps, trends), evidence)
        log.event("claims", kept=len(claims), notes=notes)

        if cfg.review is not None:
            claims = cfg.review(claims)
        recommendations = report.surviving(report.recommend(claims), claims)

        times = [t for t in of("temporal") if t in df.columns]

        def draw() -> tuple[list[charts.Chart], bool, list[str], list[dict], list[tuple[str, str]]]:
            """The charts of the plan by the rules, by proposals that fit, and by what the claims ask for; each passes the gate."""
            dims = {d: facts[d]["distinct"] for d in of("dimension", "categorical") if d in df.columns}
            shape = charts.Shape(tuple(measures), dims, {t: facts[t]["distinct"] for t in times})
            proposed, errors = charts.validate_proposals(plan.kpis, cfg.chart_proposals, shape)
            for e in errors:
                log.info(e)
            n = rows_before
            planned: list[tuple[charts.Chart, Kpi]] = []
            for k in plan.kpis:
                op = k.op
                grown = max(points.get(k.kpi_id, {}).values(), default=0) if op.function == "growth" else n
                for c in charts.plan_op(op, facts.get(op.group_by[0], {}).get("distinct", 0) if op.group_by else 0, grown):
                    about = [x.kind for x in claims if {e["evidence"] for e in kpis if e["kpi_id"] == k.kpi_id} & set(x.evidence)]
                    c = charts.override(c, k, about, shape) if op.function not in ("growth", "correlation") else c
                    if k.kpi_id in proposed:
                        c = replace(c, kind=proposed[k.kpi_id][0], reason=proposed[k.kpi_id][1] or c.reason)
                    planned.append((charts.downgrade(c, n, grown) if op.function != "growth" else c, k))
            planned += [(c, Kpi("", c.reason, Op("mean", column=c.columns[0]))) for c in charts.plan_measures(measures, n)]
            ranked, cut = charts.rank([c for c, _ in planned], most=cfg.max_charts)
            label = understanding.quality_label(sum(s == "high" for s, _, _ in found), 0, max((d["rate"] for d in deep), default=0.0), sum("outliers" in f for _, f, _ in found))[0]
            svgs, data, gates = [], [], []
            for c in ranked:
                k = next(k for x, k in planned if x == c)
                if c.kind == "bar" and not k.op.group_by:
                    continue
                svg, rows = charts.draw(df, k, c)
                whole = shown = None
                if c.kind in ("bar", "barh", "lollipop", "pareto") and k.op.function == "sum" and not k.op.filter:
                    shown, whole = sum(r[1] for r in rows), df.agg(F.coalesce(F.sum(kpi.number(df, k.op.column)), F.lit(0.0))).first()[0]
                    shown = None if c.kind == "pareto" else shown  # a Pareto chart clips what is negative
                gates.append((c.kind, *charts.gate(svg, shown, whole, label)))
                svgs.append(svg)
                data.append(charts.interactive(c.kind, k.name, rows))
            return ranked, cut, svgs, data, gates

        shown, cut, svg, data, gates = stage("charts", draw)
        for i, drawing in enumerate(svg):
            (folder / f"chart-{i:02d}.svg").write_text(drawing)
        log.event("charts", planned=[c.kind for c in shown], truncated=cut, gates=gates)

        def check() -> list[str]:
            frozen = spark.createDataFrame([(evidence.entries[k["evidence"]]["operation"], k["label"], k["value"]) for k in kpis], "evidence string, label string, value double")
            return [r["status"] for r in verify.compare(frozen, recompute.recompute(df, plan)).collect()]

        statuses = stage("verify", check)
        span = stage("span", lambda: tuple(understanding.temporal_span(df, times[0]).first())) if times else None
        without = [k["kpi_id"] for k in kpis if k["function"] == "growth" and k["value"] is None]
        without += [k.kpi_id for k in plan.kpis if k.op.function == "growth" and all(x["kpi_id"] != k.kpi_id for x in kpis)]
        lead = [{**c, "variance": next((r.asDict() for r in kpi.period_variance(df, names[c["kpi_id"]].op, times[0]).collect()), None) if times and names[c["kpi_id"]].op.function in ("sum", "mean", "median", "count", "nunique") and not names[c["kpi_id"]].op.filter else None} for c in report.cards(kpis)]
        plain = report.summary(lead, sum(s == "high" for s, _, _ in found), report.growth_note(without, span, times[0] if times else None))
        summary = ask(f"Summarise this run in a few sentences; state no figure that is not in the data.\n{understanding.fence({'kpis': lead, 'findings': found}, 'run')}", plain)
        rows_after = stage("count", df.count)
        lies = report.contradictions(summary, times, max(0, rows_before - rows_after))
        past = store.previous(name) if store else None
        old = {(k["kpi_id"], k["label"]): k["value"] for k in json.loads((Path(past) / "results.json").read_text())["kpis"]} if past and (Path(past) / "results.json").is_file() else {}
        changes = [f"{k['name']}: {fmt(old[k['kpi_id'], k['label']])} before, {fmt(k['value'])} now" for k in kpis if (k["kpi_id"], k["label"]) in old]
        sections = {
            "executive_summary": [summary],
            "cleaning": [f"{rows_before} rows before, {rows_after} after."],
            "business_context": [f"{q}: {a}" for q, a in cfg.context.items()] or ["none given; the run is generic"],
            "dq_summary": [f"{f}: {n} rows ({s})" for s, f, n in found] + [f"Missing values: {quality.missingness_level([d['effective_rate'] for d in deep])}"] + [f"{d['column_name']}: {d['effective_rate']:.1%} missing, {d['verdict']}" for d in deep if d["effective_rate"]],
            "data_overview": [f"Domain: {understanding.domain_of(' '.join([*cfg.context.values(), *df.columns]).replace('_', ' '))[0]}", f"Columns: {', '.join(f'{c} ({r.role})' for c, r in roles.items())}"],
            "kpis": [f"{k['name']}{' / ' + k['label'] if k['label'] else ''}: {fmt(k['value'])} [{k['evidence']}]" for k in kpis] + [f"{c['name']}: {c['variance']['delta_percent']} % against the month before" for c in lead if c["variance"]],
            "stats": [", ".join(f"{a}={fmt(b) if isinstance(b, float) else b}" for a, b in d.items()) for d in [*descr, *series]],
            "insights": [f"{c.text} [{', '.join(c.evidence)}]" for c in claims],
            "recommendations": [r.text for r in recommendations],
            "limitations": [f"{i}: {why}" for i, why in plan.dropped] + [f"chart {kind}: {why}" for kind, status, why in gates if status != "pass"],
            "evidence": [f"{e}: {x['kind']} = {x['value']}" for e, x in evidence.entries.items()],
            "run_comparison": changes,
        }
        broken_refs = report.broken_references(evidence, kpis, claims, recommendations, [str(folder / f"chart-{i:02d}.svg") for i in range(len(svg))], [*sections, "charts"])
        critical = statuses.count("mismatch") + sum(s == "critical" for s, _ in broken_refs) + sum(status == "fail" for _, status, _ in gates)
        warnings = statuses.count("null") + statuses.count("unmatched") + len(plan.dropped) + len(lies) + sum(s == "warning" for s, _ in broken_refs)
        infos = sum(status == "warn" for _, status, _ in gates)
        for text in lies:
            log.info(f"summary {text}")
        (folder / "report.html").write_text(report.page("Analysis", sections, svg, data))
        evidence.save(str(folder / "evidence.json"))
        (folder / "results.json").write_text(json.dumps(understanding.json_safe({"kpis": kpis, "evidence": evidence.entries})))
    except LimitExceeded as e:
        reasons.append(str(e))
    verdict = verify.verdict(critical, warnings, tuple(reasons))
    log.event("verdict", verdict=verdict, critical=critical, warnings=warnings, reasons=reasons)
    if store and key:
        store.store(key, name, str(folder), verdict, time.time())
    return Run(verdict, reasons, kpis, claims, str(folder), verify.score(critical, warnings, infos), took, recommendations)


def main() -> None:
    """python -m veritab.pipeline TABLE OUTPUT_FOLDER"""
    import sys

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(spark, sys.argv[1], sys.argv[2])
    print(out.verdict, out.folder)


if __name__ == "__main__":
    main()
