"""Chart planning from the shape of results, and the data each chart needs as small DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators import profiling, render, statistics
from veritab.plans import compile as kpi
from veritab.plans.ir import Kpi, Op


@dataclass(frozen=True)
class Chart:
    kind: str
    columns: tuple[str, ...]
    reason: str
    strength: float = 0.5
    flags: tuple[str, ...] = field(default_factory=tuple)


def plan_op(op: Op, cardinality: int, points: int) -> list[Chart]:
    """Charts of one operation by the number of groups or points."""
    if op.function == "growth":
        cols = (op.column, op.over_column)
        return [Chart("line", cols, "growth over time", 0.9), Chart("waterfall", cols, "steps of the change", 0.5)] if points >= 3 else [Chart("bar", cols, "few periods", 0.3)]
    if op.function == "correlation":
        return [Chart("scatter", (op.column_a, op.column_b), "relation of two measures", 0.8)]
    if not op.group_by:
        return []
    cols = (op.group_by[0], op.column)
    share = bool(op.column and "share" in op.column)
    if op.function in ("sum", "count", "nunique") and 3 <= cardinality <= 15 and not share:
        return [Chart("pareto", cols, "additive values of a few groups", 0.8)]
    if cardinality <= 2:
        return [Chart("doughnut" if share else "bar", cols, "two groups", 0.4)]
    return [Chart("bar" if cardinality <= 12 else "barh", cols, f"{cardinality} groups", 0.6)]


def plan_measures(measures: list[str], values: int) -> list[Chart]:
    if values < 3:
        return []
    out = [Chart("histogram", (m,), "distribution", 0.5) for m in measures]
    if len(measures) == 2:
        out.append(Chart("scatter", tuple(measures), "two measures", 0.5))
    elif len(measures) > 2:
        out.append(Chart("heatmap", tuple(measures), "correlations", 0.6))
    return out


def downgrade(chart: Chart, rows: int, points: int) -> Chart:
    return replace(chart, kind="bar", flags=(*chart.flags, "low_n")) if (rows < 10 or points < 3) and chart.kind not in ("bar", "histogram") else chart


def rank(charts: list[Chart], penalty: float = 0.25, most: int = 20) -> tuple[list[Chart], bool]:
    """Distinct (kind, columns) by strength; each repetition of a kind weighs less; at most ``most``, and whether more were cut."""
    unique = list({(c.kind, tuple(sorted(c.columns))): c for c in reversed(charts)}.values())[::-1]
    seen: dict[str, int] = {}
    scored = []
    for c in sorted(unique, key=lambda c: -c.strength):
        scored.append((c.strength * (1 - penalty) ** seen.get(c.kind, 0), c))
        seen[c.kind] = seen.get(c.kind, 0) + 1
    ordered = [c for _, c in sorted(scored, key=lambda x: -x[0])]
    return ordered[:most], len(ordered) > most


def pareto(grouped: DataFrame, label: str, value: str) -> DataFrame:
    """Values clipped at 0 in falling order with running sums and shares; ``grouped`` has one row for each label."""
    v = F.greatest(F.coalesce(F.col(value), F.lit(0)).cast("double"), F.lit(0.0))
    rows = grouped.select(label, v.alias("value"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), label)
    run = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("value").over(Window.partitionBy(F.lit(0)))
    share = F.try_divide(run, total) * 100
    return rows.select(label, "value", run.alias("running"), share.alias("cumulative_percent"), F.row_number().over(w).alias("position"))


def waterfall(series: DataFrame, order: str, label: str, value: str) -> DataFrame:
    """(label, delta, start, end): changes from one existing period to the next; the first starts at 0."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    before = F.coalesce(F.lag(value).over(w), F.lit(0.0))
    return series.select(label, (F.col(value) - before).alias("delta"), before.alias("start"), F.col(value).alias("end"))


def top_rest(grouped: DataFrame, label: str, value: str, most: int = 15) -> DataFrame:
    """The ``most`` largest groups, the others added up as ``$rest``; ``grouped`` has one row for each label."""
    top = grouped.orderBy(F.desc(value), label).limit(most).select(label, F.lit(True).alias("_top"))
    rows = grouped.join(F.broadcast(top), label, "left")  # at most ``most`` rows
    return rows.groupBy(F.when(F.col("_top"), F.col(label).cast("string")).otherwise("$rest").alias(label)).agg(F.sum(value).alias(value))


def stacked(df: DataFrame, dimension: str, measures: list[str]) -> DataFrame:
    return df.groupBy(dimension).agg(*[F.sum(F.greatest(F.col(m), F.lit(0))).alias(m) for m in measures])


def reconcile(groups_total: float, total: float, tolerance: float = 0.001) -> str:
    """``pass`` if the chart's groups add up to the independent total."""
    return "pass" if abs(groups_total - total) <= tolerance * max(abs(total), 1e-12) else "fail"


# -- proposals ---------------------------------------------------------------------------------------------------------

SHARE = re.compile(r"share|percent|pct|%|ratio|proportion", re.I)


@dataclass(frozen=True)
class Shape:
    """What decides whether a chart can be drawn: columns by role, and the distinct values of dimensions and time columns."""

    measures: tuple[str, ...] = ()
    dimensions: dict[str, int] = field(default_factory=dict)
    times: dict[str, int] = field(default_factory=dict)


def fits(k: Kpi, kind: str, shape: Shape) -> bool:
    """Whether the data can carry a kind of chart for a KPI."""
    op = k.op
    periods = shape.times.get(op.over_column, next(iter(shape.times.values()), 0))
    own = op.group_by[0] if op.group_by else None
    groups = shape.dimensions.get(own, next(iter(shape.dimensions.values()), 0))
    need = {
        "line": periods >= 3, "area": periods >= 3, "waterfall": periods >= 3, "scatter": len(shape.measures) >= 2, "heatmap": len(shape.measures) >= 3,
        "histogram": bool(shape.measures), "boxplot": bool(shape.measures), "stacked_bar": groups > 0 and len(shape.measures) >= 2, "pareto": 3 <= groups <= 15,
        "bar": groups > 0, "barh": groups > 0, "lollipop": groups > 0,
    }
    part = groups > 0 or bool(shape.measures) if SHARE.search(k.name) else 0 < groups <= 2
    return need.get(kind, part if kind in ("pie", "doughnut") else False)


def validate_proposals(kpis: list[Kpi], proposals: list, shape: Shape) -> tuple[dict[str, tuple[str, str]], list[str]]:
    """({kpi_id: (kind, reason)}, errors): proposed kinds that exist, for a KPI that exists, and that the data can carry."""
    known, taken, errors = {k.kpi_id: k for k in kpis}, {}, []
    for i, p in enumerate(proposals):
        if not isinstance(p, dict):
            errors.append(f"proposal {i}: not an object")
        elif p.get("kpi_id") not in known:
            errors.append(f"proposal {i}: no KPI {p.get('kpi_id')}")
        elif p.get("kind") not in render.RENDERERS:
            errors.append(f"{p['kpi_id']}: no kind {p.get('kind')}")
        elif not fits(known[p["kpi_id"]], p["kind"], shape):
            errors.append(f"{p['kpi_id']}: {p['kind']} does not fit the data")
        else:
            taken[p["kpi_id"]] = (p["kind"], str(p.get("reason") or ""))
    return taken, errors


def kind_by_claims(kinds: list[str]) -> str | None:
    """The kind of chart that the claims about a KPI ask for, by the claims' kinds; a correlation before a trend before a comparison."""
    return next((chart for claim, chart in (("CORRELATIONAL", "scatter"), ("TREND", "line"), ("COMPARATIVE", "bar")) if claim in kinds), None)


def override(chart: Chart, k: Kpi, claims: list[str], shape: Shape) -> Chart:
    """The chart in the kind its claims ask for, if the data carry it."""
    wanted = kind_by_claims(claims)
    if wanted is None or wanted == chart.kind or not fits(k, wanted, shape):
        return chart
    return replace(chart, kind=wanted, reason=f"{chart.reason}; asked for by a claim: {wanted}")


# -- drawing -----------------------------------------------------------------------------------------------------------


def chart_data(df: DataFrame, op: Op, kind: str, points: int = 1500) -> tuple[list, dict]:
    """What a chart shows, as a small list, and further arguments of its drawing; only aggregates and at most ``points`` rows reach the driver."""
    if kind in ("line", "area", "waterfall"):
        months = statistics.monthly_totals(df, op.column, op.over_column)
        if kind == "waterfall":
            return [(r["period"], r["start"], r["end"]) for r in waterfall(months, "key", "period", "total").orderBy("period").collect()], {}
        return [(r["period"], r["total"]) for r in months.orderBy("key").collect()], {}
    if kind == "scatter":
        x, y = op.column_a, op.column_b
        rows = df.select(kpi.number(df, x).cast("double").alias("x"), kpi.number(df, y).cast("double").alias("y")).na.drop()
        fit = statistics.linear_trend(rows, "x", "y").first()
        return [(r["x"], r["y"]) for r in profiling.even_sample(rows, "x", points).collect()], {"trend": (fit["slope"], fit["intercept"])}
    if kind == "histogram":
        return [(r["low"], r["high"], r["count"]) for r in statistics.histogram(df, [op.column]).orderBy("bin").collect()], {}
    if kind == "boxplot":
        return [r.asDict() for r in statistics.box_plot(df, [op.column]).collect()], {}
    if kind == "pareto":
        rows = pareto(grouped(df, op), "label", "value").orderBy("position").limit(50).collect()
        return [(r["label"], r["value"], r["cumulative_percent"]) for r in rows], {}
    rows = top_rest(grouped(df, op), "label", "value") if op.function in ("sum", "count") else grouped(df, op)
    return [(r["label"], r["value"] or 0.0) for r in rows.orderBy(F.desc("value"), "label").limit(50).collect()], {}


def grouped(df: DataFrame, op: Op) -> DataFrame:
    return kpi.grouped_values(df, op).withColumn("value", F.col("value").cast("double"))


def draw(df: DataFrame, k: Kpi, chart: Chart) -> tuple[str, list]:
    """(SVG, data) of one chart."""
    if chart.kind == "heatmap":
        data = [(r["a"], r["b"], round(r["r"] or 0.0, 3)) for r in statistics.correlation_matrix(df, list(chart.columns)).collect()]
        return render.render("heatmap", k.name, data), data
    if chart.kind == "stacked_bar":
        dimension, *measures = chart.columns
        rows = stacked(df, dimension, measures).orderBy(dimension).limit(50).collect()
        data = [(str(r[dimension]), {m: float(r[m] or 0) for m in measures}) for r in rows]
        return render.render("stacked_bar", k.name, data), data
    op = k.op
    if chart.kind == "scatter" and op.column_a is None:
        op = Op("correlation", column_a=chart.columns[0], column_b=chart.columns[1])
    elif chart.kind in ("histogram", "boxplot"):
        op = Op("mean", column=chart.columns[0])
    data, more = chart_data(df, op, chart.kind)
    return render.render(chart.kind, k.name, data, **more), data


def interactive(kind: str, title: str, data: list) -> dict:
    """A chart as plain JSON for a page's own drawing code, with the rows behind it for drilling down."""
    if kind in ("histogram",):
        labels, values = [f"{a:g} to {b:g}" for a, b, _ in data], [n for *_, n in data]
    elif kind in ("scatter", "boxplot", "heatmap", "stacked_bar"):
        labels, values = [], [list(d) if isinstance(d, tuple) else d for d in data]
    else:
        labels, values = [d[0] for d in data], [d[-1] if kind == "waterfall" else d[1] for d in data]
    return {"kind": kind, "title": title, "labels": labels, "values": values, "rows": [list(d.values()) if isinstance(d, dict) else list(d) for d in data]}


def drill(df: DataFrame, op: Op, label: str, order: str, most: int = 50) -> DataFrame:
    """The first rows behind one group of a chart."""
    return df.where(kpi.group_label(op.group_by) == label).orderBy(order).limit(most)


def gate(svg: str, shown: float | None, total: float | None, label: str) -> tuple[str, str]:
    """(status, why): a drawing that is broken or whose groups don't add up fails, doubtful data warn, else it passes."""
    if not (svg.startswith("<svg") and svg.endswith("</svg>")) or "NaN" in svg or "Infinity" in svg:
        return "fail", "the drawing is broken"
    if shown is not None and total is not None and reconcile(shown, total) == "fail":
        return "fail", f"the groups add up to {shown:g}, not {total:g}"
    return ("pass", "drawn and reconciled") if label == "ok" else ("warn", f"data: {label}")
