"""Recomputation of KPIs by a second way: each operation is written as SQL text and run by itself.

Nothing here is shared with ``compile``: numbers in text, filters, groups, medians, ranks and periods are said again in SQL, so a
wrong formula on one side shows as a difference.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from veritab.plans.ir import Kpi, Op, Plan, blocked

RESULT = "kpi_id string, label string, value double, evidence string"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _literal(value) -> str:
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "NULL"}[value]
    return repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class Sql:
    """Statements over one view whose columns have the given types."""

    def __init__(self, view: str, kinds: dict[str, str]):
        self.view, self.kinds = view, kinds

    def number(self, column: str) -> str:
        c, kind = _name(column), self.kinds[column]
        if kind == "string":
            return f"CASE WHEN regexp_like(trim(both ' \t\n\r' from {c}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(trim(both ' \t\n\r' from {c}) AS DOUBLE) END"
        return f"nanvl(CAST({c} AS DOUBLE), NULL)"

    def instant(self, column: str) -> str:
        c = _name(column)
        return f"CAST(coalesce(try_to_timestamp({c}, 'yyyy-MM-dd HH:mm:ss'), try_to_timestamp({c}, 'yyyy-MM-dd')) AS TIMESTAMP_NTZ)" if self.kinds[column] == "string" else f"CAST({c} AS TIMESTAMP_NTZ)"

    def where(self, op: Op) -> str:
        tests = [f"{_name(c)} IN ({', '.join(map(_literal, v))})" if isinstance(v, tuple) else f"{_name(c)} = {_literal(v)}" for c, v in op.filter]
        return " WHERE " + " AND ".join(tests) if tests else ""

    def source(self, op: Op) -> str:
        return f"(SELECT * FROM {self.view}{self.where(op)})"

    def keys(self, op: Op) -> tuple[str, str]:
        """(group by, label)"""
        names = [_name(c) for c in op.group_by]
        label = " || ' | ' || ".join(f"nvl(CAST({n} AS STRING), 'nan')" for n in names)
        return (" GROUP BY " + ", ".join(names), label) if names else ("", "CAST(NULL AS STRING)")

    def aggregate(self, op: Op) -> str:
        by, label = self.keys(op)
        x, raw = self.number(op.column), _name(op.column)
        if self.kinds[op.column] in ("double", "float"):
            raw = f"nanvl({raw}, NULL)"
        if op.function == "median":
            # the middle of the ordered values, by their numbers
            over = "PARTITION BY " + ", ".join(_name(c) for c in op.group_by) if op.group_by else ""
            inner = f"SELECT *, {x} AS __x, row_number() OVER ({over} ORDER BY {x} NULLS LAST) AS __i, count({x}) OVER ({over}) AS __n FROM {self.source(op)}"
            return f"SELECT {label} AS label, avg(CASE WHEN __i IN (div(__n + 1, 2), div(__n + 2, 2)) THEN __x END) AS value FROM ({inner}){by}"
        value = {
            "sum": f"sum(nvl({x}, 0D))", "mean": f"sum({x}) / nullif(count({x}), 0)", "count": f"sum(int({raw} IS NOT NULL))", "nunique": f"size(collect_set({raw}))", "min": f"min({raw})", "max": f"max({raw})",
            "std": f"sqrt(nullif(count({x}) - 1, 0) * var_samp({x}) / nullif(count({x}) - 1, 0))",
        }[op.function]
        if op.function in ("sum", "count"):
            value = f"nvl({value}, 0)"
        return f"SELECT {label} AS label, try_cast(CAST({value} AS STRING) AS DOUBLE) AS value FROM {self.source(op)}{by}"

    def correlation(self, op: Op) -> str:
        a, b = self.number(op.column_a), self.number(op.column_b)
        rows = f"(SELECT * FROM (SELECT {a} AS a, {b} AS b FROM {self.source(op)}) WHERE a IS NOT NULL AND b IS NOT NULL)"
        if op.method == "spearman":
            mean_rank = lambda c: f"CAST(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS DOUBLE)"
            rows = f"(SELECT {mean_rank('a')} AS a, {mean_rank('b')} AS b FROM {rows})"
        means = f"(SELECT avg(a) AS ma, avg(b) AS mb, count(*) AS n FROM {rows})"
        return f"SELECT CAST(NULL AS STRING) AS label, CASE WHEN max(n) >= 3 THEN try_divide(sum((a - ma) * (b - mb)), sqrt(sum(power(a - ma, 2))) * sqrt(sum(power(b - mb, 2)))) END AS value FROM {rows} JOIN {means}"

    def growth(self, op: Op) -> str:
        t, x = self.instant(op.over_column), self.number(op.column)
        groups = "".join(f"{_name(c)}, " for c in op.group_by)
        key = "extract(YEAROFWEEK FROM __t) * 100 + weekofyear(__t)" if op.period == "WoW" else "year(__t) * 12 + month(__t)"
        totals = f"SELECT {groups}{key} AS __k, sum(__x) AS __v FROM (SELECT *, {t} AS __t, {x} AS __x FROM {self.source(op)}) WHERE __t IS NOT NULL AND __x IS NOT NULL GROUP BY {groups}{key}"
        same = "".join(f" AND p.{_name(c)} <=> n.{_name(c)}" for c in op.group_by)
        if op.basis != "start_of_period" and op.period != "YoY":
            # the period before is the one whose number is one less
            over = f"PARTITION BY {groups[:-2]} " if op.group_by else ""
            numbered = f"SELECT *, row_number() OVER ({over}ORDER BY __k) AS __i FROM totals"
            joined = f"({numbered}) n JOIN ({numbered}) p ON p.__i = n.__i - 1{same}"
        elif op.basis == "start_of_period":
            by = f" GROUP BY {groups[:-2]}" if op.group_by else ""
            firsts = f"SELECT {groups}min_by(__v, __k) AS __v FROM totals{by}"
            joined = f"totals n JOIN ({firsts}) p ON true{same}"
        else:
            joined = f"totals n JOIN totals p ON p.__k = n.__k - 12{same}"
        own = "".join(f"n.{_name(c)}, " for c in op.group_by)
        grown = f"SELECT {own}n.__k, (n.__v - p.__v) / p.__v * {100 if op.as_percent else 1} AS __g FROM {joined} WHERE p.__v <> 0"
        by, label = self.keys(op)
        out = f"SELECT {label} AS label, max_by(__g, __k) AS value FROM ({grown}){by}"
        return f"WITH totals AS ({totals}) {out}"

    def statement(self, op: Op) -> str:
        if op.function == "ratio":
            a, b = self.statement(op.numerator), self.statement(op.denominator)
            return f"SELECT CAST(NULL AS STRING) AS label, try_divide(CAST(a.value AS DOUBLE), CAST(b.value AS DOUBLE)) AS value FROM ({a}) a JOIN ({b}) b ON true"
        if op.function == "correlation":
            return self.correlation(op)
        return self.growth(op) if op.function == "growth" else self.aggregate(op)


def _columns(op: Op) -> set[str]:
    own = {c for c in (op.column, op.column_a, op.column_b, op.over_column, *op.group_by, *[c for c, _ in op.filter]) if c}
    return own.union(*[_columns(o) for o in (op.numerator, op.denominator) if o])


def recompute(df: DataFrame, plan: Plan) -> DataFrame:
    """(kpi_id, label, value, evidence) of all KPIs, each by a statement of its own; one that can't be computed has a null value."""
    spark, view = df.sparkSession, f"recompute_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(view)
    sql = Sql(view, {f.name: f.dataType.typeName() for f in df.schema.fields})
    out, failed = None, []
    for kpi in plan.kpis:
        if blocked(kpi.op) or not _columns(kpi.op) <= set(df.columns):
            failed.append((kpi.kpi_id, None, None, None))
            continue
        one = spark.sql(sql.statement(kpi.op)).selectExpr(f"'{kpi.kpi_id}' AS kpi_id", "label", "try_cast(value AS DOUBLE) AS value", f"'{kpi.op.key}' AS evidence")
        out = one if out is None else out.unionByName(one)
    lost = spark.createDataFrame(failed, RESULT)
    return lost if out is None else out.unionByName(lost)


def one(df: DataFrame, op: Op) -> DataFrame:
    return recompute(df, Plan([Kpi("K1", op.function, op)]))
