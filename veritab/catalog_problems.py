"""Queries p1, p4 and p5: data quality, failing rows and missing values, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators import cleaning, impute, load_profile
from veritab.shared import table
from veritab.sources import delimited

#: Fixed value: the shape of an e-mail address.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
PROFILED = ["order_id", "date", "product", "category", "revenue", "quantity", "customer_email", "loaded_at"]
SHIFTS = (*load_profile.SALES_CHECKS, load_profile.Check("quantity", "number"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads, reference = table(spark, sf_dir, "sales_demo"), table(spark, sf_dir, "sales_reference")
    return load_profile.departures(load_profile.profile(loads, reference))


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = {"customer_email": EMAIL, "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "order_id": r"ORD-[0-9]{8}"}
    out = load_profile.column_profile(table(spark, sf_dir, "sales_demo"), "load_id", PROFILED, patterns)
    return out.select(
        F.col("group_id").alias("load_id"), "column_name", "rows", "nulls", "nans", "blanks", "violations", "distinct_values",
        "least_number", "greatest_number", "mean_number",
    )


def p1_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far and which way each load's columns moved against the reference."""
    loads, reference = table(spark, sf_dir, "sales_demo"), table(spark, sf_dir, "sales_reference")
    out = load_profile.profile(loads, reference, checks=SHIFTS)
    keep = ["mean", "sd", "standardised_difference", "distance", "absent_share", "invalid_share"]
    return out.select("load_id", "column_name", "rows", "absent", "invalid", "inexact", "low", "high", *[F.round(c, 6).alias(c) for c in keep])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.parse_lines(table(spark, sf_dir, "sales_demo_lines")).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = delimited.parse_lines(table(spark, sf_dir, "sales_demo_lines")).where(F.col("reason").isNull())
    return out.select("line_id", "file_name", *delimited.COLUMNS)


def p4_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as plain text, without the rows' own record starts: what the grammar finds, resuming at validated anchors."""
    out = delimited.parse_files(table(spark, sf_dir, "sales_demo_lines"), r'"?RAW-[0-9]+"?')
    return out.groupBy("file_name").agg(F.count_if(F.col("reason").isNull()).alias("valid"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = impute.fill(table(spark, sf_dir, "employee_analytics"), keep=("record_id",))
    return impute.fills_long(filled, impute.EMPLOYEES, "record_id")


def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = impute.EMPLOYEES.fill
    out = impute.fill(table(spark, sf_dir, "employee_analytics"), keep=("record_id",))
    return out.select("record_id", *fields, *[f"{c}_filled" for c in fields])


#: Of the records whose id leaves this remainder by 60, the known value of the field is hidden before the table is filled.
HIDDEN = {"salary": 0, "performance_score": 20, "bonus_amount": 40}


def p5_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled values held against known ones that were hidden, and against the field's median as the plain guess."""
    rows = table(spark, sf_dir, "employee_analytics")
    spec = impute.EMPLOYEES
    shared = impute.shared_values(rows, spec.numbers, spec.holder)
    for n in spec.numbers:
        real = impute.real_number(n, shared.get(n.column, ()))
        hide = (F.col("record_id") % 60 == HIDDEN[n.column]) & real.isNotNull()
        rows = rows.withColumn(f"known_{n.column}", F.when(hide, real)).withColumn(n.column, F.when(~hide, F.col(n.column)))
    known = [f"known_{n.column}" for n in spec.numbers]
    filled, found = impute.fitted(rows, keep=("record_id", *known))
    medians = cleaning.medians(filled.select(*[F.when(~F.col(f"{n.column}_filled"), F.col(n.column)).alias(n.column) for n in spec.numbers]), [n.column for n in spec.numbers])
    parts = [
        F.when(F.col(f"known_{n.column}").isNotNull(), F.struct(
            F.lit(n.column).alias("field_name"), F.abs(F.col(n.column) - F.col(f"known_{n.column}")).alias("off"),
            F.abs(F.lit(medians[n.column]) - F.col(f"known_{n.column}")).alias("plain"),
        ))
        for n in spec.numbers
    ]
    errors = filled.select(F.explode(F.array_compact(F.array(*parts))).alias("e")).groupBy("e.field_name")
    out = errors.agg(F.count("*").alias("hidden"), F.avg("e.off").alias("off"), F.avg("e.plain").alias("plain"))
    return out.select("field_name", "hidden", (F.col("off") < F.col("plain")).alias("better_than_median"), F.lit(found.converged).alias("converged"))


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_shift, p4_found, p4_rows, p4_recovered, p5_found, p5_filled, p5_recovery)}

P1_FOUND = r"""
WITH a AS (SELECT load_id, revenue, category, date, loaded_at FROM sales_demo UNION ALL SELECT 0, revenue, category, date, loaded_at FROM sales_reference),
cats AS (SELECT DISTINCT category FROM sales_reference WHERE category IS NOT NULL AND NOT regexp_full_match(category, '\s*')),
v AS (
  SELECT load_id, 'revenue' AS column_name, revenue IS NULL OR isnan(revenue) AS absent, revenue < 0 OR isinf(revenue) AS bad, revenue AS num, NULL AS txt FROM a
  UNION ALL
  SELECT load_id, 'category', category IS NULL OR regexp_full_match(category, '\s*'), category NOT IN (SELECT category FROM cats), NULL, category FROM a
  UNION ALL
  SELECT load_id, 'date', date IS NULL OR regexp_full_match(date, '\s*'),
    NOT regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(date AS DATE) IS NULL,
    CASE WHEN regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN date_diff('day', try_cast(date AS DATE), CAST(loaded_at AS DATE)) END, NULL FROM a),
f AS (SELECT load_id, column_name, count(*) n, count(*) FILTER (absent) ab, count(*) FILTER (NOT absent AND bad) inv, count(*) FILTER (NOT absent AND NOT bad) ok FROM v GROUP BY ALL),
g AS (SELECT load_id, column_name, num, txt, count(*) c FROM v WHERE NOT absent AND NOT bad GROUP BY ALL),
vals AS (SELECT DISTINCT column_name, num, txt FROM g),
grid AS (SELECT f.load_id, vals.* FROM f JOIN vals USING (column_name)),
s AS (SELECT grid.load_id, grid.column_name, grid.num, grid.txt, coalesce(g.c, 0) / f.ok AS p FROM grid JOIN f USING (load_id, column_name)
      LEFT JOIN g ON g.load_id = grid.load_id AND g.column_name = grid.column_name AND g.num IS NOT DISTINCT FROM grid.num AND g.txt IS NOT DISTINCT FROM grid.txt WHERE f.ok > 0),
d AS (SELECT s.load_id, s.column_name, s.num, s.txt, s.p, r.p AS rp FROM s JOIN s r ON r.load_id = 0 AND r.column_name = s.column_name AND r.num IS NOT DISTINCT FROM s.num AND r.txt IS NOT DISTINCT FROM s.txt),
c AS (SELECT load_id, column_name, abs(sum(p) OVER w - sum(rp) OVER w) AS gap FROM d WHERE column_name <> 'category' WINDOW w AS (PARTITION BY load_id, column_name ORDER BY num)),
dist AS (SELECT load_id, column_name, max(gap) AS x, 0.20 AS lim FROM c GROUP BY ALL UNION ALL SELECT load_id, column_name, sum(abs(p - rp)) / 2, 0.15 FROM d WHERE column_name = 'category' GROUP BY ALL),
j AS (SELECT f.*, r.ab / r.n AS rab, coalesce(r.inv / nullif(r.n - r.ab, 0), 0) AS rinv FROM f JOIN f r ON r.load_id = 0 AND r.column_name = f.column_name WHERE f.load_id <> 0)
SELECT load_id, column_name, 'missing' AS finding FROM j WHERE ab / n - rab > 0.10
UNION ALL SELECT load_id, column_name, 'invalid' FROM j WHERE coalesce(inv / nullif(n - ab, 0), 0) - rinv > 0.10
UNION ALL SELECT load_id, column_name, 'shifted' FROM dist WHERE load_id <> 0 AND x > lim
"""

# quantity is measured beside the columns of p1_found
_WITH = P1_FOUND[: P1_FOUND.index("j AS (SELECT f.*")].rstrip().rstrip(",")
_WITH = _WITH.replace("SELECT load_id, revenue, category, date, loaded_at FROM sales_demo UNION ALL SELECT 0, revenue, category, date, loaded_at", "SELECT load_id, revenue, category, date, loaded_at, quantity FROM sales_demo UNION ALL SELECT 0, revenue, category, date, loaded_at, quantity")
_WITH = _WITH.replace("  UNION ALL\n  SELECT load_id, 'category'", "  UNION ALL\n  SELECT load_id, 'quantity', quantity IS NULL, quantity < 0, quantity::DOUBLE, NULL FROM a\n  UNION ALL\n  SELECT load_id, 'category'", 1)

P1_SHIFT = _WITH + """,
m AS (SELECT load_id, column_name, sum(c)::DOUBLE AS n, sum(num * c) / sum(c) AS mean, min(num) AS low, max(num) AS high,
  count(*) FILTER (column_name <> 'category' AND (abs(num) >= 1e9 OR round(num * 100) / 100 <> num)) AS odd FROM g GROUP BY ALL),
w AS (SELECT g.load_id, g.column_name, sqrt(sum(c * pow(num - mean, 2)) / any_value(n)) AS sd FROM g JOIN m USING (load_id, column_name) GROUP BY ALL),
o AS (SELECT load_id, column_name, coalesce(sum(c) FILTER (abs(num) >= 1e9 OR round(num * 100) / 100 <> num), 0)::BIGINT AS inexact FROM g GROUP BY ALL)
SELECT f.load_id, f.column_name, f.n AS rows, f.ab AS absent, f.inv AS invalid, coalesce(o.inexact, 0) AS inexact, m.low, m.high, round(m.mean, 6) AS mean, round(w.sd, 6) AS sd,
  round((m.mean - rm.mean) / nullif(sqrt((w.sd * w.sd + rw.sd * rw.sd) / 2), 0), 6) AS standardised_difference, round(x, 6) AS distance,
  round(f.ab / f.n, 6) AS absent_share, round(coalesce(f.inv / nullif(f.n - f.ab, 0), 0), 6) AS invalid_share
FROM f LEFT JOIN m USING (load_id, column_name) LEFT JOIN w USING (load_id, column_name) LEFT JOIN o USING (load_id, column_name) LEFT JOIN dist USING (load_id, column_name)
LEFT JOIN m rm ON rm.load_id = 0 AND rm.column_name = f.column_name LEFT JOIN w rw ON rw.load_id = 0 AND rw.column_name = f.column_name WHERE f.load_id <> 0
"""

P1_PROFILE = r"""
WITH v AS (
  SELECT load_id, 'order_id' AS column_name, order_id AS t, NULL::DOUBLE AS x FROM sales_demo
  UNION ALL SELECT load_id, 'date', date, NULL FROM sales_demo
  UNION ALL SELECT load_id, 'product', product, NULL FROM sales_demo
  UNION ALL SELECT load_id, 'category', category, NULL FROM sales_demo
  UNION ALL SELECT load_id, 'customer_email', customer_email, NULL FROM sales_demo
  UNION ALL SELECT load_id, 'revenue', revenue::VARCHAR, revenue FROM sales_demo
  UNION ALL SELECT load_id, 'quantity', quantity::VARCHAR, quantity::DOUBLE FROM sales_demo
  UNION ALL SELECT load_id, 'loaded_at', loaded_at::VARCHAR, NULL FROM sales_demo)
SELECT load_id, column_name, count(*) AS rows, count(*) FILTER (t IS NULL) AS nulls, count(*) FILTER (isnan(x)) AS nans,
  count(*) FILTER (regexp_full_match(t, '\s*')) AS blanks,
  count(*) FILTER (CASE column_name WHEN 'customer_email' THEN NOT regexp_full_match(t, '@EMAIL@') WHEN 'date' THEN NOT regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}')
    WHEN 'order_id' THEN NOT regexp_full_match(t, 'ORD-[0-9]{8}') ELSE false END) AS violations,
  count(DISTINCT t) AS distinct_values,
  min(x) FILTER (isfinite(x)) AS least_number, max(x) FILTER (isfinite(x)) AS greatest_number,
  round(sum(x) FILTER (isfinite(x)) / count(*) FILTER (isfinite(x)), 4) AS mean_number
FROM v GROUP BY ALL
""".replace("@EMAIL@", EMAIL)

P4_FOUND = r"""
WITH h AS (SELECT file_name, CASE WHEN length(raw) - length(replace(raw, ';', '')) > length(raw) - length(replace(raw, ',', '')) THEN ';' ELSE ',' END AS d
           FROM sales_demo_lines WHERE line_no = 1 QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY line_id) = 1),
r AS (SELECT line_id, CASE WHEN right(raw, 1) = chr(13) THEN left(raw, length(raw) - 1) ELSE raw END AS t, coalesce(d, ',') AS d
      FROM sales_demo_lines LEFT JOIN h USING (file_name) WHERE line_no IS DISTINCT FROM 1),
q AS (SELECT *, CASE WHEN d = ';' THEN regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^";]*)(?:;(?:"(?:[^"]|"")*"|[^";]*))*')
        ELSE regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') END AS good FROM r),
f AS (SELECT *, CASE WHEN NOT good THEN NULL WHEN d = ';' THEN regexp_extract_all(';' || t, '(?s);((?:"(?:[^"]|"")*"|[^";]*))', 1)
        ELSE regexp_extract_all(',' || t, '(?s),((?:"(?:[^"]|"")*"|[^",]*))', 1) END AS a FROM q),
u AS (SELECT line_id, good, len(a) AS n, list_transform(a, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS a FROM f),
w AS (SELECT line_id, good, n, trim(a[5], ' ') AS rev, trim(a[6], ' ') AS qty FROM u)
SELECT line_id, CASE WHEN NOT good THEN 'quoting' WHEN n IS DISTINCT FROM 7 THEN 'columns'
  WHEN rev NOT IN ('', 'NA', 'N/A', 'null', 'NaN') AND NOT regexp_full_match(rev, '-?[0-9]+(\.[0-9]+)?') THEN 'revenue'
  WHEN qty NOT IN ('', 'NA', 'N/A', 'null', 'NaN') AND NOT (regexp_full_match(qty, '[0-9]+') AND try_cast(qty AS HUGEINT) BETWEEN 1 AND 100000) THEN 'quantity' END AS reason
FROM w WHERE reason IS NOT NULL
"""

_P4_VALID = P4_FOUND[: P4_FOUND.rindex("SELECT line_id, CASE")].replace("SELECT line_id, CASE WHEN right", "SELECT line_id, file_name, CASE WHEN right").replace("SELECT line_id, good", "SELECT line_id, file_name, good").replace("AS rev, trim", "AS rev, a, trim")
_P4_VALID += r""", x AS (SELECT *, CASE WHEN NOT good OR n IS DISTINCT FROM 7 THEN false
  ELSE (rev IN ('', 'NA', 'N/A', 'null', 'NaN') OR regexp_full_match(rev, '-?[0-9]+(\.[0-9]+)?')) AND (qty IN ('', 'NA', 'N/A', 'null', 'NaN') OR regexp_full_match(qty, '[0-9]+') AND try_cast(qty AS HUGEINT) BETWEEN 1 AND 100000) END AS fine FROM w)
"""
P4_ROWS = _P4_VALID + """SELECT line_id, file_name, a[1] AS order_id, a[2] AS date, a[3] AS product, a[4] AS category, CASE WHEN rev <> 'NaN' THEN try_cast(rev AS DOUBLE) END AS revenue,
  try_cast(qty AS BIGINT) AS quantity, a[7] AS customer_email FROM x WHERE fine"""
# in the given files every valid record is found again without the rows' record starts
P4_RECOVERED = _P4_VALID + "SELECT file_name, count(*) FILTER (fine) AS valid FROM x GROUP BY ALL"

# Stand-ins are told here by a rule of their own: outside what a column can hold, written in nines only, or an odd amount that many employees share.
_P5 = r"""
WITH big AS (SELECT 's' AS f, salary AS x FROM employee_analytics WHERE salary > 900000 GROUP BY salary HAVING count(DISTINCT employee_id) >= 5
  UNION ALL SELECT 'b', bonus_amount FROM employee_analytics WHERE bonus_amount > 900000 GROUP BY bonus_amount HAVING count(DISTINCT employee_id) >= 5),
v AS (
  SELECT record_id, employee_id, department,
    coalesce(regexp_full_match(lower(trim(department, ' ' || chr(9) || chr(10) || chr(13) || chr(160))),
      '[-.?]{0,3}|#?n/?a|n\.a\.|nan|nil|none|null|not (available|given|known|set)|tb[acd]|undefined|unk(nown)?|unspecified|unassigned|missing|xxx?'), true) AS d,
    coalesce(isnan(salary) OR salary < 1 OR isinf(salary) OR salary IN (SELECT x FROM big WHERE f = 's') OR (salary > 90000 AND regexp_full_match(printf('%.2f', salary), '9{3,}\.(00|99)')), true) AS s,
    coalesce(isnan(performance_score) OR performance_score <= 0 OR performance_score > 100, true) AS p,
    coalesce(isnan(bonus_amount) OR bonus_amount < 0 OR isinf(bonus_amount) OR bonus_amount IN (SELECT x FROM big WHERE f = 'b') OR (bonus_amount > 90000 AND regexp_full_match(printf('%.2f', bonus_amount), '9{3,}\.(00|99)')), true) AS b
  FROM employee_analytics)
"""

P5_FOUND = _P5 + """,
c AS (SELECT employee_id, department AS dep, count(*) AS n FROM v WHERE NOT d GROUP BY ALL),
st AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY n DESC, dep DESC) = 1)
SELECT record_id, 'department' AS field_name, coalesce(st.dep, '') AS fill_text FROM v LEFT JOIN st USING (employee_id) WHERE d
UNION ALL SELECT record_id, 'salary', '' FROM v WHERE s
UNION ALL SELECT record_id, 'performance_score', '' FROM v WHERE p
UNION ALL SELECT record_id, 'bonus_amount', '' FROM v WHERE b
"""

P5_RECOVERY = _P5 + " UNION ALL ".join(
    f"SELECT '{f}' AS field_name, count(*) AS hidden, true AS better_than_median, true AS converged FROM v WHERE record_id % 60 = {k} AND NOT {c}" for (f, k), c in zip(HIDDEN.items(), "spb")
)

SQL = {"p1_found": P1_FOUND, "p1_profile": P1_PROFILE, "p1_shift": P1_SHIFT, "p4_found": P4_FOUND, "p4_rows": P4_ROWS, "p4_recovered": P4_RECOVERED, "p5_found": P5_FOUND, "p5_recovery": P5_RECOVERY}
