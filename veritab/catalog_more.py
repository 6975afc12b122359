"""Further queries over the general operators: coercion, repair, contracts, samples, charts and what the library decides without a table."""

from __future__ import annotations

import csv
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab import pipeline
from veritab.catalog import FUSED, _kpis, _one, _ordered, _r
from veritab.operators import charts, cleaning, profiling, quality, report, understanding, verify
from veritab.plans import compile as kpi
from veritab.plans.ir import Kpi, build_plan, parse, validate
from veritab.shared import ensure_checkpoint_dir, table
from veritab.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _values(columns: str, rows: list[tuple]) -> str:
    """Expected rows as SQL."""
    say = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) v({columns})"


# -- projections and filters -----------------------------------------------------------------------------------------------


@query(_one("corr(l_quantity, l_extendedprice)", "lineitem WHERE l_returnflag = 'R' AND l_linestatus IN ('O', 'F')"))
def kpi_corr_filtered(spark, sf_dir):
    return _kpis(table(spark, sf_dir, "lineitem"), {"function": "correlation", "column_a": "l_quantity", "column_b": "l_extendedprice", "filter": {"l_returnflag": "R", "l_linestatus": ["O", "F"]}})


def _written(spark, sf_dir) -> DataFrame:
    """Orders with numbers and dates written in several ways, some of them none."""
    k, v = F.col("o_orderkey") % 8, (F.col("o_orderkey") % 97).cast("string")
    number = (
        F.when(k == 0, v).when(k == 1, F.concat(F.lit("  "), v, F.lit(".5 "))).when(k == 2, F.concat(v, F.lit("e2"))).when(k == 3, F.concat(F.lit("-"), v)).when(k == 4, F.concat(v, F.lit("d")))
        .when(k == 5, F.lit("NaN")).when(k == 6, F.lit("Infinity"))
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    when = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T10:20:30+02:00"))).when(k == 2, F.concat(day, F.lit(" 01:02:03"))).when(k == 3, F.lit("2024-02-30")).when(k == 4, F.concat(day, F.lit("T00:30:00Z"))).when(k == 5, F.lit("soon"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", number.alias("amount"), when.alias("placed"))


_WRITTEN = """WITH w AS (SELECT o_orderkey, o_orderpriority, o_orderkey % 8 AS k, (o_orderkey % 97)::DOUBLE AS v, CAST(o_orderdate AS DATE) AS d FROM orders),
n AS (SELECT *, CASE k WHEN 0 THEN v WHEN 1 THEN v + 0.5 WHEN 2 THEN v * 100 WHEN 3 THEN -v END AS amount FROM w)"""


@query(_WRITTEN + " SELECT o_orderpriority, count(amount) AS n, round(sum(amount), 4) AS total FROM n GROUP BY ALL")
def coerced_numbers(spark, sf_dir):
    df = _written(spark, sf_dir)
    x = kpi.number(df, "amount")
    return df.groupBy("o_orderpriority").agg(F.count(x).alias("n"), F.round(F.sum(x), 4).alias("total"))


@query(_WRITTEN + " SELECT o_orderkey, CASE k WHEN 0 THEN d::TIMESTAMP WHEN 1 THEN d + INTERVAL '8 hours 20 minutes 30 seconds' WHEN 2 THEN d + INTERVAL '1 hour 2 minutes 3 seconds' WHEN 4 THEN d + INTERVAL '30 minutes' END AS placed FROM n")
def normalized_dates(spark, sf_dir):
    return _written(spark, sf_dir).select("o_orderkey", cleaning.normalize_dates(F.col("placed")).alias("placed"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 <> 0")
def dropped_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return cleaning.drop_null(rows, "c_acctbal")


@query("SELECT r_regionkey FROM region")
def dropped_column(spark, sf_dir):
    return cleaning.execute(table(spark, sf_dir, "region"), cleaning.normalize_strategy([{"action": "drop_column", "column": "r_name"}, {"action": "burn", "column": "r_name"}], ["r_regionkey", "r_name"]))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey FROM orders, q WHERE o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def dropped_outliers(spark, sf_dir):
    return cleaning.iqr_flag(table(spark, sf_dir, "orders"), "o_totalprice", drop=True).select("o_orderkey")


def _damaged(spark, sf_dir) -> DataFrame:
    """Customers with amounts as text, impossible dates and repeats."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("$"), F.format_string("%.2f", F.abs("c_acctbal"))).alias("balance"),
        F.when(F.col("c_custkey") % 10 == 0, "2024-13-45").when(F.col("c_custkey") % 10 == 1, "2150-01-01").otherwise("2024-05-06").alias("since"),
    )
    return rows.unionByName(rows.where("c_custkey % 3 = 0"))


@query("SELECT c_custkey, round(abs(c_acctbal), 2) AS balance, TIMESTAMP '2024-05-06 00:00:00' AS since FROM customer WHERE c_custkey % 10 NOT IN (0, 1)")
def repaired(spark, sf_dir):
    return cleaning.repair(_damaged(spark, sf_dir), ["balance"], ["since"])


@query("SELECT c_custkey, round(abs(c_acctbal), 2) AS balance, '$x' AS note FROM customer")
def normalized_amounts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("USD "), F.format_string("%.2f", F.abs("c_acctbal"))).alias("balance"), F.lit("$x").alias("note"))
    return cleaning.normalize_amounts(rows, ["balance", "note"])


@query("SELECT c_custkey, c_custkey % 9 <> 0 AND c_custkey % 2 = 0 AS kept, c_custkey % 9 = 0 AS seg_missing_flag FROM customer")
def kept_with_flag(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("seg"))
    out = cleaning.execute(rows, cleaning.Strategy([cleaning.Step("keep_flag", "seg")]))
    return out.select("c_custkey", (F.col("seg").isNotNull() & (F.col("c_custkey") % 2 == 0)).alias("kept"), "seg_missing_flag")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'lamp TABLE x' ELSE 'its fine' END AS note FROM orders")
def sanitized_text(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    note = F.when(k == 1, "lamp'; DROP TABLE x").when(k == 2, "it's fine;")
    cleaned = cleaning.sanitize_text(note)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_replace(cleaned, " +", " ").alias("note"))


@query("SELECT o_orderkey, lower(o_orderpriority) AS a, o_orderstatus AS b FROM orders")
def unified_case(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("a"), F.col("o_orderstatus").alias("b"))
    return cleaning.unify_case(cleaning.unify_case(rows, "a"), "b")


@query(_WRITTEN + " SELECT o_orderkey, amount, CASE k WHEN 0 THEN d::TIMESTAMP WHEN 2 THEN d + INTERVAL '1 hour 2 minutes 3 seconds' END AS placed, k::VARCHAR AS kind FROM n")
def cast_by_role(spark, sf_dir):
    rows = _written(spark, sf_dir).select("o_orderkey", "amount", "placed", (F.col("o_orderkey") % 8).alias("kind"))
    return cleaning.cast_by_role(rows, {"o_orderkey": "identifier", "amount": "measure", "placed": "temporal", "kind": "dimension"})


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, (SELECT count(*) FROM orders) AS n, o_orderkey, o_totalprice FROM orders)
SELECT o_orderkey, o_totalprice FROM o WHERE round(round(i * (least(n, 1500) - 1)::DOUBLE / (n - 1)) * (n - 1)::DOUBLE / (least(n, 1500) - 1)) = i""")
def even_sample(spark, sf_dir):
    return profiling.even_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1500)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5")
def first_rows(spark, sf_dir):
    return profiling.head(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("""WITH t AS (SELECT l_shipmode_, count(*) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY ALL ORDER BY n DESC, l_shipmode_ LIMIT 5),
r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag || l_linestatus AS flags FROM lineitem), o AS (SELECT r.*, row_number() OVER (PARTITION BY flags ORDER BY id) - 1 AS pos, greatest(n // 4, 1) AS stride FROM r JOIN t ON flags = l_shipmode_),
s AS (SELECT id, flags FROM o WHERE pos % stride = 0 AND pos / stride < 4), rest AS (SELECT id, flags, 1 AS later FROM r WHERE id NOT IN (SELECT id FROM s) ORDER BY id LIMIT 20)
SELECT id, flags FROM (SELECT id, flags, 0 AS later FROM s UNION ALL SELECT * FROM rest) ORDER BY later, id LIMIT 20""")
def stratified_sample_chosen(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat("l_returnflag", "l_linestatus").alias("flags"))
    return profiling.stratified_sample(rows, None, "id")


# -- KPI helpers --------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority AS label, round(median(o_totalprice), 4) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def grouped_values(spark, sf_dir):
    return _r(kpi.grouped_values(table(spark, sf_dir, "orders"), parse({"function": "median", "column": "o_totalprice", "group_by": ["o_orderpriority"], "filter": {"o_orderstatus": "F"}})))


@query("""WITH m AS (SELECT o_orderstatus AS label, year(o_orderdate) * 12 + month(o_orderdate) AS k, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
g AS (SELECT m.label, m.k, m.period, m.v / p.v - 1 AS g FROM m JOIN m p ON p.label = m.label AND p.k = m.k - 12 WHERE p.v <> 0) SELECT label, max_by(period, k) AS period, round(max_by(g, k), 6) AS value FROM g GROUP BY ALL""")
def grouped_growth_values(spark, sf_dir):
    op = parse({"function": "growth", "column": "o_totalprice", "over_column": "o_orderdate", "period": "YoY", "group_by": ["o_orderstatus"]})
    return _r(kpi.grouped_growth_values(table(spark, sf_dir, "orders"), op), 6)


@query("SELECT 'KPI-001' AS kpi_id, NULL::VARCHAR AS label, 'KPI-001' AS group_id UNION ALL SELECT 'KPI-002', label, 'KPI-002-' || lpad(row_number() OVER (ORDER BY label)::VARCHAR, 3, '0') FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)")
def numbered_groups(spark, sf_dir):
    plan = build_plan({"kpis": [{"operation": {"function": "sum", "column": "o_totalprice"}}, {"operation": {"function": "sum", "column": "o_totalprice", "group_by": ["o_orderpriority"]}}]})
    return kpi.numbered(kpi.execute_plan(table(spark, sf_dir, "orders"), plan), plan).select("kpi_id", "label", "group_id")


@query("SELECT CAST(ts AS DATE) AS day, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_sums(spark, sf_dir):
    return _r(kpi.daily_sums(table(spark, sf_dir, "events"), "value", "ts"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, median(o_totalprice) AS v FROM orders GROUP BY ALL ORDER BY period DESC LIMIT 2), a AS (SELECT max(period) AS period, min_by(v, period) AS p, max_by(v, period) AS c FROM m)
SELECT period, round(p, 4) AS previous, round(c, 4) AS current, round(c - p, 4) AS delta, round((c - p) / p * 100, 2) AS delta_percent FROM a""")
def period_variance(spark, sf_dir):
    return _r(kpi.period_variance(table(spark, sf_dir, "orders"), parse({"function": "median", "column": "o_totalprice"}), "o_orderdate"))


@query("SELECT min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last, ((year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate)) + 1)::INT AS months FROM orders")
def temporal_span(spark, sf_dir):
    return understanding.temporal_span(table(spark, sf_dir, "orders"), "o_orderdate")


# -- quality -------------------------------------------------------------------------------------------------------------------


@query("SELECT 'discount_pct:negative' AS finding, count(*) FILTER (l_discount < 0) AS rows FROM lineitem UNION ALL SELECT 'discount_pct:over_100_percent', count(*) FILTER (l_orderkey % 4 = 0 AND l_discount > 0.05) FROM lineitem UNION ALL SELECT 'age:negative', count(*) FILTER (l_linenumber - 2 < 0) FROM lineitem UNION ALL SELECT 'age:out_of_range', count(*) FILTER (l_linenumber - 2 < 0 OR (l_linenumber - 2) * 60 > 150) FROM lineitem")
def percent_and_age(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * F.when(F.col("l_orderkey") % 4 == 0, 2000).otherwise(100)).alias("discount_pct"), ((F.col("l_linenumber") - 2) * 60).alias("age"))
    return quality.validity(rows, ["discount_pct", "age"], [], [], "2024-01-01")


@query("""WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey AS i, n, o_orderstatus AS s, CASE WHEN o_orderkey >= n // 3 OR (o_orderkey) % 2 = 0 THEN 1 END AS mnar, CASE WHEN (o_orderkey) % 9 <> 0 THEN 1 END AS mcar, CASE WHEN o_orderstatus <> 'F' OR o_orderkey % 2 = 1 THEN 1 END AS mar FROM orders, n),
u AS (SELECT i, n, s, c, v FROM (SELECT i, n, s, 'mnar' AS c, mnar AS v FROM o UNION ALL SELECT i, n, s, 'mcar', mcar FROM o UNION ALL SELECT i, n, s, 'mar', mar FROM o)),
r AS (SELECT c, round(avg((v IS NULL)::DOUBLE), 6) AS missing_rate FROM u GROUP BY c), g AS (SELECT c, max(x) - min(x) AS gap FROM (SELECT c, s, round(avg((v IS NULL)::DOUBLE), 6) AS x FROM u GROUP BY c, s) GROUP BY c),
t AS (SELECT c, max(x) - min(x) AS gap FROM (SELECT c, CASE WHEN i < n // 3 THEN 0 WHEN i < 2 * n // 3 THEN 1 ELSE 2 END AS k, round(avg((v IS NULL)::DOUBLE), 6) AS x FROM u GROUP BY ALL) GROUP BY c)
SELECT r.c AS column_name, missing_rate, CASE WHEN missing_rate = 0 THEN 'none' WHEN g.gap > 0.2 THEN 'MAR' WHEN t.gap > 0.3 THEN 'MNAR' ELSE 'MCAR' END AS mechanism FROM r JOIN g USING (c) JOIN t USING (c)""")
def missing_mechanism(spark, sf_dir):
    rows = _ordered(spark, sf_dir).withColumn("mar", F.when((F.col("o_orderstatus") != "F") | (F.col("row_id") % 2 == 1), F.lit(1.0)))
    return quality.missing_mechanism(rows, ["mnar", "mcar", "mar"], ["o_orderstatus"], "row_id")


@query("SELECT 'employee_id:null_identifier' AS finding, count(*) FILTER (employee_id IS NULL) AS rows FROM hr UNION ALL SELECT 'name:null_identifier', count(*) FILTER (name IS NULL) FROM hr")
def identifier_nulls(spark, sf_dir):
    return quality.identifier_nulls(table(spark, sf_dir, "hr"), ["employee_id", "name"])


@query("""WITH r AS (SELECT o_custkey::VARCHAR AS customer_id, (o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000 ELSE 0 END)::VARCHAR AS buyer_customer FROM orders), k AS (SELECT DISTINCT customer_id FROM r), v AS (SELECT DISTINCT buyer_customer FROM r)
SELECT 'buyer_customer' AS column_name, 'customer_id' AS identifier, count(*) AS distinct_values, count(*) FILTER (buyer_customer NOT IN (SELECT customer_id FROM k)) AS orphans FROM v""")
def referential_integrity(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 1_000_000).otherwise(0)).alias("buyer_customer"), "o_totalprice")
    return quality.referential_integrity(rows, ["customer_id"])


@query("SELECT * FROM (SELECT 'l_quantity:below_range' AS violation, count(*) FILTER (l_quantity < 5) AS rows FROM lineitem UNION ALL SELECT 'l_quantity:above_range', count(*) FILTER (l_quantity > 40) FROM lineitem UNION ALL SELECT 'l_tax:below_range', count(*) FILTER (l_tax < 0.02) FROM lineitem) WHERE rows > 0")
def declared_ranges(spark, sf_dir):
    return quality.out_of_declared_range(table(spark, sf_dir, "lineitem"), "Usually l_quantity between 5 and 40, and l_tax >= 0.02; weight from 1 to 2.")


@query("""SELECT 'c_acctbal' AS column_name, round(min(c_acctbal) - 0.05 * (max(c_acctbal) - min(c_acctbal)), 4) AS low, round(max(c_acctbal) + 0.05 * (max(c_acctbal) - min(c_acctbal)), 4) AS high, false AS is_unique, NULL::VARCHAR AS date_format, NULL::VARCHAR AS unit FROM customer
UNION ALL SELECT 'weight_kg', round(0 - 0.05 * 99, 4), round(99 + 0.05 * 99, 4), false, NULL, 'kg' UNION ALL SELECT 'since', NULL, NULL, false, 'yyyy/MM/dd', NULL UNION ALL SELECT 'c_custkey', NULL, NULL, true, NULL, NULL""")
def built_contracts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", (F.col("c_custkey") % 100).alias("weight_kg"), F.lit("2024/01/31").alias("since"))
    own = quality.build_contracts(rows, ["c_acctbal", "weight_kg"], ["c_custkey", "c_nationkey"], ("since",))
    return _r(spark.createDataFrame([(c.column, c.low, c.high, c.unique, c.date_format, c.unit) for c in own], "column_name string, low double, high double, is_unique boolean, date_format string, unit string"))


_TXT = "lower(trim(replace({c}, chr(160), ' '), ' '))"
_NA, _UNK = (", ".join(f"'{t}'" for t in ts) for ts in (quality.NA_TEXTS, quality.UNKNOWN_TEXTS))


@query(f"""WITH c AS (SELECT 'department' AS column_name, count(*) AS n, count(*) FILTER (department IS NULL) AS missing, count(*) FILTER ({_TXT.format(c='department')} IN ('', {_NA}, {_UNK})) AS sentinels, 'impute_unknown_category' AS verdict FROM employee_analytics
UNION ALL SELECT 'salary', count(*), count(*) FILTER (salary IS NULL OR isnan(salary)), 0, CASE WHEN avg((salary IS NULL OR isnan(salary))::DOUBLE) >= 0.1 THEN 'impute_median' ELSE 'low' END FROM employee_analytics UNION ALL SELECT 'employee_id', count(*), count(*) FILTER (employee_id IS NULL), 0, 'cannot_impute' FROM employee_analytics)
SELECT column_name, missing, round(missing / n, 6) AS rate, sentinels::BIGINT AS sentinels, round((missing + sentinels) / n, 6) AS effective_rate, verdict FROM c""")
def deep_missingness(spark, sf_dir):
    return quality.deep_missingness(table(spark, sf_dir, "employee_analytics"), {"department": "dimension", "salary": "measure", "employee_id": "identifier"})


_Z = "WITH x AS (SELECT record_id, {seg} AS segment, hours_worked::DOUBLE AS x FROM employee_analytics WHERE hours_worked IS NOT NULL), m AS (SELECT segment, median(x) AS med FROM x GROUP BY ALL HAVING count(*) >= 10), d AS (SELECT x.*, med FROM x JOIN m ON x.segment IS NOT DISTINCT FROM m.segment), a AS (SELECT segment, median(abs(x - med)) AS mad FROM d GROUP BY ALL), z AS (SELECT d.record_id, d.segment, d.x, 0.6745 * (d.x - med) / CASE WHEN mad = 0 THEN 1e-12 ELSE mad END AS z FROM d JOIN a ON d.segment IS NOT DISTINCT FROM a.segment)"


@query(_Z.format(seg="NULL::VARCHAR") + " SELECT record_id, segment, x, round(z, 4) AS z FROM z WHERE abs(z) > 3.5 ORDER BY abs(z) DESC, record_id LIMIT 5")
def worst_outliers(spark, sf_dir):
    return _r(quality.worst_outliers(table(spark, sf_dir, "employee_analytics"), "hours_worked", keep=("record_id",)))


@query(_Z.format(seg="level") + " SELECT record_id, segment, x, round(z, 4) AS z FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY abs(z) DESC, record_id) AS n FROM z WHERE abs(z) > 3.5) WHERE n <= 3")
def worst_outliers_by_segment(spark, sf_dir):
    return _r(quality.worst_outliers(table(spark, sf_dir, "employee_analytics"), "hours_worked", "level", keep=("record_id",)))


@query("""WITH f AS (SELECT line_id - 1 AS i, file_name, raw FROM sales_demo_lines), g AS (SELECT *, row_number() OVER (PARTITION BY file_name, raw ORDER BY i) AS n FROM f) SELECT i, file_name, raw FROM g WHERE n > 1 ORDER BY i LIMIT 5""")
def duplicate_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "sales_demo_lines").select((F.col("line_id") - 1).alias("i"), "file_name", "raw")
    return profiling.duplicate_examples(rows, "i")


@query("WITH t AS (SELECT o_custkey + CASE WHEN o_orderkey % 100 = 0 THEN 5000000 ELSE 0 END AS o_custkey FROM orders) SELECT o_custkey, count(*) AS n FROM t WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY ALL")
def planted_dangling(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 100 == 0, 5_000_000).otherwise(0)).alias("o_custkey"))
    return verify.dangling(rows, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT 'K1' AS kpi_id, o_orderpriority AS label, round(sum(o_totalprice), 2) AS now, round(sum(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-01-01'), 2) AS before, round(sum(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-01-01'), 2) AS delta FROM orders GROUP BY ALL")
def compared_runs(spark, sf_dir):
    orders, plan = table(spark, sf_dir, "orders"), build_plan({"kpis": [{"kpi_id": "K1", "operation": {"function": "sum", "column": "o_totalprice", "group_by": ["o_orderpriority"]}}]})
    return _r(verify.compare_runs(kpi.execute_plan(orders, plan), kpi.execute_plan(orders.where("o_orderdate < '1998-01-01'"), plan)), 2)


# -- profile, files ---------------------------------------------------------------------------------------------------------------


@query("SELECT row_id, nfc_normalize(product) AS product FROM sales_duplicates")
def normalize_nfc(spark, sf_dir):
    return table(spark, sf_dir, "sales_duplicates").select("row_id", cleaning.nfc("product").alias("product"))


_HASH = "('0x' || substr(sha256(concat_ws(chr(31), {t})), 1, 15))::BIGINT"


@query("SELECT count(*) AS rows, sum(" + _HASH.format(t="'=' || c_custkey, '=' || c_name, '=' || c_nationkey, '=' || c_mktsegment") + ")::VARCHAR AS hash FROM customer")
def fingerprint(spark, sf_dir):
    return profiling.fingerprint(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def infer_csv_types(spark, sf_dir):
    """Text columns typed by content, as after reading a CSV."""
    text = table(spark, sf_dir, "supplier").select(*[F.col(c).cast("string").alias(c) for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")])
    return files.infer_types(text)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1")
def union_by_name(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    blank = n.select(F.lit(None).cast("int").alias("n_nationkey"), F.lit(None).cast("string").alias("n_name")).limit(1)
    return files.union_sheets([n.where("n_nationkey % 2 = 0"), n.where("n_nationkey % 2 = 1").select("n_name", "n_nationkey"), blank])


@query("WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey AS row_id, n, o_orderstatus, CASE WHEN o_orderkey >= n // 3 OR (o_orderkey) % 2 = 0 THEN o_totalprice END AS mnar, CASE WHEN (o_orderkey) % 9 <> 0 THEN o_totalprice END AS mcar FROM orders, n), m AS (SELECT median(mcar) AS med FROM o WHERE mcar >= 0 OR mcar IS NULL), f AS (SELECT row_id, o_orderstatus, mnar, mnar IS NULL AS mnar_missing_flag, mcar IS NULL AS mcar_missing_flag, coalesce(mcar, med) AS mcar FROM o, m WHERE mcar >= 0 OR mcar IS NULL), q AS (SELECT quantile_cont(mcar, 0.25) AS a, quantile_cont(mcar, 0.75) AS b FROM f) SELECT f.*, mcar < a - 1.5 * (b - a) OR mcar > b + 1.5 * (b - a) AS mcar_outlier_flag FROM f, q")
def clean_pipeline(spark, sf_dir):
    """Mechanism, strategy and execution on the planted gaps."""
    rows = _ordered(spark, sf_dir)
    missing = {r["column_name"]: (r["missing_rate"], r["mechanism"]) for r in quality.missing_mechanism(rows, ["mnar", "mcar"], ["o_orderstatus"], "row_id").collect()}
    return cleaning.execute(rows, cleaning.build_strategy({"mnar": "measure", "mcar": "measure"}, missing, negative=["mcar"], outliers=["mcar"]))


_ROLES = [
    ("record_id", "identifier"), ("snapshot_day", "temporal"), ("employee_id", "identifier"), ("hire_date", "temporal"), ("department", "dimension"), ("level", "dimension"), ("salary", "measure"),
    ("tenure_years", "measure"), ("performance_score", "measure"), ("projects_completed", "measure"), ("hours_worked", "measure"), ("bonus_amount", "measure"), ("received_at", "temporal"),
]


@query(_values("column_name, role", _ROLES))
def column_roles(spark, sf_dir):
    found = profiling.roles(table(spark, sf_dir, "employee_analytics"))
    return spark.createDataFrame([(r.column, r.role) for r in found.values()], "column_name string, role string")


@query("""SELECT 'gender' AS column_name, true AS code_like, false AS ordinal, NULL::VARCHAR AS unit, 'categorical' AS role UNION ALL SELECT 'rating', false, true, NULL, 'measure' UNION ALL SELECT 'weight_kg', false, false, 'kg', 'measure' UNION ALL SELECT 'zip', false, false, NULL, 'identifier'""")
def column_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 2).alias("gender"), (F.col("c_custkey") % 5).alias("rating"), (F.col("c_custkey") % 400).alias("weight_kg"), F.format_string("0%04d", F.col("c_custkey") % 9999).alias("zip"))
    u, facts = understanding.understand(rows), profiling.identifier_facts(rows)
    return spark.createDataFrame([(c.name, understanding.is_code_like(c.name, facts[c.name]), c.ordinal, c.unit, c.role) for c in u.columns], "column_name string, code_like boolean, ordinal boolean, unit string, role string")


# -- charts ------------------------------------------------------------------------------------------------------------------------


@query(_values("kind, columns, reason", [("histogram", "o_totalprice", "distribution"), ("pareto", "o_orderstatus,o_totalprice", "additive values of a few groups"), ("bar", "o_orderstatus,o_totalprice", "3 groups")]))
def chart_plan(spark, sf_dir):
    plan = build_plan({"kpis": [{"operation": op} for op in FUSED]})
    orders = table(spark, sf_dir, "orders")
    dims = sorted({k.op.group_by[0] for k in plan.kpis if k.op.group_by})
    sizes = orders.agg(*[F.count_distinct(d).alias(d) for d in dims]).first().asDict()
    found = [c for k in plan.kpis for c in charts.plan_op(k.op, sizes.get(k.op.group_by[0], 0) if k.op.group_by else 0, 12)] + charts.plan_measures(["o_totalprice"], 100)
    ranked, _ = charts.rank(found)
    return spark.createDataFrame([(c.kind, ",".join(c.columns), c.reason) for c in ranked], "kind string, columns string, reason string")


@query("""WITH p AS (SELECT count(DISTINCT o_orderpriority) AS n FROM orders), m AS (SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n FROM orders), t AS (SELECT least(count(*), 1500) AS n FROM part),
h AS (SELECT count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS iqr FROM part)
SELECT k AS kind, n AS marks FROM p, (SELECT unnest(['bar', 'barh', 'lollipop', 'pie', 'doughnut']) AS k) UNION ALL SELECT 'pareto', 2 * n FROM p UNION ALL SELECT k, n FROM m, (SELECT unnest(['line', 'area']) AS k) UNION ALL SELECT 'waterfall', n + 1 FROM m
UNION ALL SELECT 'histogram', greatest(2, least(50, ceil((hi - lo) / (2 * iqr / pow(n, 1 / 3.0)))))::BIGINT FROM h UNION ALL SELECT 'boxplot', 1 UNION ALL SELECT 'scatter', n FROM t UNION ALL SELECT 'heatmap', 4 UNION ALL SELECT 'stacked_bar', 2 * count(DISTINCT p_brand) FROM part""")
def chart_marks(spark, sf_dir):
    """Each kind of chart drawn from a table, and the number of marks in the drawing."""
    orders, part, out = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part"), []
    by = Kpi("K1", "by priority", parse({"function": "mean", "column": "o_totalprice", "group_by": ["o_orderpriority"]}))
    over = Kpi("K2", "by month", parse({"function": "growth", "column": "o_totalprice", "over_column": "o_orderdate"}))
    pair = Kpi("K3", "size and price", parse({"function": "correlation", "column_a": "p_size", "column_b": "p_retailprice"}))
    for kind, df, k, columns in (
        *((kind, orders, by, ("o_orderpriority", "o_totalprice")) for kind in ("bar", "barh", "lollipop", "pie", "doughnut", "pareto")),
        *((kind, orders, over, ("o_totalprice", "o_orderdate")) for kind in ("line", "area", "waterfall")),
        ("histogram", part, pair, ("p_retailprice",)), ("boxplot", part, pair, ("p_retailprice",)), ("scatter", part, pair, ("p_size", "p_retailprice")),
        ("heatmap", part, pair, ("p_size", "p_retailprice")), ("stacked_bar", part, pair, ("p_brand", "p_size", "p_retailprice")),
    ):
        svg, data = charts.draw(df, k, charts.Chart(kind, columns, ""))
        assert charts.gate(svg, None, None, "ok")[0] == "pass" and charts.interactive(kind, k.name, data)["rows"]
        out.append((kind, svg.count("<title>")))
    return spark.createDataFrame(out, "kind string, marks long")


# -- what is decided without a table ----------------------------------------------------------------------------------------------------


@query(_values("what, answer", [
    ("domain", "sales 0.7"), ("no domain", "generic 0.0"), ("unit", "kg"), ("currency", "EUR"), ("filter", "a==1 & b in ['x', 'y']"), ("verdict", "NEEDS_REVISION"), ("score", "80.0"), ("label", "data_warning"), ("level", "moderate"),
    ("strategy", "median_fill,unknown_fill,drop_column,flag_and_preserve,drop_row"), ("override", "identifier"), ("no override", "measure"), ("bad plan", "2"), ("card", "sum of revenue"), ("claim kind", "scatter"), ("safe", "null"),
]))
def decisions(spark, sf_dir):
    role = profiling.Role("x", "measure")
    act = [cleaning.action_for(*a) for a in (("measure", 0.02, "MCAR"), ("dimension", 0.2, "MCAR"), ("measure", 0.8, "MCAR"), ("dimension", 0.3, "MAR"), ("temporal", 0.3, "MNAR"))]
    cards = report.cards([{"name": "mean of age", "column": "age", "function": "mean", "value": 900.0}, {"name": "sum of revenue", "column": "revenue", "function": "sum", "value": 5.0}])
    out = {
        "domain": " ".join(map(str, understanding.domain_of("orders of products"))), "no domain": " ".join(map(str, understanding.domain_of("x y"))), "unit": understanding.unit_of("weight_kg"), "currency": understanding.unit_of("total EUR"),
        "filter": parse({"function": "sum", "column": "v", "filter": {"a": 1, "b": ["x", "y"]}}).render_filter(), "verdict": verify.verdict(0, 0, ("stage_time_limit_exceeded",)), "score": str(verify.score(1, 2, 0)),
        "label": understanding.quality_label(0, 0, 0.2, 0)[0], "level": quality.missingness_level([0.0, 0.3]), "strategy": ",".join(act), "override": understanding.override_role(role, "long", "identifier")[0],
        "no override": understanding.override_role(role, "long", "temporal")[0], "bad plan": str(len(validate({"function": "sum", "over": 1}))), "card": cards[0]["name"], "claim kind": charts.kind_by_claims(["COMPARATIVE", "CORRELATIONAL"]),
        "safe": str(understanding.json_safe(float("nan"))).replace("None", "null"),
    }
    return spark.createDataFrame(list(out.items()), "what string, answer string")


@query("SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def drafted_claims(spark, sf_dir):
    """Claims of grouped KPIs, validated against their evidence, in turns; one for each group."""
    plan = build_plan({"kpis": [{"kpi_id": "K1", "operation": {"function": "sum", "column": "o_totalprice", "group_by": ["o_orderstatus"]}}]})
    evidence = verify.Evidence()
    rows = sorted(kpi.execute_plan(table(spark, sf_dir, "orders"), plan).collect(), key=lambda r: r["label"])
    kpis = [{"name": r["label"], "value": r["value"], "evidence": evidence.add("kpi", r["value"])} for r in rows]
    kept, _ = verify.validate_claims(verify.draft_claims(kpis, [], [], []), evidence)
    return spark.createDataFrame([(c.text.split(" is ")[0], int(c.claim_id[3:])) for c in kept], "o_orderstatus string, n long")


# -- files, runs -------------------------------------------------------------------------------------------------------------------------


def _scratch(spark) -> Path:
    """A new folder inside the session's shared one."""
    at = Path(ensure_checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")) / f"files-{uuid.uuid4().hex}"
    at.mkdir(parents=True)
    return at


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name || '; \"x\"' AS n_name, n_regionkey * 1.5 AS half, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'é' END AS note FROM nation")
def csv_scan(spark, sf_dir):
    """A CSV in latin-1 with semicolons, quotes and signs of absence, written by the driver and read by Spark."""
    path = _scratch(spark) / "nation.csv"
    with path.open("w", newline="", encoding="latin-1") as f:
        writer = csv.writer(f, delimiter=";")
        writer.writerow(["n_nationkey", "n_name", "half", "note"])
        for r in table(spark, sf_dir, "nation").collect():
            writer.writerow([r["n_nationkey"], r["n_name"] + '; "x"', r["n_regionkey"] * 1.5, "N/A" if r["n_nationkey"] % 3 == 0 else "é"])
    return files.read(spark, str(path))


@query("SELECT r_regionkey, r_name, 2 AS attempt FROM region")
def versioned_sink(spark, sf_dir):
    """Two attempts beside each other; the later one is what is analysed."""
    at, region = _scratch(spark), table(spark, sf_dir, "region")
    for attempt in (1, 2):
        files.write_attempt(region.withColumn("attempt", F.lit(attempt)), str(at / "cleaned"), attempt)
    return files.read(spark, files.prefer_ready(str(at)))


@query(_values("what, answer", [
    ("none", "file_not_found"), ("a.txt", "unsupported_format"), ("nul.csv", "invalid_signature"), ("zip.csv", "invalid_signature"), ("bad.xlsx", "parser_error"), ("few.csv", "min_rows"), ("quote.csv", "parser_error"), ("good.csv", "ok"), ("big.csv", "file_too_large"),
    ("rejected", "False"), ("stored", "True"), ("cached", "run-2 APPROVED"), ("previous", "run-2"),
]))
def file_gates(spark, sf_dir):
    at, out = _scratch(spark), {"none": files.validate_file("/nowhere.csv")}
    good = b"a,b\n" + b"1,2\n" * 6
    for name, body in {"a.txt": b"x", "nul.csv": b"a\0b\n", "zip.csv": b"PK\x03\x04", "bad.xlsx": b"PK\x03\x04 x", "few.csv": b"a,b\n1,2\n", "quote.csv": b'a,b\n1,"x"y\n' * 9, "good.csv": good}.items():
        (at / name).write_bytes(body)
        out[name] = files.validate_file(str(at / name)) or "ok"
    out["big.csv"] = files.validate_file(str(at / "good.csv"), max_mb=1e-6)
    cache = files.ResultCache(str(at / "cache.db"))
    key = cache.key("hash", {"a": 1})
    out["rejected"] = str(cache.store(key, "s.csv", "run-1", "NEEDS_REVISION", 1.0))
    out["stored"] = str(cache.store(key, "s.csv", "run-2", "APPROVED", 2.0))
    out["cached"], out["previous"] = " ".join(cache.get(key)), cache.previous("s.csv")
    return spark.createDataFrame(list(out.items()), "what string, answer string")


@query(_values("what, answer", [
    ("proposal", "lollipop"), ("rejected", "3"), ("claimed", "bar"), ("low n", "bar low_n"), ("ranked", "line,bar,bar"), ("cut", "True"), ("gate", "fail"), ("labels", "a,b"), ("recommendations", "8"), ("contradictions", "2"), ("summary", "The headline figure is revenue at 5.00."),
    ("sections", "13"), ("dangling", "critical,critical"), ("context", "generic 0.0"), ("prompt", "1"), ("json", "a"), ("score", "0.0"),
]))
def report_decisions(spark, sf_dir):
    k, shape = Kpi("K1", "sum of a", parse({"function": "sum", "column": "a", "group_by": ["g"]})), charts.Shape(("a",), {"g": 5}, {})
    taken, errors = charts.validate_proposals([k], [{"kpi_id": "K1", "kind": "lollipop"}, {"kpi_id": "K1", "kind": "line"}, {"kpi_id": "K9", "kind": "bar"}, 1], shape)
    low = charts.downgrade(charts.Chart("pareto", ("g", "a"), ""), 5, 9)
    ranked, cut = charts.rank([charts.Chart("bar", ("a",), "", 0.8), charts.Chart("bar", ("b",), "", 0.79), charts.Chart("line", ("c",), "", 0.9), charts.Chart("bar", ("a",), "", 0.8), charts.Chart("pie", ("d",), "", 0.1)], most=3)
    claims = [verify.Claim(f"IN-{i}", "DESCRIPTIVE", "t", ["EV-001"]) for i in range(12)]
    evidence = verify.Evidence()
    bad = report.broken_references(evidence, [], claims[:1], [report.Recommendation("R", "none", "")], [], list(report.SECTIONS))
    answers, confidence = understanding.gather_context()
    out = {
        "proposal": taken["K1"][0], "rejected": str(len(errors)), "claimed": charts.override(charts.Chart("pareto", ("g", "a"), ""), k, ["COMPARATIVE"], shape).kind, "low n": f"{low.kind} {low.flags[0]}", "ranked": ",".join(c.kind for c in ranked), "cut": str(cut),
        "gate": charts.gate("<svg></svg>", 1.0, 2.0, "ok")[0], "labels": ",".join(charts.interactive("bar", "t", [("a", 1.0), ("b", 2.0)])["labels"]), "recommendations": str(len(report.recommend(claims))),
        "contradictions": str(len(report.contradictions("It has no dates. Nothing was removed, none deleted.", ["d"], 4))), "summary": report.summary([{"name": "revenue", "value": 5.0}], 0, "").split(" No")[0], "sections": str(report.page("t", {}, [], []).count("<section")),
        "dangling": ",".join(s for s, _ in bad), "context": f"{'generic' if not answers else ''} {confidence}", "prompt": str(understanding.fence("</data>").count("</data>")), "json": next(iter(pipeline.first_json('so: {"a": 1}.'))), "score": str(verify.score(9, 0, 0)),
    }
    return spark.createDataFrame(list(out.items()), "what string, answer string")


@query("SELECT p_brand AS label, round(sum(p_retailprice), 2) AS value, 'approved' AS verdict FROM part GROUP BY ALL")
def pipeline_kpis(spark, sf_dir):
    """A whole run, from a table to its verdict, and the KPIs it reports."""
    plan = {"kpis": [{"operation": {"function": "sum", "column": "p_retailprice", "group_by": ["p_brand"]}}], "tests": ["descriptive"]}
    out = pipeline.run(spark, table(spark, sf_dir, "part"), str(_scratch(spark)), pipeline.Config(plan=plan))
    rows = [(k["label"], round(k["value"], 2), "approved" if out.verdict.startswith("APPROVED") else out.verdict) for k in out.kpis]
    return spark.createDataFrame(rows, "label string, value double, verdict string")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50")
def drilled_rows(spark, sf_dir):
    op = parse({"function": "sum", "column": "o_totalprice", "group_by": ["o_orderpriority", "o_orderstatus"]})
    return charts.drill(table(spark, sf_dir, "orders"), op, "1-URGENT | F", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def json_sink(spark, sf_dir):
    at = str(_scratch(spark) / "region.json")
    files.write_json(table(spark, sf_dir, "region"), at)
    return spark.read.json(at)
