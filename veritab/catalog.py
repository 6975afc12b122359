"""Queries over the library's general operators and, where SQL can say the same, that SQL.

The tables supplied for them are clean, so defects are planted by rules of the keys, the same in both languages.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators import charts, cleaning, profiling, quality, statistics, verify
from veritab.plans import compile as kpi, recompute
from veritab.plans.ir import build_plan, parse
from veritab.shared import table
from veritab.streaming import kpi as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def _kpis(df: DataFrame, *ops: dict) -> DataFrame:
    plan = build_plan({"kpis": [{"kpi_id": f"K{i}", "operation": op} for i, op in enumerate(ops, 1)]})
    return _r(kpi.execute_plan(df, plan).select("kpi_id", "label", "value"))


def _add_kpi(name: str, source: str, ops: list[dict], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _kpis(table(spark, sf_dir, source), *ops)
    SQL[name] = sql


def _one(expr: str, source: str) -> str:
    return f"SELECT 'K1' AS kpi_id, NULL::VARCHAR AS label, round(({expr})::DOUBLE, 4) AS value FROM {source}"


_add_kpi("kpi_sum", "lineitem", [{"function": "sum", "column": "l_extendedprice"}], _one("sum(l_extendedprice)", "lineitem"))
_add_kpi("kpi_mean", "lineitem", [{"function": "mean", "column": "l_quantity"}], _one("avg(l_quantity)", "lineitem"))
_add_kpi("kpi_median", "lineitem", [{"function": "median", "column": "l_extendedprice"}], _one("median(l_extendedprice)", "lineitem"))
_add_kpi("kpi_std", "lineitem", [{"function": "std", "column": "l_extendedprice"}], _one("stddev_samp(l_extendedprice)", "lineitem"))
_add_kpi("kpi_min", "lineitem", [{"function": "min", "column": "l_discount"}], _one("min(l_discount)", "lineitem"))
_add_kpi("kpi_max", "lineitem", [{"function": "max", "column": "l_tax"}], _one("max(l_tax)", "lineitem"))
_add_kpi("kpi_count", "orders", [{"function": "count", "column": "o_orderkey"}], _one("count(o_orderkey)", "orders"))
_add_kpi("kpi_nunique", "lineitem", [{"function": "nunique", "column": "l_partkey"}], _one("count(DISTINCT l_partkey)", "lineitem"))
_add_kpi(
    "kpi_grouped_sum_two_keys", "lineitem", [{"function": "sum", "column": "l_extendedprice", "group_by": ["l_returnflag", "l_linestatus"]}],
    "SELECT 'K1' AS kpi_id, l_returnflag || ' | ' || l_linestatus AS label, round(sum(l_extendedprice), 4) AS value FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
_add_kpi(
    "kpi_grouped_median", "orders", [{"function": "median", "column": "o_totalprice", "group_by": ["o_orderpriority"]}],
    "SELECT 'K1' AS kpi_id, o_orderpriority AS label, round(median(o_totalprice), 4) AS value FROM orders GROUP BY ALL",
)
_add_kpi(
    "kpi_filtered_in", "orders", [{"function": "mean", "column": "o_totalprice", "filter": {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": "O"}}],
    _one("avg(o_totalprice)", "orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'"),
)
_add_kpi(
    "kpi_grouped_filtered", "orders", [{"function": "sum", "column": "o_totalprice", "group_by": ["o_orderstatus"], "filter": {"o_orderpriority": "1-URGENT"}}],
    "SELECT 'K1' AS kpi_id, o_orderstatus AS label, round(sum(o_totalprice), 4) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL",
)
_add_kpi(
    "kpi_ratio", "orders", [{"function": "ratio", "numerator": {"function": "sum", "column": "o_totalprice"}, "denominator": {"function": "count", "column": "o_orderkey"}}],
    _one("sum(o_totalprice) / nullif(count(o_orderkey), 0)", "orders"),
)
_add_kpi(
    "kpi_corr_pearson", "lineitem", [{"function": "correlation", "column_a": "l_quantity", "column_b": "l_extendedprice"}],
    "SELECT 'K1' AS kpi_id, NULL::VARCHAR AS label, round(corr(l_quantity, l_extendedprice), 4) AS value FROM lineitem",
)
_add_kpi(
    "kpi_corr_spearman", "lineitem", [{"function": "correlation", "column_a": "l_quantity", "column_b": "l_extendedprice", "method": "spearman"}],
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
    rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT 'K1' AS kpi_id, NULL::VARCHAR AS label, round(corr(a::DOUBLE, b::DOUBLE), 4) AS value FROM r""",
)

FUSED = [
    {"function": "sum", "column": "o_totalprice"}, {"function": "mean", "column": "o_totalprice", "filter": {"o_orderstatus": "F"}},
    {"function": "nunique", "column": "o_custkey"}, {"function": "std", "column": "o_totalprice", "filter": {"o_orderpriority": ["1-URGENT", "5-LOW"]}},
    {"function": "sum", "column": "o_totalprice", "group_by": ["o_orderstatus"]}, {"function": "max", "column": "o_totalprice", "group_by": ["o_orderstatus"]},
]
_add_kpi(
    "kpi_fused_plan", "orders", FUSED,
    """SELECT 'K1' AS kpi_id, NULL::VARCHAR AS label, round(sum(o_totalprice), 4) AS value FROM orders
    UNION ALL SELECT 'K2', NULL, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) FROM orders
    UNION ALL SELECT 'K3', NULL, count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'K4', NULL, round(stddev_samp(o_totalprice) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')), 4) FROM orders
    UNION ALL SELECT 'K5', o_orderstatus, round(sum(o_totalprice), 4) FROM orders GROUP BY ALL
    UNION ALL SELECT 'K6', o_orderstatus, round(max(o_totalprice), 4) FROM orders GROUP BY ALL""",
)


def _series(spark, sf_dir, source, **op) -> DataFrame:
    out = kpi.growth_series(table(spark, sf_dir, source), parse({"function": "growth", **op}))
    return _r(out.drop("_key"), 6)


_MONTHS = "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, year(o_orderdate) * 12 + month(o_orderdate) AS k, sum(o_totalprice) AS total FROM orders GROUP BY ALL)"
_OUT = "period, round(total, 6) AS total, round(baseline, 6) AS baseline, round((total - baseline) / baseline, 6) AS growth"


@query(f"{_MONTHS}, b AS (SELECT *, lag(total) OVER (ORDER BY k) AS baseline FROM m) SELECT {_OUT} FROM b WHERE baseline <> 0")
def growth_mom(spark, sf_dir):
    return _series(spark, sf_dir, "orders", column="o_totalprice", over_column="o_orderdate")


@query(f"{_MONTHS}, b AS (SELECT m.*, p.total AS baseline FROM m JOIN m p ON p.k = m.k - 12) SELECT {_OUT} FROM b WHERE baseline <> 0")
def growth_yoy(spark, sf_dir):
    return _series(spark, sf_dir, "orders", column="o_totalprice", over_column="o_orderdate", period="YoY")


@query(f"{_MONTHS}, b AS (SELECT *, first(total) OVER (ORDER BY k) AS baseline FROM m) SELECT {_OUT} FROM b WHERE baseline <> 0")
def growth_start_basis(spark, sf_dir):
    return _series(spark, sf_dir, "orders", column="o_totalprice", over_column="o_orderdate", basis="start_of_period")


@query("""WITH w AS (SELECT isoyear(ts) AS y, weekofyear(ts) AS w, sum(value) AS total FROM events GROUP BY ALL),
b AS (SELECT *, lag(total) OVER (ORDER BY y, w) AS baseline FROM w)
SELECT y || '-W' || lpad(w::VARCHAR, 2, '0') AS period, round(total, 6) AS total, round(baseline, 6) AS baseline, round((total - baseline) / baseline * 100, 6) AS growth FROM b WHERE baseline <> 0""")
def growth_wow(spark, sf_dir):
    return _series(spark, sf_dir, "events", column="value", over_column="ts", period="WoW", as_percent=True)


@query("""WITH m AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
b AS (SELECT *, lag(total) OVER (PARTITION BY o_orderstatus ORDER BY period) AS baseline FROM m)
SELECT o_orderstatus, max_by(period, period) AS period, round(max_by((total - baseline) / baseline, period), 6) AS value FROM b WHERE baseline <> 0 GROUP BY ALL""")
def growth_grouped(spark, sf_dir):
    op = parse({"function": "growth", "column": "o_totalprice", "over_column": "o_orderdate", "group_by": ["o_orderstatus"]})
    return _r(kpi.growth(table(spark, sf_dir, "orders"), op), 6)


def _integral(density: str, upper: str) -> str:
    """Simpson's rule from 0 to ``upper`` in SQL; ``u`` is the variable."""
    at = f"(i * ({upper}) / 4000.0)"
    return f"(SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density.replace('$u', at)}) * ({upper}) / 12000.0 FROM range(4001) steps_(i))"


# p-values by numerical integration or, for even degrees of freedom, by finite sums
def _sql_t(t: str, v: str) -> str:
    return f"round(greatest(0, 1 - 2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * {_integral(f'pow(1 + $u * $u / ({v}), -(({v}) + 1) / 2)', f'least(abs({t}), 40)')}), 6)"


def _sql_normal(z: str) -> str:
    return f"round(greatest(0, 1 - 2 / sqrt(2 * pi()) * {_integral('exp(-$u * $u / 2)', f'least({z}, 40)')}), 6)"


def _sql_chi2(x: str, halves: int) -> str:
    return "round(exp(-({x}) / 2) * (".format(x=x) + " + ".join(f"pow(({x}) / 2, {i}) / {math.factorial(i)}" for i in range(halves)) + "), 6)"


def _p(df: DataFrame, places: int = 4) -> DataFrame:
    """Rounded, the p-values to six places."""
    own = [c for c in df.columns if c == "p" or c.startswith("p_")]
    return _r(df.withColumns({c: F.round(F.lit(1) * F.col(c), 6).cast("decimal(12,6)") for c in own}), places).withColumns({c: F.col(c).cast("double") for c in own})


# -- statistics --------------------------------------------------------------------------------------------------------


@query("""WITH u AS (UNPIVOT (SELECT p_size::DOUBLE AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME variable VALUE x)
SELECT variable, count(x) AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS std, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.75), 4) AS q3,
round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr, round(skewness(x), 4) AS skewness, round(kurtosis(x), 4) AS kurtosis, min(x) AS min, max(x) AS max FROM u GROUP BY variable""")
def descriptive_summary(spark, sf_dir):
    return _r(statistics.descriptive(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))


@query("""WITH f AS (SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem),
b AS (SELECT *, greatest(2, least(50, ceil((hi - lo) / (2 * iqr / pow(n, 1 / 3.0)))))::INT AS bins FROM f),
c AS (SELECT least(floor((l_quantity - lo) * bins / (hi - lo)), bins - 1)::INT AS bin, count(*) AS count FROM lineitem, b GROUP BY ALL)
SELECT 'l_quantity' AS variable, g.bin::INT AS bin, round(lo + (hi - lo) * g.bin / bins, 4) AS low, round(lo + (hi - lo) * (g.bin + 1) / bins, 4) AS high, coalesce(count, 0) AS count
FROM b, (SELECT unnest(range(50)) AS bin) g LEFT JOIN c ON c.bin = g.bin WHERE g.bin < bins""")
def histogram_fd(spark, sf_dir):
    return _r(statistics.histogram(table(spark, sf_dir, "lineitem"), ["l_quantity"]))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS total FROM orders GROUP BY ALL)
SELECT period, round(total, 4) AS total, round(avg(total) OVER (ORDER BY period ROWS 2 PRECEDING), 4) AS rolling_mean FROM m""")
def rolling_mean_3(spark, sf_dir):
    return _r(statistics.rolling_mean(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate"))


@query("""WITH m AS (SELECT month(o_orderdate) AS mo, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
s AS (SELECT var_pop(mean) AS v FROM (SELECT avg(total) AS mean FROM m GROUP BY mo)), t AS (SELECT count(*) AS months, var_pop(total) AS v FROM m)
SELECT months, round(s.v / t.v, 6) AS strength, CASE WHEN s.v / t.v > 0.3 THEN 'seasonal' ELSE 'not_seasonal' END AS verdict FROM s, t""")
def seasonality_strength(spark, sf_dir):
    return _r(statistics.seasonality(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate"), 6)


@query("""WITH g AS (SELECT o_orderstatus AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL),
p AS (SELECT a.n AS na, a.m AS ma, a.v AS va, b.n AS nb, b.m AS mb, b.v AS vb FROM g a, g b WHERE a.g = 'F' AND b.g = 'O')
SELECT round((ma - mb) / sqrt(va / na + vb / nb), 4) AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df,
round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 4) AS cohens_d, @P@ AS p FROM (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS v FROM p)""".replace("@P@", _sql_t("t", "v")))
def welch_t(spark, sf_dir):
    return _p(statistics.welch(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", "F", "O"))


@query("""WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY ALL),
s AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n * m) AS t, sum(n * m * m) AS q, sum((n - 1) * v) AS w FROM g)
SELECT round(((q - t * t / n) / (k - 1)) / (w / (n - k)), 4) AS f, k - 1 AS df_between, (n - k)::BIGINT AS df_within, round((q - t * t / n) / (q - t * t / n + w), 6) AS eta_squared, round(pow(x, a) * (1 + a * (1 - x)), 6) AS p
FROM (SELECT *, (n - k) / 2 AS a, (n - k) / ((n - k) + (q - t * t / n) / (w / (n - k))) AS x FROM s)""")
def anova_f_eta2(spark, sf_dir):
    out = statistics.anova(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment")
    return out.select(F.round("f", 4).alias("f"), "df_between", "df_within", F.round("eta_squared", 6).alias("eta_squared"), F.round("p", 6).alias("p"))


_U_P = _sql_normal("(greatest(a.rs - a.n * (a.n + 1) / 2, a.n * b.n - a.rs + a.n * (a.n + 1) / 2) - a.n * b.n / 2 - 0.5) / sqrt(a.n * b.n / 12 * (a.n + b.n + 1 - ties / ((a.n + b.n) * (a.n + b.n - 1))))")
_RANKS = "WITH r AS (SELECT c_mktsegment AS g, c_acctbal AS x, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS rk FROM customer{where}), t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY x)), s AS (SELECT g, count(*)::DOUBLE AS n, sum(rk)::DOUBLE AS rs FROM r GROUP BY g)"


@query(_RANKS.format(where="") + ", a AS (SELECT count(*) AS k, sum(n) AS n, sum(rs * rs / n) AS q FROM s) SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h, k - 1 AS df, " + _sql_chi2("(12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n))", 2) + " AS p FROM a, t")
def kruskal_h(spark, sf_dir):
    return _p(statistics.kruskal(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment"))


@query(_RANKS.format(where=" WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')") + " SELECT round(a.rs - a.n * (a.n + 1) / 2, 2) AS u, a.n::BIGINT AS n_a, b.n::BIGINT AS n_b, ties, " + _U_P + " AS p FROM s a, s b, t WHERE a.g = 'BUILDING' AND b.g = 'MACHINERY'")
def mannwhitney_u(spark, sf_dir):
    return _p(statistics.mann_whitney(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY"), 2)


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS o FROM orders GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS rb, sum(o) OVER () AS n FROM c),
s AS (SELECT sum(pow(o - ra * rb / n, 2) / (ra * rb / n)) AS x, max(n) AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM m)
SELECT round(x, 4) AS chi2, (ka - 1) * (kb - 1) AS df, round(sqrt(x / (n * (least(ka, kb) - 1))), 4) AS cramers_v, n::BIGINT AS n, @P@ AS p FROM s""".replace("@P@", _sql_chi2("x", 4)))
def chi2_cramers_v(spark, sf_dir):
    return _p(statistics.chi_squared(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def crosstab(spark, sf_dir):
    return statistics.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


_PAIRS = [(a, b) for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i:]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS))
def corr_matrix_long(spark, sf_dir):
    return _r(statistics.correlation_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pearson(a: str, b: str) -> str:
    return (
        f"SELECT '{a}' AS a, '{b}' AS b, round(r, 4) AS r, n, {_sql_t('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)::DOUBLE')} AS p, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 4) AS low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 4) AS high, "
        f"round(r * r, 4) AS effect FROM (SELECT corr({a}, {b}) AS r, count(*) AS n FROM lineitem)"
    )


@query(" UNION ALL ".join(_pearson(a, b) for a, b in _PAIRS if a != b))
def correlation_tests(spark, sf_dir):
    return _p(statistics.correlation_tests(table(spark, sf_dir, "lineitem"), _MEASURES))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY day(o_orderdate)) + (count(*) OVER (PARTITION BY day(o_orderdate)) - 1) / 2.0 AS b FROM orders),
s AS (SELECT corr(a::DOUBLE, b::DOUBLE) AS r, count(*) AS n FROM r)
SELECT 'o_totalprice' AS a, 'day' AS b, round(r, 4) AS r, n, @P@ AS p, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 4) AS low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 4) AS high, round(r * r, 4) AS effect FROM s""".replace("@P@", _sql_t("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)::DOUBLE")))
def spearman_tests(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_totalprice", F.dayofmonth("o_orderdate").alias("day"))
    return _p(statistics.correlation_tests(rows, ["o_totalprice", "day"], "spearman"))


@query("""WITH c AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), d AS (SELECT DISTINCT g FROM c), pr AS (SELECT p.g AS ga, q.g AS gb FROM d p JOIN d q ON p.g < q.g),
k AS (SELECT ga, gb, g, x, rank() OVER (PARTITION BY ga, gb ORDER BY x) + (count(*) OVER (PARTITION BY ga, gb, x) - 1) / 2.0 AS rk FROM pr JOIN c ON g IN (ga, gb)),
ti AS (SELECT ga, gb, sum(n * n * n - n)::DOUBLE AS ties FROM (SELECT ga, gb, count(*)::DOUBLE AS n FROM k GROUP BY ga, gb, x) GROUP BY ALL), s AS (SELECT ga, gb, g, count(*)::DOUBLE AS n, sum(rk)::DOUBLE AS rs FROM k GROUP BY ALL),
o AS (SELECT a.ga, a.gb, a.rs - a.n * (a.n + 1) / 2 AS u, @P@ AS p FROM s a JOIN s b ON a.ga = b.ga AND a.gb = b.gb AND a.g = a.ga AND b.g = b.gb JOIN ti ON ti.ga = a.ga AND ti.gb = a.gb)
SELECT ga AS a, gb AS b, round(u, 4) AS u, p, round(least(1, p * (SELECT count(*) FROM pr)), 4) AS p_adjusted FROM o""".replace("@P@", _U_P))
def posthoc_pairs(spark, sf_dir):
    out = _p(statistics.posthoc_pairs(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment"))
    return out.withColumn("p_adjusted", F.round("p_adjusted", 4))


@query(f"""WITH m AS (SELECT 'MoM' AS kind, strftime(o_orderdate, '%Y-%m') AS period, year(o_orderdate) * 12 + month(o_orderdate) AS k, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
w AS (SELECT isoyear(o_orderdate) || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') AS period, isoyear(o_orderdate) * 100 + weekofyear(o_orderdate) AS k, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
g AS (SELECT 'MoM' AS kind, period, v / lag(v) OVER (ORDER BY k) - 1 AS growth FROM m UNION ALL SELECT 'YoY', m.period, m.v / p.v - 1 FROM m JOIN m p ON p.k = m.k - 12 UNION ALL SELECT 'WoW', period, v / lag(v) OVER (ORDER BY k) - 1 FROM w)
SELECT 'o_totalprice' AS measure, 'o_orderdate' AS over, kind, period, round(growth, 6) AS growth FROM g WHERE growth IS NOT NULL""")
def growth_suite(spark, sf_dir):
    return _r(statistics.growth_suite(table(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderdate"]), 6)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem")
def linear_trend(spark, sf_dir):
    return _r(statistics.linear_trend(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) AS q3, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
w AS (SELECT *, greatest(lo, q1 - 1.5 * (q3 - q1)) AS lw, least(hi, q3 + 1.5 * (q3 - q1)) AS hw FROM q)
SELECT 'o_totalprice' AS variable, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, round(lw, 4) AS low_whisker, round(hw, 4) AS high_whisker, (SELECT count(*) FROM orders, w WHERE o_totalprice < lw OR o_totalprice > hw) AS outliers FROM w""")
def box_plot(spark, sf_dir):
    return _r(statistics.box_plot(table(spark, sf_dir, "orders"), ["o_totalprice"]))


# -- profile -----------------------------------------------------------------------------------------------------------

_CUST = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM customer" for c, t in _CUST.items()))
def profile_columns(spark, sf_dir):
    return profiling.profile(table(spark, sf_dir, "customer")).select("column_name", "dtype", "rows", "nulls", "distinct_values")


@query("WITH a AS (SELECT * FROM finance), g AS (SELECT count(*) AS n FROM a GROUP BY account_id, date, debit, credit, balance, category) SELECT sum(n - 1)::BIGINT AS duplicate_rows, count(*) FILTER (n > 1) AS repeated_groups FROM g")
def exact_duplicates(spark, sf_dir):
    return profiling.duplicates(table(spark, sf_dir, "finance"))


@query("""SELECT 'customer_email' AS column_name, count(*) FILTER (regexp_matches(customer_email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails,
count(*) FILTER (regexp_matches(customer_email, '^\\s*(?:\\+|00)?[0-9][0-9 ().-]{7,}[0-9]\\s*$')) AS phones, true AS by_name FROM sales_demo
UNION ALL SELECT 'product', count(*) FILTER (regexp_matches(product, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')), count(*) FILTER (regexp_matches(product, '^\\s*(?:\\+|00)?[0-9][0-9 ().-]{7,}[0-9]\\s*$')), false FROM sales_demo""")
def pii_scan(spark, sf_dir):
    return profiling.pii_scan(table(spark, sf_dir, "sales_demo"), ["customer_email", "product"])


@query("SELECT '[REDACTED]' AS c_name, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def pii_redact(spark, sf_dir):
    return profiling.redact(table(spark, sf_dir, "customer"), ["c_name"]).groupBy("c_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC, c_mktsegment LIMIT 5),
r AS (SELECT c.c_custkey, c.c_mktsegment, row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY c_custkey) - 1 AS pos, greatest(n // 4, 1) AS stride FROM customer c JOIN t USING (c_mktsegment))
SELECT c_mktsegment, c_custkey FROM r WHERE pos % stride = 0 AND pos / stride < 4""")
def stratified_sample(spark, sf_dir):
    return profiling.stratified_sample(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey").select("c_mktsegment", "c_custkey")


# -- quality -----------------------------------------------------------------------------------------------------------


def _holes(spark, sf_dir) -> DataFrame:
    """lineitem with planted gaps: MCAR, tied to the return flag, in the first third, and two columns together."""
    q, p = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
        F.when(q % 11 != 0, F.col("l_quantity")).alias("mcar"), F.when((F.col("l_returnflag") != "R") | (q % 2 != 0), F.col("l_quantity")).alias("mar"),
        F.when((q * 7 + p) % 13 != 0, F.col("l_tax")).alias("pair_a"), F.when(((q * 7 + p) % 13 != 0) | (q % 5 == 0), F.col("l_discount")).alias("pair_b"),
    )


_HOLES = """WITH h AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate, CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS mcar, CASE WHEN l_returnflag <> 'R' OR l_orderkey % 2 <> 0 THEN l_quantity END AS mar,
CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 <> 0 THEN l_tax END AS pair_a, CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 <> 0 OR l_orderkey % 5 = 0 THEN l_discount END AS pair_b FROM lineitem)"""


@query("""WITH u AS (UNPIVOT (SELECT p_size::DOUBLE AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME column_name VALUE x),
b AS (SELECT column_name, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM u GROUP BY ALL HAVING count(*) >= 10), w AS (SELECT column_name, a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM b WHERE b > a)
SELECT column_name, round(low, 4) AS low, round(high, 4) AS high, count(*) FILTER (x < low OR x > high) AS outliers FROM u JOIN w USING (column_name) GROUP BY ALL""")
def iqr_outliers(spark, sf_dir):
    return _r(quality.iqr_outliers(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))


_MAD = """WITH x AS (SELECT employee_id, snapshot_day, {seg} AS segment, hours_worked::DOUBLE AS x FROM employee_analytics WHERE hours_worked IS NOT NULL), m AS (SELECT segment, median(x) AS med FROM x GROUP BY ALL HAVING count(*) >= 10),
d AS (SELECT segment, any_value(med) AS med, median(abs(x - med)) AS mad FROM x JOIN m ON x.segment IS NOT DISTINCT FROM m.segment GROUP BY ALL)
SELECT record_id, segment, x, round(z, 4) AS z FROM (SELECT e.record_id, d.segment, e.hours_worked::DOUBLE AS x, 0.6745 * (e.hours_worked - med) / CASE WHEN mad = 0 THEN 1e-12 ELSE mad END AS z
FROM employee_analytics e JOIN d ON d.segment IS NOT DISTINCT FROM {eseg}) WHERE abs(z) > 3.5""".replace("SELECT segment, any_value(med) AS med, median(abs(x - med)) AS mad FROM x JOIN m ON x.segment IS NOT DISTINCT FROM m.segment GROUP BY ALL", "SELECT m.segment, any_value(med) AS med, median(abs(x - med)) AS mad FROM x JOIN m ON x.segment IS NOT DISTINCT FROM m.segment GROUP BY m.segment")


@query(_MAD.format(seg="NULL::VARCHAR", eseg="NULL"))
def mad_outliers(spark, sf_dir):
    return _r(quality.mad_outliers(table(spark, sf_dir, "employee_analytics"), "hours_worked", keep=("record_id",)))


@query(_MAD.format(seg="level", eseg="e.level"))
def mad_outliers_by_segment(spark, sf_dir):
    return _r(quality.mad_outliers(table(spark, sf_dir, "employee_analytics"), "hours_worked", "level", keep=("record_id",)))


@query(_HOLES + " ".join(f"{'UNION ALL' if i else ''} SELECT '{s}' AS segment, {s} AS value, '{c}' AS column_name, count(*) AS rows, round(avg(({c} IS NULL)::DOUBLE), 6) AS missing_rate FROM h GROUP BY {s}" for i, (s, c) in enumerate((s, c) for s in ("l_returnflag", "l_linestatus") for c in ("mcar", "mar"))))
def missing_by_segment(spark, sf_dir):
    return quality.missing_by_segment(_holes(spark, sf_dir), ["mcar", "mar"], ["l_returnflag", "l_linestatus"])


@query(_HOLES + " SELECT strftime(l_shipdate, '%Y-%m') AS month, round(avg((mcar IS NULL)::DOUBLE), 6) AS mcar, round(avg((mar IS NULL)::DOUBLE), 6) AS mar FROM h GROUP BY ALL")
def missing_by_month(spark, sf_dir):
    return quality.missing_by_month(_holes(spark, sf_dir), ["mcar", "mar"], "l_shipdate")


@query(_HOLES + ", p AS (SELECT count(*) FILTER (pair_a IS NULL AND pair_b IS NULL) AS b, count(*) FILTER (pair_a IS NULL OR pair_b IS NULL) AS u FROM h) SELECT 'pair_a' AS column_a, 'pair_b' AS column_b, b AS both, round(b / u, 3) AS jaccard FROM p WHERE b >= 3 AND b / u >= 0.5")
def co_missing_jaccard(spark, sf_dir):
    return quality.co_missing(_holes(spark, sf_dir), ["mcar", "pair_a", "pair_b"])


def _ordered(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("row_id"), "o_orderstatus", "o_totalprice")
    n = rows.agg(F.count("*").alias("n"), F.min("row_id").alias("lo")).withColumn("one", F.lit(1))
    rows = rows.withColumn("one", F.lit(1)).join(n, "one")
    return rows.select("row_id", "o_orderstatus", F.when((F.col("row_id") >= F.floor(F.col("n") / 3)) | (F.col("row_id") % 2 == 0), F.col("o_totalprice")).alias("mnar"), F.when(F.col("row_id") % 9 != 0, F.col("o_totalprice")).alias("mcar"))


_ORDERED = """WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey AS row_id, n, CASE WHEN o_orderkey >= n // 3 OR (o_orderkey) % 2 = 0 THEN o_totalprice END AS mnar, CASE WHEN (o_orderkey) % 9 <> 0 THEN o_totalprice END AS mcar FROM orders, n),
t AS (SELECT *, CASE WHEN row_id < n // 3 THEN 0 WHEN row_id < 2 * n // 3 THEN 1 ELSE 2 END::INT AS third FROM o)"""


@query(_ORDERED + " SELECT 'mnar' AS column_name, third, round(avg((mnar IS NULL)::DOUBLE), 6) AS missing_rate FROM t GROUP BY ALL UNION ALL SELECT 'mcar', third, round(avg((mcar IS NULL)::DOUBLE), 6) FROM t GROUP BY ALL")
def missing_thirds(spark, sf_dir):
    return quality.missing_thirds(_ordered(spark, sf_dir), ["mnar", "mcar"], "row_id")


_NA, _UNK = (", ".join(f"'{t}'" for t in ts) for ts in (quality.NA_TEXTS, quality.UNKNOWN_TEXTS))


@query(f"SELECT 'department' AS column_name, count(*) FILTER (department IS NULL) AS nan, count(*) FILTER (trim(replace(department, chr(160), ' '), ' ') = '') AS blank, count(*) FILTER (lower(trim(replace(department, chr(160), ' '), ' ')) IN ({_NA})) AS na, count(*) FILTER (lower(trim(replace(department, chr(160), ' '), ' ')) IN ({_UNK})) AS unknown, 0::BIGINT AS zero FROM employee_analytics UNION ALL SELECT 'bonus_amount', count(*) FILTER (bonus_amount IS NULL OR isnan(bonus_amount)), 0, 0, 0, count(*) FILTER (bonus_amount = 0) FROM employee_analytics")
def sentinel_census(spark, sf_dir):
    return quality.sentinel_census(table(spark, sf_dir, "employee_analytics"), ["department", "bonus_amount"])


@query("WITH h AS (SELECT DISTINCT employee_id FROM hr WHERE employee_id IS NOT NULL), e AS (SELECT DISTINCT employee_id FROM employee_analytics WHERE employee_id IS NOT NULL) SELECT count(*) AS distinct_values, count(h.employee_id) AS matched, count(*) - count(h.employee_id) AS orphans FROM e LEFT JOIN h USING (employee_id)")
def orphan_references(spark, sf_dir):
    return quality.orphans(table(spark, sf_dir, "employee_analytics"), "employee_id", table(spark, sf_dir, "hr"), "employee_id")


@query("SELECT 'l_quantity:below_range' AS violation, count(*) FILTER (l_quantity < 5) AS rows FROM lineitem UNION ALL SELECT 'l_quantity:above_range', count(*) FILTER (l_quantity > 45) FROM lineitem UNION ALL SELECT 'l_returnflag:forbidden_value', count(*) FILTER (l_returnflag IN ('R')) FROM lineitem UNION ALL SELECT 'l_orderkey:repeated', (count(l_orderkey) - count(DISTINCT l_orderkey)) FROM lineitem")
def contract_violations(spark, sf_dir):
    c = quality.Contract
    return quality.contract_violations(table(spark, sf_dir, "lineitem"), [c("l_quantity", 5, 45), c("l_returnflag", forbidden=("R",)), c("l_orderkey", unique=True)])


@query("SELECT 'revenue:negative' AS finding, count(*) FILTER (revenue < 0) AS rows FROM sales_demo UNION ALL SELECT 'product:sql_suspected', count(*) FILTER (regexp_matches(product, '(?i)(?:;|''|\\b(?:DROP|DELETE|INSERT|UPDATE|SELECT|UNION|ALTER|CREATE|EXEC|EXECUTE)\\b)')) FROM sales_demo UNION ALL SELECT 'loaded_at:impossible', count(*) FILTER (year(loaded_at) >= 2100) FROM sales_demo UNION ALL SELECT 'loaded_at:future', count(*) FILTER (loaded_at::DATE > DATE '2023-06-01' + 365 AND year(loaded_at) < 2100) FROM sales_demo UNION ALL SELECT 'product:mixed_units', 0 FROM (SELECT 1)")
def validity_checks(spark, sf_dir):
    return quality.validity(table(spark, sf_dir, "sales_demo"), ["revenue"], ["loaded_at"], ["product"], as_of="2023-06-01")


# -- cleaning ----------------------------------------------------------------------------------------------------------


@query(_HOLES + " SELECT l_orderkey, l_linenumber, mcar IS NULL AS mcar_missing_flag, coalesce(mcar, (SELECT median(mcar) FROM h)) AS mcar FROM h")
def clean_median_fill(spark, sf_dir):
    rows = _holes(spark, sf_dir).select("l_orderkey", "l_linenumber", "mcar")
    return cleaning.median_fill(rows, ["mcar"], flag=True).select("l_orderkey", "l_linenumber", "mcar_missing_flag", "mcar")


_SEG = "WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS seg FROM customer)"


def _segments(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("seg"))


@query(_SEG + ", m AS (SELECT seg FROM h WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1) SELECT c_custkey, coalesce(h.seg, m.seg) AS seg FROM h, m")
def clean_mode_fill(spark, sf_dir):
    return cleaning.mode_fill(_segments(spark, sf_dir), ["seg"])


@query(_SEG + " SELECT c_custkey, coalesce(seg, 'Unknown') AS seg FROM h")
def clean_unknown_fill(spark, sf_dir):
    return cleaning.unknown_fill(_segments(spark, sf_dir), ["seg"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 OR c_acctbal IS NULL")
def clean_drop_negative(spark, sf_dir):
    return cleaning.drop_negative(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("SELECT DISTINCT account_id, date, debit, credit, balance, category FROM finance")
def clean_dedup(spark, sf_dir):
    df = table(spark, sf_dir, "finance")
    return cleaning.dedup(df, df.columns)


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a) AS o_totalprice_outlier_flag FROM orders, q")
def clean_outlier_flag(spark, sf_dir):
    return cleaning.iqr_flag(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", "o_totalprice_outlier_flag")


@query("""WITH t AS (SELECT o_orderkey, (o_orderkey * 37 % 900)::INT AS v FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1000.0 * v + 7 WHEN 1 THEN v * 1000.0 WHEN 2 THEN v::DOUBLE WHEN 3 THEN v + 0.5 WHEN 4 THEN NULL ELSE v::DOUBLE END::DOUBLE AS amount FROM t""")
def parse_amount(spark, sf_dir):
    v = (F.col("o_orderkey") * 37 % 900).cast("int")
    s, k = v.cast("string"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("$"), s, F.lit(",007"))).when(k == 1, F.concat(s, F.lit("k"))).when(k == 2, F.concat(s, F.lit("%")))
        .when(k == 3, F.concat(F.lit("EGP "), s, F.lit(".5"))).when(k == 4, F.lit("abc")).otherwise(F.concat(s, F.lit(" USD")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", cleaning.parse_amount(text).alias("amount"))


@query("SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 50 WHEN 1 THEN o_orderkey % 50 * 0.001 WHEN 2 THEN o_orderkey % 50 * 0.45359237 ELSE NULL END, 6)::DOUBLE AS kg FROM orders")
def convert_units(spark, sf_dir):
    s, k = (F.col("o_orderkey") % 50).cast("string"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(s, F.lit(" kg"))).when(k == 1, F.concat(s, F.lit("g"))).when(k == 2, F.concat(s, F.lit(" LBS"))).otherwise(F.concat(s, F.lit(" miles")))
    return _r(table(spark, sf_dir, "orders").select("o_orderkey", cleaning.convert_unit(text, "kg").alias("kg")), 6)


@query("SELECT row_id, trim(regexp_replace(product, '[\\s ]+', ' ', 'g'), ' ') AS product FROM sales_duplicates")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "sales_duplicates").select("row_id", cleaning.normalize_text(F.col("product")).alias("product"))


@query("""WITH a AS (SELECT c_acctbal AS x FROM customer), b AS (SELECT x FROM a WHERE x >= 0)
SELECT 'c_acctbal' AS measure, (SELECT count(*) FROM a) AS rows_before, (SELECT count(*) FROM b) AS rows_after, round((SELECT sum(x) FROM a), 2) AS sum_before, round((SELECT sum(x) FROM b), 2) AS sum_after, round((SELECT sum(x) FROM b) - (SELECT sum(x) FROM a), 2) AS delta, round((SELECT median(x) FROM b), 2) AS median_after""")
def impact_delta(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    out = cleaning.impact(c, cleaning.drop_negative(c, "c_acctbal"), ["c_acctbal"])
    return _r(out.select("measure", "rows_before", "rows_after", "sum_before", "sum_after", "delta", "median_after"), 2)


# -- charts and verification ---------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT o_orderpriority, round(v, 2) AS value, round(sum(v) OVER w, 2) AS running, round(sum(v) OVER w / sum(v) OVER () * 100, 4) AS cumulative_percent, (row_number() OVER w)::INT AS position FROM g WINDOW w AS (ORDER BY v DESC, o_orderpriority ROWS UNBOUNDED PRECEDING)""")
def pareto_cumulative(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    out = charts.pareto(g, "o_orderpriority", "v")
    return out.select("o_orderpriority", F.round("value", 2).alias("value"), F.round("running", 2).alias("running"), F.round("cumulative_percent", 4).alias("cumulative_percent"), "position")


@query(f"{_MONTHS} SELECT period, round(total - coalesce(lag(total) OVER (ORDER BY k), 0), 2) AS delta, round(coalesce(lag(total) OVER (ORDER BY k), 0), 2) AS start, round(total, 2) AS end FROM m")
def waterfall_running(spark, sf_dir):
    m = statistics.monthly_totals(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate")
    return _r(charts.waterfall(m, "key", "period", "total"), 2)


@query("""WITH g AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, p_brand) AS n FROM g)
SELECT CASE WHEN n <= 15 THEN p_brand ELSE '$rest' END AS p_brand, round(sum(v), 2) AS v FROM r GROUP BY 1""")
def topn_rest_rollup(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    return _r(charts.top_rest(g, "p_brand", "v"), 2)


@query("SELECT c_mktsegment, round(sum(greatest(c_acctbal, 0)), 2) AS c_acctbal FROM customer GROUP BY ALL")
def stacked_sums(spark, sf_dir):
    return _r(charts.stacked(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_acctbal"]), 2)


@query("SELECT 'ok' AS status, 12 + 3 * count(DISTINCT o_orderstatus) AS n FROM orders UNION ALL SELECT 'null', 1")
def kpi_recompute_compare(spark, sf_dir):
    """Fused results against statements of their own in SQL text, for all eleven functions, each KPI and group on its own."""
    grown = {"function": "growth", "column": "o_totalprice", "over_column": "o_orderdate"}
    more = [
        {"function": "median", "column": "o_totalprice", "filter": {"o_orderpriority": "1-URGENT"}}, {"function": "min", "column": "o_orderdate"}, {"function": "count", "column": "o_orderkey"},
        {"function": "ratio", "numerator": {"function": "sum", "column": "o_totalprice"}, "denominator": {"function": "count", "column": "o_orderkey"}},
        {"function": "correlation", "column_a": "o_totalprice", "column_b": "o_shippriority"}, {"function": "correlation", "column_a": "o_totalprice", "column_b": "o_shippriority", "method": "spearman"},
        grown, {**grown, "period": "YoY", "as_percent": True}, {**grown, "period": "WoW", "basis": "start_of_period"}, {**grown, "group_by": ["o_orderstatus"]},
    ]
    orders = table(spark, sf_dir, "orders").withColumn("o_shippriority", F.dayofmonth("o_orderdate"))
    plan = build_plan({"kpis": [{"operation": op} for op in (*FUSED, *more)]})
    return verify.compare(kpi.execute_plan(orders, plan), recompute.recompute(orders, plan)).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT 1::BIGINT AS o_custkey, 0::BIGINT AS n WHERE false")
def dangling_references(spark, sf_dir):
    return verify.dangling(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


# -- star schema, streams --------------------------------------------------------------------------------------------------


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single table the engine analyses, joined from the star schema; Spark picks the joins by measured sizes."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


@query("SELECT 'K1' AS kpi_id, r_name || ' | ' || c_mktsegment AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment")
def star_schema_kpi(spark, sf_dir):
    out = kpi.execute_plan(wide(spark, sf_dir), build_plan({"kpis": [{"kpi_id": "K1", "operation": {"function": "sum", "column": "l_extendedprice", "group_by": ["r_name", "c_mktsegment"]}}]}))
    return _r(out.select("kpi_id", "label", "value"), 2)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_kpi(spark, sf_dir):
    return _r(stream.windowed(table(spark, sf_dir, "events"), "ts", "value", ["event_type"]))


@query("""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_kpi(spark, sf_dir):
    return stream.sessions(table(spark, sf_dir, "events"), "ts", "user_id")


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_id, event_type, user_id FROM events) GROUP BY ALL")
def stream_once(spark, sf_dir):
    return stream.once(table(spark, sf_dir, "events"), "ts", ["event_id"]).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


