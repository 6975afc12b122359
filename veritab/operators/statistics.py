"""The statistical suite as DataFrames: each operator scans its input once for all of its columns.

p-values come from ``functions.special`` by Arrow functions over the few aggregated rows of a test (``with_p``), so every test is a
lazy DataFrame with its statistic and its p.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import special
from veritab.plans.compile import average_rank, correlation, exact_quantiles, growth_series, moment, number, period_key, spearman
from veritab.plans.ir import Op, is_identifier_name

MIN_BINS, MAX_BINS = 2, 50
#: Distribution tails by the names of their arguments' columns.
TAILS = {"t": special.t_two_sided, "f": special.f_tail, "chi2": special.chi2_tail, "mann_whitney": lambda u, m, n, ties: special.mann_whitney_p(u, int(m), int(n), ties)}


def with_p(df: DataFrame, tail: str, *inputs: Column, name: str = "p") -> DataFrame:
    """``df`` with a p-value; null inputs give null."""
    fn = TAILS[tail]

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(fn(*row)) for row in zip(*columns)], dtype="float64")

    udf = F.pandas_udf(lambda *c: run(*c), "double") if len(inputs) > 4 else {
        2: F.pandas_udf(lambda a, b: run(a, b), "double"), 3: F.pandas_udf(lambda a, b, c: run(a, b, c), "double"), 4: F.pandas_udf(lambda a, b, c, d: run(a, b, c, d), "double"),
    }[len(inputs)]
    return df.withColumn(name, udf(*[c.cast("double") for c in inputs]))


def _unpivot(df: DataFrame, measures: list[str], keep: list[str] | None = None) -> DataFrame:
    parts = [F.struct(F.lit(m).alias("variable"), number(df, m).cast("double").alias("x")) for m in measures]
    return df.select(*(keep or []), F.explode(F.array(*parts)).alias("u")).select(*(keep or []), "u.*").where(F.col("x").isNotNull())


def descriptive(df: DataFrame, measures: list[str]) -> DataFrame:
    """n, moments, quartiles and adjusted skewness and kurtosis of each measure."""
    n, g, k = F.col("n"), F.col("_g"), F.col("_k")
    rows = _unpivot(df, measures)
    quartiles = exact_quantiles(rows, ["variable"], "x", [0.25, 0.5, 0.75], "_q").drop("n")
    out = rows.groupBy("variable").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.var_pop("x").alias("_v"),
        F.skewness("x").alias("_g"), F.kurtosis("x").alias("_k"),
    ).join(quartiles, "variable")
    skew = F.when((n > 2) & (F.col("_v") > 0), g * F.sqrt(n * (n - 1.0)) / (n - 2))
    kurt = F.when((n > 3) & (F.col("_v") > 0), (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * k + 6))
    q = lambda i: F.element_at("_q", i)
    return out.select(
        "variable", "n", "mean", q(2).alias("median"), "std", q(1).alias("q1"), q(3).alias("q3"), (q(3) - q(1)).alias("iqr"),
        skew.alias("skewness"), kurt.alias("kurtosis"), "min", "max",
    )


def histogram_bins(n: Column, q1: Column, q3: Column, low: Column, high: Column) -> Column:
    """Freedman-Diaconis: width 2 * IQR / n**(1/3), between 2 and 50 bins; sqrt(n) bins where the IQR is 0; 1 without a span."""
    clip = lambda c: F.greatest(F.lit(MIN_BINS), F.least(F.lit(MAX_BINS), c.cast("int")))
    width = 2 * (q3 - q1) / F.pow(n, F.lit(1 / 3))
    return F.when((n < 2) | (high <= low), 1).when(q3 <= q1, clip(F.floor(F.sqrt(n)))).otherwise(clip(F.ceil(F.try_divide(high - low, width))))


def histogram(df: DataFrame, measures: list[str]) -> DataFrame:
    """(variable, bin, low, high, count), empty bins included; the last bin is closed."""
    rows = _unpivot(df, measures)
    facts = rows.groupBy("variable").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).join(exact_quantiles(rows, ["variable"], "x", [0.25, 0.75]), "variable")
    facts = facts.withColumn("bins", histogram_bins(F.col("n"), F.element_at("q", 1), F.element_at("q", 2), F.col("lo"), F.col("hi"))).drop("q", "n")
    span = F.col("hi") - F.col("lo")
    at = F.when(span <= 0, 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * F.col("bins") / F.nullif(span, F.lit(0.0))), F.col("bins") - 1)).cast("int")
    counts = rows.join(facts, "variable").groupBy("variable", at.alias("bin")).agg(F.count("*").alias("count"))
    grid = facts.select("variable", "lo", span.alias("span"), "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    edge = lambda k: F.col("lo") + F.col("span") * k / F.col("bins")
    return grid.join(counts, ["variable", "bin"], "left").select(
        "variable", "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("count", F.lit(0)).alias("count")
    )


def correlation_matrix(df: DataFrame, measures: list[str], diagonal: bool = True) -> DataFrame:
    """(a, b, r, n) of all pairs in one aggregate; r is null for constant sides and fewer than three pairs."""
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i if diagonal else i + 1 :]]
    cols = {m: number(df, m).cast("double") for m in measures}
    rows = df.select(*[c.alias(m) for m, c in cols.items()])
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs.append(correlation(F.col(a), F.col(b)).alias(f"r{i}"))
        aggs.append(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}"))
    row = rows.agg(*aggs)
    structs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def _tested(rows: DataFrame, n: Column, r: Column) -> DataFrame:
    """p of r by t with n - 2 degrees of freedom, the 95 % interval by Fisher's z from four pairs on, and r squared."""
    t = r * F.sqrt(F.try_divide(n - 2, 1 - r * r))
    z, half = F.atanh(r), 1.96 / F.sqrt(F.greatest(n - 3, F.lit(1)))
    sure = F.abs(r) >= 1
    out = with_p(rows, "t", F.when(~sure, t), (n - 2))
    return out.withColumns({
        "p": F.when(sure, 0.0).otherwise(F.col("p")), "low": F.when((n >= 4) & ~sure, F.tanh(z - half)), "high": F.when((n >= 4) & ~sure, F.tanh(z + half)), "effect": r * r,
    })


def correlation_tests(df: DataFrame, measures: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r, n, p, low, high, effect) of each pair with at least three rows and no constant side; identifiers are left out."""
    measures = [m for m in measures if not is_identifier_name(m)]
    if method == "spearman":
        out = None
        for i, a in enumerate(measures):
            for b in measures[i + 1 :]:
                one = spearman_pair(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "r", "n")
                out = one if out is None else out.unionByName(one)
        rows = out if out is not None else df.sparkSession.createDataFrame([], "a string, b string, r double, n long")
    elif len(measures) > 1:
        rows = correlation_matrix(df, measures, diagonal=False)
    else:
        rows = df.sparkSession.createDataFrame([], "a string, b string, r double, n long")
    return _tested(rows.where(F.col("r").isNotNull() & (F.col("n") >= 3)), F.col("n"), F.col("r"))


def spearman_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (r, n) of the average ranks."""
    both = number(df, a).isNotNull() & number(df, b).isNotNull()
    n = df.agg(F.count_if(both).alias("n")).withColumn("_k", F.lit(1))
    r = spearman(df, Op("correlation", column_a=a, column_b=b, method="spearman")).withColumn("_k", F.lit(1))
    return r.join(n, "_k").select(F.col("value").alias("r"), "n")


def group_moments(df: DataFrame, measure: str, dimension: str) -> DataFrame:
    """n, mean and variance of the groups that have at least two numbers."""
    rows = df.select(F.col(dimension).alias("g"), number(df, measure).cast("double").alias("x")).where(F.col("g").isNotNull() & F.col("x").isNotNull())
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var")).where(F.col("n") >= 2)


def welch(df: DataFrame, measure: str, dimension: str, a: str, b: str) -> DataFrame:
    """Welch's t, its degrees of freedom and Cohen's d of two groups."""
    m = group_moments(df, measure, dimension)
    pick = lambda c, g: F.max(F.when(F.col("g") == g, F.col(c)))
    row = m.agg(*[pick(c, g).alias(f"{c}_{s}") for s, g in (("a", a), ("b", b)) for c in ("n", "mean", "var")])
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("var_a"), F.col("var_b")
    diff, se2 = F.col("mean_a") - F.col("mean_b"), va / na + vb / nb
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    out = row.select(
        F.try_divide(diff, F.sqrt(se2)).alias("t"),
        F.try_divide(se2 * se2, (va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1)).alias("df"),
        F.try_divide(diff, pooled).alias("cohens_d"),
    )
    return with_p(out, "t", F.col("t"), F.col("df"))


def anova(df: DataFrame, measure: str, dimension: str) -> DataFrame:
    """F, degrees of freedom and eta squared, from the groups' moments."""
    m = group_moments(df, measure, dimension)
    row = m.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"),
        F.sum(F.col("n") * F.col("mean") ** 2).alias("q"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
    )
    between = F.col("q") - F.col("s") ** 2 / F.col("n")
    out = row.select(
        F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k"))).alias("f"),
        (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), F.try_divide(between, between + F.col("within")).alias("eta_squared"),
    )
    return with_p(out, "f", F.col("f"), F.col("df_between"), F.col("df_within"))


def _rank_sums(df: DataFrame, measure: str, dimension: str) -> tuple[DataFrame, DataFrame]:
    rows = df.select(F.col(dimension).alias("g"), number(df, measure).cast("double").alias("x")).where(F.col("g").isNotNull() & F.col("x").isNotNull())
    big = rows.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") >= 2).select("g")
    rows = rows.join(big, "g", "left_semi")
    sums = average_rank(rows, "x", "r").groupBy("g").agg(F.count("*").alias("n"), F.sum("r").alias("rank_sum"))
    t = F.col("t").cast("double")
    ties = rows.groupBy("x").agg(F.count("*").alias("t")).agg(F.sum(t * t * t - t).alias("ties"))
    return sums, ties


def kruskal(df: DataFrame, measure: str, dimension: str) -> DataFrame:
    """Tie-corrected H with k - 1 degrees of freedom."""
    sums, ties = _rank_sums(df, measure, dimension)
    row = sums.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("s"))
    # two one-row aggregates side by side, joined on a constant key
    both = row.withColumn("one", F.lit(1)).join(ties.withColumn("one", F.lit(1)), "one")
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return with_p(both.select(F.try_divide(h, 1 - F.try_divide(F.col("ties"), n * n * n - n)).alias("h"), (F.col("k") - 1).alias("df")), "chi2", F.col("h"), F.col("df"))


def mann_whitney(df: DataFrame, measure: str, dimension: str, a: str, b: str) -> DataFrame:
    """U of group ``a`` against ``b`` with sizes and the tie term."""
    sums, ties = _rank_sums(df.where(F.col(dimension).isin(a, b)), measure, dimension)
    row = sums.agg(*[F.max(F.when(F.col("g") == g, F.col(c))).alias(f"{c}_{s}") for s, g in (("a", a), ("b", b)) for c in ("n", "rank_sum")])
    both = row.withColumn("one", F.lit(1)).join(ties.withColumn("one", F.lit(1)), "one")
    na = F.col("n_a").cast("double")
    out = both.select((F.col("rank_sum_a") - na * (na + 1) / 2).alias("u"), "n_a", "n_b", "ties")
    return with_p(out, "mann_whitney", F.col("u"), F.col("n_a"), F.col("n_b"), F.coalesce("ties", F.lit(0.0)))


def posthoc_pairs(df: DataFrame, measure: str, dimension: str, most: int = 8) -> DataFrame:
    """(a, b, u, p, p_adjusted): Mann-Whitney of all pairs of at most ``most`` groups, p raw and Bonferroni-adjusted; more groups give no rows."""
    groups = sorted(r["g"] for r in group_moments(df, measure, dimension).select("g").limit(most + 1).collect())
    out = df.sparkSession.createDataFrame([], "a string, b string, u double, p double, p_adjusted double")
    pairs = [(a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]] if len(groups) <= most else []
    for a, b in pairs:
        one = mann_whitney(df, measure, dimension, a, b)
        out = out.unionByName(one.select(F.lit(str(a)).alias("a"), F.lit(str(b)).alias("b"), F.col("u").cast("double").alias("u"), "p", F.least(F.lit(1.0), F.col("p") * len(pairs)).alias("p_adjusted")))
    return out


def compare_groups(df: DataFrame, measure: str, dimension: str) -> list[tuple[str, DataFrame]]:
    """The tests that suit the number of groups: two take Welch and Mann-Whitney, more take ANOVA, Kruskal-Wallis and the pairs; 2 to 50 values."""
    groups = sorted(r["g"] for r in group_moments(df, measure, dimension).select("g").limit(51).collect())
    if len(groups) == 2:
        return [("welch", welch(df, measure, dimension, *groups)), ("mann_whitney", mann_whitney(df, measure, dimension, *groups))]
    if not 2 < len(groups) <= 50:
        return []
    return [("anova", anova(df, measure, dimension)), ("kruskal", kruskal(df, measure, dimension)), ("posthoc", posthoc_pairs(df, measure, dimension))]


def chi_squared(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-squared without Yates' correction, degrees of freedom and Cramer's V, from the cell counts alone."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    cells = (
        cells.withColumn("ra", F.sum("c").over(Window.partitionBy("a"))).withColumn("rb", F.sum("c").over(Window.partitionBy("b")))
    )
    # sum((o - e)^2 / e) = n * (sum(o^2 / (row * column)) - 1): empty cells need no row
    c = F.col("c").cast("double")
    row = cells.agg(
        F.sum(c * c / (F.col("ra").cast("double") * F.col("rb"))).alias("s"), F.sum("c").alias("n"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb")
    )
    chi = F.col("n") * (F.col("s") - 1)
    least = F.least("ka", "kb") - 1
    out = row.select(
        chi.alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"), F.sqrt(F.try_divide(chi, F.col("n") * least)).alias("cramers_v"), "n"
    )
    return with_p(out, "chi2", F.col("chi2"), F.when(F.col("df") > 0, F.col("df")))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("count"))


def monthly_totals(df: DataFrame, measure: str, time: str) -> DataFrame:
    rows = df.select(moment(df, time).alias("ts"), number(df, measure).cast("double").alias("x")).where(F.col("ts").isNotNull())
    key, label = period_key(F.col("ts"), "MoM")
    return rows.groupBy(key.alias("key"), label.alias("period")).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"))


def rolling_mean(df: DataFrame, measure: str, time: str, window: int = 3) -> DataFrame:
    """Mean of up to ``window`` existing months; the months of a table are few, one task orders them."""
    w = Window.partitionBy(F.lit(0)).orderBy("key").rowsBetween(1 - window, 0)
    return monthly_totals(df, measure, time).select("period", "total", F.avg("total").over(w).alias("rolling_mean"))


def growth_suite(df: DataFrame, measures: list[str], times: list[str]) -> DataFrame:
    """(measure, over, kind, period, growth): MoM, YoY and WoW series of every measure over every time column."""
    out = None
    for m in measures:
        for t in times:
            for kind in ("MoM", "YoY", "WoW"):
                one = growth_series(df, Op("growth", column=m, over_column=t, period=kind)).select(F.lit(m).alias("measure"), F.lit(t).alias("over"), F.lit(kind).alias("kind"), "period", "growth")
                out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "measure string, over string, kind string, period string, growth double")


def seasonality(df: DataFrame, measure: str, time: str) -> DataFrame:
    """Variance of the calendar months' means over the variance of the months; above 0.3 is seasonal."""
    months = monthly_totals(df, measure, time)
    total = months.agg(F.count("*").alias("months"), F.var_pop("total").alias("all_var")).withColumn("one", F.lit(1))
    by = months.groupBy((F.col("key") % 12).alias("m")).agg(F.avg("total").alias("mean")).agg(F.var_pop("mean").alias("season_var")).withColumn("one", F.lit(1))
    s = F.when(F.col("months") >= 6, F.coalesce(F.try_divide(F.col("season_var"), F.col("all_var")), F.lit(0.0)))
    verdict = F.when(s.isNull(), "insufficient_data").when(s > 0.3, "seasonal").otherwise("not_seasonal")
    return total.join(by, "one").select("months", s.alias("strength"), verdict.alias("verdict"))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = number(df, x).cast("double"), number(df, y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    px, py = F.when(both, a), F.when(both, b)
    slope = F.try_divide(F.covar_pop(px, py), F.var_pop(px))
    return df.agg(slope.alias("slope"), (F.avg(py) - slope * F.avg(px)).alias("intercept"), F.count(px).alias("n"))


def box_plot(df: DataFrame, measures: list[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR inside the range, and the number of values beyond them."""
    rows = _unpivot(df, measures)
    f = rows.groupBy("variable").agg(F.min("x").alias("min"), F.max("x").alias("max")).join(exact_quantiles(rows, ["variable"], "x", [0.25, 0.5, 0.75]), "variable")
    q = lambda i: F.element_at("q", i)
    f = f.select(
        "variable", q(1).alias("q1"), q(2).alias("median"), q(3).alias("q3"),
        F.greatest(F.col("min"), q(1) - 1.5 * (q(3) - q(1))).alias("low_whisker"), F.least(F.col("max"), q(3) + 1.5 * (q(3) - q(1))).alias("high_whisker"),
    )
    beyond = rows.join(f.select("variable", "low_whisker", "high_whisker"), "variable").groupBy("variable").agg(
        F.count_if((F.col("x") < F.col("low_whisker")) | (F.col("x") > F.col("high_whisker"))).alias("outliers")
    )
    return f.join(beyond, "variable")
