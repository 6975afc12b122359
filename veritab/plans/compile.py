"""KPI operations compiled to Columns, fused so that one scan answers as many of them as possible.

Operations with the same grouping share one ``agg``; different filters become conditional inputs of that ``agg`` (null
outside the filter), so filters cost no further scan.  Grouped operations of one grouping share one shuffle, after
the map-side combine.  Spearman and growth have plans of their own.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.plans.ir import Kpi, Op, Plan, blocked

#: Fixed value: what counts as a number in text.
NUMERIC_TEXT = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def number(df: DataFrame, column: str) -> Column:
    """The column as a number; text that is none, and NaN, become null."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "string":
        return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))
    x = c.cast("double")
    return F.when(~F.isnan(x), x) if kind in ("double", "float") else x


def condition(op: Op) -> Column | None:
    out = None
    for c, v in op.filter:
        one = F.col(c).isin(*v) if isinstance(v, tuple) else F.col(c) == F.lit(v)
        out = one if out is None else out & one
    return out


def _check_columns(df: DataFrame, op: Op) -> None:
    if op.function == "ratio":
        _check_columns(df, op.numerator)
        _check_columns(df, op.denominator)
        return
    wanted = [op.column, op.column_a, op.column_b, op.over_column, *op.group_by, *[c for c, _ in op.filter]]
    missing = [c for c in wanted if c and c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r on rows where both are present; null for fewer than three rows or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) >= 3, r)


def aggregate(df: DataFrame, op: Op) -> Column:
    """One aggregate Column for an aggregate, Pearson correlation or ratio, its filter included."""
    _check_columns(df, op)
    if op.function == "ratio":
        return F.try_divide(aggregate(df, op.numerator).cast("double"), aggregate(df, op.denominator).cast("double"))
    where = condition(op)
    only = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    if op.function == "correlation":
        return correlation(only(number(df, op.column_a)), only(number(df, op.column_b)))
    c = op.column
    if op.function in ("min", "max"):
        raw = only(F.col(c))
        if df.schema[c].dataType.typeName() in ("double", "float"):
            raw = only(number(df, c))
        return F.min(raw) if op.function == "min" else F.max(raw)
    if op.function in ("count", "nunique"):
        raw = only(number(df, c) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c))
        return F.count(raw) if op.function == "count" else F.count_distinct(raw)
    x = only(number(df, c))
    return {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "mean": lambda: F.avg(x),
        "median": lambda: F.percentile(x, F.lit(0.5)),
        "std": lambda: F.stddev_samp(x),
    }[op.function]()


#: Relative accuracy of the sketch that narrows the search for an exact quantile; groups of fewer rows are counted whole.
ACCURACY = 50_000


def exact_quantiles(rows: DataFrame, keys: list[str], column: str, shares: list[float], out: str = "q") -> DataFrame:
    """(keys, n, out): exact interpolated quantiles of a numeric column without nulls, for each group.

    A sketch bounds where each quantile lies; only distinct values within those bounds are counted one by one, all others fall into
    one count for each stretch between.  So no task ever holds a column's distinct values, as the built-in exact percentile does.
    """
    x, gap = F.col(column), 3 / ACCURACY
    facts = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.count("*").alias("_n"),
        F.percentile_approx(column, F.array(*[F.lit(max(0.0, s - gap)) for s in shares]), ACCURACY).alias("_lo"),
        F.percentile_approx(column, F.array(*[F.lit(min(1.0, s + gap)) for s in shares]), ACCURACY).alias("_hi"),
    )
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    if not keys:
        rows, facts = rows.withColumn("_one", F.lit(1)), facts.withColumn("_k0", F.lit(1))
        on = F.col("_one") == F.col("_k0")
    inside, stretch = F.col("_n") <= ACCURACY, F.lit(0)
    for i in range(len(shares)):
        inside = inside | x.between(F.get("_lo", F.lit(i)), F.get("_hi", F.lit(i)))
        stretch = stretch + (x > F.get("_hi", F.lit(i))).cast("int")
    cells = rows.join(facts, on).groupBy(*keys, "_n", F.when(inside, x).alias("_v"), F.when(~inside, stretch).alias("_s")).agg(F.count("*").alias("_c"), F.min(column).alias("_x"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_r", F.sum("_c").over(w))
    at = lambda rank: F.max(F.when((F.col("_r") - F.col("_c") <= rank) & (rank < F.col("_r")), F.col("_x")))
    values = []
    for i, share in enumerate(shares):
        h = (F.col("_n") - 1) * F.lit(share)
        values += [at(F.floor(h)).alias(f"_a{i}"), at(F.ceil(h)).alias(f"_b{i}")]
    found = cells.groupBy(*keys, "_n").agg(*values)
    part = lambda s: (F.col("_n") - 1) * F.lit(s) - F.floor((F.col("_n") - 1) * F.lit(s))
    q = F.array(*[F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * part(s) for i, s in enumerate(shares)])
    return found.select(*keys, F.col("_n").alias("n"), q.alias(out))


def group_label(columns: tuple[str, ...]) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def range_bounds(df: DataFrame, columns: list[str], buckets: int = 64) -> dict[str, list]:
    """Bounds that cut each column into nearly even ranges; one aggregate for all columns."""
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    row = df.agg(*[F.percentile_approx(c, shares, 1000).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return {c: sorted(set(row[f"b{i}"] or [])) for i, c in enumerate(columns)}


def range_bucket(df: DataFrame, column: str, bounds: list | None = None) -> Column:
    """The range a value falls in, by bounds collected once: equal wherever it is computed, and nearly even.

    A window over ranges plus the ranges' totals replaces one over the whole table, which would run in a single task.
    """
    out = F.lit(0)
    for b in range_bounds(df, [column])[column] if bounds is None else bounds:
        out = out + (F.col(column) > F.lit(b)).cast("int")
    return F.coalesce(out, F.lit(0))


def average_rank(df: DataFrame, column: str, out: str, weight: str | None = None, bounds: list | None = None) -> DataFrame:
    """Average ranks by way of the distinct values' counts: no window runs over the rows themselves; a row counts ``weight`` times.

    Distinct values are ranked within ranges; each range starts where the ones before it end.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    counts = counts.withColumn("_range", range_bucket(df, column, bounds))
    starts = counts.groupBy("_range").agg(F.sum("_n").alias("_t"))
    w = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows
    starts = starts.select("_range", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_start"))
    within = F.sum("_n").over(Window.partitionBy("_range").orderBy(column))
    ranked = counts.withColumn("_c", within).join(starts, "_range")
    ranked = ranked.select(column, (F.col("_start") + F.col("_c") - (F.col("_n") - 1) / 2.0).cast("double").alias(out))
    return df.join(ranked, column, "left")


def spearman(df: DataFrame, op: Op) -> DataFrame:
    """One row: r of the average ranks on rows where both are present.

    Equal pairs are counted first; what is joined with the ranks are the distinct pairs, and the correlation weighs them.
    """
    _check_columns(df, op)
    where = condition(op)
    rows = (df if where is None else df.where(where)).select(number(df, op.column_a).alias("_a"), number(df, op.column_b).alias("_b"))
    pairs = rows.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).groupBy("_a", "_b").agg(F.count("*").alias("_w"))
    bounds = range_bounds(rows, ["_a", "_b"])
    ranked = average_rank(average_rank(pairs, "_a", "_ra", "_w", bounds["_a"]), "_b", "_rb", "_w", bounds["_b"])
    w, x, y = F.col("_w").cast("double"), F.col("_ra"), F.col("_rb")
    # ranks are centred by their known mean before they are multiplied
    n = F.sum(w)
    row = ranked.join(pairs.agg(((F.sum("_w") + 1) / 2).alias("_mean")).withColumn("_one", F.lit(1)), F.col("_one") == 1)
    dx, dy = x - F.col("_mean"), y - F.col("_mean")
    r = F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy)))
    return row.agg(F.when(n >= 3, r).alias("value"))


def median(df: DataFrame, op: Op) -> DataFrame:
    """(group columns, value): a row for each group, null where a group has no number; one row without groups."""
    _check_columns(df, op)
    where = condition(op)
    rows = (df if where is None else df.where(where)).select(*op.group_by, number(df, op.column).cast("double").alias("_m"))
    found = exact_quantiles(rows.where(F.col("_m").isNotNull()), list(op.group_by), "_m", [0.5]).select(*op.group_by, F.get("q", F.lit(0)).alias("value"))
    if not op.group_by:
        return found.agg(F.max("value").alias("value"))
    named = found.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(op.group_by)], "value")
    on = F.lit(True)
    for i, k in enumerate(op.group_by):
        on = on & F.col(k).eqNullSafe(F.col(f"_m{i}"))
    return rows.select(*op.group_by).distinct().join(named, on, "left").select(*op.group_by, "value")


# -- growth ----------------------------------------------------------------------------------------------------------


def moment(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "string":
        return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    return c.cast("timestamp_ntz") if kind in ("timestamp", "timestamp_ntz", "date") else c.try_cast("timestamp_ntz")


def period_key(ts: Column, period: str) -> tuple[Column, Column]:
    """(order key, label): months, or ISO weeks for WoW."""
    if period == "WoW":
        year, week = F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts)
        return (year * 100 + week).cast("int"), F.concat(year.cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int"), F.date_format(ts, "yyyy-MM")


def growth_series(df: DataFrame, op: Op) -> DataFrame:
    """(group columns, period, total, baseline, growth): a row for each period with a baseline that is not 0."""
    _check_columns(df, op)
    where = condition(op)
    rows = df if where is None else df.where(where)
    ts = moment(df, op.over_column)
    rows = rows.select(*op.group_by, ts.alias("_ts"), number(df, op.column).alias("_x")).where(F.col("_ts").isNotNull() & F.col("_x").isNotNull())
    key, label = period_key(F.col("_ts"), op.period)
    totals = rows.groupBy(*op.group_by, key.alias("_key"), label.alias("period")).agg(F.sum("_x").alias("total"))
    w = Window.partitionBy(*op.group_by).orderBy("_key") if op.group_by else Window.partitionBy(F.lit(0)).orderBy("_key")
    if op.basis == "start_of_period":
        base = F.first("total").over(w)
    elif op.period == "YoY":
        base = F.max("total").over(w.rangeBetween(-12, -12))
    else:
        base = F.lag("total").over(w)
    scale = 100.0 if op.as_percent else 1.0
    out = totals.withColumn("baseline", base)
    out = out.withColumn("growth", F.try_divide(F.col("total") - F.col("baseline"), F.col("baseline")) * scale)
    return out.where(F.col("growth").isNotNull()).select(*op.group_by, "period", "_key", "total", "baseline", "growth")


def growth(df: DataFrame, op: Op) -> DataFrame:
    """The latest growth, for each group if there are any."""
    series = growth_series(df, op)
    return series.groupBy(*op.group_by).agg(F.max_by("growth", "_key").alias("value"), F.max_by("period", "_key").alias("period"))


# -- plans -----------------------------------------------------------------------------------------------------------

RESULT = "kpi_id string, label string, value double, text string, evidence string"


def _value(name: str) -> list[Column]:
    c = F.col(name)
    # by way of text, which is exact for doubles, as dates have no cast to a number
    return [c.cast("string").try_cast("double").alias("value"), c.cast("string").alias("text")]


def execute_plan(df: DataFrame, plan: Plan) -> DataFrame:
    """(kpi_id, label, value, text, evidence) of all KPIs; one that fails has a null value and the reason as evidence."""
    spark = df.sparkSession
    # a filter of a grouped operation also decides which groups there are, so it stays in front of the grouping
    fused: dict[tuple, list[tuple[Kpi, Column]]] = defaultdict(list)
    parts: list[DataFrame] = []
    failed: list[tuple] = []
    for kpi in plan.kpis:
        op = kpi.op
        try:
            if blocked(op):
                raise ValueError("identifier columns have no meaningful values")
            if op.function == "growth":
                own = growth(df, op)
                parts.append(own.select(F.lit(kpi.kpi_id).alias("kpi_id"), (group_label(op.group_by) if op.group_by else F.lit(None).cast("string")).alias("label"), *_value("value"), F.lit(op.key).alias("evidence")))
            elif op.function == "median":
                parts.append(median(df, op).select(F.lit(kpi.kpi_id).alias("kpi_id"), (group_label(op.group_by) if op.group_by else F.lit(None).cast("string")).alias("label"), *_value("value"), F.lit(op.key).alias("evidence")))
            elif op.function == "correlation" and op.method == "spearman":
                parts.append(spearman(df, op).select(F.lit(kpi.kpi_id).alias("kpi_id"), F.lit(None).cast("string").alias("label"), *_value("value"), F.lit(op.key).alias("evidence")))
            else:
                own = Op(**{**op.__dict__, "filter": ()}) if op.group_by else op
                fused[op.group_by, op.filter if op.group_by else ()].append((kpi, aggregate(df, own)))
                _check_columns(df, op)
        except ValueError as e:
            failed.append((kpi.kpi_id, None, None, None, f"failed: {e}"))
    for (keys, own_filter), members in fused.items():
        rows = df.where(condition(Op("count", filter=own_filter))) if own_filter else df
        row = rows.groupBy(*keys).agg(*[c.alias(f"v{i}") for i, (_, c) in enumerate(members)])
        label = group_label(keys) if keys else F.lit(None).cast("string")
        structs = [F.struct(F.lit(k.kpi_id).alias("kpi_id"), *_value(f"v{i}"), F.lit(k.op.key).alias("evidence")) for i, (k, _) in enumerate(members)]
        parts.append(row.select(label.alias("label"), F.explode(F.array(*structs)).alias("r")).select("r.kpi_id", "label", "r.value", "r.text", "r.evidence"))
    out = spark.createDataFrame(failed, RESULT)
    for p in parts:
        out = out.unionByName(p)
    return out


def grouped_values(df: DataFrame, op: Op) -> DataFrame:
    """(label, value) of a grouped aggregate, in the order of the labels as texts."""
    own = Op(**{**op.__dict__, "filter": ()})
    rows = df if condition(op) is None else df.where(condition(op))
    out = median(df, op).select(group_label(op.group_by).alias("label"), "value") if op.function == "median" else rows.groupBy(*op.group_by).agg(aggregate(rows, own).alias("value")).select(group_label(op.group_by).alias("label"), "value")
    return out.orderBy("label")


def grouped_growth_values(df: DataFrame, op: Op) -> DataFrame:
    """(label, period, value): the latest growth of each group, in the order of the labels as texts."""
    return growth(df, op).select(group_label(op.group_by).alias("label"), "period", "value").orderBy("label")


def numbered(results: DataFrame, plan: Plan) -> DataFrame:
    """Results with an id for each group: KPI-001-001, KPI-001-002, ... in the order of the labels; ungrouped KPIs keep theirs."""
    grouped = [k.kpi_id for k in plan.kpis if k.op.group_by]
    at = F.row_number().over(Window.partitionBy("kpi_id").orderBy(F.col("label").asc_nulls_last()))
    own = F.when(F.col("kpi_id").isin(grouped), F.concat("kpi_id", F.lit("-"), F.lpad(at.cast("string"), 3, "0"))).otherwise(F.col("kpi_id"))
    return results.withColumn("group_id", own)


def daily_sums(df: DataFrame, column: str, over: str) -> DataFrame:
    """(day, total): sums of each day that has a date."""
    rows = df.select(F.to_date(moment(df, over)).alias("day"), number(df, column).cast("double").alias("x")).where(F.col("day").isNotNull())
    return rows.groupBy("day").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"))


def period_variance(df: DataFrame, op: Op, over: str) -> DataFrame:
    """(period, previous, current, delta, delta_percent): a plain aggregate in the last two months of a time column; no row with fewer."""
    rows = df.withColumn("_ts", moment(df, over)).where(F.col("_ts").isNotNull())
    key, label = period_key(F.col("_ts"), "MoM")
    rows = rows.withColumns({"_key": key, "_label": label})
    if op.function == "median":
        middle = exact_quantiles(rows.select("_key", "_label", number(df, op.column).cast("double").alias("_m")).where(F.col("_m").isNotNull()), ["_key", "_label"], "_m", [0.5])
        months = middle.select("_key", "_label", F.get("q", F.lit(0)).alias("v"))
    else:
        months = rows.groupBy("_key", "_label").agg(aggregate(df, op).cast("double").alias("v"))
    two = months.orderBy(F.desc("_key")).limit(2)
    row = two.agg(F.count("*").alias("n"), F.max_by("_label", "_key").alias("period"), F.min_by("v", "_key").alias("previous"), F.max_by("v", "_key").alias("current")).where(F.col("n") == 2)
    delta = F.col("current") - F.col("previous")
    return row.select("period", "previous", "current", delta.alias("delta"), F.round(F.try_divide(delta, F.col("previous")) * 100, 2).alias("delta_percent"))
