"""The data-quality gate: validity, missingness, duplicates, references, contracts and outliers.

All checks that look at one row at a time are conditional counts of a single aggregate.  Missing rates by segment share one
GROUPING SETS plan for all segments and columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators.profiling import NEGATIVE_NAME, clean_null
from veritab.operators.understanding import unit_of
from veritab.plans.compile import exact_quantiles, moment, number

#: What stands for a missing value in text.
NA_TEXTS = ("na", "n/a", "n.a", "nan", "null", "none", "nil", "missing", "-", "--", "?", "??", "—")
UNKNOWN_TEXTS = ("unknown", "unk", "not known", "tbd", "to be determined", "n.d", "n/k", "not available")
#: Fixed value: text that looks like an attempt to inject SQL.
SQL_TEXT = r"(?i)(?:;|'|\b(?:DROP|DELETE|INSERT|UPDATE|SELECT|UNION|ALTER|CREATE|EXEC|EXECUTE)\b)"
UNIT_TEXT = r"(?i)^\s*(?:(?:\$|€|£|EGP|USD|EUR|SAR|AED)\s*[0-9][0-9.,]*|[0-9][0-9.,]*\s*(?:kg|g|lbs?|oz|cm|mm|km|m|ml|l|%|USD|EUR|EGP|SAR|AED|€|£))\s*$"


@dataclass(frozen=True)
class Contract:
    column: str
    low: float | None = None
    high: float | None = None
    required: bool = False
    unique: bool = False
    forbidden: tuple[str, ...] = ()
    date_format: str | None = None
    unit: str | None = None


def _counts(df: DataFrame, checks: dict[str, Column], names: tuple[str, str]) -> DataFrame:
    """One aggregate for all conditions, as (check, rows)."""
    row = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    structs = [F.struct(F.lit(k).alias(names[0]), F.col(f"c{i}").alias(names[1])) for i, k in enumerate(checks)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def validity(df: DataFrame, measures: list[str], temporals: list[str], texts: list[str], as_of: str, negative_allowed: tuple[str, ...] = ()) -> DataFrame:
    """(finding, rows) of negative, over-100-percent and out-of-range numbers, impossible and future dates, units and SQL in text."""
    checks: dict[str, Column] = {}
    for m in measures:
        x = number(df, m)
        if m not in negative_allowed and not NEGATIVE_NAME.search(m):
            checks[f"{m}:negative"] = x < 0
        if re.search(r"percent|pct|%", m, re.I):
            checks[f"{m}:over_100_percent"] = x > 100
        if "age" in re.split(r"[^a-z]+", m.lower()):
            checks[f"{m}:out_of_range"] = (x < 0) | (x > 150)
    for t in temporals:
        ts = moment(df, t)
        checks[f"{t}:impossible"] = F.col(t).isNotNull() & (ts.isNull() | (F.year(ts) >= 2100))
        checks[f"{t}:future"] = (F.to_date(ts) > F.date_add(F.lit(as_of).cast("date"), 365)) & (F.year(ts) < 2100)
    for t in texts:
        checks[f"{t}:sql_suspected"] = F.col(t).rlike(SQL_TEXT)
        # units count where the column isn't plain numbers throughout; a plain number never has the form of one with a unit
        checks[f"{t}:mixed_units"] = F.col(t).rlike(UNIT_TEXT)
    return _counts(df, checks, ("finding", "rows"))


def iqr_outliers(df: DataFrame, measures: list[str], least: int = 10) -> DataFrame:
    """(column_name, low, high, outliers) of measures with at least ``least`` values and a spread."""
    parts = [F.struct(F.lit(m).alias("column_name"), number(df, m).cast("double").alias("x")) for m in measures]
    rows = df.select(F.explode(F.array(*parts)).alias("u")).select("u.*").where(F.col("x").isNotNull())
    q = exact_quantiles(rows, ["column_name"], "x", [0.25, 0.75])
    a, b = F.element_at("q", 1), F.element_at("q", 2)
    bounds = q.where((F.col("n") >= least) & (b > a)).select("column_name", (a - 1.5 * (b - a)).alias("low"), (b + 1.5 * (b - a)).alias("high"))
    return rows.join(bounds, "column_name").groupBy("column_name", "low", "high").agg(F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("outliers"))


def mad_outliers(df: DataFrame, measure: str, segment: str | None = None, limit: float = 3.5, least: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose modified z-score exceeds ``limit``, within the whole column or each segment."""
    seg = F.col(segment).cast("string") if segment else F.lit(None).cast("string")
    rows = df.select(*keep, seg.alias("segment"), number(df, measure).cast("double").alias("x")).where(F.col("x").isNotNull())
    med = exact_quantiles(rows, ["segment"], "x", [0.5]).where(F.col("n") >= least)
    med = med.select(F.col("segment").alias("m_segment"), F.get("q", F.lit(0)).alias("med"))
    off = rows.join(med, F.col("segment").eqNullSafe(F.col("m_segment"))).select("segment", "med", F.abs(F.col("x") - F.col("med")).alias("d"))
    mad = exact_quantiles(off, ["segment", "med"], "d", [0.5]).select(F.col("segment").alias("d_segment"), "med", F.get("q", F.lit(0)).alias("mad"))
    z = 0.6745 * (F.col("x") - F.col("med")) / F.when(F.col("mad") == 0, 1e-12).otherwise(F.col("mad"))
    found = rows.join(mad, F.col("segment").eqNullSafe(F.col("d_segment")))
    return found.select(*keep, "segment", "x", z.alias("z")).where(F.abs("z") > limit)


def worst_outliers(df: DataFrame, measure: str, segment: str | None = None, keep: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """The outliers of largest z, then of smallest key: five of the column, three of each segment."""
    rows = mad_outliers(df, measure, segment, keep=keep)
    if segment is None:
        return rows.orderBy(F.desc(F.abs("z")), *keep).limit(most or 5)
    w = Window.partitionBy("segment").orderBy(F.desc(F.abs("z")), *keep)  # outliers alone, few beside the rows
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= (most or 3)).drop("_n")


def identifier_nulls(df: DataFrame, identifiers: list[str]) -> DataFrame:
    """(finding, rows): identifiers without a value."""
    return _counts(df, {f"{c}:null_identifier": clean_null(df, c).isNull() for c in identifiers}, ("finding", "rows"))


def reference_candidates(columns: list[str], identifiers: list[str]) -> list[tuple[str, str]]:
    """(column, identifier it may refer to), by name: another column that ends in _id or holds the identifier's stem."""
    out = []
    for i in identifiers:
        stem = re.sub(r"_?id$", "", i.lower())
        out += [(c, i) for c in columns if c != i and (c.lower().endswith("_id") or stem and stem in c.lower())]
    return out


def referential_integrity(df: DataFrame, identifiers: list[str], least: float = 0.5) -> DataFrame:
    """(column, identifier, distinct_values, orphans) of candidates at least half of whose distinct values are found, with orphans."""
    out = df.sparkSession.createDataFrame([], "column_name string, identifier string, distinct_values long, orphans long")
    for c, i in reference_candidates(df.columns, identifiers):
        own = df.select(F.col(c).cast("string").alias("v"))
        row = orphans(own, "v", df.select(F.col(i).cast("string").alias("r")), "r")
        row = row.where((F.col("matched") >= least * F.col("distinct_values")) & (F.col("orphans") > 0))
        out = out.unionByName(row.select(F.lit(c).alias("column_name"), F.lit(i).alias("identifier"), "distinct_values", "orphans"))
    return out


def out_of_declared_range(df: DataFrame, text: str) -> DataFrame:
    """(violation, rows) of ranges that a text declares for columns of the table."""
    names = {c.lower(): c for c in df.columns}
    own = [Contract(names[c], low, high) for c, (low, high) in declared_ranges(text).items() if c in names]
    rows = contract_violations(df, own)
    return rows.where(F.col("rows") > 0)


def imputability(role: str, rate: float) -> str:
    """What may be done about a column's missing values."""
    if role == "measure":
        return "high_missing_drop" if rate >= 0.5 else "impute_median" if rate >= 0.1 else "low"
    if role in ("dimension", "categorical"):
        return "impute_unknown_category" if rate < 0.5 else "high_missing_drop"
    return "cannot_impute"


def deep_missingness(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(column_name, missing, rate, sentinels, effective_rate, verdict): missing values plain and in guise, and what may be done about them."""
    census = sentinel_census(df, list(roles))
    rows = df.agg(F.count("*").alias("all_rows")).withColumn("_k", F.lit(1))
    hidden = F.col("blank") + F.col("na") + F.col("unknown")
    share = lambda c: F.coalesce(F.round(F.try_divide(c.cast("double"), F.col("all_rows").cast("double")), 6), F.lit(0.0))
    out = census.withColumn("_k", F.lit(1)).join(rows, "_k")
    verdict = F.lit(None).cast("string")
    rate = share(F.col("nan"))
    for role in set(roles.values()):
        own = F.col("column_name").isin([c for c, r in roles.items() if r == role])
        steps = F.when(rate >= 0.5, imputability(role, 0.5)).when(rate >= 0.1, imputability(role, 0.1)).otherwise(imputability(role, 0.0))
        verdict = F.when(own, steps).otherwise(verdict)
    return out.select("column_name", F.col("nan").alias("missing"), rate.alias("rate"), hidden.alias("sentinels"), share(F.col("nan") + hidden).alias("effective_rate"), verdict.alias("verdict"))


def missingness_level(effective_rates: list[float]) -> str:
    """high from one half on, moderate from a tenth on, low above zero, else none - by the worst column."""
    worst = max(effective_rates, default=0.0)
    return "high" if worst >= 0.5 else "moderate" if worst >= 0.1 else "low" if worst > 0 else "none"


def sentinel_census(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nan, blank, na, unknown, zero)."""
    aggs = []
    for i, c in enumerate(columns):
        v = clean_null(df, c)
        t = F.lower(F.trim(F.regexp_replace(v.cast("string"), "\u00a0", " ")))
        aggs += [F.count_if(v.isNull()).alias(f"a{i}"), F.count_if(t == "").alias(f"b{i}"), F.count_if(t.isin(*NA_TEXTS)).alias(f"c{i}"), F.count_if(t.isin(*UNKNOWN_TEXTS)).alias(f"d{i}")]
        aggs.append((F.count_if(v == 0) if df.schema[c].dataType.typeName() != "string" else F.lit(0).cast("long")).alias(f"e{i}"))
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{s}{i}").alias(n) for s, n in zip("abcde", ("nan", "blank", "na", "unknown", "zero"))]) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def missing_by_segment(df: DataFrame, columns: list[str], segments: list[str]) -> DataFrame:
    """(segment, value, column_name, rows, missing_rate): all segments in one GROUPING SETS aggregate; a null segment is kept."""
    flags = df.select(*[clean_null(df, c).isNull().cast("double").alias(f"m{i}") for i, c in enumerate(columns)], *[F.col(s).cast("string").alias(f"s{j}") for j, s in enumerate(segments)])
    sets = [[F.col(f"s{j}")] for j in range(len(segments))]
    agg = flags.groupingSets(sets, *[F.col(f"s{j}") for j in range(len(segments))]).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("rows"), *[F.avg(f"m{i}").alias(f"r{i}") for i in range(len(columns))]
    )
    full = (1 << len(segments)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for j, s in enumerate(segments):
        here = F.col("gid") == (full ^ (1 << (len(segments) - 1 - j)))
        name, value = F.when(here, s).otherwise(name), F.when(here, F.col(f"s{j}")).otherwise(value)
    structs = [F.struct(F.lit(c).alias("column_name"), F.round(f"r{i}", 6).alias("missing_rate")) for i, c in enumerate(columns)]
    return agg.select(name.alias("segment"), value.alias("value"), "rows", F.explode(F.array(*structs)).alias("s")).select("segment", "value", "s.column_name", "rows", "s.missing_rate")


def missing_by_month(df: DataFrame, columns: list[str], time: str) -> DataFrame:
    rows = df.select(F.date_format(moment(df, time), "yyyy-MM").alias("month"), *[clean_null(df, c).isNull().cast("double").alias(c) for c in columns])
    return rows.where(F.col("month").isNotNull()).groupBy("month").agg(*[F.round(F.avg(c), 6).alias(c) for c in columns])


def co_missing(df: DataFrame, columns: list[str], least: int = 3, threshold: float = 0.5) -> DataFrame:
    """(column_a, column_b, both, jaccard) of columns that are missing together; all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    gone = {c: clean_null(df, c).isNull() for c in columns}
    row = df.agg(*[F.count_if(gone[a] & gone[b]).alias(f"b{i}") for i, (a, b) in enumerate(pairs)], *[F.count_if(gone[a] | gone[b]).alias(f"u{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"b{i}").alias("both"), F.try_divide(F.col(f"b{i}"), F.col(f"u{i}")).alias("jaccard")) for i, (a, b) in enumerate(pairs)]
    out = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return out.where((F.col("both") >= least) & (F.col("jaccard") >= threshold)).withColumn("jaccard", F.round("jaccard", 3))


def missing_thirds(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """(column_name, third, missing_rate): rows by the thirds [i * n / 3, (i + 1) * n / 3) of a dense zero-based row id."""
    n = df.agg((F.count("*")).alias("n")).withColumn("one", F.lit(1))
    rows = df.withColumn("one", F.lit(1)).join(n, "one")
    third = F.when(F.col(row_id) < F.floor(F.col("n") / 3), 0).when(F.col(row_id) < F.floor(2 * F.col("n") / 3), 1).otherwise(2)
    parts = [F.struct(F.lit(c).alias("column_name"), clean_null(df, c).isNull().cast("double").alias("gone")) for c in columns]
    return rows.select(third.alias("third"), F.explode(F.array(*parts)).alias("u")).groupBy("u.column_name", "third").agg(F.round(F.avg("u.gone"), 6).alias("missing_rate"))


def missing_mechanism(df: DataFrame, columns: list[str], segments: list[str], row_id: str, mar_gap: float = 0.2, mnar_gap: float = 0.3) -> DataFrame:
    """(column_name, missing_rate, mechanism): MAR if a segment's rates differ widely, else MNAR if the thirds' do, else MCAR."""
    by = missing_by_segment(df, columns, segments).where(F.col("segment") != F.col("column_name"))
    seg = by.groupBy("column_name", "segment").agg((F.max("missing_rate") - F.min("missing_rate")).alias("gap"), F.min("rows").alias("least"), F.count("*").alias("groups"))
    mar = seg.where((F.col("groups") >= 2) & (F.col("least") >= 3)).groupBy("column_name").agg(F.max("gap").alias("mar"))
    mnar = missing_thirds(df, columns, row_id).groupBy("column_name").agg((F.max("missing_rate") - F.min("missing_rate")).alias("mnar"))
    rate = df.agg(*[F.avg(clean_null(df, c).isNull().cast("double")).alias(f"r{i}") for i, c in enumerate(columns)])
    rate = rate.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(f"r{i}", 6).alias("missing_rate")) for i, c in enumerate(columns)])).alias("s")).select("s.*")
    kind = F.when(F.col("missing_rate") == 0, "none").when(F.col("mar") > mar_gap, "MAR").when(F.col("mnar") > mnar_gap, "MNAR").otherwise("MCAR")
    return rate.join(mar, "column_name", "left").join(mnar, "column_name", "left").select("column_name", "missing_rate", kind.alias("mechanism"))


def orphans(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """One row: distinct values, those found in the other column, those without a partner."""
    own = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct()
    ref = other.where(F.col(other_column).isNotNull()).select(F.col(other_column).alias("v")).distinct().withColumn("found", F.lit(True))
    row = own.join(ref, "v", "left").agg(F.count("*").alias("distinct_values"), F.count("found").alias("matched"))
    return row.withColumn("orphans", F.col("distinct_values") - F.col("matched"))


def build_contracts(df: DataFrame, measures: list[str], identifiers: list[str], times: tuple[str, ...] = ()) -> list[Contract]:
    """Ranges widened by 5 % of the span, with units; the form of dates; identifiers that are unique now stay so."""
    row = df.agg(*[f(number(df, m)).cast("double").alias(f"{k}{i}") for i, m in enumerate(measures) for k, f in (("a", F.min), ("b", F.max))], *[(F.count_distinct(c) == F.count("*")).alias(f"u{i}") for i, c in enumerate(identifiers)]).first()
    out = []
    for i, m in enumerate(measures):
        a, b = row[f"a{i}"], row[f"b{i}"]
        if a is not None:
            out.append(Contract(m, a - 0.05 * (b - a), b + 0.05 * (b - a)))
    out = [replace(c, unit=unit_of(c.column)) for c in out]
    out += [Contract(t, date_format=f) for t, f in date_formats(df, times).items() if f]
    return out + [Contract(c, unique=True, required=True) for i, c in enumerate(identifiers) if row[f"u{i}"]]


#: Forms of written dates, tried in this order.
DATE_FORMS = {
    "yyyy-MM-dd": r"\A\d{4}-\d{2}-\d{2}\z", "yyyy-MM-dd HH:mm:ss": r"\A\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\z", "yyyy/MM/dd": r"\A\d{4}/\d{2}/\d{2}\z",
    "dd/MM/yyyy": r"\A(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])/\d{4}\z", "MM/dd/yyyy": r"\A(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/\d{4}\z", "dd.MM.yyyy": r"\A\d{2}\.\d{2}\.\d{4}\z",
}


def date_formats(df: DataFrame, columns: list[str], share: float = 0.95) -> dict[str, str | None]:
    """The first form that at least ``share`` of a text column's values have; one aggregate for all columns and forms."""
    texts = [c for c in columns if df.schema[c].dataType.typeName() == "string"]
    if not texts:
        return {}
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(texts)], *[F.count_if(F.trim(c).rlike(p)).alias(f"f{i}_{k}") for i, c in enumerate(texts) for k, p in enumerate(DATE_FORMS.values())]).first()
    return {c: next((f for k, f in enumerate(DATE_FORMS) if row[f"n{i}"] and row[f"f{i}_{k}"] >= share * row[f"n{i}"]), None) for i, c in enumerate(texts)}


def contract_violations(df: DataFrame, contracts: list[Contract]) -> DataFrame:
    """(violation, rows): below, above, forbidden and unexpected null in one aggregate, repeats of unique columns beside it."""
    checks: dict[str, Column] = {}
    for c in contracts:
        if c.low is not None:
            checks[f"{c.column}:below_range"] = number(df, c.column) < c.low
        if c.high is not None:
            checks[f"{c.column}:above_range"] = number(df, c.column) > c.high
        if c.required:
            checks[f"{c.column}:unexpected_null"] = clean_null(df, c.column).isNull()
        if c.date_format:
            checks[f"{c.column}:date_format"] = F.col(c.column).isNotNull() & ~F.trim(c.column).rlike(DATE_FORMS[c.date_format])
        if c.forbidden:
            checks[f"{c.column}:forbidden_value"] = F.col(c.column).cast("string").isin(*c.forbidden)
    out = _counts(df, checks, ("violation", "rows")) if checks else df.sparkSession.createDataFrame([], "violation string, rows long")
    for c in contracts:
        if c.unique:
            groups = df.where(F.col(c.column).isNotNull()).groupBy(c.column).agg(F.count("*").alias("n")).where(F.col("n") > 1)
            out = out.unionByName(groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(F.lit(f"{c.column}:repeated").alias("violation"), "rows"))
    return out


def declared_ranges(text: str) -> dict[str, tuple[float, float | None]]:
    """Ranges stated in words: "x between a and b", "x from a to b", "x >= a"."""
    num = r"(-?\d+(?:\.\d+)?)"
    out: dict[str, tuple[float, float | None]] = {}
    for m in re.finditer(rf"([a-z_]\w*)\s*>=\s*{num}", text.lower()):
        out[m[1]] = (float(m[2]), None)
    for m in re.finditer(rf"([a-z_]\w*)\s+(?:between\s+{num}\s+and|from\s+{num}\s+to)\s+{num}", text.lower()):
        out[m[1]] = (float(m[2] or m[3]), float(m[4]))
    return out


def gate(findings: list[tuple[str, str]]) -> str:
    """``needs_repair`` if a finding (severity, text) is high, else ``passed``."""
    return "needs_repair" if any(s == "high" for s, _ in findings) else "passed"
