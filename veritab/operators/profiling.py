"""Column facts in one aggregate, semantic roles from them, and personal-data signals."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.plans.compile import range_bucket
from veritab.plans.ir import is_identifier_name

NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")
TEMPORAL = ("date", "timestamp", "timestamp_ntz")
#: Words of column names.  ``acctbal`` is the balance of the supplied customer and supplier tables.
TIME_NAME = re.compile(r"(?:^|_)(?:date|time|timestamp|day|month|year|at|on)$|date", re.I)
METRIC_NAME = re.compile(
    r"amount|price|pricing|qty|quantity|count|total|revenue|income|cost|expense|spend|sales|profit|duration|days|hours|minutes|age|value|volume|"
    r"weight|mass|size|length|width|height|balance|margin|rate|interest", re.I)  # fmt: skip
ORDINAL_NAME = re.compile(r"rating|satisfaction|score|rank|level|priority|grade|stage|nps|star|tier", re.I)
NEGATIVE_NAME = re.compile(r"temp|celsius|fahrenheit|latitude|longitude|altitude|elevation|balance|acctbal|delta|difference|diff|growth|margin|return", re.I)
PII_NAME = re.compile(r"e-?mail|phone|mobile|address|ssn|passport|salary|birth|iban|(?:^|_)name$|(?:first|last|full)_?name", re.I)
EMAIL_VALUE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DATE_VALUE = r"\A\d{4}-\d{2}-\d{2}"
PHONE_VALUE = r"^\s*(?:\+|00)?[0-9][0-9 ().-]{7,}[0-9]\s*$"


def clean_null(df: DataFrame, c: str) -> Column:
    """The column with NaN as null."""
    return F.when(~F.isnan(c), F.col(c)) if df.schema[c].dataType.typeName() in ("float", "double") else F.col(c)


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, column_name, dtype, nulls, distinct_values): distinct counts null as a value.

    Values are counted per (column, value) first, which combines on the map side; several distinct counts in one aggregate would
    write every row once for each column, with all its other columns.
    """
    columns = columns or df.columns
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    named = df.sparkSession.createDataFrame([(i, c, kinds[c]) for i, c in enumerate(columns)], "i int, column_name string, dtype string")
    parts = [F.struct(F.lit(i).alias("i"), clean_null(df, c).cast("string").alias("v")) for i, c in enumerate(columns)]
    values = df.select(F.explode(F.array(*parts)).alias("u")).groupBy("u.i", "u.v").agg(F.count("*").alias("n"))
    facts = values.groupBy("i").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("nulls"), F.count("*").alias("distinct_values"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return named.join(facts, "i", "left").select(zero("rows"), "column_name", "dtype", zero("nulls"), zero("distinct_values"))


def duplicate_examples(df: DataFrame, order: str, columns: list[str] | None = None, most: int = 5) -> DataFrame:
    """The first rows in ``order`` that repeat an earlier one; only groups that repeat are ordered, by a join with their first row."""
    columns = columns or [c for c in df.columns if c != order]
    groups = df.groupBy(*columns).agg(F.count("*").alias("_n"), F.min(order).alias("_first")).where(F.col("_n") > 1)
    on = F.lit(True)
    for i, c in enumerate(columns):
        on = on & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    named = groups.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], "_first")
    return df.join(named, on).where(F.col(order) > F.col("_first")).orderBy(order).limit(most).select(*df.columns)


def head(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in ``order``."""
    return df.orderBy(order).limit(n)


def duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows that repeat an earlier one, and how many groups repeat."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"), F.count_if(F.col("_n") > 1).alias("repeated_groups"))


@dataclass
class Role:
    column: str
    role: str
    alternates: list[str] = field(default_factory=list)
    reasons: list[str] = field(default_factory=list)


def identifier_facts(df: DataFrame) -> dict[str, dict]:
    """The facts role rules need, for all columns, collected as one row."""
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        kind = df.schema[c].dataType.typeName()
        v = clean_null(df, c)
        text = v.cast("string")
        aggs += [F.count(v).alias(f"n{i}"), F.count_distinct(v).alias(f"d{i}")]
        if kind in NUMERIC:
            whole = F.when(v.isNotNull(), (v.cast("double") % 1 == 0).cast("double"))
            aggs += [F.avg(whole).alias(f"w{i}"), F.percentile(F.length(F.abs(v).cast("decimal(38,0)").cast("string")), F.lit(0.5)).alias(f"l{i}"), F.min(v.cast("double")).alias(f"a{i}"), F.max(v.cast("double")).alias(f"b{i}")]
        elif kind == "string":
            aggs += [F.bool_or(text.rlike("^0[0-9]+$")).alias(f"z{i}"), F.avg(F.when(text.isNotNull(), text.rlike(r"^\s*[$€£]?\s*[0-9][0-9., ]*\s*(?:%|[A-Za-z]{1,3})?\s*$").cast("double"))).alias(f"p{i}")]
    row = df.agg(*aggs).first().asDict()
    return {
        c: {"rows": row["rows"], "kind": df.schema[c].dataType.typeName(), **{k: row.get(f"{s}{i}") for k, s in (("n", "n"), ("distinct", "d"), ("whole", "w"), ("digits", "l"), ("low", "a"), ("high", "b"), ("zeros", "z"), ("amounts", "p"))}}
        for i, c in enumerate(df.columns)
    }


def identifier_score(name: str, f: dict) -> float:
    score = 0.75 * is_identifier_name(name)
    if f["kind"] in NUMERIC:
        score += 0.2 * ((f["whole"] or 0) >= 0.99)
    if f["n"] and f["distinct"] / f["n"] > 0.9:
        score += 0.15
    return min(1.0, score + 0.4 * bool(f["zeros"]))


def infer_role(name: str, f: dict) -> Role:
    unique = f["rows"] > 0 and f["distinct"] == f["rows"]
    if not f["rows"]:
        return Role(name, "dimension")
    if f["kind"] in TEMPORAL:
        return Role(name, "temporal")
    if f["kind"] in NUMERIC:
        if unique:
            return Role(name, "identifier", ["measure"]) if is_identifier_name(name) else Role(name, "measure", ["identifier"])
        role = Role(name, "measure", [] if f["distinct"] > 20 else ["categorical"])
        if identifier_score(name, f) >= 0.7:
            return Role(name, "identifier", ["measure"], ["values and name look like an identifier"])
        few = f["distinct"] <= 10 and (f["whole"] or 0) >= 0.99 and not METRIC_NAME.search(name) and not ORDINAL_NAME.search(name)
        if few and f["rows"] >= 10 * max(1, f["distinct"]):
            return Role(name, "categorical", ["measure"], ["few whole codes"])
        return role
    if f["kind"] == "boolean":
        return Role(name, "dimension")
    if TIME_NAME.search(name):
        return Role(name, "temporal")
    if METRIC_NAME.search(name) and f["n"] >= 5 and (f["amounts"] or 0) >= 0.95:
        return Role(name, "measure", ["dimension"], ["amounts written as text"])
    if unique:
        return Role(name, "identifier")
    if identifier_score(name, f) >= 0.7:
        return Role(name, "identifier", ["dimension"], ["name looks like an identifier"])
    if f["distinct"] <= 20:
        return Role(name, "dimension")
    return Role(name, "free_text") if f["distinct"] > 50 else Role(name, "dimension", ["free_text"])


def roles(df: DataFrame) -> dict[str, Role]:
    facts = identifier_facts(df)
    return {c: infer_role(c, f) for c, f in facts.items()}


def pii_scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, emails, phones, by_name): values of the whole column that look personal; times are none, whatever their digits."""
    columns = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    row = df.agg(*[F.count_if(F.col(c).rlike(EMAIL_VALUE)).alias(f"e{i}") for i, c in enumerate(columns)], *[F.count_if(F.col(c).rlike(PHONE_VALUE) & (F.lit(not TIME_NAME.search(c)) & ~F.trim(c).rlike(DATE_VALUE))).alias(f"p{i}") for i, c in enumerate(columns)])
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"e{i}").alias("emails"), F.col(f"p{i}").alias("phones"), F.lit(bool(PII_NAME.search(c))).alias("by_name")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def redact(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit("[REDACTED]") for c in columns})


def sampling_column(facts: dict[str, dict]) -> str | None:
    """The column with the most values of those with at most 50, and at most one for two rows; the first among equals."""
    fit = [(f["distinct"], c) for c, f in facts.items() if f["kind"] == "string" and 1 < f["distinct"] <= min(50, f["rows"] / 2)]
    best = max((d for d, _ in fit), default=0)
    return next((c for d, c in fit if d == best), None)


def stratified_sample(df: DataFrame, category: str | None, order: str, groups: int = 5, each: int = 4) -> DataFrame:
    """``each`` evenly spaced rows of each of the ``groups`` commonest categories, filled up to ``groups * each`` rows by the first others.

    Without a category the one that suits is taken, and evenly spaced rows of the whole table where none does.
    """
    if category is None:
        category = sampling_column(identifier_facts(df.drop(order)))
    if category is None:
        return even_sample(df, order, groups * each)
    top = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), category).limit(groups)
    own = df.join(F.broadcast(top), category)  # at most ``groups`` rows
    w = Window.partitionBy(category).orderBy(order)
    stride = F.greatest(F.floor(F.col("_n") / each), F.lit(1))
    at = F.row_number().over(w) - 1
    taken = own.withColumn("_at", at).where((F.col("_at") % stride == 0) & (F.col("_at") / stride < each)).drop("_at", "_n").select(*df.columns)
    rest = df.join(taken.select(F.col(order).alias("_taken")), F.col(order) == F.col("_taken"), "left_anti").orderBy(order).limit(groups * each)
    both = taken.withColumn("_first", F.lit(0)).unionByName(rest.withColumn("_first", F.lit(1)))
    return both.orderBy("_first", order).limit(groups * each).drop("_first")


def even_sample(df: DataFrame, order: str, points: int = 1500) -> DataFrame:
    """At most ``points`` rows, evenly spaced in ``order``, first and last included.

    Row numbers come from ranges of ``order`` and their sizes, so no single task orders the table.
    """
    parts = df.withColumn("_p", range_bucket(df, order))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_s"))
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows
    starts = sizes.withColumn("_b", F.coalesce(F.sum("_s").over(w), F.lit(0))).withColumn("_n", F.sum("_s").over(Window.partitionBy(F.lit(0)))).drop("_s")
    rows = parts.join(starts, "_p").withColumn("_at", F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    shown = F.least(F.col("_n"), F.lit(points))
    # row i is shown if i = round(k * (n - 1) / (shown - 1)) for some k
    k = F.round(F.col("_at") * (shown - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    back = F.round(k * (F.col("_n") - 1) / F.greatest(shown - 1, F.lit(1)))
    return rows.where(back == F.col("_at")).drop("_p", "_b", "_n", "_at")


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, hash): independent of the order of rows, sensitive to every value and to repetitions: the sum of 60 bits of each row's SHA-256."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in df.columns]
    h = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *texts), 256), 1, 15), 16, 10)
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash"))
