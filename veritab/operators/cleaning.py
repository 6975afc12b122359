"""Cleaning: a strategy from roles and missingness, and its execution as a lazy plan with few statistics jobs.

Values are never invented silently: a fill with a flag keeps ``<column>_missing_flag``.  Steps that need a statistic compute
it on the table as the steps before left it; neighbouring steps that don't change rows share one statistics job.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veritab.operators.profiling import clean_null
from veritab.operators.quality import SQL_TEXT
from veritab.plans.compile import exact_quantiles, moment, number

#: Marks of currencies, and units beside a written amount.
CURRENCIES = ("$", "€", "£", "EGP", "USD", "EUR", "SAR", "AED", "KWD", "QAR", "BHD", "OMR", "LE", "JPY", "GBP", "CNY", "JOD")
AMOUNT_UNITS = ("kg", "kgs", "g", "gm", "lb", "lbs", "oz", "cm", "mm", "km", "m", "ml", "l", "k", "%", "pct")
#: Each unit's kind and its size in that kind's base unit (gram, metre, litre).
SIZES = {
    "kg": ("mass", 1000.0), "g": ("mass", 1.0), "mg": ("mass", 0.001), "lbs": ("mass", 453.59237), "lb": ("mass", 453.59237), "oz": ("mass", 28.349523125),
    "km": ("length", 1000.0), "m": ("length", 1.0), "cm": ("length", 0.01), "mm": ("length", 0.001), "l": ("volume", 1.0), "ml": ("volume", 0.001),
}


def _without(text: Column, words: tuple[str, ...]) -> tuple[Column, Column]:
    """(the text without one of the words at either end, in upper case; the word)"""
    own = "|".join(re.escape(w.upper()) for w in sorted(words, key=len, reverse=True))
    front, back = F.regexp_extract(text, f"^(?:{own})", 0), F.regexp_extract(text, f"(?:{own})$", 0)
    word = F.when(front != "", front).otherwise(back)
    rest = F.when(front != "", F.substr(text, F.length(front) + 1)).otherwise(F.substr(text, F.lit(1), F.length(text) - F.length(back)))
    return F.trim(rest), word


def parse_amount(text: Column) -> Column:
    """A written amount as a number: thousands separators go, k and m multiply, percent stays in points; else null.

    Read from outside in: a currency at one end or the other, then a unit at the end, then the number.
    """
    rest, _ = _without(F.upper(F.regexp_replace(text, r"^\s+|\s+$", "")), CURRENCIES)
    rest, _ = _without(rest, CURRENCIES)
    units = "|".join(re.escape(u.upper()) for u in sorted(AMOUNT_UNITS, key=len, reverse=True))
    unit = F.regexp_extract(rest, f"(?:{units})$", 0)
    number_text = F.regexp_replace(F.substr(rest, F.lit(1), F.length(rest) - F.length(unit)), "[, ]", "")
    value = F.when(number_text.rlike(r"^[0-9]+(?:\.[0-9]*)?$"), number_text.try_cast("double"))
    return value * F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1.0)


def convert_unit(text: Column, to: str) -> Column:
    """A written quantity in the unit ``to``; text without a unit counts as already in it; units of another kind give null."""
    pattern = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)\s*$"
    value, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(text, pattern, 2))
    kind, size = SIZES[to]
    factor = F.when(unit == "", 1.0)
    for name, (own, f) in SIZES.items():
        if own == kind:
            factor = factor.when(unit == name, f / size)
    return value * factor


def normalize_text(text: Column) -> Column:
    """Outer white space goes, inner runs become one blank; null stays null."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark SQL has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def unify_case(df: DataFrame, column: str) -> DataFrame:
    """Lower case if that merges values, decided by one aggregate over the column."""
    row = df.agg(F.count_distinct(column).alias("a"), F.count_distinct(F.lower(column)).alias("b")).first()
    return df.withColumn(column, F.lower(column)) if row["b"] < row["a"] else df


def sanitize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SQL_TEXT, ""))


def drop_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(clean_null(df, column).isNotNull())


def drop_negative(df: DataFrame, column: str) -> DataFrame:
    return df.where((F.col(column) >= 0) | F.col(column).isNull())


def flag_missing(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_missing_flag", clean_null(df, column).isNull())


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """Exact quantiles of each column that has a number; one job for all columns."""
    parts = [F.struct(F.lit(c).alias("c"), number(df, c).cast("double").alias("x")) for c in columns]
    rows = df.select(F.explode(F.array(*parts)).alias("u")).select("u.*").where(F.col("x").isNotNull())
    return {r["c"]: r["q"] for r in exact_quantiles(rows, ["c"], "x", shares).collect()}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    found = quantiles(df, columns, [0.5]) if columns else {}
    return {c: found[c][0] if c in found else None for c in columns}


def median_fill(df: DataFrame, columns: list[str], flag: bool = False) -> DataFrame:
    values = medians(df, columns)
    for c in columns:
        if flag:
            df = flag_missing(df, c)
        df = df.withColumn(c, F.coalesce(number(df, c).cast("double"), F.lit(values[c])))
    return df


def mode_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """The commonest value, the smallest one among equals."""
    row = df.agg(*[F.mode(c, True).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(row[f"m{i}"])) for i, c in enumerate(columns)})


def unknown_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in columns})


def iqr_flag(df: DataFrame, column: str, drop: bool = False) -> DataFrame:
    a, b = quantiles(df, [column], [0.25, 0.75]).get(column, (None, None))
    if a is None or b <= a:
        return df if drop else df.withColumn(f"{column}_outlier_flag", F.lit(False))
    x = number(df, column)
    out = F.coalesce((x < a - 1.5 * (b - a)) | (x > b + 1.5 * (b - a)), F.lit(False))
    return df.where(~out) if drop else df.withColumn(f"{column}_outlier_flag", out)


def dedup(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """One row of each group of equal rows: the first in ``order``, or any where rows are equal throughout."""
    if order is None:
        return df.dropDuplicates(columns)
    rest = [c for c in df.columns if c not in columns]
    first = df.groupBy(*columns).agg(F.min_by(F.struct(*rest), order).alias("_r"))  # combines on the map side, unlike a window
    return first.select(*columns, "_r.*").select(*df.columns)


@dataclass
class Step:
    action: str
    column: str


@dataclass
class Strategy:
    steps: list[Step] = field(default_factory=list)
    rejected: list[str] = field(default_factory=list)


def action_for(role: str, rate: float, mechanism: str) -> str | None:
    """What to do with a column's missing values."""
    if rate <= 0:
        return None
    number_like, named = role == "measure", role in ("dimension", "categorical")
    if rate > 0.70:
        return "drop_column" if number_like or role in ("temporal", "identifier") else "keep_flag"
    if mechanism in ("MAR", "MNAR"):
        return "drop_row" if role in ("temporal", "identifier") else "flag_and_preserve"
    if number_like:
        return "median_fill" if rate < 0.05 else "median_fill_flag"
    if named:
        return "mode_fill" if rate < 0.05 else "unknown_fill"
    return "drop_row"


def build_strategy(roles: dict[str, str], missing: dict[str, tuple[float, str]], negative: list[str] = (), unsafe: list[str] = (), outliers: list[str] = ()) -> Strategy:
    out = Strategy([Step("drop_negative", c) for c in negative] + [Step("sanitize_text", c) for c in unsafe])
    for c, role in roles.items():
        action = action_for(role, *missing.get(c, (0.0, "none")))
        if action == "drop_column":
            out.steps = [s for s in out.steps if s.column != c]
        if action:
            out.steps.append(Step(action, c))
    gone = {s.column for s in out.steps if s.action == "drop_column"}
    out.steps += [Step("outlier_flag", c) for c in outliers if c not in gone]
    return out


ACTIONS = {
    "drop_negative": drop_negative, "drop_row": drop_null, "drop_column": lambda df, c: df.drop(c),
    "sanitize_text": lambda df, c: df.withColumn(c, sanitize_text(F.col(c))), "flag_and_preserve": flag_missing, "keep_flag": flag_missing,
    "outlier_flag": iqr_flag, "outlier_drop": lambda df, c: iqr_flag(df, c, drop=True),
}
FILLS = {"median_fill": lambda df, cs: median_fill(df, cs), "median_fill_flag": lambda df, cs: median_fill(df, cs, flag=True), "mode_fill": mode_fill, "unknown_fill": unknown_fill}


def normalize_strategy(proposed: list[dict], columns: list[str]) -> Strategy:
    """A proposed strategy without its unknown columns and actions, each with the reason."""
    out = Strategy()
    for p in proposed:
        if p.get("column") not in columns:
            out.rejected.append(f"no column {p.get('column')}")
        elif p.get("action") not in ACTIONS and p.get("action") not in FILLS:
            out.rejected.append(f"no action {p.get('action')}")
        else:
            out.steps.append(Step(p["action"], p["column"]))
    return out


def execute(df: DataFrame, strategy: Strategy) -> DataFrame:
    """Steps in order; runs of one fill share a statistics job, since a fill changes no rows of other columns."""
    i = 0
    while i < len(strategy.steps):
        s = strategy.steps[i]
        if s.action in FILLS:
            run = [s.column]
            while i + 1 < len(strategy.steps) and strategy.steps[i + 1].action == s.action:
                i += 1
                run.append(strategy.steps[i].column)
            df = FILLS[s.action](df, run)
        else:
            df = ACTIONS[s.action](df, s.column)
        i += 1
    return df


def repair(df: DataFrame, measures: list[str], temporals: list[str], order: str | None = None) -> DataFrame:
    """Deterministic repair: written amounts to numbers where 95 % of the rows parse, dates parsed, impossible dates and repeats dropped."""
    texts = [m for m in measures if df.schema[m].dataType.typeName() == "string"]
    if texts:
        # here the share is of all rows, unlike in normalize_amounts
        row = df.agg(F.count("*").alias("n"), *[F.count(parse_amount(F.col(m))).alias(f"p{i}") for i, m in enumerate(texts)]).first()
        for i, m in enumerate(texts):
            good = row["n"] and row[f"p{i}"] / row["n"] >= 0.95
            df = df.withColumn(m, parse_amount(F.col(m)) if good else number(df, m))
    for t in temporals:
        ts = moment(df, t)
        df = df.where(F.col(t).isNull() | (ts.isNotNull() & (F.year(ts) < 2100))).withColumn(t, ts)
    return dedup(df, [c for c in df.columns if c != order], order)


def cast_by_role(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Measures as doubles, times as timestamps, all else as text; what can't be read is null."""
    out = {}
    for c in df.columns:
        role, kind = roles.get(c), df.schema[c].dataType.typeName()
        if role == "measure" and kind == "string":
            out[c] = number(df, c)
        elif role == "temporal" and kind == "string":
            out[c] = moment(df, c)
        elif role in ("dimension", "free_text") and kind != "string":
            out[c] = F.col(c).cast("string")
    return df.withColumns(out)


def normalize_amounts(df: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """Text columns as numbers where at least ``share`` of the values that are present read as amounts; others stay text."""
    texts = [c for c in columns if df.schema[c].dataType.typeName() == "string"]
    if not texts:
        return df
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(texts)], *[F.count(parse_amount(F.col(c))).alias(f"p{i}") for i, c in enumerate(texts)]).first()
    return df.withColumns({c: parse_amount(F.col(c)) for i, c in enumerate(texts) if row[f"n{i}"] and row[f"p{i}"] >= share * row[f"n{i}"]})


def normalize_dates(text: Column) -> Column:
    """Written times in UTC without a zone: ISO dates and times, with or without an offset; anything else is null."""
    iso = F.regexp_replace(F.trim(text), "T", " ")
    zoned = F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ssXXX")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss XXX")))
    plain = F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.to_utc_timestamp(zoned, F.current_timezone()), plain).cast("timestamp_ntz")


def merge_proposed(own: Strategy, proposed: Strategy) -> Strategy:
    """The deterministic strategy with proposed steps on columns it leaves alone; what it decides stays."""
    decided = {s.column for s in own.steps}
    rejected = [f"{s.action} on {s.column}: decided by the rules" for s in proposed.steps if s.column in decided]
    return Strategy(own.steps + [s for s in proposed.steps if s.column not in decided], [*own.rejected, *proposed.rejected, *rejected])


def lineage(steps: list[Step], before: DataFrame, after: DataFrame, fingerprint) -> dict:
    """What was done to a table: steps, rows and fingerprints on both sides."""
    a, b = fingerprint(before).first(), fingerprint(after).first()
    return {"steps": [(s.action, s.column) for s in steps], "rows_before": a["rows"], "rows_after": b["rows"], "hash_before": a["hash"], "hash_after": b["hash"]}


def impact(before: DataFrame, after: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, rows, sums, means and medians before and after, and the change of the sum)."""

    def facts(df: DataFrame, tag: str) -> DataFrame:
        parts = [F.struct(F.lit(m).alias("measure"), number(df, m).cast("double").alias("x")) for m in measures]
        rows = df.select(F.explode(F.array(*parts)).alias("u")).select("u.*")
        middle = exact_quantiles(rows.where(F.col("x").isNotNull()), ["measure"], "x", [0.5]).select("measure", F.get("q", F.lit(0)).alias(f"median_{tag}"))
        return rows.groupBy("measure").agg(
            F.count("*").alias(f"rows_{tag}"), F.count("x").alias(f"present_{tag}"), F.coalesce(F.sum("x"), F.lit(0.0)).alias(f"sum_{tag}"), F.avg("x").alias(f"mean_{tag}"),
        ).join(middle, "measure", "left")

    both = facts(before, "before").join(facts(after, "after"), "measure", "full_outer")
    delta = F.col("sum_after") - F.col("sum_before")
    return both.withColumns({"delta": delta, "delta_percent": F.try_divide(delta, F.col("sum_before")) * 100})
