"""Column profiles of loads and their departures from an accepted reference load.

Plan.  One scan of the loads.  A first aggregate counts each *cell* of (load, column): a distinct value of a categorical column,
or an interval of a numeric one whose bounds are the reference's distinct values.  Numeric cells of a load are bounded by the
reference, so a load with a third of all rows is one small group after the map-side combine.  Cells add up (``merge_cells``):
they can be stored for each part or day and merged later.

* counts, nulls, blanks, NaN, pattern violations, distinct values, ranges;
* power sums: numbers of at most two decimals below 10**9 are summed as whole hundredths in DECIMAL, exactly and whatever the
  order; all others are summed beside them in floating point, and ``inexact`` counts them;
* standardised differences of means (in pooled standard deviations) between load and reference;
* distribution distance against the reference: half the L1 distance for categories, Kolmogorov-Smirnov for numbers.  A step
  function of the load moves only at the load's own cells, so its cells and the reference's cumulative counts suffice.

The sums give a bound from below: the largest difference of two cumulative shares is at least the difference of the means over
the common range (``least_distance``).  They can't bound it from above, so the exact distance from the cells decides.

A reference with more than ``MAX_BOUNDS`` distinct values of a column is cut at ``QUANTILES`` of its values instead.  Cells between two
of them then keep their numbers, and where a number inside an interval may lie further from the reference than the interval's ends,
it is placed among the reference's values there (``_gaps_inside``).  So the distance is exact for a reference of any size;
``distance_error``, the largest share of the reference inside one interval, is what the ends alone would leave open.

Defined results: a load without present values has no shift; a reference without present values gives no shift either, an empty one has
shares of 0 and no known category;
null load ids form a load of their own; NaN counts as absent and infinity as invalid; equal rows count each; an empty
table gives an empty profile; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.shared import ensure_checkpoint_dir

#: Largest number of distinct reference values kept as interval bounds inside the plan, and how many bounds a larger reference gets.
MAX_BOUNDS, QUANTILES = 100_000, 10_000
SCALE = 100


@dataclass(frozen=True)
class Check:
    """How one column is read: ``kind`` is number, category or day; days are counted back from ``until``."""

    column: str
    kind: str
    until: str | None = None


SALES_CHECKS = (Check("revenue", "number"), Check("category", "category"), Check("date", "day", "loaded_at"))


def _day(text: Column) -> Column:
    """The date of an existing day written YYYY-MM-DD, else null."""
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def _blank(text: Column) -> Column:
    return text.rlike(r"\A[\p{IsWhite_Space}\x1c-\x1f]*\z")


@dataclass
class Reference:
    """What loads are measured by; what the driver holds of it is bounded by MAX_BOUNDS for each numeric column."""

    checks: tuple[Check, ...]
    known: DataFrame  # (column_name, text, ref_n) of categories
    bounds: dict[str, list[float]] = field(default_factory=dict)
    upto: dict[str, list[int]] = field(default_factory=dict)  # reference values in the cells up to each one, from cell -1 on
    facts: dict[str, dict] = field(default_factory=dict)
    error: dict[str, float] = field(default_factory=dict)
    inside: DataFrame | None = None  # (i_column, i_cell, i_values, i_upto) of intervals that hold reference values, if a column was cut
    most_inside: int = 0  # reference values in one interval


def _read(df: DataFrame, c: Check) -> tuple[Column, Column, Column, Column]:
    """absent, bad, number, text of a column."""
    v = F.col(c.column)
    none = F.lit(None)
    if c.kind == "number":
        d = v.cast("double")
        return d.isNull() | F.isnan(d), (d < 0) | (F.abs(d) == float("inf")), d, none.cast("string")
    absent = v.isNull() | _blank(v)
    if c.kind == "category":
        return absent, F.lit(False), none.cast("double"), v
    day = _day(v)
    return absent, day.isNull(), F.datediff(F.to_date(F.col(c.until)), day).cast("double"), none.cast("string")


def _cells(df: DataFrame, load: str, checks: tuple[Check, ...], bounds: dict[str, list[float]] | None = None, kept: dict[str, list[int] | None] | None = None) -> DataFrame:
    """(load, column, kind, absent, bad, number, text, cell, value): one row per stored value.

    ``value`` is the number in an interval of a ``kept`` column, if the cumulative reference counts given for it grow there.
    """
    cols = []
    for i, c in enumerate(checks):
        absent, bad, number, text = _read(df, c)
        bad = ~absent & F.coalesce(bad, F.lit(False))
        cols += [absent.alias(f"a{i}"), bad.alias(f"b{i}"), F.when(~absent & ~bad, number).alias(f"x{i}"), F.when(~absent, text).alias(f"t{i}")]
    rows = df.select(F.col(load).cast("long").alias("load_id"), *cols)
    for i, c in enumerate(checks):
        rows = _placed(rows, f"x{i}", f"c{i}", (bounds or {}).get(c.column)) if c.kind != "category" and bounds else rows.withColumn(f"c{i}", F.lit(None).cast("int"))
        within = F.lit(False)
        if c.column in (kept or {}):
            cell, upto = F.col(f"c{i}"), kept[c.column]
            within = (cell % 2 != 0) & (F.lit(True) if upto is None else F.get(_longs(upto, "long"), cell + 2) > F.get(_longs(upto, "long"), cell + 1))
        rows = rows.withColumn(f"v{i}", F.when(within, F.col(f"x{i}")))
    parts = [
        F.struct(F.lit(c.column).alias("column_name"), F.lit(c.kind).alias("kind"), *[F.col(f"{k}{i}").alias(n) for k, n in zip("abxtcv", ("absent", "bad", "number", "text", "cell", "value"))])
        for i, c in enumerate(checks)
    ]
    return rows.select("load_id", F.explode(F.array(*parts)).alias("c")).select("load_id", "c.*")


def _longs(values: list, kind: str) -> Column:
    """A constant array, folded once."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _placed(df: DataFrame, number: str, out: str, bounds: list[float]) -> DataFrame:
    """The index of the cell: 2k for the k-th bound itself, 2k+1 for the open interval above it; -1 below the first; null for null."""
    depth = len(bounds).bit_length()
    arr = _longs([*bounds, *[float("inf")] * ((1 << depth) - 1 - len(bounds))], "double")
    df = _reached(df, number, out, arr, depth)
    at = F.col(out)
    cell = F.when(at == 0, -1).when(F.get(arr, at - 1) == F.col(number), 2 * (at - 1)).otherwise(2 * (at - 1) + 1)
    return df.withColumn(out, F.when(F.col(number).isNotNull(), cell))


def _reached(df: DataFrame, number: str, out: str, arr: Column, depth: int) -> DataFrame:
    """How many of fewer than 2**depth sorted values are at most the number.

    A binary search, one projection for each halving, so that it is compiled with the scan and needs no join.
    """
    df = df.withColumn(out, F.lit(0))
    for k in reversed(range(depth)):
        df = df.withColumn(out, F.when(F.get(arr, F.col(out) + F.lit((1 << k) - 1)) <= F.col(number), F.col(out) + F.lit(1 << k)).otherwise(F.col(out)))
    return df


#: What tells cells apart.
KEYS = ("load_id", "column_name", "kind", "absent", "bad", "text", "cell", "value")


def _counted(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), *power_sums(F.col("number")))


def measure(reference: DataFrame, checks: tuple[Check, ...] = SALES_CHECKS) -> Reference:
    """Bounds, counts and facts of the reference."""
    ensure_checkpoint_dir(reference.sparkSession)
    one = reference.withColumn("_load", F.lit(0))
    plain = _cells(one, "_load", checks)
    out, cut = Reference(checks, plain.limit(0)), []
    for c in [c.column for c in checks if c.kind != "category"]:
        values = plain.where((F.col("column_name") == c) & F.col("number").isNotNull()).select("number")
        rows = values.distinct().orderBy("number").limit(MAX_BOUNDS + 1).collect()
        if len(rows) > MAX_BOUNDS:
            cuts = [k / (QUANTILES - 1) for k in range(QUANTILES)]
            found = values.agg(F.percentile_approx("number", _longs(cuts, "double"), 10 * QUANTILES)).first()[0]
            out.bounds[c] = sorted(set(found))
            cut.append(c)
        else:
            out.bounds[c] = [r["number"] for r in rows] or [0.0]
    counted = _counted(_cells(one, "_load", checks, out.bounds, dict.fromkeys(cut))).checkpoint()
    kind, ok = F.col("kind"), ~F.col("absent") & ~F.col("bad")
    out.known = counted.where((kind == "category") & ok).groupBy(F.col("column_name").alias("k_column"), F.col("text").alias("k_text")).agg(F.sum("n").alias("ref_n"))
    for c, values in out.bounds.items():
        n = [0] * (2 * len(values) + 1)
        for r in counted.where((F.col("column_name") == c) & ok).groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
            n[r["cell"] + 1] = r["n"]
        total = sum(n)
        out.error[c] = max(n[0::2], default=0) / total if total else 0.0
        out.upto[c] = [0, *accumulate(n)]
        out.most_inside = max(out.most_inside, max(n[0::2]))
    if cut:
        values = counted.where(F.col("value").isNotNull()).groupBy(F.col("column_name").alias("i_column"), F.col("cell").alias("i_cell"), "value").agg(F.sum("n").alias("n"))
        interval = Window.partitionBy("i_column", "i_cell").orderBy("value")
        values = values.withColumn("upto", F.sum("n").over(interval.rowsBetween(Window.unboundedPreceding, 0)))
        pairs = values.groupBy("i_column", "i_cell").agg(F.array_sort(F.collect_list(F.struct("value", "upto"))).alias("p"))
        out.inside = pairs.select("i_column", "i_cell", F.col("p.value").alias("i_values"), F.concat(F.array(F.lit(0).cast("long")), F.col("p.upto")).alias("i_upto"))
    out.facts = {r["column_name"]: r.asDict() for r in _facts(counted).collect()}
    return out


def cells_of(loads: DataFrame, ref: Reference, load: str = "load_id") -> DataFrame:
    """The counted cells of the loads; they can be stored, and merged with those of other parts."""
    kept = {c: upto for c, upto in ref.upto.items() if ref.inside is not None and ref.error[c]}
    return _counted(_cells(loads, load, ref.checks, ref.bounds, kept))


def merge_cells(cells: DataFrame) -> DataFrame:
    """Cells of several parts added up."""
    return cells.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *merge_power_sums())


def profile(loads: DataFrame, reference: DataFrame, load: str = "load_id", checks: tuple[Check, ...] = SALES_CHECKS) -> DataFrame:
    """One row per load and checked column with counts, ranges, power sums, shifts and both shares against the reference."""
    ensure_checkpoint_dir(loads.sparkSession)
    ref = measure(reference, checks)
    # the cells are small and read twice below; written once, the loads are scanned once
    return profile_of_cells(cells_of(loads, ref, load).checkpoint(), ref)


def profile_of_cells(cells: DataFrame, ref: Reference) -> DataFrame:
    # spellings of a category: the reference's, few rows; the join is left to Spark, which sees its size
    category = F.col("kind") == "category"
    cells = cells.join(ref.known, (F.col("column_name") == F.col("k_column")) & (F.col("text") == F.col("k_text")), "left").drop("k_column", "k_text")
    cells = cells.withColumn("bad", F.col("bad") | (category & ~F.col("absent") & F.col("ref_n").isNull()))
    facts = _facts(cells)
    distance = _distances(cells, ref)
    names = ("rows", "absent", "invalid", "valid", "mean", "sd", "low", "high")
    at = lambda name: _by_column({c: f[name] for c, f in ref.facts.items()}, "long" if name in names[:4] else "double")
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    present, ref_present = F.col("rows") - F.col("absent"), F.col("ref_rows") - F.col("ref_absent")
    apart = F.abs(F.col("mean") - F.col("ref_mean"))
    reach = F.greatest("high", "ref_high") - F.least("low", "ref_low")
    return (
        facts.join(distance, F.col("load_id").eqNullSafe(F.col("d_load")) & (F.col("column_name") == F.col("d_column")), "left").drop("d_load", "d_column")
        .withColumns({f"ref_{n}": at(n) for n in names} | {"distance_error": F.coalesce(_by_column(ref.error, "double"), F.lit(0.0))})
        .withColumn("absent_share", share("absent", "rows")).withColumn("ref_absent_share", F.coalesce(share("ref_absent", "ref_rows"), F.lit(0.0)))
        .withColumn("invalid_share", F.coalesce(F.try_divide(F.col("invalid").cast("double"), present.cast("double")), F.lit(0.0)))
        .withColumn("ref_invalid_share", F.coalesce(F.try_divide(F.col("ref_invalid").cast("double"), ref_present.cast("double")), F.lit(0.0)))
        .withColumn("standardised_difference", F.try_divide(F.col("mean") - F.col("ref_mean"), F.sqrt((F.col("sd") ** 2 + F.col("ref_sd") ** 2) / 2)))
        .withColumn("least_distance", F.try_divide(apart, reach))
    )


def _by_column(values: dict[str, object], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for c, v in values.items():
        out = F.when(F.col("column_name") == c, F.lit(v).cast(kind)).otherwise(out)
    return out


LIMB = 10**9
RANGE = 10**11
LIMBS = ("s1", "s2", "xh", "xl", "hh", "hl", "ll")


def power_sums(value: Column) -> list[Column]:
    """Sums of the first four powers that add up over parts in any order.

    A value of at most two decimals below 10**9 is a whole number of hundredths x; x**2 is cut into h * 10**9 + l, so that no product
    exceeds 38 digits, and all sums are exact.  Any other value adds to the floating point sums f1..f4, and ``ps_f`` counts it.
    """
    scaled = F.round(value * SCALE)
    exact = (F.abs(value) * SCALE < RANGE) & (scaled / SCALE == value)
    x = F.when(exact, scaled).cast("decimal(12,0)")
    sq = (x * x).cast("decimal(24,0)")
    h = F.floor(sq / LIMB).cast("decimal(15,0)")
    low = (sq - h * LIMB).cast("decimal(9,0)")
    parts = dict(zip(LIMBS, (x, sq, x * h, x * low, h * h, h * low, low * low)))
    other = F.when(~exact, value)
    return [
        F.count(value).alias("ps_n"), F.count(other).alias("ps_f"), *[F.sum(v.cast("decimal(28,0)")).alias(f"ps_{k}") for k, v in parts.items()],
        *[F.sum(other**k).alias(f"ps_f{k}") for k in (1, 2, 3, 4)],
    ]


def merge_power_sums() -> list[Column]:
    """Aggregates that merge the columns of ``power_sums`` of several parts."""
    kinds = {"n": "long", "f": "long"} | {k: "decimal(38,0)" for k in LIMBS} | {f"f{k}": "double" for k in (1, 2, 3, 4)}
    return [F.sum(f"ps_{k}").cast(t).alias(f"ps_{k}") for k, t in kinds.items()]


def power_values() -> dict[str, Column]:
    """mean, sd, skewness and kurtosis (population) from merged power sums, and how many values were summed in floating point."""
    n = F.col("ps_n")
    d = lambda c: F.coalesce(F.col(f"ps_{c}").cast("double"), F.lit(0.0))
    sums = (d("s1"), d("s2"), d("xh") * LIMB + d("xl"), d("hh") * float(LIMB) ** 2 + 2 * d("hl") * LIMB + d("ll"))
    m1, m2, m3, m4 = [F.try_divide(s / float(SCALE**k) + d(f"f{k}"), n) for k, s in enumerate(sums, 1)]
    var = F.when(m2.isNotNull(), F.greatest(m2 - m1**2, F.lit(0.0)))
    return {
        "mean": m1, "sd": F.sqrt(var),
        "skewness": F.try_divide(m3 - 3 * m1 * m2 + 2 * m1**3, var * F.sqrt(var)),
        "kurtosis": F.try_divide(m4 - 4 * m1 * m3 + 6 * m1**2 * m2 - 3 * m1**4, var**2) - 3,
        "inexact": F.col("ps_f"),
    }


def _facts(cells: DataFrame) -> DataFrame:
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    ok = ~F.col("absent") & ~F.col("bad")
    facts = cells.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("rows"), n(F.col("absent")).alias("absent"), n(F.col("bad")).alias("invalid"), n(ok).alias("valid"),
        F.min("low").alias("low"), F.max("high").alias("high"), *merge_power_sums(),
    )
    return facts.withColumns(power_values()).drop(*[c for c in facts.columns if c.startswith("ps_")])


def column_profile(df: DataFrame, group: str, columns: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """(group, column): rows, nulls, blanks, NaNs, exact distinct values, range, pattern violations, moments of numbers.

    Values are counted per (group, column, value) first, which combines on the map side; the second aggregate never meets
    more than one row for a distinct value, so neither a hot value nor a hot group gathers rows in one task.
    ``patterns`` are regular expressions the whole text of a value must match.
    """
    patterns = patterns or {}
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "decimal")}
    parts = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"),
            (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"),
        )
        for c in columns
    ]
    values = (
        df.select(F.col(group).alias("group_id"), F.explode(F.array(*parts)).alias("c"))
        .groupBy("group_id", "c.column_name", "c.value", "c.number").agg(F.count("*").alias("n"))
    )
    number = F.when(~F.isnan("number") & (F.abs("number") < float("inf")), F.col("number"))
    violates = F.lit(False)
    for c, p in patterns.items():
        violates = F.when(F.col("column_name") == c, F.col("value").isNotNull() & ~F.col("value").rlike(rf"\A(?:{p})\z")).otherwise(violates)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    weighted = [F.sum(number * F.col("n")), F.sum(F.when(number.isNotNull(), F.col("n")))]
    return values.groupBy("group_id", "column_name").agg(
        F.sum("n").alias("rows"), n(F.col("value").isNull()).alias("nulls"), n(F.isnan("number")).alias("nans"),
        n(_blank(F.col("value"))).alias("blanks"), n(violates).alias("violations"), F.count("value").alias("distinct_values"),
        F.min(F.when(F.col("number").isNull(), F.col("value"))).alias("least_text"), F.max(F.when(F.col("number").isNull(), F.col("value"))).alias("greatest_text"),
        F.min(number).alias("least_number"), F.max(number).alias("greatest_number"), F.round(F.try_divide(*weighted), 4).alias("mean_number"),
    )


def _distances(cells: DataFrame, ref: Reference) -> DataFrame:
    """Half the L1 distance of the shares, or the largest difference of the cumulative shares, of each load with valid values.

    Between two values of the load its cumulative share stands still while the reference's grows, so the largest difference is at
    a value of the load or just before one: each cell of the load is compared with the reference before it and at it.
    """
    ok = ~F.col("absent") & ~F.col("bad")
    own = cells.where(ok).groupBy("load_id", "column_name", "kind", "text", "cell").agg(F.sum("n").alias("n"), F.first("ref_n").alias("ref_n"))
    load = Window.partitionBy("load_id", "column_name")
    rows = own.select("*", F.sum("n").over(load).alias("own_all"), F.sum("n").over(load.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    total = _by_column({c: f["valid"] for c, f in ref.facts.items()}, "double")
    rows = rows.withColumn("ref_all", total).where(F.col("ref_all") > 0)
    at, before = F.lit(None).cast("double"), F.lit(None).cast("double")
    for c, upto in ref.upto.items():
        arr, here = _longs(upto, "long"), F.col("column_name") == c
        before, at = F.when(here, F.get(arr, F.col("cell") + 1)).otherwise(before), F.when(here, F.get(arr, F.col("cell") + 2)).otherwise(at)
    p, q = F.col("n") / F.col("own_all"), F.col("ref_n") / F.col("ref_all")
    rows = rows.withColumns({"before": before, "at": at}).withColumn("gap", _gap())
    gaps = rows.select("load_id", "column_name", "kind", "gap", F.abs(p - q).alias("apart"), q.alias("shared"))
    if ref.inside is not None:
        gaps = gaps.unionByName(_gaps_inside(cells.where(ok), rows, ref), allowMissingColumns=True)
    found = gaps.groupBy(F.col("load_id").alias("d_load"), F.col("column_name").alias("d_column"), "kind").agg(
        F.max("gap").alias("gap"), F.sum("apart").alias("apart"), F.sum("shared").alias("shared")
    )
    # what the reference has beyond the load's own values
    return found.select("d_load", "d_column", F.when(F.col("kind") == "category", (F.col("apart") + 1 - F.col("shared")) / 2).otherwise(F.col("gap")).alias("distance"))


def _gap() -> Column:
    """The larger difference of the cumulative shares just before a cell and at it."""
    run, n, own, ref = (F.col(c) for c in ("run", "n", "own_all", "ref_all"))
    return F.greatest(F.abs((run - n) / own - F.col("before") / ref), F.abs(run / own - F.col("at") / ref))


def _gaps_inside(cells: DataFrame, rows: DataFrame, ref: Reference) -> DataFrame:
    """(load, column, kind, gap) at the load's numbers inside intervals, where one may exceed all gaps at the ends.

    Both cumulative shares only grow from one end to the other, so their difference inside exceeds neither ``most``; an interval
    where that is no more than the load's largest gap is left out, which changes no result.  The numbers of the others fall
    into second cells, between two of the reference's values there or at one.
    """
    run, n, own, of = (F.col(c) for c in ("run", "n", "own_all", "ref_all"))
    most = F.greatest(run / own - F.col("before") / of, F.col("at") / of - (run - n) / own)
    wide = rows.withColumn("best", F.max("gap").over(Window.partitionBy("load_id", "column_name")))
    wide = wide.where((F.col("cell") % 2 != 0) & (F.col("at") > F.col("before")) & (most > F.col("best")))
    wide = wide.select(F.col("load_id").alias("w_load"), F.col("column_name").alias("w_column"), F.col("cell").alias("w_cell"), (run - n).alias("start"), F.col("before").alias("base"), "own_all", "ref_all")
    inner = (
        cells.where(F.col("value").isNotNull()).select("load_id", "column_name", "kind", "cell", "value", "n")
        .join(wide, F.col("load_id").eqNullSafe(F.col("w_load")) & (F.col("column_name") == F.col("w_column")) & (F.col("cell") == F.col("w_cell")))
        .join(ref.inside, (F.col("column_name") == F.col("i_column")) & (F.col("cell") == F.col("i_cell")))
    )
    inner = _reached(inner, "value", "k", F.col("i_values"), ref.most_inside.bit_length())
    equal = F.coalesce(F.get("i_values", F.col("k") - 1) == F.col("value"), F.lit(False))
    upto = lambda k: F.col("base") + F.get("i_upto", k)
    inner = inner.withColumns({"before": upto(F.col("k") - equal.cast("int")), "at": upto(F.col("k"))})
    inner = inner.groupBy("load_id", "column_name", "kind", "cell", "start", "own_all", "ref_all", "before", "at").agg(F.sum("n").alias("n"))
    cell = Window.partitionBy("load_id", "column_name", "cell").orderBy("before", "at").rowsBetween(Window.unboundedPreceding, 0)
    return inner.withColumn("run", F.col("start") + F.sum("n").over(cell)).select("load_id", "column_name", "kind", _gap().alias("gap"))


def departures(
    profiled: DataFrame, checks: tuple[Check, ...] = SALES_CHECKS, missing: float = 0.10, invalid: float = 0.10,
    category_shift: float = 0.15, number_shift: float = 0.20,
) -> DataFrame:
    """(load_id, column_name, finding) of a profile: missing, invalid or shifted."""
    categories = [c.column for c in checks if c.kind == "category"]
    limit = F.when(F.col("column_name").isin(categories), category_shift).otherwise(number_shift)
    found = F.array_compact(
        F.array(
            F.when(F.col("absent_share") - F.col("ref_absent_share") > missing, "missing"),
            F.when(F.col("invalid_share") - F.col("ref_invalid_share") > invalid, "invalid"),
            F.when(F.col("distance") > limit, "shifted"),
        )
    )
    return profiled.select("load_id", "column_name", F.explode(found).alias("finding"))
