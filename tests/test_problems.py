"""Load profiles, failing records and imputation: planted cases, brute force, and the awkward inputs."""

import math
import random
import re
import time
from bisect import bisect_left, bisect_right
from datetime import date, datetime
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from veritab.operators import impute, load_profile as lp
from veritab.sources import delimited as dl

SALES = "order_id string, date string, product string, category string, revenue double, quantity long, customer_email string, load_id long, loaded_at timestamp"


def sale(load, revenue=10.0, category="A", day="2024-01-01", extra=()):
    return ("o", day, "p", category, revenue, 1, "e", load, datetime(2024, 1, 5, 3), *extra)


def found(spark, loads, reference, schema=SALES):
    p = lp.profile(spark.createDataFrame(loads, schema), spark.createDataFrame(reference, schema))
    return {(r["load_id"], r["column_name"], r["finding"]) for r in lp.departures(p).collect()}


def test_planted_departures(spark):
    rng = np.random.default_rng(1)
    ref = [sale(0, float(x), "AB"[i % 2]) for i, x in enumerate(rng.uniform(1, 100, 200).round(2))]
    usual = [sale(1, float(x), "AB"[i % 2]) for i, x in enumerate(rng.uniform(1, 100, 200).round(2))]
    shifted = [sale(2, float(x) + 60, "A" if i % 5 else "B") for i, x in enumerate(rng.uniform(1, 100, 200).round(2))]
    missing = [sale(3, None if i % 4 == 0 else float("nan") if i % 4 == 1 else 50.5, " \t" if i % 3 else "A", day="" if i % 2 else "2024-01-01") for i in range(80)]
    invalid = [sale(4, -1.0 if i % 3 else math.inf, "a", day=["2024-02-30", "1/2/2024", "2024-1-01"][i % 3]) for i in range(60)]
    got = found(spark, usual + shifted + missing + invalid, ref)
    assert {x for x in got if x[0] == 1} == set()
    assert {x for x in got if x[0] == 2} == {(2, "revenue", "shifted"), (2, "category", "shifted")}
    assert {(3, c, "missing") for c in ("revenue", "category", "date")} <= got
    assert {x for x in got if x[0] == 4} == {(4, c, "invalid") for c in ("revenue", "category", "date")}


def test_distance_against_brute_force(spark):
    rng = np.random.default_rng(2)
    ref, own = rng.integers(0, 30, 97).astype(float), rng.integers(5, 45, 61).astype(float) / 2
    p = lp.profile(spark.createDataFrame([sale(1, float(x)) for x in own], SALES), spark.createDataFrame([sale(0, float(x)) for x in ref], SALES))
    row = p.where("column_name = 'revenue'").first()
    at = np.union1d(ref, own)
    want = max(abs((own <= x).mean() - (ref <= x).mean()) for x in at)
    assert row["distance"] == pytest.approx(want) and row["mean"] == pytest.approx(own.mean()) and row["sd"] == pytest.approx(own.std())
    d = (own - own.mean()) / own.std()
    assert row["skewness"] == pytest.approx((d**3).mean()) and row["kurtosis"] == pytest.approx((d**4).mean() - 3)


def test_cells_of_parts_add_up(spark):
    rng = np.random.default_rng(5)
    ref = spark.createDataFrame([sale(0, float(x), "AB"[i % 2]) for i, x in enumerate(rng.integers(0, 50, 80))], SALES)
    rows = spark.createDataFrame([sale(i % 2, float(x), "ABC"[i % 3]) for i, x in enumerate(rng.normal(30, 20, 120).round(1))], SALES)
    measured = lp.measure(ref)
    whole = lp.profile_of_cells(lp.cells_of(rows, measured), measured)
    parts = [lp.cells_of(rows.where(F.col("revenue") > 30), measured), lp.cells_of(rows.where(~(F.col("revenue") > 30)), measured)]
    merged = lp.profile_of_cells(lp.merge_cells(parts[0].unionByName(parts[1])), measured)
    key = lambda r: (r["load_id"], r["column_name"])
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, merged.collect()), key=str)
    for r in whole.where("column_name = 'revenue'").collect():
        assert r["least_distance"] <= r["distance"] + 1e-12 and r["inexact"] == 0, key(r)


def test_distance_of_a_large_reference_is_within_its_error(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(lp, "MAX_BOUNDS", 50)
    monkeypatch.setattr(lp, "QUANTILES", 40)
    ref, own = rng.lognormal(0, 1, 900), rng.lognormal(0.3, 1, 300)
    p = lp.profile(spark.createDataFrame([sale(1, float(x)) for x in own], SALES), spark.createDataFrame([sale(0, float(x)) for x in ref], SALES))
    row = p.where("column_name = 'revenue'").first()
    want = max(abs((own <= x).mean() - (ref <= x).mean()) for x in np.union1d(ref, own))
    assert 0 < row["distance_error"] < 0.06 and abs(row["distance"] - want) <= row["distance_error"]
    assert row["inexact"] == 300 and row["mean"] == pytest.approx(own.mean()) and row["sd"] == pytest.approx(own.std())


def test_results_do_not_depend_on_the_size_of_the_reference(spark, monkeypatch):
    ref = np.arange(1000.0)
    # the first two differ from the reference inside an interval only
    loads = {1: np.maximum(ref, 220), 2: np.maximum(ref, 150), 3: np.random.default_rng(7).uniform(0, 1200, 300).round(1), None: np.full(7, 600.5)}
    want = {i: max(abs((own <= x).mean() - (ref <= x).mean()) for x in np.union1d(ref, own)) for i, own in loads.items()}
    own = spark.createDataFrame([sale(i, float(x)) for i, v in loads.items() for x in v], SALES)
    reference = spark.createDataFrame([sale(0, float(x)) for x in ref], SALES)
    for most, quantiles in ((100_000, 10_000), (10, 5)):
        monkeypatch.setattr(lp, "MAX_BOUNDS", most)
        monkeypatch.setattr(lp, "QUANTILES", quantiles)
        measured = lp.measure(reference)
        parts = [lp.cells_of(own.where(cond), measured) for cond in (F.col("revenue") % 2 < 1, F.col("revenue") % 2 >= 1)]
        for cells in (lp.cells_of(own, measured), lp.merge_cells(parts[0].unionByName(parts[1]))):
            p = lp.profile_of_cells(cells, measured).where("column_name = 'revenue'").checkpoint()
            assert {r["load_id"]: r["distance"] for r in p.collect()} == pytest.approx(want)
            assert {(r["load_id"], r["finding"]) for r in lp.departures(p).collect()} == {(i, "shifted") for i in loads if want[i] > 0.2}
    assert want[1] > 0.2 > want[2]


def test_profile_of_awkward_tables(spark):
    wide = SALES + ", n long, column_name string, kind string, cell int"
    rows = [sale(None, None, None, None, (1, "x", "y", 2)), sale(1, 1e12, "A" * 100_000, "x" * 100_000, (1, "x", "y", 2))] * 2
    got = found(spark, rows, [sale(0, extra=(1, "x", "y", 2))] * 5, wide)
    assert (None, "revenue", "missing") in got and (1, "category", "invalid") in got
    assert found(spark, [], [sale(0)]) == set() and found(spark, [sale(1)], []) == {(1, "category", "invalid")}


def test_power_sums_are_exact_and_add_up(spark):
    values = [0.1, 999999999.99, -123456.78, 0.01] * 5
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "part int, v double")
    whole = df.agg(*lp.power_sums(F.col("v"))).first()
    parts = df.groupBy("part").agg(*lp.power_sums(F.col("v"))).agg(*lp.merge_power_sums()).first()
    assert whole == parts
    cents = [round(v * 100) for v in values]
    limb = 10**9
    assert int(whole["ps_s2"]) == sum(c * c for c in cents)
    assert int(whole["ps_xh"]) * limb + int(whole["ps_xl"]) == sum(c**3 for c in cents)
    assert int(whole["ps_hh"]) * limb**2 + 2 * int(whole["ps_hl"]) * limb + int(whole["ps_ll"]) == sum(c**4 for c in cents)


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "a@b.co", 1.5), (1, "bad", float("nan")), (1, " ", None), (1, None, 2.5), (1, "bad", 2.5), (None, None, None)], "g long, t string, x double")
    got = {(r["group_id"], r["column_name"]): r for r in lp.column_profile(df, "g", ["t", "x"], {"t": ".+@.+"}).collect()}
    t, x = got[1, "t"], got[1, "x"]
    assert (t["rows"], t["nulls"], t["blanks"], t["violations"], t["distinct_values"]) == (5, 1, 1, 3, 3)
    assert (x["nans"], x["least_number"], x["greatest_number"], x["mean_number"]) == (1, 1.5, 2.5, pytest.approx(2.1667))
    assert got[None, "t"]["rows"] == 1


# -- delimited records ---------------------------------------------------------------------------------------------------

GOOD = "o,2024-01-01,p,c,1.5,2,e"


def parse_record(raw, delimiter, columns=7):
    """A record by itself, without anchors."""
    text = (raw or "").removesuffix("\r") if raw else ""
    try:
        fields, _ = dl.Grammar(text, delimiter).record(0)
    except dl.Broken as e:
        return dl.Parsed(0, None, "quoting", e.at)
    return dl.Parsed(0, fields, *(("columns", len(fields)) if len(fields) != columns else ()))


REASONS = [
        (GOOD, None), (GOOD + "\r", None), (GOOD + "\r\r", None), ('"o","d","a ""b"" \n,","c","-1","007","e"\r', None), ("o,d,p,c,,NA,e", None), ("o,d,p,c, NaN ,null,e", None),
        ('o,d,"p,c,1,2,e', "quoting"), ('o,d,"p"x,c,1,2,e', "quoting"), ('o,d,p 12" w,c,1,2,e', "quoting"), ('o,d,"p" ,c,1,2,e', "quoting"), ('"', "quoting"), ('o,d,"p\r', "quoting"),
        ("o,d,p,c,1,2", "columns"), (GOOD + ",", "columns"), ("", "columns"), (None, "columns"), ("o;d;p;c;1;2;e", "columns"),
        ("o,d,p,c,1e5,2,e", "revenue"), ("o,d,p,c,1.,2,e", "revenue"), ("o,d,p,c,+1,2,e", "revenue"), ('o,d,p,c,"1,204.10",0,e', "revenue"), ("o,d,p,c,٣,2,e", "revenue"), ("o,d,p,c,\t1,2,e", "revenue"),
        ("o,d,p,c,1,0,e", "quantity"), ("o,d,p,c,1,100001,e", "quantity"), ("o,d,p,c,1,100000,e", None), ("o,d,p,c,1,-3,e", "quantity"), ("o,d,p,c,1,2.0,e", "quantity"), ("o,d,p,c,1," + "9" * 5000 + ",e", "quantity"),
    ]


@pytest.mark.parametrize(("raw", "reason"), REASONS)
def test_reasons(raw, reason):
    p = parse_record(raw, ",")
    if p.reason is None:
        p.reason = "revenue" if not dl.revenue_of(p.fields[4])[1] else "quantity" if not dl.quantity_of(p.fields[5])[1] else None
    assert p.reason == reason


def test_reasons_in_spark(spark):
    """The same cases through both ways, built-in functions and grammar."""
    df = spark.createDataFrame([(i, "f", i + 2, raw) for i, (raw, _) in enumerate(REASONS)], "line_id long, file_name string, line_no long, raw string")
    got = {r["line_id"]: r for r in dl.parse_lines(df).collect()}
    assert {i: r["reason"] for i, r in got.items()} == dict(enumerate(reason for _, reason in REASONS))
    for i, (raw, reason) in enumerate(REASONS):
        p = parse_record(raw, ",")
        want = (dl.revenue_of(p.fields[4])[0], dl.quantity_of(p.fields[5])[0]) if reason is None else (None, None)
        assert (got[i]["revenue"], got[i]["quantity"]) == want
        if reason in ("quoting", "columns"):
            assert got[i]["error_at"] == p.at


FIELD = re.compile(r'"(?:[^"]|"")*"|[^",]*', re.S)


@settings(max_examples=300, deadline=None)
@given(hs.text(alphabet='a",\n\r 1', max_size=24))
def test_grammar_against_a_regular_expression(raw):
    text = raw[:-1] if raw.endswith("\r") else raw
    good = re.fullmatch(rf"(?:{FIELD.pattern})(?:,(?:{FIELD.pattern}))*", text, re.S) is not None
    p = parse_record(raw, ",")
    assert (p.reason == "quoting") == (not good)
    if good:
        fields = [m[1] for m in re.finditer(rf",({FIELD.pattern})", "," + text, re.S)]
        assert p.fields == [f[1:-1].replace('""', '"') if f.startswith('"') else f for f in fields]


def test_stream_recovers_at_validated_anchors():
    text = f'{GOOD}\r\nR2,d,"p,c,1,2,e\nnot a start\n{GOOD.replace("o,", "R3,")}\nR4,d,"x\ny",c,1,2,e\nR5,d\n'
    got = [(p.fields[0] if p.fields else None, p.reason) for p in dl.parse_stream(text, ",", 7, r"o|R\d")]
    assert got == [("o", None), (None, "quoting"), ("R3", None), ("R4", None), ("R5", "columns")]


@settings(max_examples=300, deadline=None)
@given(hs.lists(hs.text(alphabet='a",\n\r 1', max_size=12), max_size=6))
def test_records_of_one_text_equal_single_ones(raws):
    got = [(p.fields, p.reason, p.at) for p in dl.parse_records(raws, ",", 2)]
    assert got == [(p.fields, p.reason, p.at) for p in (parse_record(r, ",", 2) for r in raws)]


def test_many_broken_quotes_take_linear_time():
    text = "\n".join(f'R{i},"open' if i % 2 else f"R{i},x" for i in range(40_000))
    began = time.time()
    got = dl.parse_stream(text, ",", 2, r"R\d+")
    assert time.time() - began < 20 and sum(p.reason is None for p in got) == 20_000 and sum(p.reason == "quoting" for p in got) == 20_000


@pytest.mark.parametrize("chunk", [30, 77, 1000])
def test_files_in_chunks_equal_one_text(spark, chunk):
    rng = random.Random(chunk)
    raws = ["order_id,date,product,category,revenue,quantity,customer_email"]
    for i in range(200):
        raws.append(rng.choice([f"R{i},d,p,c,1.5,2,e", f'R{i},d,"p\n, {i}",c,1,2,e\r', f'R{i},d,"open,c,1,2,e', f'R{i},d,p 12" w,c,1,2,e', f"R{i},d", f'R{i},"d"x,p,c,1,2,e', "stray text", f"R{i},d,p,c,x,2,e"]))
    rows = [(i, f, i + 1, r) for f in ("a", "b") for i, r in enumerate(raws)]
    df = spark.createDataFrame(rows, "line_id long, file_name string, line_no long, raw string").repartition(3)
    got = sorted((r["line_no"], r["reason"] or "", r["order_id"] or "", r["lines"]) for r in dl.parse_files(df, r"R\d+", chunk).where("file_name = 'a'").collect())
    body = raws[1:]
    starts = [0, *accumulate(len(r) + 1 for r in body)]
    want = []
    parsed = dl.parse_stream("\n".join(body), ",", 7, r"R\d+")
    for p, after in zip(parsed, [*(q.start for q in parsed[1:]), starts[-1]]):
        k = bisect_right(starts, p.start) - 1
        reason, _, order, *_ = dl._typed(p)
        want.append((k + 2, reason or "", order or "", bisect_left(starts, after) - k))
    assert got == sorted(want)
    assert dl.parse_files(df.where("1 = 0"), r"R\d+", chunk).count() == 0


LINES = "line_id long, file_name string, line_no long, raw string, reason string, delimiter string"


def test_parse_lines(spark):
    header = "order_id,date,product,category,revenue,quantity,customer_email"
    rows = [
        (1, "f", 1, header), (2, "f", 2, GOOD), (3, "f", 2, GOOD), (4, "g", 1, header.replace(",", ";")), (5, "g", 2, GOOD.replace(",", ";")), (6, "g", 3, GOOD),
        (7, None, None, GOOD), (8, "h", 2, 'o,d,"' + "x" * 200_000 + '",c,1,2,e'), (9, "f", 9, None), (10, "f", 1, header),
    ]
    got = {r["line_id"]: r for r in dl.parse_lines(spark.createDataFrame([(*r, "clash", "clash") for r in rows], LINES)).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {2: None, 3: None, 5: None, 6: "columns", 7: None, 8: None, 9: "columns"}
    assert got[5]["revenue"] == 1.5 and got[5]["quantity"] == 2 and len(got[8]["product"]) == 200_000
    assert dl.parse_lines(spark.createDataFrame([], LINES)).count() == 0


# -- imputation ------------------------------------------------------------------------------------------------------------

PEOPLE = (
    "record_id long, snapshot_day date, employee_id string, hire_date string, department string, level string, salary double, tenure_years double, "
    "performance_score double, projects_completed long, hours_worked long, bonus_amount double, received_at timestamp"
)


def people(n=400, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        e, dep = i % 80, "XYZ"[i % 80 % 3]
        salary = float(round({"X": 40_000, "Y": 80_000, "Z": 160_000}[dep] * math.exp(rng.normal(0, 0.1)), 2))
        out.append([i, date(2024, 1 + i // 80 % 12, 1), f"E{e}", "2020-01-01", dep, "LMH"[e % 3], salary, 2.0, 50.0 + e / 4, 3, 160, 0.0 if i % 5 == 0 else 1000.0, None])
    return out


def test_masks_and_statements(spark):
    rows = people()
    plant = [(0, 6, None), (1, 6, float("nan")), (2, 6, 999999.0), (3, 6, -1.0), (4, 6, 0.0), (5, 4, " tbd "), (6, 4, None), (7, 8, 999.0), (8, 8, -99.0), (9, 11, -1.0), (10, 11, None), (11, 11, 99999999.0)]
    for i, k, v in plant:
        rows[i][k] = v
    rows.append([900, None, None, None, "?", None, None, None, None, None, None, None, None])
    rows.append([901, date(2024, 1, 1), "ONLY", None, "", "L", 50_000.0, 1.0, 60.0, 1, 1, 0.0, None])
    df = spark.createDataFrame([tuple(r) for r in rows], PEOPLE).withColumn("row", F.lit("clash")).withColumn("x_0", F.lit(1.0)).withColumn("holder", F.lit("h"))
    filled = impute.fill(df, components=3, steps=4)
    assert filled.count() == len(rows) and {"row", "x_0", "holder"} <= set(filled.columns)
    got = {(r["record_id"], r["field_name"]): r["fill_text"] for r in impute.fills_long(filled, impute.EMPLOYEES, "record_id").collect()}
    want = {(i, {6: "salary", 4: "department", 8: "performance_score", 11: "bonus_amount"}[k]): "" for i, k, _ in plant}
    want |= {(5, "department"): "XYZ"[5 % 3], (6, "department"): "XYZ"[6 % 3], (901, "department"): ""}
    want |= {(900, f): "" for f in impute.EMPLOYEES.fill}
    assert got == want
    out = {r["record_id"]: r for r in filled.collect()}
    assert all(out[i][c] is not None for i in out for c in impute.EMPLOYEES.fill)
    assert out[20]["salary"] == rows[20][6] and not out[20]["salary_filled"] and out[0]["bonus_amount"] == 0.0


def test_held_out_accuracy(spark):
    rows, truth = people(800, 5), {}
    for i in range(0, 800, 9):
        truth[i] = (rows[i][6], rows[i][4])
        rows[i][6] = None
    out = {r["record_id"]: r for r in impute.fill(spark.createDataFrame([tuple(r) for r in rows], PEOPLE), components=4, steps=6).collect()}
    error = np.median([abs(out[i]["salary"] / s - 1) for i, (s, _) in truth.items()])
    plain = np.median([abs(80_000 / s - 1) for s, _ in truth.values()])
    assert error < 0.12 < plain


def test_sufficient_statistics_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    x[rng.random((40, 3)) < 0.3] = np.nan
    c = rng.integers(-1, 2, (40, 1)).astype(np.int32)
    m = impute.Mixture(np.array([0.4, 0.6]), rng.normal(size=(2, 3)), np.repeat(np.eye(3)[None], 2, 0), [np.array([[0.3, 0.7], [0.6, 0.4]])])
    whole = m.statistics(x, c)
    assert np.allclose(whole, m.statistics(x[:13], c[:13]) + m.statistics(x[13:], c[13:]))
    last = -np.inf
    for _ in range(5):
        assert whole[-2] >= last - 1e-6 * abs(whole[-2]) - 0.5  # EM never lowers the likelihood, the ridge apart
        last, m = whole[-2], m.updated(whole)
        whole = m.statistics(x, c)


def test_empty_table(spark):
    assert impute.fill(spark.createDataFrame([], PEOPLE)).count() == 0


def test_large_amounts_are_real_unless_shared(spark):
    values = [1_234_567.5, 2_000_000.0, 950_000.0, 9_999_999.0, 99_999.0, -1.0, 0.0, float("inf"), float("nan"), None, 1e300]
    rows = [(f"e{i}", v) for i, v in enumerate(values)] + [(f"f{i}", 7_777_777.0) for i in range(5)] + [("one", 3_000_000.0)] * 9
    df = spark.createDataFrame(rows, "employee_id string, salary double")
    n = impute.EMPLOYEES.numbers[0]
    shared = impute.shared_values(df, (n,), "employee_id")["salary"]
    got = {r["s"] for r in df.select(impute.real_number(n, shared).alias("s")).collect()}
    assert shared == [7_777_777.0] and got == {1_234_567.5, 2_000_000.0, 950_000.0, 3_000_000.0, 1e300, None}
