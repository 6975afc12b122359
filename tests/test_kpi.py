"""The KPI language: validation, every function on literal rows, fused against unfused plans."""

import pytest
from pyspark.sql import functions as F

from veritab.plans import compile as kpi, recompute
from veritab.plans.ir import blocked, build_plan, parse, validate
from veritab.operators import verify


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        ("2023-01-10", "a", "x", 50), ("2023-02-10", "b", "x", 100), ("2023-03-10", "a", "y", 150),
        ("2024-01-10", "b", "y", 100), ("2024-02-10", "a", None, 200), ("2024-03-10", "b", "x", 300),
    ]
    return spark.createDataFrame(rows, "date string, product string, category string, revenue long")


def value(df, **op):
    rows = kpi.execute_plan(df, build_plan({"kpis": [{"operation": op}]})).collect()
    return {r["label"]: r["value"] for r in rows} if op.get("group_by") else rows[0]["value"]


@pytest.mark.parametrize(
    ("function", "want"), [("sum", 900.0), ("mean", 150.0), ("median", 125.0), ("count", 6), ("nunique", 5), ("min", 50), ("max", 300), ("std", 89.4427191)]
)
def test_aggregates(sales, function, want):
    assert value(sales, function=function, column="revenue") == pytest.approx(want)


def test_groups_keep_null_and_label_several_keys(sales):
    assert value(sales, function="sum", column="revenue", group_by=["category"]) == {"x": 450.0, "y": 250.0, "nan": 200.0}
    assert value(sales, function="count", column="revenue", group_by=["product", "category"])["a | nan"] == 1


def test_filters(sales):
    assert value(sales, function="sum", column="revenue", filter={"category": ["x", "y"], "product": "a"}) == 200.0
    assert value(sales, function="sum", column="revenue", filter={"category": "none"}) == 0.0
    assert value(sales, function="sum", column="revenue", group_by=["product"], filter={"category": "y"}) == {"a": 150.0, "b": 100.0}


def test_text_numbers_are_coerced(spark):
    df = spark.createDataFrame([("1",), ("x",), (" 2.5 ",), ("5d",), (None,)], "v string")
    assert value(df, function="sum", column="v") == 3.5
    assert value(df, function="min", column="v") == 2.5  # min keeps the raw order of text


def test_growth(sales):
    op = {"function": "growth", "column": "revenue", "over_column": "date"}
    assert value(sales, **op) == pytest.approx(0.5)
    assert value(sales, **op, period="YoY") == pytest.approx(1.0)
    assert value(sales, **op, basis="start_of_period", as_percent=True) == pytest.approx(500.0)
    assert value(sales, **op, group_by=["product"]) == {"a": pytest.approx(1 / 3), "b": pytest.approx(2.0)}


def test_iso_weeks(spark):
    df = spark.createDataFrame([("2021-01-03", 1.0), ("2021-01-04", 3.0)], "d string, v double")
    rows = kpi.growth_series(df, parse({"function": "growth", "column": "v", "over_column": "d", "period": "WoW"})).collect()
    assert [(r["period"], r["growth"]) for r in rows] == [("2021-W01", 2.0)]


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 8.0, 5.0), (3.0, 27.0, 5.0), (4.0, None, 5.0)], "a double, b double, c double")
    assert value(df, function="correlation", column_a="a", column_b="b", method="spearman") == pytest.approx(1.0)
    assert 0.9 < value(df, function="correlation", column_a="a", column_b="b") < 1.0
    assert value(df, function="correlation", column_a="a", column_b="c") is None


def test_ratio_and_division_by_zero(sales):
    one, n = {"function": "sum", "column": "revenue"}, {"function": "count", "column": "date"}
    assert value(sales, function="ratio", numerator=one, denominator=n) == 150.0
    assert value(sales, function="ratio", numerator=one, denominator={**one, "filter": {"category": "none"}}) is None


def test_validation_lists_every_error():
    assert validate({"function": "exec"}) and validate("x")
    errors = validate({"function": "growth", "column": "", "period": "daily", "formula": "1+1"})
    assert len(errors) == 4
    assert validate({"function": "ratio", "numerator": {"function": "growth", "column": "a", "over_column": "b"}, "denominator": {"function": "sum", "column": "a", "group_by": ["c"]}})


def test_identifiers_are_not_aggregated():
    assert blocked(parse({"function": "sum", "column": "order_id"})) and not blocked(parse({"function": "count", "column": "order_id"}))
    plan = build_plan({"kpis": [{"operation": {"function": "mean", "column": "customer_id"}}], "tests": ["anova", "magic"]})
    assert not plan.kpis and plan.tests == ["anova"] and len(plan.dropped) == 2


def test_failure_becomes_evidence(sales):
    rows = kpi.execute_plan(sales, build_plan({"kpis": [{"operation": {"function": "sum", "column": "nope"}}, {"operation": {"function": "sum", "column": "revenue"}}]})).collect()
    assert {r["kpi_id"]: r["value"] for r in rows} == {"KPI-001": None, "KPI-002": 900.0}


def test_fused_equals_unfused_and_poison_is_found(sales):
    ops = [{"function": "sum", "column": "revenue", "group_by": ["category"]}, {"function": "mean", "column": "revenue", "filter": {"product": "a"}}, {"function": "max", "column": "date"}]
    plan = build_plan({"kpis": [{"operation": o} for o in ops]})
    fused, plain = kpi.execute_plan(sales, plan), recompute.recompute(sales, plan)
    assert {r["status"] for r in verify.compare(fused, plain).collect()} == {"ok", "null"}
    poisoned = fused.withColumn("value", F.when(F.col("label") == "x", F.col("value") * 1.01).otherwise(F.col("value")))
    assert "mismatch" in {r["status"] for r in verify.compare(poisoned, plain).collect()}


def test_empty_table(sales):
    none = sales.where("1 = 0")
    assert value(none, function="sum", column="revenue") == 0.0 and value(none, function="mean", column="revenue") is None
    assert kpi.growth(none, parse({"function": "growth", "column": "revenue", "over_column": "date", "group_by": ["product"]})).count() == 0
