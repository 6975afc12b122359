"""Quality checks and cleaning on planted defects."""

import pytest
from pyspark.sql import functions as F

from veritab.operators import render, charts, cleaning, profiling, quality, verify
from veritab.sources import files


def test_sentinels(spark):
    values = [None, "", "  ", "n/a", "NA", "null", "-", "None", "unknown", "ok", "fine"]
    df = spark.createDataFrame([(v, 0.0) for v in values], "v string, z double")
    r = {x["column_name"]: x for x in quality.sentinel_census(df, ["v", "z"]).collect()}
    assert (r["v"]["nan"], r["v"]["blank"], r["v"]["na"], r["v"]["unknown"]) == (1, 2, 5, 1) and r["z"]["zero"] == 11


def test_missing_mechanisms(spark):
    rows = [(i, "ab"[i % 2], None if i % 2 else 1.0, None if i < 10 else 1.0, None if i % 7 == 0 else 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "i long, s string, mar double, mnar double, mcar double")
    got = {r["column_name"]: r["mechanism"] for r in quality.missing_mechanism(df, ["mar", "mnar", "mcar"], ["s"], "i").collect()}
    assert got == {"mar": "MAR", "mnar": "MNAR", "mcar": "MCAR"}


def test_segment_missing_keeps_the_null_segment(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None), (None, 2.0)], "s string, v double")
    got = {(r["segment"], r["value"]): r["missing_rate"] for r in quality.missing_by_segment(df, ["v"], ["s"]).collect()}
    assert got == {("s", "a"): 0.0, ("s", None): 0.5}


def test_mad(spark):
    df = spark.createDataFrame([("r", 100.0 + i) for i in range(19)] + [("r", 5000.0)], "g string, v double")
    assert [r["x"] for r in quality.mad_outliers(df, "v").collect()] == [5000.0]
    assert [r["segment"] for r in quality.mad_outliers(df, "v", "g").collect()] == ["r"]


def test_contracts_validity_orphans(spark):
    df = spark.createDataFrame([("o1", 5.0, "x"), ("o1", -1.0, "y'; DROP TABLE"), (None, 500.0, "5 kg")], "k string, v double, t string")
    got = {r["violation"]: r["rows"] for r in quality.contract_violations(df, [quality.Contract("v", 0, 100), quality.Contract("k", unique=True, required=True), quality.Contract("t", forbidden=("x",))]).collect()}
    assert got == {"v:below_range": 1, "v:above_range": 1, "k:unexpected_null": 1, "t:forbidden_value": 1, "k:repeated": 1}
    found = {r["finding"]: r["rows"] for r in quality.validity(df, ["v"], [], ["t"], "2024-01-01").collect()}
    assert found == {"v:negative": 1, "t:sql_suspected": 1, "t:mixed_units": 1}
    other = spark.createDataFrame([("o2",)], "k string")
    assert quality.orphans(df, "k", other, "k").first()["orphans"] == 1
    assert quality.declared_ranges("Quantity between 1 and 50, age from 18 to 65; revenue >= 0") == {"quantity": (1, 50), "age": (18, 65), "revenue": (0, None)}


@pytest.mark.parametrize(("text", "want"), [("$1,200", 1200), ("EGP 500", 500), ("1.2k", 1200), ("12%", 12), ("€9.99", 9.99), ("1 200", 1200), ("abc", None), ("", None), ("-5", None)])
def test_amounts(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(cleaning.parse_amount(F.col("t")).alias("v")).first()["v"]
    assert got == (None if want is None else pytest.approx(want))


def test_units_text_and_case(spark):
    df = spark.createDataFrame([("500 g",), ("1",), ("2 KG",), ("250g",), ("3 miles",)], "w string")
    assert [r["v"] for r in df.select(cleaning.convert_unit(F.col("w"), "kg").alias("v")).collect()] == [0.5, 1.0, 2.0, 0.25, None]
    t = spark.createDataFrame([("  A \t b ",), ("a b",), (None,)], "t string").withColumn("t", cleaning.normalize_text(F.col("t")))
    assert [r["t"] for r in cleaning.unify_case(t, "t").collect()] == ["a b", "a b", None]
    assert spark.createDataFrame([("é",)], "t string").select(cleaning.nfc("t").alias("t")).first()["t"] == "é"


def test_fills_and_execution(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 5.0, None), (4, -2.0, "a"), (5, 3.0, "b")], "i long, v double, c string")
    steps = [cleaning.Step("drop_negative", "v"), cleaning.Step("median_fill_flag", "v"), cleaning.Step("mode_fill", "c")]
    got = cleaning.execute(df, cleaning.Strategy(steps)).orderBy("i").collect()
    assert [(r["i"], r["v"], r["c"], r["v_missing_flag"]) for r in got] == [(1, 1.0, "b", False), (2, 3.0, "a", True), (3, 5.0, "b", False), (5, 3.0, "b", False)]
    assert cleaning.action_for("measure", 0.8, "MCAR") == "drop_column" and cleaning.action_for("dimension", 0.2, "MCAR") == "unknown_fill"
    assert cleaning.normalize_strategy([{"column": "zz", "action": "mode_fill"}, {"column": "v", "action": "evil"}, {"column": "v", "action": "drop_row"}], ["v"]).rejected.__len__() == 2


def test_repair_and_dedup(spark):
    df = spark.createDataFrame([(1, "$1,000", "2024-01-01"), (2, "$1,000", "2024-01-01"), (3, "7", "2150-01-01"), (4, "9", "soon")], "i long, v string, d string")
    got = cleaning.repair(df, ["v"], ["d"], order="i").collect()
    assert [(r["i"], r["v"]) for r in got] == [(1, 1000.0)]


def test_profile_roles_pii(spark):
    rows = [(i, f"ORD-{i}", float(i % 7), ["red", "blue"][i % 2], f"2024-01-{i % 28 + 1:02d}", "a@b.com" if i == 3 else "+20 100 555 0199") for i in range(60)]
    df = spark.createDataFrame(rows, "phone_number long, order_id string, revenue double, colour string, order_date string, contact string")
    got = {c: r.role for c, r in profiling.roles(df).items()}
    assert got == {"phone_number": "identifier", "order_id": "identifier", "revenue": "measure", "colour": "dimension", "order_date": "temporal", "contact": "dimension"}
    pii = {r["column_name"]: r for r in profiling.pii_scan(df, ["contact", "colour"]).collect()}
    assert pii["contact"]["emails"] == 1 and pii["contact"]["phones"] == 59 and pii["colour"]["emails"] == 0
    p = {r["column_name"]: r["distinct_values"] for r in profiling.profile(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")).collect()}
    assert p == {"x": 2}
    assert profiling.duplicates(spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "a long, b string")).first()["duplicate_rows"] == 2
    assert profiling.fingerprint(df).first() == profiling.fingerprint(df.orderBy(F.desc("order_id"))).first()


def test_even_sample(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    got = sorted(r["i"] for r in profiling.even_sample(df, "i", 11).collect())
    assert got == [round(k * 999 / 10) for k in range(11)] and profiling.even_sample(df.limit(5), "i", 11).count() == 5


def test_charts(spark):
    g = spark.createDataFrame([("a", 60.0), ("b", 30.0), ("c", 10.0), ("d", -5.0)], "k string, v double")
    got = [(r["k"], r["running"], r["cumulative_percent"]) for r in charts.pareto(g, "k", "v").orderBy("position").collect()]
    assert got == [("a", 60.0, 60.0), ("b", 90.0, 90.0), ("c", 100.0, 100.0), ("d", 100.0, 100.0)]
    assert {r["k"]: r["v"] for r in charts.top_rest(g, "k", "v", 2).collect()} == {"a": 60.0, "b": 30.0, "$rest": 5.0}
    ranked, cut = charts.rank([charts.Chart("bar", ("a", "b"), "", 0.9), charts.Chart("bar", ("b", "a"), "", 0.8), charts.Chart("line", ("a",), "", 0.7)], most=1)
    assert len(ranked) == 1 and cut and "&lt;b&gt;" in render.render("bar", "<b>", [("x", 1.0), ("y", -2.0)])


def test_verdict_and_claims():
    e = verify.Evidence()
    kpi, cor = e.add("kpi", 1.0), e.add("correlation", 0.8)
    with pytest.raises(ValueError):
        e.add("kpi", 1.0, kpi)
    claims = [verify.Claim("1", "CAUSAL", "", [kpi]), verify.Claim("2", "CORRELATIONAL", "", [kpi]), verify.Claim("3", "CORRELATIONAL", "", [cor, "EV-999"])]
    kept, notes = verify.validate_claims(claims, e)
    assert [c.claim_id for c in kept] == ["3"] and kept[0].evidence == [cor] and len(notes) == 2
    assert verify.verdict(1, 0) == "NEEDS_REVISION" and verify.verdict(0, 1) == "APPROVED_WITH_WARNINGS" and verify.verdict(0, 0, ("cost_limit_exceeded",)) == "NEEDS_REVISION"
    assert verify.score(1, 2, 2) == 79.0


def test_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿id;name;v\n1;x;1,5\n2;NA;2\n3;\"a;b\";3\n4;y;4\n5;z;5\n".encode())
    assert files.validate_file(str(p)) is None and files.dialect(str(p)) == (";", "UTF-8")
    df = files.read_csv(spark, str(p))
    assert df.columns == ["id", "name", "v"] and df.schema["id"].dataType.typeName() == "long" and df.where("name is null").count() == 1
    assert files.validate_file(str(tmp_path / "no.csv")) == "file_not_found"
    (tmp_path / "b.csv").write_bytes(b"a\0b\n" * 9)
    assert files.validate_file(str(tmp_path / "b.csv")) == "invalid_signature"
    cache = files.ResultCache(str(tmp_path / "c.db"))
    key = cache.key(files.file_sha256(str(p)), {"seed": 1})
    assert not cache.store(key, str(p), "r0", "NEEDS_REVISION", 0) and cache.store(key, str(p), "r1", "APPROVED_WITH_WARNINGS", 1)
    assert cache.get(key) == ("r1", "APPROVED_WITH_WARNINGS") and cache.previous(str(p)) == "r1"
    with pytest.raises(ValueError):
        files.union_sheets([df, df.drop("v")])
    assert sorted(r["_row_id"] for r in files.with_row_id(df).collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("encoding", ["latin-1", "utf-8", "utf-8-sig"])
def test_encoding_by_the_whole_file(spark, tmp_path, encoding):
    p = tmp_path / "late.csv"
    p.write_bytes(("name;n\n" + "plain;1\n" * 400_000 + "Zoé;2\nZoë;3\n").encode(encoding))
    assert files.dialect(str(p)) == (";", "ISO-8859-1" if encoding == "latin-1" else "UTF-8")
    got = files.read_csv(spark, str(p))
    assert got.columns == ["name", "n"] and {r["name"] for r in got.where("n > 1").collect()} == {"Zoé", "Zoë"}
