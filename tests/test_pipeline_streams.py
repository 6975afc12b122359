"""A whole run on a dirty file, limits, and streams against batches."""

import json
from pathlib import Path

import pytest

from veritab import pipeline
from veritab.operators import understanding
from veritab.streaming import kpi as stream


def test_run(spark, tmp_path):
    lines = ["order_id,order_date,product,category,revenue,quantity"]
    for i in range(60):
        lines.append(f"GS-{i},202{3 + i // 30}-{i % 3 + 1:02d}-05,{'<b>lamp' if i % 2 else 'desk'},{'A' if i % 3 else 'B'},{'' if i == 7 else 10 * (i % 9) + i},{i % 4 + 1}")
    lines += ["GS-99,2024-01-05,desk,A,-50,1", "GS-98,2024-01-05,x'; DROP TABLE t,A,5,1", lines[1]]
    p = tmp_path / "sales.csv"
    p.write_text("\n".join(lines) + "\n")
    out = pipeline.run(spark, str(p), str(tmp_path / "runs"))
    assert out.verdict in ("APPROVED", "APPROVED_WITH_WARNINGS") and not out.reasons and out.score > 50
    page = Path(out.folder, "report.html").read_text()
    assert "<b>lamp" not in page and "DROP TABLE" not in page
    total = next(k["value"] for k in out.kpis if k["name"] == "sum of revenue")
    rows = spark.read.parquet(f"{out.folder}/cleaned/attempt=1")
    assert total == pytest.approx(rows.agg({"revenue": "sum"}).first()[0]) and rows.where("revenue < 0").count() == 0
    kinds = [json.loads(x)["kind"] for x in Path(out.folder, "events.jsonl").read_text().splitlines()]
    assert kinds[-1] == "verdict" and kinds.count("stage") >= 6
    assert pipeline.run(spark, rows, str(tmp_path / "runs"), pipeline.Config(max_seconds=-1)).verdict == "NEEDS_REVISION"
    with pytest.raises(ValueError, match="file_not_found"):
        pipeline.run(spark, str(tmp_path / "none.csv"), str(tmp_path / "runs"))


def test_run_uses_mechanisms_outliers_and_points(spark, tmp_path):
    rows = [(f"GS-{i}", f"2024-{i % 2 + 1:02d}-05", "AB"[i // 30], None if i >= 30 and i % 2 else 10.0 + i % 7, 5000.0 if i == 4 else float(i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "order_id string, order_date string, region string, revenue double, cost double")
    plan = {"kpis": [{"operation": {"function": "growth", "column": "cost", "over_column": "order_date", "period": "MoM"}}], "tests": ["trend"]}
    out = pipeline.run(spark, df, str(tmp_path / "runs"), pipeline.Config(plan=plan))
    events = [json.loads(x) for x in Path(out.folder, "events.jsonl").read_text().splitlines()]
    steps = next(e["steps"] for e in events if e["kind"] == "clean")
    assert ["flag_and_preserve", "revenue"] in steps and ["outlier_flag", "cost"] in steps
    cleaned = spark.read.parquet(f"{out.folder}/cleaned/attempt=1")
    assert cleaned.where("revenue IS NULL AND revenue_missing_flag").count() == 15 and cleaned.where("cost_outlier_flag").count() == 1
    assert out.kpis[0]["value"] is not None and not [c for c in out.claims if c.kind == "TREND"]
    assert "growth_MoM" in Path(out.folder, "report.html").read_text()


def test_helpers():
    assert pipeline.first_json('text {bad {"a": {"b": 1}} more') == {"a": {"b": 1}} and pipeline.first_json("none") is None
    assert understanding.domain_of("employee_id salary x") == ("hr", 0.7) and pipeline.fmt(1234.5) == "1,234.50" and pipeline.fmt(None) == "n/a"


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(60)] + [(90, "2024-01-05 00:00:00", "a", 0.0)]
    batch = spark.createDataFrame(rows, "id long, t string, k string, v double").selectExpr("id", "timestamp(t) AS ts", "k", "v")
    batch.write.parquet(str(tmp_path / "in"))
    flow = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = stream.windowed(stream.once(flow, "ts", ["id"]), "ts", "v", ["k"], "30 minutes", None).writeStream.format("memory").queryName("w").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r["start"]), r["k"], r["n"], r["total"]) for r in spark.table("w").collect()}
    want = {(str(r["start"]), r["k"], r["n"], r["total"]) for r in stream.windowed(batch, "ts", "v", ["k"], "30 minutes").collect() if r["start"].day == 1}
    assert got == want and len(want) == 4
    assert stream.sessions(batch, "ts", "k").count() == 3
