"""python tests/compare.py SF_DIR [NAME...]: every query beside its SQL in DuckDB, as sets of rows with counts."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v) + 0.0
    if type(v).__name__ in ("Timestamp", "datetime"):
        return str(v)[:19]
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v) if not isinstance(v, str) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir, name, query, sql):
    t = time.time()
    df = query(spark, sf_dir)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return f"{name}: {sum(got.values())} rows, no SQL, {took:.1f} s", True
    rel = con.execute(sql)
    want_cols, want = rows([d[0] for d in rel.description], rel.fetchall())
    ok = got_cols == want_cols and got == want
    note = "" if ok else f" DIFFERS {got_cols} {want_cols} {sum(want.values())} only here {list((got - want).items())[:3]} only SQL {list((want - got).items())[:3]}"
    return f"{name}: {sum(got.values())} rows, {took:.1f} s{note}", ok


def main():
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    sql, bad = e.oracle_sql(), []
    for name, q in e.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            text, ok = compare(spark, con, sf_dir, name, q, sql.get(name))
        except Exception as x:  # noqa: BLE001
            text, ok = f"{name}: ERROR {str(x)[:600]}", False
        print(text[:1500], flush=True)
        bad += [] if ok else [name]
    print("bad:", bad)


if __name__ == "__main__":
    main()
