"""Queries p2, p3, p6, p7 and p8, over whole tables and whole texts with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import bpe, copies, leak, quantiles, subjects
from veritab.operators.impute import EMPLOYEES, real_number, real_text, shared_values, stated_by_holder
from veritab.shared import table

SALES_KEY = {"texts": ["order_id", "date"], "exchangeable": ["product", "category"], "exact": ["revenue", "quantity", "unit_price"]}


def _salaries(rows: DataFrame) -> DataFrame:
    """(department, snapshot_day, salary) of all records: a department that is absent comes from the employee's other records, else it is null."""
    salary = EMPLOYEES.numbers[0]
    shared = shared_values(rows, (salary,), EMPLOYEES.holder)[salary.column]
    own = rows.select(
        F.col(EMPLOYEES.holder).cast("string").alias("holder"), real_text("department").alias("department"), "snapshot_day", real_number(salary, shared).alias("salary")
    )
    kept = ["department", "snapshot_day", "salary"]
    # only the records with a gap are joined
    gaps = own.where(F.col("department").isNull()).drop("department").join(stated_by_holder(own, "holder", "department"), "holder", "left")
    return own.where(F.col("department").isNotNull()).select(kept).unionByName(gaps.withColumnRenamed("stated", "department").select(kept))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of real salaries per department (null: none is known), per snapshot_day (part) and over all days (part null)."""
    out = quantiles.percentiles_by_group(_salaries(table(spark, sf_dir, "employee_analytics")), "department", "snapshot_day", "salary")
    return out.select(F.col("grp").alias("department"), F.to_date("part").alias("snapshot_day"), "n", "percentile", "value", "rank_error")


def p2_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer of p2_percentiles held against the exact ranks of its value: whether they are within the stated error, and that within EPS."""
    rows = _salaries(table(spark, sf_dir, "employee_analytics")).where(F.col("salary").isNotNull())
    found = quantiles.percentiles_by_group(rows, "department", "snapshot_day", "salary")
    days = found.where(F.col("part").isNotNull()).groupBy("grp", "part").agg(F.map_from_entries(F.collect_list(F.struct("percentile", "value"))).alias("v"))
    whole = found.where(F.col("part").isNull()).groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("percentile", "value"))).alias("w"))
    at = [F.lit(p) for p in quantiles.PERCENTILES]
    own = rows.select(F.col("department").alias("g"), F.col("snapshot_day").cast("string").alias("d"), "salary")
    joined = own.join(days, F.col("g").eqNullSafe(F.col("grp")) & F.col("d").eqNullSafe(F.col("part"))).drop("grp", "part").join(whole, F.col("g").eqNullSafe(F.col("grp")))
    exact = [
        joined.groupBy("g", *keys).agg(*[f(op(F.col("salary"), F.element_at(m, p))).alias(f"{k}{i}") for i, p in enumerate(at) for k, f, op in (("b", F.count_if, lambda a, b: a < b), ("t", F.count_if, lambda a, b: a <= b))])
        for keys, m in ((["d"], "v"), ([], "w"))
    ]
    counts = exact[0].unionByName(exact[1].withColumn("d", F.lit(None).cast("string")))
    long = counts.select("g", "d", F.explode(F.array(*[F.struct(p.alias("percentile"), F.col(f"b{i}").alias("below"), F.col(f"t{i}").alias("upto")) for i, p in enumerate(at)])).alias("c")).select("g", "d", "c.*").withColumnRenamed("percentile", "q")
    both = found.join(long, F.col("grp").eqNullSafe(F.col("g")) & F.col("part").eqNullSafe(F.col("d")) & (F.col("percentile") == F.col("q")))
    rank = F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("n")))
    off = F.greatest(F.col("below") + 1 - rank, rank - F.col("upto"), F.lit(0))
    within = (off <= F.round(F.col("rank_error") * F.col("n"))) & (F.col("rank_error") <= quantiles.EPS + 1 / F.col("n"))
    return both.select(F.col("grp").alias("department"), F.to_date("part").alias("snapshot_day"), "percentile", "n", within.alias("within"))


def _ledger(spark: SparkSession, sf_dir: str):
    rows = table(spark, sf_dir, "sales_duplicates")
    key = copies.canonical_key(**SALES_KEY)
    return rows, key, copies.ledger_of(rows, key, "row_id", "received_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key, ledger = _ledger(spark, sf_dir)
    return copies.members(rows, ledger, key, "row_id")


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each set of copies, with the number of its copies."""
    rows, _, ledger = _ledger(spark, sf_dir)
    counted = ledger.read().select(F.col("keep_id").alias("row_id"), "copies")
    return rows.join(counted, "row_id").select("row_id", "copies", "order_id", "date", "product", "category", "revenue", "quantity", "unit_price")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and those whose decoded ids are their text again (null as the empty text)."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), keep=("doc_id", "text"))
    same = bpe.decode(F.col("ids")) == F.coalesce("text", F.lit(""))
    return encoded.agg(F.count("*").alias("documents"), F.count_if(same).alias("equal"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return subjects.score(documents, subjects.fit(documents, table(spark, sf_dir, "subject_labels")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject; a document with k subjects counts 1/k in weight."""
    own = _subjects(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("subject").alias("s"))
    out = own.select(F.explode("s").alias("subject"), (1 / F.size("s")).alias("w"))
    return out.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum("w"), 6).alias("weight"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_within, p3_found, p3_records, p6_ids, p6_roundtrip, p7_found, p8_found, p8_composition)}

_KEYS = r"""
WITH k AS (SELECT *, regexp_replace(lower(upper(order_id)), '[^\p{L}\p{Nd}]', '', 'g') AS o, regexp_replace(lower(upper(date)), '[^\p{L}\p{Nd}]', '', 'g') AS d,
    list_sort([coalesce('=' || regexp_replace(lower(upper(product)), '[^\p{L}\p{Nd}]', '', 'g'), '0'), coalesce('=' || regexp_replace(lower(upper(category)), '[^\p{L}\p{Nd}]', '', 'g'), '0')]) AS pc
  FROM sales_duplicates),
g AS (SELECT *, min(row_id) OVER w AS keep_id, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY o, d, pc, revenue, quantity, unit_price))
"""

# stand-ins are told here by a rule of their own: not positive, written in nines only, or an odd amount of many employees above every payroll
_P2 = r"""
WITH big AS (SELECT salary FROM employee_analytics WHERE salary > 900000 GROUP BY salary HAVING count(DISTINCT employee_id) >= 5),
v AS (SELECT employee_id, snapshot_day, CASE WHEN NOT isnan(salary) AND salary >= 1 AND isfinite(salary) AND salary NOT IN (SELECT salary FROM big)
      AND NOT (salary > 90000 AND regexp_full_match(printf('%.2f', salary), '9{3,}\.(00|99)')) THEN salary END AS salary,
    CASE WHEN regexp_full_match(lower(trim(department, ' ' || chr(9) || chr(10) || chr(13) || chr(160))),
      '[-.?]{0,3}|#?n/?a|n\.a\.|nan|nil|none|null|not (available|given|known|set)|tb[acd]|undefined|unk(nown)?|unspecified|unassigned|missing|xxx?') THEN NULL ELSE department END AS department FROM employee_analytics),
c AS (SELECT employee_id, department, count(*) AS n FROM v WHERE department IS NOT NULL GROUP BY ALL),
st AS (SELECT employee_id, department AS stated FROM c QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY n DESC, department DESC) = 1),
r AS (SELECT coalesce(department, stated) AS department, snapshot_day, salary FROM v LEFT JOIN st USING (employee_id) WHERE salary IS NOT NULL),
g AS (SELECT department, snapshot_day, count(*) AS n FROM r GROUP BY department, snapshot_day UNION ALL SELECT department, NULL, count(*) FROM r GROUP BY department)
SELECT department, snapshot_day, percentile, n, true AS within FROM g, (SELECT unnest([0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS percentile)
"""

SQL = {
    "p2_within": _P2,
    "p3_found": _KEYS + "SELECT keep_id, row_id AS copy_id FROM g WHERE row_id <> keep_id",
    "p6_roundtrip": "SELECT count(*) AS documents, count(*) AS equal FROM documents",
    "p3_records": _KEYS + "SELECT row_id, copies, order_id, date, product, category, revenue, quantity, unit_price FROM g WHERE row_id = keep_id",
}
