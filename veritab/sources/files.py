"""Files in and out: gates, dialects, typed reading, versions of outputs, hashes and the result cache."""

from __future__ import annotations

import codecs
import csv
import hashlib
import json
import os
import sqlite3
import tempfile
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.sources import xlsx

#: Texts read as null.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def validate_file(path: str, max_mb: float = 200, min_rows: int = 5) -> str | None:
    """The code of the first failing gate, cheapest first, or None."""
    p = Path(path)
    if not p.is_file():
        return "file_not_found"
    if p.suffix.lower() not in (".csv", ".xlsx"):
        return "unsupported_format"
    if p.stat().st_size > max_mb * 2**20:
        return "file_too_large"
    head = p.open("rb").read(4096)
    if p.suffix.lower() == ".xlsx":
        if not head.startswith(b"PK\x03\x04"):
            return "invalid_signature"
        try:
            records = max(xlsx.sheets(path).values(), default=0)
        except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
            return "parser_error"
    else:
        if b"\0" in head or head.startswith(b"PK\x03\x04"):
            return "invalid_signature"
        sep, encoding = dialect(path)
        try:
            # records, not lines: a quoted field may hold line breaks
            with p.open(newline="", encoding=encoding) as f:
                records = sum(1 for _, row in zip(range(min_rows + 1), (r for r in csv.reader(f, delimiter=sep, strict=True) if r)))
        except (csv.Error, UnicodeDecodeError):
            return "parser_error"
    return "min_rows" if records < min_rows + 1 else None


def is_utf8(path: str, block: int = 1 << 20) -> bool:
    """Whether the whole file is UTF-8, read in blocks."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    with open(path, "rb") as f:
        try:
            while raw := f.read(block):
                decoder.decode(raw)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            return False
    return True


def dialect(path: str) -> tuple[str, str]:
    """(separator, encoding): the separator by the first line, latin-1 where the file as a whole isn't UTF-8."""
    with open(path, "rb") as f:
        first = f.readline()  # both separators are one byte in either encoding
    return (";" if first.count(b";") > first.count(b",") else ","), "UTF-8" if is_utf8(path) else "ISO-8859-1"


def breaks_in_quotes(path: str, encoding: str, block: int = 1 << 22) -> bool:
    """Whether a line ends inside quotes anywhere: an odd number of quotes before a line break; read in blocks."""
    odd = False
    with open(path, "rb") as f:
        while raw := f.read(block):
            at = 0
            while (end := raw.find(b"\n", at)) >= 0:
                odd ^= raw.count(b'"', at, end) % 2 == 1
                if odd:
                    return True
                at = end + 1
            odd ^= raw.count(b'"', at) % 2 == 1
    return False


def infer_types(df: DataFrame) -> DataFrame:
    """String columns as long, double or boolean where every present value is one; one aggregate for all columns."""
    tests = {"bigint": r"^[+-]?\d{1,18}$", "double": r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$", "boolean": r"^(?i:true|false)$"}
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if not cols:
        return df
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)], *[F.count_if(F.trim(c).rlike(p)).alias(f"{t}{i}") for i, c in enumerate(cols) for t, p in tests.items()]).first()
    out = {}
    for i, c in enumerate(cols):
        kind = next((t for t in tests if row[f"n{i}"] and row[f"{t}{i}"] == row[f"n{i}"]), None)
        if kind:
            out[c] = F.trim(c).try_cast(kind)
    return df.withColumns(out)


def read_csv(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """A CSV with the detected dialect, NA tokens as null, and types by content."""
    sep, encoding = dialect(path)
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"')
    # a file without line breaks inside quotes is split among tasks
    df = reader.option("multiLine", breaks_in_quotes(path, encoding)).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    df = df.withColumns({c: F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)) for c in df.columns})
    return infer_types(df) if typed else df


def read(spark: SparkSession, path: str, cache: str | None = None, cache_mb: float = 200, sheet: str | None = None) -> DataFrame:
    """Parquet (a file, or a folder of part files) as it is, a workbook's chosen sheet, anything else as CSV.

    A CSV of at least ``cache_mb`` is written once as Parquet under ``cache`` and read from there as long as the file stays the same.
    """
    p = Path(path)
    if path.rstrip("/").endswith(".parquet") or p.is_dir() and any(p.glob("*.parquet")):
        return spark.read.parquet(path)
    if p.suffix.lower() == ".xlsx":
        at = tempfile.mkdtemp(prefix="veritab-sheet-") if cache is None else cache
        return read_csv(spark, xlsx.extract(path, xlsx.choose(xlsx.sheets(path), sheet), at))
    if cache is None or p.stat().st_size < cache_mb * 2**20:
        return read_csv(spark, path)
    own = f"{cache.rstrip('/')}/{p.stem}-{p.stat().st_size}-{p.stat().st_mtime_ns}"
    if not (Path(own) / "_SUCCESS").exists():
        read_csv(spark, path).write.mode("overwrite").parquet(own)
    return spark.read.parquet(own)


def read_sheets(spark: SparkSession, path: str, names: list[str], folder: str) -> DataFrame:
    """Several sheets of a workbook under each other, by column names; empty sheets are left out."""
    return union_sheets([df for df in (read_csv(spark, xlsx.extract(path, n, folder), typed=False) for n in names) if df.columns])


def estimate_rows(spark: SparkSession, path: str) -> int:
    """Lines of a text file, the header among them, counted by Spark."""
    return spark.read.text(path).count()


def prefer_ready(folder: str) -> str | None:
    """The table to analyse: the ready one if there is one, else the latest cleaned attempt."""
    base = Path(folder)
    if (base / "analysis_ready").exists():
        return str(base / "analysis_ready")
    attempts = sorted((base / "cleaned").glob("attempt=*"), key=lambda p: int(p.name.split("=")[1]))
    return str(attempts[-1]) if attempts else None


def content_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file on any storage Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def encrypt_file(spark: SparkSession, path: str, out: str, key: bytes) -> None:
    """A file's content encrypted with AES-GCM, as Parquet (path, content)."""
    spark.read.format("binaryFile").load(path).select("path", F.aes_encrypt("content", F.lit(key)).alias("content")).write.mode("overwrite").parquet(out)


def decrypt_file(spark: SparkSession, at: str, key: bytes) -> bytes:
    return bytes(spark.read.parquet(at).select(F.aes_decrypt("content", F.lit(key)).alias("c")).first()["c"])


def date_forms(df: DataFrame) -> DataFrame:
    """Text columns of dates as timestamps, by the one form that nearly all their values have; other values become null."""
    from veritab.operators.quality import date_formats

    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: F.try_to_timestamp(F.trim(c), F.lit(form)).cast("timestamp_ntz") for c, form in date_formats(df, texts).items() if form})


def union_sheets(sheets: list[DataFrame]) -> DataFrame:
    """Sheets of one schema under each other, rows without any value dropped; different columns are an error."""
    names = set(sheets[0].columns)
    for s in sheets[1:]:
        if set(s.columns) != names:
            raise ValueError(f"columns differ: {sorted(names ^ set(s.columns))}")
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s)
    return out.na.drop("all")


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """Dense zero-based row ids in the order of the files: Spark's own ids give partition and place, and each partition starts where those before it end.

    Ids are stable only over a stable input, so ``df`` is a table that was read, not a plan with a shuffle.
    """
    place = F.monotonically_increasing_id()
    rows = df.select("*", place.alias("_at"), F.spark_partition_id().alias("_part"))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return rows.join(starts, "_part").select(*df.columns, (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def write_attempt(df: DataFrame, folder: str, attempt: int) -> str:
    """Outputs of earlier attempts stay beside the new one."""
    at = f"{folder.rstrip('/')}/attempt={attempt}"
    df.write.mode("overwrite").parquet(at)
    return at


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


class ResultCache:
    """Runs by (content, configuration); only approved runs are stored."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(path)
        self.db.execute("CREATE TABLE IF NOT EXISTS runs (key TEXT PRIMARY KEY, source TEXT, run TEXT, verdict TEXT, at REAL)")

    @staticmethod
    def key(content_hash: str, config: dict) -> str:
        return hashlib.sha256((content_hash + json.dumps(config, sort_keys=True)).encode()).hexdigest()

    def store(self, key: str, source: str, run: str, verdict: str, at: float) -> bool:
        if verdict not in ("APPROVED", "APPROVED_WITH_WARNINGS"):
            return False
        with self.db:
            self.db.execute("INSERT OR REPLACE INTO runs VALUES (?, ?, ?, ?, ?)", (key, os.path.abspath(source), run, verdict, at))
        return True

    def get(self, key: str) -> tuple[str, str] | None:
        """(run, verdict); the verdict is the stored one."""
        return self.db.execute("SELECT run, verdict FROM runs WHERE key = ?", (key,)).fetchone()

    def previous(self, source: str) -> str | None:
        row = self.db.execute("SELECT run FROM runs WHERE source = ? ORDER BY at DESC LIMIT 1", (os.path.abspath(source),)).fetchone()
        return row and row[0]


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
