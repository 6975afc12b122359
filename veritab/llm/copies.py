"""Copies of records that differ only in formatting: an incremental ledger of canonical keys.

The canonical key holds, for each text, its letters and digits in one case; texts named as interchangeable are sorted;
other fields are compared as they are.  Null, the empty text and every other text stay apart.

The ledger is a folder of Parquet, cut into buckets by a hash of the key; a key stands in its bucket as a whole text, so equal
hashes never merge different keys.  ``Ledger.add`` aggregates a batch by key (map-side combine, so a key with a third of the
rows is a few partial rows), reads only the buckets the batch touches, joins them to the batch with a full outer join, adds the
counts, keeps the earliest representative (smallest id) and writes those buckets as a new version.  A manifest, written last,
names the version of each bucket: a job that fails leaves the former state, and ``Ledger.open`` in any later session goes on
from there.  ``vacuum`` deletes versions the manifest no longer names; a ledger without a folder of its own is scratch and
goes when the application ends.

Buckets.  Their number is fixed when the first batch comes: one for each ``ROWS`` rows, and a multiple of the session's shuffle
partitions.  The bucket is the hash Spark itself partitions by, so what leaves an aggregate or a join by key lies bucket by
bucket in its tasks already and is written without a further shuffle.

Defined results: repeated ids of exact copies count each; empty batches change nothing; NaN equals NaN and -0.0 equals 0.0;
clashing extra columns are ignored as the operator selects what it needs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.shared import ensure_checkpoint_dir

#: Rows of the first batch for each bucket.
ROWS = 4_000_000
#: Batches that are counted side by side in one aggregate.
BESIDE = 12


def canonical(text: Column) -> Column:
    """Letters and digits of a text in one case; null stays null."""
    return F.regexp_replace(F.lower(F.upper(text)), r"[^\p{L}\p{Nd}]", "")


def _mark(value: Column) -> Column:
    """A text form in which null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit("0"))


def canonical_key(texts: list[str], exchangeable: list[str], exact: list[str]) -> Column:
    own = [_mark(canonical(F.col(c))) for c in texts]
    either = F.array_sort(F.array(*[_mark(canonical(F.col(c))) for c in exchangeable])) if exchangeable else F.array().cast("array<string>")
    # adding 0 makes -0.0 equal 0.0
    plain = [_mark((F.col(c) + F.lit(0)).cast("string")) for c in exact]
    return F.concat_ws("|", *own, F.concat_ws("|", either), *plain)


@dataclass
class Ledger:
    """Canonical keys with the number of copies and the representative, kept in buckets."""

    spark: SparkSession
    folder: str
    buckets: int = 0
    number: int = 0  # of the manifest
    versions: dict[int, str] = field(default_factory=dict)

    schema = "key string, copies long, keep_id long"

    @classmethod
    def new(cls, spark: SparkSession, folder: str | None = None, buckets: int = 0) -> Ledger:
        """An empty ledger; without a folder it is scratch in the cluster's shared one."""
        if folder is None:
            folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/copies-{uuid.uuid4().hex}"
            fs, path = _filesystem(spark, folder)
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        return cls(spark, folder.rstrip("/"), buckets)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Ledger:
        """The ledger as its latest manifest has it."""
        rows = spark.read.schema("bucket int, at string, buckets int, n int").parquet(f"{folder.rstrip('/')}/manifest")
        last = rows.agg(F.max("n")).first()[0]
        out = cls(spark, folder.rstrip("/"), 0, last)
        for r in rows.where(F.col("n") == last).toLocalIterator():  # one row for each bucket
            out.buckets = r["buckets"]
            out.versions[r["bucket"]] = r["at"]
        return out

    def _commit(self) -> None:
        rows = [(b, v, self.buckets) for b, v in sorted(self.versions.items())]
        self.spark.createDataFrame(rows, "bucket int, at string, buckets int").coalesce(1).write.parquet(f"{self.folder}/manifest/n={self.number + 1}")
        self.number += 1

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{v}/bucket={b}" for b, v in sorted(self.versions.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def add(self, batch: DataFrame, key: Column, id_col: str) -> None:
        """Count a batch in."""
        self.add_all(batch, key, id_col, F.lit(0))

    def add_all(self, df: DataFrame, key: Column, id_col: str, batch: Column) -> None:
        """Count all batches of ``df`` in, in the order of ``batch`` (a long, null last); the table is scanned once, whatever their number."""
        if not self.buckets:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.buckets = parts * -(-df.count() // (ROWS * parts)) or parts
        at, found = _stage(df, f"{self.folder}/staged-{uuid.uuid4().hex[:8]}", key, id_col, batch, self.buckets)
        for b, touched in found.items():
            self._merge(f"{at}/batch={b}", touched)
        if found:
            self._commit()

    def _merge(self, at: str, touched: list[int]) -> None:
        """Add the counts of a staged batch to the buckets it touches; a bucket that was empty takes them as they are."""
        known = [b for b in touched if b in self.versions]
        self.versions.update({b: at for b in touched if b not in self.versions})
        if not known:
            return
        new = self.spark.read.schema(self.schema).parquet(*[f"{at}/bucket={b}" for b in known]).select("key", F.col("copies").alias("n"), F.col("keep_id").alias("first"))
        version = f"{self.folder}/version-{uuid.uuid4().hex[:8]}"
        joined = self.read(known).join(new, "key", "full_outer").select(
            "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("keep_id", "first").alias("keep_id"), _bucket(self.buckets),
        )
        joined.write.partitionBy("bucket").parquet(version)
        self.versions.update({b: version for b in known})

    def vacuum(self) -> None:
        """Delete what the latest manifest doesn't name."""
        fs, root = _filesystem(self.spark, self.folder)
        named = {f"{v.removeprefix(self.folder + '/')}/bucket={b}" for b, v in self.versions.items()}
        keep = {n.rsplit("/", k)[0] for n in named for k in range(3)} | {"manifest"}

        def sweep(path, name: str) -> None:
            for entry in fs.listStatus(path):
                own = f"{name}{entry.getPath().getName()}"
                if own not in keep:
                    fs.delete(entry.getPath(), True)
                elif own not in named and own != "manifest":
                    sweep(entry.getPath(), own + "/")

        sweep(root, "")
        for entry in fs.listStatus(_filesystem(self.spark, f"{self.folder}/manifest")[1]):
            if entry.getPath().getName() != f"n={self.number}":
                fs.delete(entry.getPath(), True)


def _filesystem(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _bucket(buckets: int) -> Column:
    """The bucket of a key, by the hash that Spark partitions by."""
    return F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket")


def _stage(df: DataFrame, at: str, key: Column, id_col: str, batch: Column, buckets: int) -> tuple[str, dict[str, list[int]]]:
    """Write the counts of all batches by batch and bucket after one scan; the folder, and for each batch in order the buckets it touches."""
    rows = df.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(batch.cast("long").cast("string"), F.lit("none")).alias("batch"))
    names = [r["batch"] for r in rows.select("batch").distinct().limit(BESIDE + 1).collect()]
    if len(names) <= BESIDE:
        # the batches side by side, so that the aggregate is by key alone
        aggs = [a for i, b in enumerate(names) for a in (F.count_if(F.col("batch") == b).alias(f"n{i}"), F.min(F.when(F.col("batch") == b, F.col("id"))).alias(f"f{i}"))]
        each = F.array(*[F.struct(F.lit(b).alias("batch"), F.col(f"n{i}").alias("copies"), F.col(f"f{i}").alias("keep_id")) for i, b in enumerate(names)])
        counted = rows.groupBy("key").agg(*aggs).select("key", F.explode(F.filter(each, lambda x: x["copies"] > 0)).alias("b")).select("key", "b.*", _bucket(buckets)) if names else None
    else:
        counted = rows.groupBy("key", "batch").agg(F.count("*").alias("copies"), F.min("id").alias("keep_id")).withColumn("bucket", _bucket(buckets)).repartition("bucket")
    if counted is None:
        return at, {}
    counted.write.partitionBy("batch", "bucket").parquet(at)
    written = df.sparkSession.read.schema(f"{Ledger.schema}, batch string, bucket int").parquet(at)
    found: dict[str, list[int]] = {}
    for r in written.select("batch", "bucket").distinct().orderBy(F.try_to_number("batch", F.lit("S9999999999999999999")).asc_nulls_last(), "bucket").toLocalIterator():
        found.setdefault(r["batch"], []).append(r["bucket"])
    return at, found


def ledger_of(df: DataFrame, key: Column, id_col: str, when: str, unit: str = "year", folder: str | None = None) -> Ledger:
    """The ledger after the batches of ``df`` in the order of their time; ``unit`` is the calendar span of a batch.

    Rows without a time are the last batch.
    """
    ledger = Ledger.new(df.sparkSession, folder)
    ledger.add_all(df, key, id_col, F.unix_date(F.to_date(F.date_trunc(unit, F.col(when).cast("timestamp")))))
    return ledger


def members(df: DataFrame, ledger: Ledger, key: Column, id_col: str) -> DataFrame:
    """(keep_id, copy_id): every record that is not its own representative."""
    repeated = ledger.read().where(F.col("copies") > 1).select("key", "keep_id")
    rows = df.select(key.alias("key"), F.col(id_col).cast("long").alias("copy_id"))
    return rows.join(repeated, "key").where(F.col("copy_id") != F.col("keep_id")).select("keep_id", "copy_id")
