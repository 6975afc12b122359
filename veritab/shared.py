"""Session helpers that every part of the library uses."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by the cluster (spark.checkpoint.dir).

    Where none is set, a session in one process (``local[n]``) gets one of its own; on a cluster that is an error, as a folder of one machine
    would not be seen by the others.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="veritab-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
