"""Freeze points: what later steps may only read is written once, before they are planned."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark is one process, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tauplane-frozen-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def freeze(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again; it is deleted when the session's process ends.

    So a candidate or policy can't change after it was looked at, and no later plan works it out anew.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/frozen-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it a job's shuffle files go when the job ends; for jobs whose results are frozen or collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the cluster's cleaner then takes the folder
        pass


def payload_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, payload_sha256): the digest of every row's other columns as JSON in the order of their names."""
    rest = sorted(c for c in df.columns if c not in keys)
    return df.select(*keys, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias("payload_sha256"))


def mutations(frozen: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status) of every row of either: unchanged, mutated, removed or added since the payloads were frozen."""
    a, b = frozen.select(*keys, F.col("payload_sha256").alias("_was")), payload_hash(now, keys).select(*keys, F.col("payload_sha256").alias("_is"))
    status = F.when(F.col("_is").isNull(), "removed").when(F.col("_was").isNull(), "added").when(F.col("_was") != F.col("_is"), "mutated").otherwise("unchanged")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))
