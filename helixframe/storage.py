"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set (tests, one machine)."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{_KEY} must name a folder that all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="helixframe-"))
    return _fallback[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/helixframe/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the table.

    Later plans start from files, so a lost executor costs one task and
    not the whole lineage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
