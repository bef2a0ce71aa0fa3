"""Where intermediate tables go: the folder every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder only for local sessions."""
    where = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_CONF} to a folder every executor can reach")
    where = tempfile.mkdtemp(prefix="quillmark-")
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> str:
    path = new_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a written table, which survives the loss of executors."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, label))
