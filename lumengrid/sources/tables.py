"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder in local sessions without it, an error on a cluster without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="lumengrid-"))


def own_folder(spark: SparkSession) -> str:
    """Where the tables of this application lie."""
    return f"{folder(spark)}/lumengrid/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application has settled: for when no result that reads them is needed any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df written under the shared folder and read again.

    A plan that is used several times is computed once, and a lost executor costs no recomputation.  The table stays
    until `forget`.
    """
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
