"""Session settings and the folder for what queries write."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_ENDING: set[str] = set()


def session(app: str = "rillway", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings are added to it, dots written as underscores."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    }
    for key, value in (defaults | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its class of paths."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; what is there goes when the application ends.

    Where that is unset, a folder of our own on a single machine; on a cluster that is an error.
    """
    base, app = spark.conf.get("spark.checkpoint.dir", ""), spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="rillway-")
        _OWN[app] = base
    top = f"{base.rstrip('/')}/rillway-scratch-{app}"
    if app not in _ENDING:
        system, path = file_system(spark, top)
        system.mkdirs(path(top))
        system.deleteOnExit(path(top))
        _ENDING.add(app)
    return f"{top}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to scratch and read again, so that several readers don't compute it several times."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
