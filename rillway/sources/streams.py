"""Sources of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_lines(spark: SparkSession, brokers: str, topics: str, **options: str) -> DataFrame:
    """A stream of the values of Kafka messages as text; needs Spark's Kafka package."""
    given = {"kafka.bootstrap.servers": brokers, "subscribe": topics} | options
    return spark.readStream.format("kafka").options(**given).load().select(F.col("value").cast("string").alias("value"))


def file_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of the lines of text files that appear under path."""
    return spark.readStream.options(**options).text(path)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
