"""Sources that a table of registrations describes, each readable under its target name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillway import embedded

# Numbers of the kinds of source.
HIVE, MYSQL, ORACLE, DB2, JSON, PARQUET, PHOENIX = 1, 2, 3, 4, 5, 6, 7

DRIVERS = {MYSQL: "com.mysql.cj.jdbc.Driver", ORACLE: "oracle.jdbc.OracleDriver", DB2: "com.ibm.db2.jcc.DB2Driver"}


def read_jdbc(spark: SparkSession, url: str, table: str, user: str | None = None, password: str | None = None, driver: str | None = None, **options: str) -> DataFrame:
    """A table by JDBC. partitionColumn, lowerBound, upperBound and numPartitions among options make it a parallel read.

    Of a database inside the driver it is the table as it is now, read at once and through the driver.
    """
    given = {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver} | options
    given = {k: v for k, v in given.items() if v is not None}
    return embedded.read(spark, **given) if embedded.is_embedded(url) else spark.read.format("jdbc").options(**given).load()


def _jdbc(kind: int) -> Callable[[SparkSession, dict], DataFrame]:
    return lambda spark, r: read_jdbc(spark, r["url"], r["source_table"], r.get("username"), r.get("password"), r.get("driver") or DRIVERS.get(kind))


READERS: dict[int, Callable[[SparkSession, dict], DataFrame]] = {
    HIVE: lambda spark, r: spark.table(r["source_table"]),
    MYSQL: _jdbc(MYSQL),
    ORACLE: _jdbc(ORACLE),
    DB2: _jdbc(DB2),
    JSON: lambda spark, r: spark.read.json(r["url"]),
    PARQUET: lambda spark, r: spark.read.parquet(r["url"]),
}


def registrations(source: DataFrame) -> list[dict]:
    """The rows of a table of registrations, a few by nature, with lower case names."""
    return [{k.lower(): v for k, v in row.asDict().items()} for row in source.collect()]


def register(spark: SparkSession, rows: list[dict], readers: dict[int, Callable[[SparkSession, dict], DataFrame]] = READERS) -> list[str]:
    """Makes each registration a view of its target name; returns the names. Kinds without a reader are an error."""
    names = []
    for row in rows:
        kind = int(row["datasource_type"])
        if kind not in readers:
            raise ValueError(f"source kind {kind} of {row['target_table']} can't be read")
        readers[kind](spark, row).createOrReplaceTempView(row["target_table"])
        names.append(row["target_table"])
    return names


def federated(spark: SparkSession, rows: list[dict], query: str, readers: dict[int, Callable[[SparkSession, dict], DataFrame]] = READERS) -> DataFrame:
    """Registers the sources and runs a query over them."""
    register(spark, rows, readers)
    return spark.sql(query)
