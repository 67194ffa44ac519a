"""Sinks: append, console, replace by partition, upserts by JDBC, by version and by partition."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway import embedded
from rillway.session import file_system


def append(df: DataFrame, target: str, kind: str = "parquet", **options: str) -> None:
    """Adds rows to a table of files, or by JDBC if kind is jdbc and target its url; to a database inside the driver, through the driver."""
    if kind == "jdbc" and embedded.is_embedded(target):
        embedded.append(df, target, **options)
    elif kind == "jdbc":
        df.write.format("jdbc").options(url=target, **options).mode("append").save()
    else:
        df.write.format(kind).options(**options).mode("append").save(target)


def console(df: DataFrame, n: int = 20) -> None:
    """Shows the first rows, uncut; a stream's batches as they come, until the query that is returned ends."""
    if df.isStreaming:
        return df.writeStream.format("console").option("numRows", n).option("truncate", False).trigger(availableNow=True).start()
    df.show(n, truncate=False)


def execute_jdbc(spark: SparkSession, url: str, *statements: str, **options: str) -> None:
    """Runs statements in a database by JDBC, in one transaction."""
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in options.items():
        given.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        run = connection.createStatement()
        for s in statements:
            run.executeUpdate(s)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def upsert_jdbc(df: DataFrame, url: str, table: str, keys: list[str], **options: str) -> None:
    """Rows replace those of the same keys in a table by JDBC, and the others are added, in one transaction.

    The rows are written to a table beside it first, as append does; then statements split them into updates and inserts
    inside the database. Keys must not be null, and not repeat in df. The two tables beside it have indices, unless a key
    is of a type that not every database can index; so the table itself needs none.
    """
    beside = f"{table}_{uuid.uuid4().hex[:12]}"
    known = f"{beside}_k"
    append(df, url, "jdbc", dbtable=beside, **options)
    append(df.select(*keys).limit(0), url, "jdbc", dbtable=known, **options)
    indexed = all(isinstance(df.schema[k].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) for k in keys)
    index = [f"CREATE UNIQUE INDEX {t}_i ON {t} ({', '.join(keys)})" for t in (beside, known) if indexed]
    execute_jdbc(df.sparkSession, url, *index, **options)
    others = [c for c in df.columns if c not in keys]
    same = " AND ".join(f"s.{k} = {table}.{k}" for k in keys)
    names, mine = ", ".join(df.columns), ", ".join(f"s.{c}" for c in df.columns)
    statements = [f"INSERT INTO {known} ({', '.join(keys)}) SELECT DISTINCT {', '.join(f's.{k}' for k in keys)} FROM {table}, {beside} s WHERE {same}"]
    if others:
        sets = ", ".join(f"{c} = (SELECT s.{c} FROM {beside} s WHERE {same})" for c in others)
        statements.append(f"UPDATE {table} SET {sets} WHERE EXISTS (SELECT 1 FROM {beside} s WHERE {same})")
    there = " AND ".join(f"s.{k} = {known}.{k}" for k in keys)
    statements.append(f"INSERT INTO {table} ({names}) SELECT {mine} FROM {beside} s WHERE NOT EXISTS (SELECT 1 FROM {known} WHERE {there})")
    execute_jdbc(df.sparkSession, url, *statements, f"DROP TABLE {known}", f"DROP TABLE {beside}", **options)


def with_task(df: DataFrame, task_id: int) -> DataFrame:
    return df.select(F.lit(task_id).cast("long").alias("task_id"), *df.columns)


def replace_groups(df: DataFrame, target: str, keys: list[str]) -> None:
    """Replaces the groups of keys that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(target)


class VersionedTable:
    """A table in a folder of complete versions; a pointer that is written last names the current one.

    A version's name is the id of the batch that made it, so a batch that is run again makes the same version, and a
    failed one leaves the pointer where it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        return file_system(self.spark, self.path)

    def versions(self) -> list[int]:
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.path}/done-*"))
        return sorted(int(s.getPath().getName().removeprefix("done-")) for s in found or [])

    def read(self, before: int | None = None) -> DataFrame | None:
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v{known[-1]}") if known else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        fs, path = self._fs()
        fs.create(path(f"{self.path}/done-{version}"), True).close()
        for old in self.versions()[:-2]:  # readers of the version before keep it
            fs.delete(path(f"{self.path}/done-{old}"), False)
            fs.delete(path(f"{self.path}/v{old}"), True)

    def upsert(self, rows: DataFrame, keys: list[str], version: int) -> None:
        """Rows replace those with the same keys; the others stay."""
        old = self.read(before=version)
        if old is None:
            self.write(rows, version)
            return
        same = [old[k].eqNullSafe(rows[k]) for k in keys]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        self.write(old.join(rows, condition, "left_anti").unionByName(rows), version)


class BatchedTable:
    """Rows added batch by batch, each in a folder of its own: a batch that is run again replaces itself, and none reads what others wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")


class DatedTable:
    """A table in partitions by one column, of which a batch rewrites those that it touches.

    batch-N/part=value holds the partition as of batch N; done-N says that the batch is complete. A partition's state
    is that of its newest complete batch; older ones go, but for the one before.
    """

    def __init__(self, spark: SparkSession, path: str, by: str = "date"):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by

    def _states(self, before: int | None = None) -> dict[str, list[int]]:
        """Of each partition the complete batches that have it, the newest last."""
        fs, path = file_system(self.spark, self.path)
        done = {int(s.getPath().getName().removeprefix("done-")) for s in fs.globStatus(path(f"{self.path}/done-*")) or []}
        out: dict[str, list[int]] = {}
        for s in fs.globStatus(path(f"{self.path}/batch-*/part=*")) or []:
            number = int(s.getPath().getParent().getName().removeprefix("batch-"))
            if number in done and (before is None or number < before):
                out.setdefault(s.getPath().getName(), []).append(number)
        return {k: sorted(v) for k, v in out.items()}

    def read(self, before: int | None = None, only: set[str] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/batch-{v[-1]}/{k}" for k, v in sorted(self._states(before).items()) if only is None or k in only]
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, rows: DataFrame, keys: list[str], number: int, add: list[str] | None = None) -> list[str]:
        """Rows replace those of the same keys or, with add, have those columns' sums with them; returns the touched values.

        Only the partitions that rows has, a few for each batch, are read and written.
        """
        part = F.coalesce(F.col(self.by).cast("string"), F.lit("none"))
        rows = rows.persist()
        try:
            touched = sorted(r[0] for r in rows.select(part).distinct().collect())
            old = self.read(number, {f"part={v}" for v in touched})
            if old is None:
                new = rows
            elif add:
                others = [c for c in rows.columns if c not in keys and c not in add]
                new = old.unionByName(rows).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in add), *(F.max(c).alias(c) for c in others))
            else:
                same = [old[k].eqNullSafe(rows[k]) for k in keys]
                condition = same[0]
                for c in same[1:]:
                    condition = condition & c
                new = old.join(rows, condition, "left_anti").unionByName(rows)
            new.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/batch-{number}")
        finally:
            rows.unpersist()
        fs, path = file_system(self.spark, self.path)
        fs.create(path(f"{self.path}/done-{number}"), True).close()
        for value, numbers in self._states().items():
            for stale in numbers[:-2]:
                fs.delete(path(f"{self.path}/batch-{stale}/{value}"), True)
        return touched
