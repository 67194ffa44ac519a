"""Partitioned load of text logs: gate, parse, write as ORC by day, hour and five minutes, publish."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rillway.session import file_system

PARTS = ("d", "h", "m5")


@dataclass
class JobResult:
    """How a load ended: 成功 or 执行异常 with the first line of the reason, and what was published."""

    message: str
    partitions: list[dict[str, str]] = field(default_factory=list)
    rows: int = 0

    @property
    def ok(self) -> bool:
        return self.message == "成功"


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    fs, p = file_system(spark, path)
    found = fs.globStatus(p(path.rstrip("/") + "/*"))
    return [(s.getPath().toString(), s.getLen()) for s in found or [] if s.isFile() and not s.getPath().getName().startswith(("_", "."))]


def wait_for_files(spark: SparkSession, path: str, expected: int, checks: int = 9, pause_s: float = 20.0) -> bool:
    """Whether path holds the expected number of files within so many checks."""
    for k in range(checks):
        if len(_files(spark, path)) >= expected:
            return True
        if k + 1 < checks:
            time.sleep(pause_s)
    return False


def read_lines(spark: SparkSession, path: str, mb_per_partition: int = 128) -> DataFrame:
    """Lines of the files under path, in partitions of about that many MB."""
    size = sum(n for _, n in _files(spark, path))
    return spark.read.text(path).coalesce(max(1, -(-size // (mb_per_partition << 20))))


def delimited(names: list[str], time_column: str, separator: str = "\t", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Callable[[DataFrame], DataFrame]:
    """A parser of lines of so many values, one of which is the time; other lines go."""

    def parse(lines: DataFrame) -> DataFrame:
        p = F.split("value", "\\Q" + separator + "\\E")
        rows = lines.where(F.size(p) == len(names)).select(*(p[i].alias(name) for i, name in enumerate(names)))
        return rows.where(F.try_to_timestamp(F.col(time_column), F.lit(pattern)).isNotNull())

    return parse


def with_partitions(rows: DataFrame, ts: Column) -> DataFrame:
    """d (yyyyMMdd), h (HH) and m5 (the minute, down to a multiple of five, two digits) as text."""
    m5 = F.lpad((F.floor(F.minute(ts) / 5) * 5).cast("string"), 2, "0")
    return rows.withColumns({"d": F.date_format(ts, "yyyyMMdd"), "h": F.date_format(ts, "HH"), "m5": m5})


def publish(spark: SparkSession, beside: str, target: str) -> list[dict[str, str]]:
    """Moves complete partitions from a folder beside target into it, each in place of what it had; returns their values.

    Until here a load has touched nothing in target, so one that fails leaves it as it was.
    """
    fs, path = file_system(spark, target)
    found = fs.globStatus(path(beside + "".join(f"/{p}=*" for p in PARTS)))
    out = []
    for s in found or []:
        names = s.getPath().toString().rstrip("/").split("/")[-len(PARTS) :]
        to = path("/".join([target.rstrip("/"), *names]))
        fs.mkdirs(to.getParent())
        fs.delete(to, True)
        if not fs.rename(s.getPath(), to):
            raise RuntimeError(f"{s.getPath().toString()} can't be moved to {to.toString()}")
        out.append(dict(x.split("=", 1) for x in names))
    fs.delete(path(beside), True)
    return out


def load_logs(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], ts: Column, target: str, expected_files: int = 1, checks: int = 9, pause_s: float = 20.0, table: str | None = None) -> JobResult:
    """Loads the files under path into target, replacing the partitions that they touch and no others.

    parse makes columns of the column value and drops malformed lines. With table, a catalog table over target, new
    partitions are added to it.
    """
    try:
        if not wait_for_files(spark, path, expected_files, checks, pause_s):
            return JobResult(f"执行异常 fewer than {expected_files} files in {path}")
        rows = with_partitions(parse(read_lines(spark, path)), ts)
        seen, beside = Observation(), f"{target.rstrip('/')}/.loading-{uuid.uuid4().hex}"
        # one partition's rows come together, a large one's are split again at run time
        rows.observe(seen, F.count("*").alias("n")).hint("rebalance", *PARTS).write.partitionBy(*PARTS).orc(beside)
        published = publish(spark, beside, target)
        if table:
            for r in published:
                spec = ", ".join(f"{p}='{r[p]}'" for p in PARTS)
                spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION '{target}/" + "/".join(f"{p}={r[p]}" for p in PARTS) + "'")
        return JobResult("成功", published, seen.get["n"])
    except Exception as e:  # the caller gets a response, whatever went wrong
        return JobResult("执行异常 " + str(e).split("\n", 1)[0])


def read_partitions(spark: SparkSession, target: str) -> DataFrame:
    """The loaded rows; partition values are text even if a session would infer numbers."""
    schema = spark.read.option("recursiveFileLookup", "true").orc(target).schema
    for p in PARTS:
        schema = schema.add(p, "string")
    return spark.read.schema(schema).orc(target)
