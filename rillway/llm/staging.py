"""What the operators of this subpackage share: the shared folder, staged tables and global ranks."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_ENDING: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own on a single machine; on a cluster that is an error."""
    told = spark.conf.get("spark.checkpoint.dir", "")
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="rillway-")
    return _OWN[app]


def _path(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A path in this application's own part of the shared folder, which is deleted when the application ends."""
    app = spark.sparkContext.applicationId
    top = f"{shared_folder(spark)}/rillway-{app}"
    if app not in _ENDING:
        p, system = _path(spark, top)
        system.mkdirs(p)
        system.deleteOnExit(p)
        _ENDING.add(app)
    return f"{top}/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Holds settings of the session while something runs; dots are written as double underscores."""
    before = {k.replace("__", "."): None for k in values}
    for k, v in values.items():
        key = k.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and returns the written table: lineage ends there, and a lost executor loses nothing.

    The shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rillway_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later result reads."""
    for df in tables:
        path = getattr(df, "_rillway_path", None)
        if path:
            p, system = _path(df.sparkSession, path)
            system.delete(p, True)


def unused(names: list[str], *wanted: str) -> list[str]:
    """A name for each wanted one that no column has, whatever the case."""
    taken, out = {x.lower() for x in names}, []
    for x in wanted:
        while x.lower() in taken:
            x = "_" + x
        taken.add(x.lower())
        out.append(x)
    return out


#: What stands for a null id inside; it ranks after all others.
LAST = (1 << 63) - 1


def numbered(docs: DataFrame, id_col: str, doc: str, row: str) -> DataFrame:
    """Adds two longs that together tell rows apart and rank them: doc, the id (LAST if null), and row, 0 where ids are unique.

    Where some id is null twice or repeats, the rows are staged with numbers of their own, so no row shares another's.
    """
    out = docs.withColumn(doc, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)))
    if not out.groupBy(doc).count().where("count > 1").limit(1).count():
        return out.withColumn(row, F.lit(0).cast("long"))
    return stage(out.withColumn(row, F.monotonically_increasing_id()), "numbered")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the driver has. It goes by Arrow: a list of tuples would go through Python workers of its own, which then stay idle."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds))


def with_rank(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Adds each row's global place (long, from 0) in the order, without gathering rows in one task.

    Rows are dealt by range and sorted in their partitions; only one count for each partition comes to the
    driver, where prefix sums turn the counts into the partitions' bases.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__at", 33)
    counts = sorted(map(tuple, placed.groupBy(part.alias("p")).count().collect()))
    bases, total = [], 0
    for p, n in counts:
        bases.append((p, total))
        total += n
    base = small_table(placed.sparkSession, bases or [(0, 0)], "__p long, __base long")
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("__p", part).join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + row).drop("__p", "__base", "__at")
    out._rillway_path = placed._rillway_path
    return out


#: Rows and bytes of an Arrow batch, where rows are whole texts; a longer text is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def whole_texts(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by rows and bytes, so that tasks hold few texts. Smaller settings stay.

    It is the same bound for every operator, and it stays set: the plans that operators return run later.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


_KEPT: dict = {}


def kept(key, build):
    """build() once in each Python worker for as long as the worker asks for the same key: it holds one large object at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        tidy()
        _KEPT[key] = build()
        tidy()
    return _KEPT[key]


def release() -> None:
    """Lets go of the large object that the worker holds, for steps that need none."""
    if _KEPT:
        _KEPT.clear()
        tidy()


def tidy() -> None:
    """Gives freed memory back to the system, which workers that Spark uses again would otherwise hold."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words_pattern() -> str:
    """A word: characters other than the six ASCII white space characters."""
    return r"[^\x20\x09-\x0D]+"


def plain_words(text: str) -> list[bytes]:
    """The words of a text in lower case; bytes.split() cuts at the same six characters."""
    return text.lower().encode("utf-8", "surrogatepass").split()
