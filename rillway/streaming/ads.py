"""The advertising statistics as streams, made of the batch functions.

Counts go to tables in partitions by day: a batch is counted by itself and merged into the days that it touches, so what
a batch costs doesn't grow with the stream's history, no state outlives a batch, and a batch that is repeated after a
failure adds nothing twice. The blacklist is read anew for every batch. Streams that count in Spark's state store
instead have watermarks, beyond which their state goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillway.operators import ads
from rillway.sinks import BatchedTable, DatedTable, replace_groups

#: How late clicks may be for the trend, and for the counts by day.
WATERMARK, DAY_WATERMARK = "60 minutes", "1 day"


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Runs a stream into write(batch, number); by default over all available input."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def allowed_clicks(clicks: DataFrame, load: Callable[[], DataFrame], table: BatchedTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The clicks of users that aren't on the list that load() gives when their batch comes; each batch is added by itself."""
    return start(clicks, lambda batch, number: table.add(ads.without_blacklisted(batch, load()), number), checkpoint, trigger=trigger)


def counted(clicks: DataFrame, load: Callable[[], DataFrame] | None, count: Callable[[DataFrame], DataFrame], keys: list[str], table: DatedTable, checkpoint: str, trigger: dict | None = None, then: Callable[[DatedTable, list[str], int], None] | None = None) -> StreamingQuery:
    """Counts by keys, of which the table's day is one, with the list that load() gives when a batch comes (None: of all clicks).

    then, if given, is told the days that a batch has touched.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = ads.without_blacklisted(batch, load()) if load else batch
        touched = table.merge(count(rows), keys, number, add=["click_count"])
        if then and touched:
            then(table, touched, number)

    return start(clicks, write, checkpoint, trigger=trigger)


DAILY, CITY, MINUTE = ["date", "user_id", "ad_id"], ["date", "province", "city", "ad_id"], ["date", "minute_start", "ad_id"]


def top_of_days(target: str, n: int = 3) -> Callable[[DatedTable, list[str], int], None]:
    """For counted: replaces the provinces' most clicked ads of the days that a batch has touched, and no others."""

    def write(table: DatedTable, touched: list[str], number: int) -> None:
        cities = table.read(number + 1, {f"part={v}" for v in touched})
        replace_groups(ads.province_top(cities, n), target, ["date"])

    return write


def minutes_of(clicks: DataFrame) -> DataFrame:
    """Clicks by minute, with their day."""
    return ads.minute_counts(clicks).withColumn("date", F.to_date("minute_start"))


def in_state(clicks: DataFrame, blacklist: DataFrame, keys: list[str], watermark: str = DAY_WATERMARK) -> DataFrame:
    """Daily counts by keys (date among them) in the state store, whose days go when the watermark has passed them."""
    allowed = ads.without_blacklisted(clicks, blacklist).withWatermark("ts", watermark)
    day = F.window("ts", "1 day")
    rest = [k for k in keys if k != "date"]
    return allowed.groupBy(day.alias("day"), *rest).agg(F.count("*").alias("click_count")).select(F.to_date(F.col("day.start")).alias("date"), *rest, "click_count")


def minutes(clicks: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """All clicks, blacklisted users' too, by minute."""
    return ads.minute_counts(clicks.withWatermark("ts", watermark))
