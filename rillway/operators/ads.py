"""Advertising clicks: functions that batch and stream share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillway.functions.time import from_epoch_millis


def parse_clicks(lines: DataFrame, column: str = "value") -> DataFrame:
    """ts, province, city, user_id, ad_id from lines of five blank separated values; malformed lines go."""
    p = F.split(F.col(column), " ")
    parsed = lines.select(
        from_epoch_millis(F.get(p, 0)).alias("ts"), F.get(p, 1).alias("province"), F.get(p, 2).alias("city"),
        F.get(p, 3).try_cast("bigint").alias("user_id"), F.get(p, 4).try_cast("bigint").alias("ad_id"), F.size(p).alias("parts"),
    )
    return parsed.where("parts = 5 AND ts IS NOT NULL AND user_id IS NOT NULL AND ad_id IS NOT NULL").drop("parts")


def without_blacklisted(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks of users that aren't on the list; clicks may be a stream."""
    return clicks.join(blacklist.select("user_id").distinct(), "user_id", "left_anti")


def user_daily_counts(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(F.to_date("ts").alias("date"), "user_id", "ad_id").agg(F.count("*").alias("click_count"))


def blacklisted_users(daily: DataFrame, least: int) -> DataFrame:
    """Users with at least so many clicks on one ad in one day."""
    return daily.where(F.col("click_count") >= least).select("user_id").distinct()


def city_counts(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(F.to_date("ts").alias("date"), "province", "city", "ad_id").agg(F.count("*").alias("click_count"))


def province_counts(cities: DataFrame) -> DataFrame:
    return cities.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))


def province_top(cities: DataFrame, n: int = 3) -> DataFrame:
    """The n most clicked ads of each day and province, ties by the smaller ad_id. Not for a stream itself but for its batches."""
    order = W.partitionBy("date", "province").orderBy(F.desc("click_count"), F.asc("ad_id"))
    return province_counts(cities).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def minute_counts(clicks: DataFrame) -> DataFrame:
    """Clicks by minute of event time and ad; with a watermark on ts in a stream."""
    return clicks.groupBy(F.window("ts", "1 minute").alias("w"), "ad_id").agg(F.count("*").alias("click_count")).select(F.col("w.start").alias("minute_start"), "ad_id", "click_count")


def recent_trend(minutes: DataFrame, length: str = "60 minutes") -> DataFrame:
    """date, hour, minute, ad_id, click_count of the minutes up to length before the last one."""
    last = minutes.agg(F.max("minute_start").alias("last"))
    recent = minutes.join(F.broadcast(last), F.col("minute_start") >= F.col("last") - F.expr(f"INTERVAL {length}"))  # one row
    at = F.col("minute_start")
    return recent.select(F.date_format(at, "yyyy-MM-dd").alias("date"), F.date_format(at, "HH").alias("hour"), F.date_format(at, "mm").alias("minute"), "ad_id", "click_count")
