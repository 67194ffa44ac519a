"""The logical input tables, made of a folder of Parquet tables of orders, parts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _when(kind: str, value: Column) -> Column:
    return F.when(F.col("event_type") == kind, value)


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """user_visit_action: a session is a user's day; searches are views, orders sign-ups, payments purchases."""
    parts = table(spark, folder, "part").count()  # from the files' footers
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    date = F.date_format("ts", "yyyy-MM-dd")
    events = table(spark, folder, "events")
    return events.select(
        date.alias("date"), "user_id", F.concat_ws("_", F.col("user_id").cast("string"), date).alias("session_id"), (k % 10).alias("page_id"),
        F.col("ts").alias("action_time"), F.col("event_id").alias("action_id"),
        _when("view", F.concat(F.lit("kw"), (k % 10).cast("string"))).alias("search_keyword"),
        _when("click", k).alias("click_category_id"), _when("click", F.col("event_id") % F.lit(max(parts, 1))).alias("click_product_id"),
        _when("signup", k.cast("string")).alias("order_category_ids"), _when("purchase", k.cast("string")).alias("pay_category_ids"),
        (F.col("user_id") % 25).alias("city_id"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    people = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    return people.select(
        key.alias("user_id"), F.col("c_name").alias("name"), (key % 60).cast("int").alias("age"), F.col("c_mktsegment").alias("professional"), "city",
        F.when(key % 2 == 0, "male").otherwise("female").alias("sex"),
    )


def cities(spark: SparkSession, folder: str) -> DataFrame:
    region = table(spark, folder, "region")
    joined = table(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").cast("long").alias("city_id"), F.col("n_name").alias("city_name"), F.col("r_name").alias("area"))


def products(spark: SparkSession, folder: str) -> DataFrame:
    status = F.concat(F.lit('{"product_status":'), (F.col("p_size") % 2).cast("string"), F.lit("}"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), status.alias("extend_info"))


def product_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """A sold line counts as a click from the supplier's city."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("city_id"))
    lines = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_partkey").alias("product_id"))
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("city_id", "product_id")


def ad_lines(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """value: the click log's lines, with underscores for blanks in names; events may be a stream."""
    events = table(spark, folder, "events") if events is None else events
    where = table(spark, folder, "customer").join(cities(spark, folder), F.col("c_nationkey") == F.col("city_id")).select("c_custkey", "city_name", "area")
    clicks = events.where(F.col("event_type") == "click").join(where, F.col("user_id") == F.col("c_custkey"))
    name = lambda c: F.translate(c, " ", "_")
    ad = F.get_json_object("props", "$.k").try_cast("bigint") % 5
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return clicks.select(F.concat_ws(" ", millis.cast("string"), name(F.col("area")), name(F.col("city_name")), F.col("user_id").cast("string"), ad.cast("string")).alias("value"))


def blacklist(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").where(F.col("c_custkey") % 7 == 0).select(F.col("c_custkey").alias("user_id"))
