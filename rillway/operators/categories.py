"""Categories: counts of clicks, orders and payments, the top categories and their top sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillway.functions.text import csv_values

KINDS = ("click", "order", "pay")


def category_events(actions: DataFrame) -> DataFrame:
    """category_id (long) and kind for every category that an action clicks, orders or pays for."""
    ids = {
        "click": F.when(F.col("click_category_id").isNotNull(), F.array(F.col("click_category_id").cast("string"))).otherwise(F.array().cast("array<string>")),
        "order": csv_values(F.col("order_category_ids")),
        "pay": csv_values(F.col("pay_category_ids")),
    }
    def tag(kind: str):
        return lambda x: F.struct(x.try_cast("bigint").alias("category_id"), F.lit(kind).alias("kind"))

    tagged = F.concat(*(F.transform(v, tag(k)) for k, v in ids.items()))
    return actions.select(F.explode(tagged).alias("e")).select("e.*").where("category_id IS NOT NULL")


def category_universe(actions: DataFrame) -> DataFrame:
    return category_events(actions).select("category_id").distinct()


def category_counts(actions: DataFrame) -> DataFrame:
    """click_count, order_count and pay_count of every category; 0 where there are none. One pass and one shuffle."""
    return category_events(actions).groupBy("category_id").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in KINDS))


def top_categories(counts: DataFrame, n: int = 10) -> DataFrame:
    """By clicks, then orders, then payments, then the smaller id."""
    return counts.orderBy(*(F.desc(f"{k}_count") for k in KINDS), F.asc("category_id")).limit(n)


def session_category_clicks(actions: DataFrame) -> DataFrame:
    clicked = actions.where(F.col("click_category_id").isNotNull())
    return clicked.groupBy(F.col("click_category_id").alias("category_id"), "session_id").agg(F.count("*").alias("click_count"))


def top_sessions(actions: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """For each of the categories the n sessions with most clicks, ties by the smaller session_id."""
    clicks = session_category_clicks(actions).join(categories.select("category_id"), "category_id", "left_semi")
    order = W.partitionBy("category_id").orderBy(F.desc("click_count"), F.asc("session_id"))
    return clicks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def top_session_details(actions: DataFrame, top: DataFrame) -> DataFrame:
    """The actions of top sessions, once for each category that a session is top in."""
    return actions.join(top.select("category_id", "session_id"), "session_id")
