"""Page funnel: one-step conversion along a flow of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillway.functions.predicates import ratio
from rillway.operators.sessions import in_time


def flow_steps(spark: SparkSession, flow: tuple[int, ...]) -> DataFrame:
    """step (from 1), page_from, page_to and the split's name; as many rows as the flow has steps. A flow of fewer than two pages is an error."""
    if len(flow or ()) < 2:
        raise ValueError("a funnel needs a flow of at least two pages")
    rows = [(k, a, b, f"{a}_{b}") for k, (a, b) in enumerate(zip(flow, flow[1:]), 1)]
    return spark.createDataFrame(rows, "step int, page_from long, page_to long, split string")


def page_splits(actions: DataFrame) -> DataFrame:
    """Consecutive pages of a session by time: page_from and page_to. At the same time the order is that of in_time."""
    order = W.partitionBy("session_id").orderBy(*in_time(actions))
    pairs = actions.select("session_id", F.col("page_id").alias("page_from"), F.lead("page_id").over(order).alias("page_to"))
    return pairs.where(F.col("page_to").isNotNull())


def split_counts(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    """How often each step of the flow was taken; steps never taken have 0."""
    steps = flow_steps(actions.sparkSession, flow)
    taken = page_splits(actions).groupBy("page_from", "page_to").agg(F.count("*").alias("pv"))
    return steps.join(taken, ["page_from", "page_to"], "left").select("step", "split", F.coalesce("pv", F.lit(0)).cast("long").alias("pv"))


def start_page_views(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    """One row: all views of the flow's first page."""
    return actions.agg(F.count_if(F.col("page_id") == F.lit(flow[0])).alias("start_pv"))


def conversion_rates(actions: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    """step, split, pv, rate: views of the step over those of the step before, the start page's for the first; null over 0."""
    counts = split_counts(actions, flow)
    start = start_page_views(actions, flow).select(F.lit(0).alias("step"), F.lit("").alias("split"), F.col("start_pv").alias("pv"))
    order = W.orderBy("step")  # as many rows as the flow has pages
    return counts.union(start).withColumn("before", F.lag("pv").over(order)).where("step > 0").select("step", "split", "pv", ratio(F.col("pv"), F.col("before")).alias("rate"))


def conversion_text(rates: DataFrame) -> DataFrame:
    """One row: the rates in flow order as split=rate items."""
    item = F.concat(F.col("split"), F.lit("="), F.when(F.col("rate").isNotNull(), F.format_string("%.2f", F.col("rate"))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct(F.col("step"), item.alias("item"))))
    return rates.agg(F.array_join(F.transform(listed, lambda x: x["item"]), "|").alias("convert_rate"))
