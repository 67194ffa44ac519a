"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.staging import discard, stage


def components(links: DataFrame) -> DataFrame:
    """id, component for every end of the links (a long, b long): component is the smallest id reached.

    Alternates two steps until nothing changes. Large star: each node ties its larger neighbours to its smallest
    neighbour or itself. Small star: each node ties its smaller neighbours to the smallest. Each round halves paths,
    so rounds are few; a node with many neighbours is only ever a key of a minimum, which is pre-aggregated, and of a
    join, whose large side can be split. Rounds are cut off by staged tables.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(both, "links")
    while True:
        around = now.select("a", "b").union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        # minima are staged before they are joined: so both sides are dealt anew, and a hub's links can be split
        least = stage(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        starred = stage(large, "links")
        lower = stage(starred.groupBy("a").agg(F.min("b").alias("m")), "least")
        tied = starred.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stage(tied.union(lower.select("a", F.col("m").alias("b"))).distinct(), "links")
        # done when every node has one link and what it links to has none
        heads = small.select(F.col("b").alias("a")).distinct()
        several = small.groupBy("a").count().where("count > 1").select("a")
        open_ends = small.select("a").join(heads, "a", "left_semi").select("a").union(several).limit(1).count()
        discard(now, starred, least, lower)
        now = small
        if not open_ends:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
