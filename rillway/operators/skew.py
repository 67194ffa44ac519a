"""Explicit means against skew. Partial aggregation and adaptive execution do most of this by themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _salt(df: DataFrame, salts: int, by: list[str]) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")


def salted_count(df: DataFrame, key: str, by: list[str], salts: int = 10) -> DataFrame:
    """Rows of each key, counted by key and salt first. by: columns whose hash is the salt."""
    partial = df.groupBy(key, _salt(df, salts, by).alias("salt")).agg(F.count("*").alias("n"))
    return partial.groupBy(key).agg(F.sum("n").alias("n"))


def salted_concat_distinct(df: DataFrame, key: str, value: str, by: list[str], salts: int = 10, separator: str = ",") -> DataFrame:
    """The distinct values of each key in order and joined, collected by key and salt first."""
    partial = df.groupBy(key, _salt(df, salts, by).alias("salt")).agg(F.collect_set(F.col(value).cast("string")).alias("some"))
    joined = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some")))), separator)
    return partial.groupBy(key).agg(joined.alias("joined"))


def salted_join(facts: DataFrame, dimension: DataFrame, key: str, by: list[str], salts: int = 10) -> DataFrame:
    """An inner join in which each row of the dimension stands once for each salt, so a hot key is several."""
    left = facts.withColumn("salt", _salt(facts, salts, by))
    right = dimension.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "salt"]).drop("salt")


#: Bytes up to which a side is broadcast on demand.
BROADCAST_BYTES = 20 * 1024 * 1024


def broadcast_join(facts: DataFrame, dimension: DataFrame, key: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """An inner join that broadcasts the dimension if its estimated size is within most bytes; else Spark chooses."""
    size = int(str(dimension._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return facts.join(F.broadcast(dimension) if size <= most else dimension, key)


def skewed_keys(df: DataFrame, key: str, by: list[str], fraction: float = 0.1, n: int = 1) -> DataFrame:
    """The n keys with most rows in a sample: the rows the md5 of whose columns by is in the lowest fraction, so a repeated task draws the same."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in by))), 1, 8), 16, 10).cast("long") < int(fraction * 2**32)
    return df.where(drawn).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)


def isolated_join(facts: DataFrame, dimension: DataFrame, key: str, hot: list, by: list[str], salts: int = 10) -> DataFrame:
    """An inner join in which only the named hot keys are salted."""
    is_hot = F.col(key).isin(hot)
    rest = facts.where(~is_hot).join(dimension.where(~is_hot), key)
    return rest.unionByName(salted_join(facts.where(is_hot), dimension.where(is_hot), key, by, salts))
