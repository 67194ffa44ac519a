"""Regional product rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillway.functions.text import concat_long_string, group_concat_distinct

# Levels of areas.
AREA_LEVELS = {"东北": "A级", "华东": "A级", "华南": "B级", "华中": "B级", "西北": "C级", "西南": "C级"}
OTHER_LEVEL = "D级"
# Names of product states.
OWN_PRODUCT, OTHER_PRODUCT = "自营商品", "第三方商品"


def product_clicks(actions: DataFrame) -> DataFrame:
    """city_id and product_id of clicks on a product."""
    return actions.where(F.col("click_product_id").isNotNull()).select("city_id", F.col("click_product_id").alias("product_id"))


def with_cities(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    return clicks.join(cities.select("city_id", "city_name", "area"), "city_id")


def area_clicks(located: DataFrame) -> DataFrame:
    """Clicks of each area on each product, with the cities they came from as id:name, distinct and in order."""
    city = concat_long_string(F.col("city_id"), F.col("city_name"), ":")
    return located.groupBy("area", "product_id").agg(F.count("*").alias("click_count"), group_concat_distinct(city).alias("city_infos"))


def area_level(area: Column, levels: dict[str, str] = AREA_LEVELS, other: str = OTHER_LEVEL) -> Column:
    out = F
    for name, level in levels.items():
        out = out.when(area == name, F.lit(level))
    return out.otherwise(F.lit(other)) if levels else F.lit(other)


def product_status(extend_info: Column) -> Column:
    """The seller's kind from the JSON text; anything but status 0, malformed text included, is another's product."""
    status = F.get_json_object(extend_info, "$.product_status")
    return F.when(F.coalesce(status == "0", F.lit(False)), F.lit(OWN_PRODUCT)).otherwise(F.lit(OTHER_PRODUCT))


def with_products(counts: DataFrame, products: DataFrame) -> DataFrame:
    chosen = products.select("product_id", "product_name", product_status(F.col("extend_info")).alias("product_status"))
    return counts.join(chosen, "product_id")


def top_products(counts: DataFrame, n: int = 3) -> DataFrame:
    """Each area's n most clicked products, ties by the smaller product_id."""
    order = W.partitionBy("area").orderBy(F.desc("click_count"), F.asc("product_id"))
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def area_top_products(clicks: DataFrame, cities: DataFrame, products: DataFrame, n: int = 3, levels: dict[str, str] = AREA_LEVELS) -> DataFrame:
    ranked = top_products(with_products(area_clicks(with_cities(clicks, cities)), products), n)
    return ranked.withColumn("area_level", area_level(F.col("area"), levels))
