"""Schemas of the logical input tables."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_L, _S, _I = LongType(), StringType(), IntegerType()

USER_VISIT_ACTION = _table(
    date=_S, user_id=_L, session_id=_S, page_id=_L, action_time=_S, search_keyword=_S, click_category_id=_L, click_product_id=_L,
    order_category_ids=_S, order_product_ids=_S, pay_category_ids=_S, pay_product_ids=_S, city_id=_L,
)
USER_INFO = _table(user_id=_L, username=_S, name=_S, age=_I, professional=_S, city=_S, sex=_S)
PRODUCT_INFO = _table(product_id=_L, product_name=_S, extend_info=_S)
CITY_INFO = _table(city_id=_L, city_name=_S, area=_S)
AD_BLACKLIST = _table(user_id=_L)
DATA_SOURCE = _table(id=_I, url=_S, datasource_type=_I, target_table=_S, username=_S, source_table=_S, password=_S)
