import datetime

import pytest
from pyspark.sql import functions as F

from rillway.functions import predicates as p
from rillway.functions import text as x
from rillway.functions import time as t


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values()) or (0,)], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in given.items()) or "zero int")
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, field, found", [
    ("a=1|b=2", "b", "2"), ("a=1|a=2", "a", "1"), ("a=|b=2", "a", None), ("a=1=2|b=3", "a", None), ("a", "a", None), ("", "a", None), (None, "a", None),
])
def test_get_field(spark, text, field, found):
    assert value(spark, x.get_field(F.col("c"), field), c=text) == found


@pytest.mark.parametrize("text, expected", [("a=1|b=2|b=3", "a=1|b=X|b=3"), ("a=1", "a=1"), ("b=", "b=X")])
def test_set_field_changes_the_first(spark, text, expected):
    assert value(spark, x.set_field(F.col("c"), "b", "X"), c=text) == expected


@pytest.mark.parametrize("text, expected", [(",a,", "a"), (",,a,,", ",a,"), ("a", "a"), ("", "")])
def test_trim_comma(spark, text, expected):
    assert value(spark, x.trim_comma(F.col("c")), c=text) == expected


def test_small_text_functions(spark):
    assert value(spark, x.two_digits(F.col("c")), c="7") == "07"
    assert value(spark, x.two_digits(F.col("c")), c="12") == "12"
    assert value(spark, x.csv_values(F.col("c")), c="1,2,2,") == ["1", "2", "2"]
    assert value(spark, x.csv_values(F.col("c")), c=None) == []
    assert value(spark, x.is_empty(F.col("c")), c=None) is True
    assert value(spark, x.is_not_empty(F.col("c")), c="") is False
    assert value(spark, x.concat_long_string(F.col("n"), F.col("c"), ":"), n=3, c=None) == "3:null"
    assert value(spark, x.without_prefix(x.salt_prefix(F.col("c"), 10)), c="a_b") == "a_b"


def test_sets_keep_values_that_contain_each_other(spark):
    df = spark.createDataFrame([(12,), (2,), (2,), (None,)], "c long")
    assert df.agg(x.group_concat_distinct(F.col("c")).alias("v")).first()["v"] == "12,2"


def test_times(spark):
    now, bad = F.lit("2024-01-01 10:00:00"), F.lit("nothing")
    later = F.lit("2024-01-01 10:01:30")
    assert value(spark, t.before(now, later)) and not value(spark, t.before(bad, later)) and value(spark, t.after(later, now))
    assert value(spark, t.minus_seconds(later, now)) == 90 and value(spark, t.minus_seconds(bad, now)) == 0
    assert value(spark, t.parse_date_key(F.lit("20240105"))) == datetime.date(2024, 1, 5) and value(spark, t.parse_date_key(bad)) is None
    assert value(spark, t.yesterday(datetime.date(2024, 3, 1))) == datetime.date(2024, 2, 29)
    assert value(spark, t.date_hour(t.parse_time(now))) == "2024-01-01_10"
    assert value(spark, t.from_epoch_millis(F.lit("x"))) is None


def test_predicates_with_missing_parameters(spark):
    assert value(spark, p.within(F.col("c"), 1, None), c=None) is True
    assert value(spark, p.within(F.col("n"), 1, 3), n=3) is True and value(spark, p.within(F.col("n"), 1, 3), n=4) is False
    assert value(spark, p.within(F.col("c").cast("int"), 1, 3), c=None) is False
    assert value(spark, p.equals(F.col("c"), "a"), c=None) is False and value(spark, p.equals(F.col("c"), None), c=None) is True
    assert value(spark, p.one_of(F.col("c"), ["a", "b"]), c="b") is True and value(spark, p.any_of(F.split("c", ","), ["2"]), c="12,3") is False


@pytest.mark.parametrize("part, whole, expected", [(1, 3, 0.33), (2, 3, 0.67), (1, 8, 0.13), (57, 200, 0.29), (0, 5, 0.0), (1, 0, None)])
def test_ratio_rounds_half_up(spark, part, whole, expected):
    assert value(spark, p.ratio(F.col("a"), F.col("b")), a=part, b=whole) == expected


def test_sql_functions(spark):
    x.register_sql_functions(spark)
    row = spark.sql("SELECT concat_long_string(1, 'a', '-') AS a, remove_random_prefix(random_prefix('b_c', 10)) AS b, trim_comma(',d,') AS c, trim_comma(',a,\\n') AS d").first()
    assert tuple(row) == ("1-a", "b_c", "d", "a,\n")
