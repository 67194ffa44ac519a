"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def is_not_empty(c: Column) -> Column:
    return ~is_empty(c)


def trim_comma(c: Column) -> Column:
    """Without one leading and one trailing comma."""
    return F.regexp_replace(c, r"^,|,\z", "")


def two_digits(c: Column) -> Column:
    """A text of two characters as it is, any other with a zero before it."""
    return F.when(F.length(c) == 2, c).otherwise(F.concat(F.lit("0"), c))


def csv_values(c: Column) -> Column:
    """The non-empty values of a comma separated text; no values for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")


def _items(c: Column, delimiter: str) -> Column:
    return F.split(c, "\\Q" + delimiter + "\\E")


def get_field(c: Column, field: str, delimiter: str = "|") -> Column:
    """The value of the first item field=value; null if there is none, if the value is empty or holds a further '='."""
    pairs = F.transform(_items(c, delimiter), lambda x: F.split(x, "="))
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & (p[0] == field) & (F.get(p, 1) != ""))
    return F.get(F.get(good, 0), 1)


def set_field(c: Column, field: str, value: Column | str, delimiter: str = "|") -> Column:
    """The text with the value of the first item of that name replaced; unchanged without one."""
    items = _items(c, delimiter)
    place = F.array_position(F.transform(items, lambda x: F.split(x, "=")[0]), field)
    new = F.concat(F.lit(field + "="), F.lit(value) if isinstance(value, str) else value)
    return F.array_join(F.transform(items, lambda x, i: F.when(i + 1 == place, new).otherwise(x)), delimiter)


def concat_long_string(number: Column, text: Column, separator: str) -> Column:
    """number, separator and text in one; nulls are written as 'null'."""
    shown = [F.coalesce(x.cast("string"), F.lit("null")) for x in (number, text)]
    return F.concat(shown[0], F.lit(separator), shown[1])


def group_concat_distinct(c: Column, separator: str = ",") -> Column:
    """An aggregate: the distinct values in order, joined; empty if all are null."""
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), separator)


def salt_prefix(c: Column, salts: int, *by: Column) -> Column:
    """The text behind a number below salts and an underscore. The number is a hash, so a repeated task finds the same."""
    return F.concat(F.pmod(F.xxhash64(c, *by), F.lit(salts)).cast("string"), F.lit("_"), c)


def without_prefix(c: Column) -> Column:
    """What follows the first underscore."""
    return c.substr(F.instr(c, "_") + 1, F.length(c))


SQL_FUNCTIONS = {
    "concat_long_string": "(number BIGINT, value STRING, separator STRING) RETURNS STRING RETURN concat(coalesce(cast(number AS STRING), 'null'), separator, coalesce(value, 'null'))",
    "random_prefix": "(value STRING, salts INT) RETURNS STRING RETURN concat(cast(pmod(xxhash64(value), salts) AS STRING), '_', value)",
    "remove_random_prefix": "(value STRING) RETURNS STRING RETURN substring(value, instr(value, '_') + 1)",
    "trim_comma": "(value STRING) RETURNS STRING RETURN regexp_replace(value, '^,|,\\\\z', '')",
}


def register_sql_functions(spark) -> None:
    """Makes the functions known to SQL under their names, as expressions that the optimiser sees through."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
