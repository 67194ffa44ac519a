import pytest

from rillway.plans.catalogue import QUERIES, SQL
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir, duck):
    same_rows(QUERIES[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_reaches_the_scan(spark, sf_dir):
    from rillway.operators import sessions
    from rillway.plans import adapters

    plan = plan_of(sessions.actions_between(adapters.actions(spark, sf_dir), "2024-01-05", "2024-01-12").select("user_id"))
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan and "LessThan(ts,2024-01-13" in plan


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from rillway.plans import adapters

    clicks = adapters.table(spark, sf_dir, "events").where(F.col("event_type") == "click").select("user_id")
    plan = plan_of(clicks)
    assert "EqualTo(event_type,click)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_sessions_are_aggregated_once_for_an_extract(spark, sf_dir):
    plan = plan_of(QUERIES["session_random_extract"](spark, sf_dir))
    assert "collect_set" not in plan
