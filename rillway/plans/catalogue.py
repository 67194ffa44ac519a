"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway import embedded, schemas
from rillway.functions import predicates as p
from rillway.functions import text as x
from rillway.functions import time as t
from rillway.operators import ads, categories, funnel, products, sessions, skew
from rillway.params import TaskParams
from rillway.plans import adapters as a
from rillway.plans import jobs
from rillway.plans import sql as s
from rillway.session import scratch
from rillway.sinks import BatchedTable, DatedTable, VersionedTable, append, replace_groups, upsert_jdbc
from rillway.sources import logs, registry, streams
from rillway.sources.mock import mock_tables
from rillway.streaming import ads as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The task that session queries run with.
_TASK_TEXT = '{"startDate":["2024-01-03"],"endDate":["2024-01-25"],"startAge":["5"],"endAge":["50"],"keywords":["kw1,kw2,kw3,kw4"],"sex":["male"]}'
TASK = TaskParams.from_json(_TASK_TEXT)
FLOW = (1, 2, 3, 4)
EXTRACT_TARGET = 3000
DAILY_LIMIT = 2
#: Levels of the areas that the tables have.
LEVELS = {"ASIA": "A级", "EUROPE": "A级", "AMERICA": "B级", "AFRICA": "C级"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    return sessions.filtered_sessions(a.actions(spark, d), a.users(spark, d), TASK)


def _shown(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as text, so that any engine shows them alike."""
    return df.withColumns({c: t.format_time(F.col(c)) for c in names})


_SESSION = ("session_id", "user_id", "search_keywords", "click_category_ids", "start_time", "end_time", "visit_length", "step_length")


# Sessions


@query(s.DATE_RANGE_SCAN)
def date_range_scan(spark, d):
    found = sessions.actions_between(a.actions(spark, d), "2024-01-05", "2024-01-12")
    return found.select("action_id", "date", "user_id", "session_id", "page_id", "search_keyword", "click_category_id", "order_category_ids", "pay_category_ids", "city_id")


@query(s.SESSION_AGGREGATE)
def session_aggregate(spark, d):
    return _shown(sessions.aggregate_sessions(a.actions(spark, d)).select(*_SESSION), "start_time", "end_time")


@query(s.SESSION_USER_JOIN)
def session_user_join(spark, d):
    joined = sessions.with_users(sessions.aggregate_sessions(a.actions(spark, d)), a.users(spark, d))
    return joined.select("session_id", "user_id", "visit_length", "step_length", "age", "professional", "city", "sex")


@query(s.SESSION_FILTER)
def session_filter(spark, d):
    return _filtered(spark, d).select("session_id", "user_id", "age", "sex", "search_keywords", "visit_length", "step_length")


@query(s.SESSION_AGGR_STAT)
def session_aggr_stat(spark, d):
    return sessions.session_statistics(_filtered(spark, d))


@query(s.SESSION_DETAIL)
def session_detail(spark, d):
    found = sessions.session_details(a.actions(spark, d), _filtered(spark, d))
    return _shown(found.select("action_id", "session_id", "page_id", "action_time", "search_keyword", "click_category_id", "click_product_id", "order_category_ids", "pay_category_ids"), "action_time")


def _extracted(spark, d):
    return sessions.extract_sessions(sessions.aggregate_sessions(a.actions(spark, d)), EXTRACT_TARGET)


@query(s.SESSION_RANDOM_EXTRACT)
def session_random_extract(spark, d):
    return _shown(_extracted(spark, d).select("session_id", "date", "hour", "start_time", "search_keywords", "click_category_ids"), "start_time")


@query(s.SESSION_EXTRACT_DETAIL)
def session_extract_detail(spark, d):
    return sessions.session_details(a.actions(spark, d), _extracted(spark, d)).select("action_id", "session_id", "page_id")


@query(s.SESSION_CONCAT)
def session_concat(spark, d):
    return sessions.user_concat(sessions.aggregate_sessions(a.actions(spark, d)))


@query(s.SESSION_GAPS)
def session_gaps(spark, d):
    return sessions.sessions_by_gap(a.actions(spark, d)).select("action_id", "user_id", "gap_session")


# Categories


@query(s.CATEGORY_UNIVERSE)
def category_universe(spark, d):
    return categories.category_universe(a.actions(spark, d))


@query(s.CATEGORY_COUNTS)
def category_counts(spark, d):
    return categories.category_counts(a.actions(spark, d))


def _top_categories(spark, d):
    return categories.top_categories(categories.category_counts(a.actions(spark, d)))


@query(s.TOP10_CATEGORY)
def top10_category(spark, d):
    return _top_categories(spark, d)


@query(s.SESSION_CATEGORY_CLICKS)
def session_category_clicks(spark, d):
    return categories.session_category_clicks(a.actions(spark, d))


def _top_sessions(spark, d):
    return categories.top_sessions(a.actions(spark, d), _top_categories(spark, d))


@query(s.TOP10_SESSION)
def top10_session(spark, d):
    return _top_sessions(spark, d).select("category_id", "session_id", "click_count", "place")


@query(s.TOP10_SESSION_DETAIL)
def top10_session_detail(spark, d):
    return categories.top_session_details(a.actions(spark, d), _top_sessions(spark, d)).select("category_id", "session_id", "action_id", "page_id")


# Funnel


@query(s.PAGE_SPLIT_PV)
def page_split_pv(spark, d):
    return funnel.split_counts(a.actions(spark, d), FLOW)


@query(s.PAGE_START_PV)
def page_start_pv(spark, d):
    return funnel.start_page_views(a.actions(spark, d), FLOW)


@query(s.PAGE_CONVERT_RATE)
def page_convert_rate(spark, d):
    return funnel.conversion_rates(a.actions(spark, d), FLOW)


@query(s.PAGE_CONVERT_STRING)
def page_convert_string(spark, d):
    return funnel.conversion_text(funnel.conversion_rates(a.actions(spark, d), FLOW))


@query(s.PAGE_SPLIT_LOGICAL)
def page_split_logical(spark, d):
    """The funnel over the columns of the logical schema alone, which has no number of an action."""
    known = a.actions(spark, d)
    return funnel.split_counts(known.select(*[c for c in schemas.USER_VISIT_ACTION.names if c in known.columns]), FLOW)


# Products


@query(s.PRODUCT_CLICK_SCAN)
def product_click_scan(spark, d):
    return products.product_clicks(sessions.actions_between(a.actions(spark, d), "2024-01-05", "2024-01-12"))


@query(s.CLICK_CITY_JOIN)
def click_city_join(spark, d):
    return products.with_cities(a.product_clicks(spark, d), a.cities(spark, d))


@query(s.AREA_PRODUCT_CLICKS)
def area_product_clicks(spark, d):
    return products.area_clicks(products.with_cities(a.product_clicks(spark, d), a.cities(spark, d)))


@query(s.AREA_LEVEL)
def area_level(spark, d):
    return a.cities(spark, d).select("city_id", "area", products.area_level(F.col("area"), LEVELS).alias("area_level"))


@query(s.PRODUCT_STATUS)
def product_status(spark, d):
    return a.products(spark, d).select("product_id", products.product_status(F.col("extend_info")).alias("product_status"))


@query(s.AREA_TOP3_PRODUCT)
def area_top3_product(spark, d):
    found = products.area_top_products(a.product_clicks(spark, d), a.cities(spark, d), a.products(spark, d), 3, LEVELS)
    return found.select("area", "area_level", "product_id", "city_infos", "click_count", "product_name", "product_status", "place")


# Skew


@query(s.SALTED_COUNT)
def salted_count(spark, d):
    return skew.salted_count(a.table(spark, d, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber"])


@query(s.SALTED_GROUP_CONCAT)
def salted_group_concat(spark, d):
    located = products.with_cities(a.product_clicks(spark, d), a.cities(spark, d))
    return skew.salted_concat_distinct(located, "area", "city_name", ["product_id"])


@query(s.SALTED_JOIN)
def salted_join(spark, d):
    joined = skew.salted_join(a.product_clicks(spark, d), a.cities(spark, d), "city_id", ["product_id"])
    return joined.groupBy("area", "city_name").agg(F.count("*").alias("click_count"))


@query(s.SALTED_JOIN)
def isolated_join(spark, d):
    joined = skew.isolated_join(a.product_clicks(spark, d), a.cities(spark, d), "city_id", [0, 1], ["product_id"])
    return joined.groupBy("area", "city_name").agg(F.count("*").alias("click_count"))


@query(s.SALTED_JOIN)
def broadcast_join(spark, d):
    joined = skew.broadcast_join(a.product_clicks(spark, d), a.cities(spark, d), "city_id")
    return joined.groupBy("area", "city_name").agg(F.count("*").alias("click_count"))


@query(s.SKEW_KEY_SAMPLE)
def skew_key_sample(spark, d):
    return skew.skewed_keys(a.table(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber"], n=5)


@query(s.OBSERVED_COUNTS)
def observed_counts(spark, d):
    """The bucket counts as the side effect of another action."""
    same, side = sessions.observed(_filtered(spark, d))
    same.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([side.get], ", ".join(f"{k} long" for k in side.get))


# Functions


@query(s.CONCAT_LONG_STRING)
def concat_long_string(spark, d):
    c = a.cities(spark, d)
    return c.select("city_id", x.concat_long_string(F.col("city_id"), F.col("city_name"), ":").alias("info"))


@query(s.GROUP_CONCAT_DISTINCT)
def group_concat_distinct(spark, d):
    return a.users(spark, d).groupBy("city").agg(x.group_concat_distinct(F.col("professional")).alias("professionals"))


@query(s.RANDOM_PREFIX_ROUNDTRIP)
def random_prefix_roundtrip(spark, d):
    salted = a.cities(spark, d).withColumn("salted", x.salt_prefix(F.col("city_name"), 10))
    prefix = F.substring_index("salted", "_", 1).try_cast("int")
    return salted.select("city_id", x.without_prefix(F.col("salted")).alias("city_name"), prefix.between(0, 9).alias("in_range"))


@query(s.CONCAT_LONG_STRING)
def sql_functions(spark, d):
    x.register_sql_functions(spark)
    return a.cities(spark, d).selectExpr("city_id", "concat_long_string(city_id, remove_random_prefix(random_prefix(city_name, 10)), ':') AS info")


@query(s.DAY_FUNCTIONS)
def day_functions(spark, d):
    on = datetime.date(2024, 3, 1)
    price = F.col("o_totalprice") / 7
    shown = t.format_date(t.today(on)).alias("today"), t.format_date(t.yesterday(on)).alias("yesterday")
    return a.table(spark, d, "orders").select("o_orderkey", *shown, (t.today() >= t.yesterday()).alias("in_order"), p.round_half_up(F.floor(price * 1000) / 1000 + 0.00025, 2).alias("price"))


@query(s.STRING_FUNCTIONS)
def string_functions(spark, d):
    people = a.users(spark, d)
    record = F.concat(F.lit("name="), "name", F.lit("|empty=|segment="), "professional", F.lit("|odd=1=2|age="), F.col("age").cast("string"))
    listed = F.concat(F.lit(","), F.col("age").cast("string"), F.lit(",,"), F.col("sex"), F.lit(","))
    return people.select(
        "user_id", x.get_field(record, "segment").alias("segment"), x.get_field(record, "empty").alias("empty"), x.get_field(record, "odd").alias("odd"), x.get_field(record, "none").alias("missing"),
        x.set_field(record, "segment", "X").alias("replaced"), x.trim_comma(listed).alias("trimmed"), x.two_digits(F.col("age").cast("string")).alias("padded"),
        F.array_join(x.csv_values(listed), ";").alias("listed"), x.is_empty(x.get_field(record, "none")).alias("is_empty"), x.is_not_empty(F.col("sex")).alias("is_not_empty"),
    )


@query(s.DATE_FUNCTIONS)
def date_functions(spark, d):
    e = a.table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    now, then = t.format_time(ts), F.lit("2024-01-15 12:00:00")
    bad = F.when(F.col("event_id") % 3 == 0, F.lit("no time")).otherwise(now)
    return e.select(
        "event_id", t.date_hour(ts).alias("date_hour"), t.format_date(ts).alias("day"), now.alias("time"), t.format_date_key(ts).alias("date_key"), t.format_minute_key(ts).alias("minute_key"),
        t.before(bad, then).alias("is_before"), t.after(bad, then).alias("is_after"), t.minus_seconds(bad, then).alias("seconds"),
        F.date_format(t.parse_date_key(t.format_date_key(ts)), "yyyy-MM-dd").alias("parsed"), t.parse_time(bad).isNull().alias("is_bad"),
        t.format_time(t.from_epoch_millis(F.unix_millis(ts).cast("string"))).alias("from_millis"),
    )


@query(s.PREDICATE_FUNCTIONS)
def predicate_functions(spark, d):
    u = a.users(spark, d)
    return u.select(
        "user_id", p.within(F.col("age"), 10, 30).alias("in_range"), p.within(F.col("age"), 10, None).alias("open_range"), p.one_of(F.col("professional"), ["BUILDING", "MACHINERY"]).alias("is_one"),
        p.equals(F.col("sex"), "male").alias("is_male"), p.equals(F.when(F.col("age") > 30, F.col("sex")), "male").alias("null_fails"), p.ratio(F.col("age").cast("long"), F.lit(59).cast("long")).alias("share"),
    )


# Advertising


def _clicks(spark, d):
    return ads.parse_clicks(a.ad_lines(spark, d))


def _allowed(spark, d):
    return ads.without_blacklisted(_clicks(spark, d), a.blacklist(spark, d))


@query(s.AD_BLACKLIST_FILTER)
def ad_blacklist_filter(spark, d):
    return _shown(_allowed(spark, d).select("ts", "province", "city", "user_id", "ad_id"), "ts")


def _day(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(s.AD_USER_DAILY)
def ad_user_daily(spark, d):
    return _day(ads.user_daily_counts(_allowed(spark, d)))


@query(s.AD_BLACKLIST_GENERATE)
def ad_blacklist_generate(spark, d):
    return ads.blacklisted_users(ads.user_daily_counts(_clicks(spark, d)), DAILY_LIMIT)


@query(s.AD_STAT)
def ad_stat(spark, d):
    return _day(ads.city_counts(_allowed(spark, d)))


@query(s.AD_PROVINCE_TOP3)
def ad_province_top3(spark, d):
    return _day(ads.province_top(ads.city_counts(_allowed(spark, d))))


@query(s.AD_CLICK_TREND)
def ad_click_trend(spark, d):
    return ads.recent_trend(ads.minute_counts(_clicks(spark, d)), "1440 minutes")


# The same as streams over the table's files


def _stream(spark, d):
    return ads.parse_clicks(a.ad_lines(spark, d, streams.table_stream(spark, d, "events")))


def _counted(spark, d, count, keys, label, load=None, then=None):
    path = scratch(spark, label)
    result = DatedTable(spark, f"{path}/table")
    live.counted(_stream(spark, d), load, count, keys, result, f"{path}/checkpoint", then=then and then(f"{path}/top")).awaitTermination()
    return result, f"{path}/top"


def _listed(spark, d):
    """Reads the list anew whenever a batch comes."""
    return lambda: a.blacklist(spark, d)


@query(s.AD_BLACKLIST_FILTER)
def stream_ad_blacklist_filter(spark, d):
    path = scratch(spark, "allowed")
    result = BatchedTable(spark, f"{path}/table")
    live.allowed_clicks(_stream(spark, d), _listed(spark, d), result, f"{path}/checkpoint").awaitTermination()
    return _shown(result.read().select("ts", "province", "city", "user_id", "ad_id"), "ts")


@query(s.AD_USER_DAILY)
def stream_ad_user_daily(spark, d):
    return _day(_counted(spark, d, ads.user_daily_counts, live.DAILY, "daily", _listed(spark, d))[0].read())


@query(s.AD_USER_DAILY)
def stream_ad_user_daily_in_state(spark, d):
    """The same with Spark's state store, under a watermark."""
    path, keys = scratch(spark, "state"), live.DAILY
    result = DatedTable(spark, f"{path}/table")
    daily = live.in_state(_stream(spark, d), a.blacklist(spark, d), keys)
    live.start(daily, lambda batch, number: result.merge(batch, keys, number), f"{path}/checkpoint", "update").awaitTermination()
    return _day(result.read())


@query(s.AD_BLACKLIST_GENERATE)
def stream_ad_blacklist_generate(spark, d):
    return ads.blacklisted_users(_counted(spark, d, ads.user_daily_counts, live.DAILY, "generated")[0].read(), DAILY_LIMIT)


@query(s.AD_STAT)
def stream_ad_stat(spark, d):
    return _day(_counted(spark, d, ads.city_counts, live.CITY, "cities", _listed(spark, d))[0].read())


@query(s.AD_PROVINCE_TOP3)
def stream_ad_province_top3(spark, d):
    found = spark.read.parquet(_counted(spark, d, ads.city_counts, live.CITY, "top", _listed(spark, d), live.top_of_days)[1])
    return _day(found.withColumn("date", F.col("date").cast("string").cast("date")))


@query(s.AD_CLICK_TREND)
def stream_ad_click_trend(spark, d):
    return ads.recent_trend(_counted(spark, d, live.minutes_of, live.MINUTE, "trend")[0].read().drop("date"), "1440 minutes")


# Sources and sinks


@query(s.JSON_SOURCE)
def json_source(spark, d):
    path = scratch(spark, "nation-json")
    a.table(spark, d, "nation").write.json(path)
    registry.register(spark, [{"datasource_type": registry.JSON, "url": path, "target_table": "rw_nation_json"}])
    return spark.table("rw_nation_json").select("n_nationkey", "n_name", "n_regionkey")


@query(s.JSON_SOURCE)
def jdbc_source(spark, d):
    """By way of a database inside the driver."""
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    with embedded.database(spark) as url:
        append(a.table(spark, d, "nation"), url, "jdbc", dbtable="NATION", driver=driver)
        registry.register(spark, [{"datasource_type": registry.MYSQL, "url": url, "source_table": "NATION", "target_table": "rw_nation_jdbc", "driver": driver}])
    return spark.table("rw_nation_jdbc").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query(s.JSON_SOURCE)
def catalog_source(spark, d):
    """By way of a table that the session's catalog knows, and of registrations that are a table too."""
    a.table(spark, d, "nation").createOrReplaceTempView("rw_nation_known")
    path = scratch(spark, "registrations")
    rows = [(1, None, registry.HIVE, "rw_nation_again", None, "rw_nation_known", None)]
    spark.createDataFrame(rows, schemas.DATA_SOURCE).write.json(path)
    registry.register(spark, registry.registrations(spark.read.schema(schemas.DATA_SOURCE).json(path)))
    return spark.table("rw_nation_again").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query(s.MOCK_SOURCE)
def mock_source(spark, d):
    """What holds for the seeded tables, whatever their values."""
    made = mock_tables(spark)
    kinds = " + ".join(f"int({c} IS NOT NULL)" for c in ("search_keyword", "click_category_id", "order_category_ids", "pay_category_ids"))
    bad = {"user_visit_action": f"({kinds}) <> 1 OR page_id NOT BETWEEN 0 AND 9 OR date <> substring(action_time, 1, 10)", "user_info": "age NOT BETWEEN 0 AND 59 OR sex NOT IN ('male', 'female')", "product_info": "get_json_object(extend_info, '$.product_status') NOT IN ('0', '1')"}
    out = None
    for name, df in made.items():
        one = df.agg(F.lit(name).alias("name"), F.count_if(F.expr(bad[name])).alias("bad"), (F.count("*") > 0).alias("filled"))
        out = one if out is None else out.union(one)
    return out


@query(s.FEDERATED_JOIN)
def federated_join(spark, d):
    path = scratch(spark, "region-json")
    a.table(spark, d, "region").write.json(path)
    rows = [
        {"datasource_type": registry.JSON, "url": path, "target_table": "rw_region"},
        {"datasource_type": registry.PARQUET, "url": f"{d}/nation.parquet", "target_table": "rw_nation"},
        {"datasource_type": registry.PARQUET, "url": f"{d}/supplier.parquet", "target_table": "rw_supplier"},
    ]
    text = """SELECT r_name, n_name, count(*) AS suppliers FROM rw_region JOIN rw_nation ON n_regionkey = r_regionkey
              JOIN rw_supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_name"""
    return registry.federated(spark, rows, text)


@query(s.UPSERT_TABLE)
def upsert_table(spark, d):
    e = a.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    result = VersionedTable(spark, scratch(spark, "upsert"))
    result.upsert(e, ["user_id"], 0)
    result.upsert(e.where("user_id % 2 = 0").withColumn("n", -F.col("n")), ["user_id"], 1)
    return result.read()


@query(s.UPSERT_TABLE)
def upsert_jdbc_table(spark, d):
    """By way of a database inside the driver."""
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    e = a.table(spark, d, "events").groupBy(F.col("user_id").alias("USER_ID")).agg(F.count("*").alias("N"))
    with embedded.database(spark) as url:
        append(e.where("USER_ID % 4 <> 0 OR USER_ID IS NULL"), url, "jdbc", dbtable="COUNTS", **options)
        upsert_jdbc(e.where("USER_ID % 2 = 0").withColumn("N", -F.col("N")), url, "COUNTS", ["USER_ID"], **options)
        return registry.read_jdbc(spark, url, "COUNTS", **options).toDF("user_id", "n")


@query(s.UPSERT_TABLE)
def upsert_dated_table(spark, d):
    e = a.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("part_of", F.col("user_id") % 4)
    result = DatedTable(spark, scratch(spark, "dated"), "part_of")
    result.merge(e, ["user_id"], 0)
    result.merge(e.where("user_id % 2 = 0").withColumn("n", -F.col("n")), ["user_id"], 1)
    return result.read().select("user_id", "n")


@query(s.REPLACE_GROUPS)
def replace_group(spark, d):
    path = scratch(spark, "groups")
    e = a.table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    replace_groups(e, path, ["event_type"])
    replace_groups(e.where("event_type = 'click'").withColumn("n", -F.col("n")), path, ["event_type"])
    return spark.read.parquet(path).select("event_type", "user_id", "n")


@query(s.SESSION_JOB)
def session_task(spark, d):
    """A task found by its id in a table of tasks, its whole job, and what the job wrote."""
    tasks = spark.createDataFrame([(7, jobs.SESSION, _TASK_TEXT), (8, jobs.FUNNEL, '{"targetPageFlow":["1,2,3,4"]}')], "task_id long, task_type string, task_param string")
    path, tables = scratch(spark, "task"), {"user_visit_action": a.actions(spark, d), "user_info": a.users(spark, d)}
    for k in (7, 8):
        jobs.run_task(tasks, k, tables, path)
    stat = spark.read.parquet(f"{path}/session_aggr_stat").select("task_id", "session_count")
    return stat.join(spark.read.parquet(f"{path}/page_split_convert_rate").select("convert_rate"))  # a row each


@query(s.PUBLISHED_PARTITIONS)
def published_partitions(spark, d):
    """What a load says that it has published."""
    return spark.createDataFrame(_loaded(spark, d)[0].partitions, "d string, h string, m5 string")


@query(s.ORC_PARTITION_LOAD)
def orc_partition_load(spark, d):
    path = _loaded(spark, d)[1]
    return logs.read_partitions(spark, path).groupBy("d", "h", "m5").agg(F.count("*").alias("n"))


def _loaded(spark, d):
    path = scratch(spark, "log")
    e = a.table(spark, d, "events")
    e.select(F.concat_ws("\t", F.col("event_id").cast("string"), t.format_time(F.col("ts").cast("timestamp")), "event_type").alias("value")).write.text(f"{path}/in")
    ts = F.to_timestamp("time")
    done = logs.load_logs(spark, f"{path}/in", logs.delimited(["event_id", "time", "event_type"], "time"), ts, f"{path}/out")
    if not done.ok:
        raise RuntimeError(done.message)
    return done, f"{path}/out"
