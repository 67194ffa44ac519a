"""Sessions: aggregation of actions, users, filter, histograms, details and stratified extraction."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillway.functions.predicates import any_of, equals, one_of, ratio, within
from rillway.functions.text import group_concat_distinct
from rillway.functions.time import whole_seconds
from rillway.params import TaskParams
from rillway.session import staged

#: Buckets of visit length in seconds: label, least (included), most (included). 0 is in none.
VISIT_BUCKETS = (
    ("1s_3s", 1, 3), ("4s_6s", 4, 6), ("7s_9s", 7, 9), ("10s_30s", 10, 30), ("30s_60s", 31, 60),
    ("1m_3m", 61, 180), ("3m_10m", 181, 600), ("10m_30m", 601, 1800), ("30m", 1801, None),
)
#: Buckets of step length.
STEP_BUCKETS = (("1_3", 1, 3), ("4_6", 4, 6), ("7_9", 7, 9), ("10_30", 10, 30), ("30_60", 31, 60), ("60", 61, None))


def actions_between(actions: DataFrame, start_date: str | None, end_date: str | None) -> DataFrame:
    """Actions of the days from start_date to end_date, both included; a missing bound is open.

    date is the day of action_time. Where that is a timestamp its bounds are added, as they reach a scan of the raw
    time even if date is computed from it.
    """
    out, kind = actions, dict(actions.dtypes).get("action_time", "")
    timed = kind.startswith("timestamp")
    if start_date is not None:
        out = out.where(F.col("date") >= start_date)
        if timed:
            out = out.where(F.col("action_time") >= F.lit(start_date).cast(kind))
    if end_date is not None:
        out = out.where(F.col("date") <= end_date)
        if timed:
            after = datetime.date.fromisoformat(end_date) + datetime.timedelta(days=1)
            out = out.where(F.col("action_time") < F.lit(after.isoformat()).cast(kind))
    return out


def in_time(actions: DataFrame) -> list[str]:
    """The columns that order a user's actions: by time, then by number if they have one, then by page."""
    return [c for c in ("action_time", "action_id", "page_id") if c in actions.columns]


def aggregate_sessions(actions: DataFrame) -> DataFrame:
    """A row for each session: user, distinct keywords and clicked categories, start, end, visit length (s) and step length."""
    sets = {"keywords": F.collect_set("search_keyword"), "categories": F.collect_set(F.col("click_category_id").cast("string"))}
    sessions = actions.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"), *(F.array_sort(v).alias(k) for k, v in sets.items()),
        F.min("action_time").alias("start_time"), F.max("action_time").alias("end_time"), F.count("*").alias("step_length"),
    )
    return sessions.withColumns({
        "visit_length": (whole_seconds(F.col("end_time")) - whole_seconds(F.col("start_time"))).cast("long"),
        "search_keywords": F.array_join("keywords", ","), "click_category_ids": F.array_join("categories", ","),
    })


def with_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions of known users, with age, professional, city and sex. Spark broadcasts users if they are small enough."""
    return sessions.join(users.select("user_id", "age", "professional", "city", "sex"), "user_id")


def session_predicate(params: TaskParams) -> Column:
    """All conditions that params set."""
    return (
        within(F.col("age"), params.start_age, params.end_age)
        & one_of(F.col("professional"), params.professionals)
        & one_of(F.col("city"), params.cities)
        & equals(F.col("sex"), params.sex)
        & any_of(F.col("keywords"), params.keywords)
        & any_of(F.col("categories"), params.category_ids)
    )


def filter_sessions(sessions: DataFrame, params: TaskParams) -> DataFrame:
    return sessions.where(session_predicate(params))


def filtered_sessions(actions: DataFrame, users: DataFrame, params: TaskParams) -> DataFrame:
    """The sessions of the wanted days that pass the filter; the user conditions are applied before anything is aggregated twice."""
    return filter_sessions(with_users(aggregate_sessions(actions_between(actions, params.start_date, params.end_date)), users), params)


def _in_bucket(c: Column, low: int, high: int | None) -> Column:
    return c >= low if high is None else c.between(low, high)


def bucket_counts(sessions: DataFrame) -> DataFrame:
    """One row: session_count and the number of sessions in each bucket."""
    counts = [F.count_if(_in_bucket(F.col("visit_length"), low, high)).alias(f"visit_{label}") for label, low, high in VISIT_BUCKETS]
    counts += [F.count_if(_in_bucket(F.col("step_length"), low, high)).alias(f"step_{label}") for label, low, high in STEP_BUCKETS]
    return sessions.agg(F.count("*").alias("session_count"), *counts)


def observed(sessions: DataFrame, name: str = "session_buckets") -> tuple[DataFrame, Observation]:
    """sessions as they are, and the bucket counts as a side effect of the first action on them."""
    side = Observation(name)
    counts = [F.count("*").alias("session_count")]
    counts += [F.count_if(_in_bucket(F.col("visit_length"), low, high)).alias(f"visit_{label}") for label, low, high in VISIT_BUCKETS]
    counts += [F.count_if(_in_bucket(F.col("step_length"), low, high)).alias(f"step_{label}") for label, low, high in STEP_BUCKETS]
    return sessions.observe(side, *counts), side


def session_statistics(sessions: DataFrame) -> DataFrame:
    """One row: session_count and each bucket's share, rounded half up to two digits; null shares without sessions."""
    counts = bucket_counts(sessions)
    return counts.select("session_count", *(ratio(F.col(c), F.col("session_count")).alias(c) for c in counts.columns[1:]))


def session_details(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """The actions of the sessions."""
    return actions.join(sessions.select("session_id"), "session_id", "left_semi")


def extract_sessions(sessions: DataFrame, target: int = 100, seed: str = "") -> DataFrame:
    """A sample without replacement, stratified by day and hour of the session's start.

    Each day gives target div days sessions, each hour its share of them rounded down, at most what it has. Inside an
    hour sessions are taken by the md5 of seed and session_id. Quotas come from counts by hour, a table of a row for
    each hour, so no day is gathered; ranks beyond a day's number are cut off before the shuffle. The sessions, made of
    all actions, are written once, and both the counts and the ranks read that.
    """
    placed = staged(sessions.withColumns({"date": F.date_format("start_time", "yyyy-MM-dd"), "hour": F.date_format("start_time", "HH")}), "sessions")
    days = placed.select("date").distinct().count()
    per_day = target // days if days else 0
    by_hour = placed.groupBy("date", "hour").agg(F.count("*").alias("in_hour"))
    by_day = by_hour.groupBy("date").agg(F.sum("in_hour").alias("in_day"))
    share = F.floor(F.col("in_hour") * F.lit(per_day) / F.col("in_day"))
    quota = by_hour.join(by_day, "date").select("date", "hour", F.least(share, F.col("in_hour")).alias("quota"))
    order = W.partitionBy("date", "hour").orderBy(F.md5(F.concat(F.lit(seed), F.col("session_id"))), "session_id")
    ranked = placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_day)
    return ranked.join(quota, ["date", "hour"]).where(F.col("place") <= F.col("quota")).drop("place", "quota")


def sessions_by_gap(actions: DataFrame, minutes: int = 30) -> DataFrame:
    """An extra: actions with a session number by user that rises after a pause of more than so many minutes."""
    order = W.partitionBy("user_id").orderBy(*in_time(actions))
    pause = whole_seconds(F.col("action_time")) - whole_seconds(F.lag("action_time").over(order))
    return actions.withColumn("gap_session", F.sum(F.when(pause > minutes * 60, 1).otherwise(0)).over(order))


def user_concat(sessions: DataFrame) -> DataFrame:
    """A session as one text of field=value items, for consumers of that form."""
    fields = {"sessionid": "session_id", "searchKeywords": "search_keywords", "clickCategoryIds": "click_category_ids", "visitLength": "visit_length", "stepLength": "step_length"}
    item = [F.concat(F.lit(k + "="), F.col(v).cast("string")) for k, v in fields.items()]
    return sessions.select("session_id", F.concat_ws("|", *item).alias("aggregated"))


def keywords_by(actions: DataFrame, key: str) -> DataFrame:
    """The distinct keywords of each key as comma separated text."""
    return actions.groupBy(key).agg(group_concat_distinct(F.col("search_keyword")).alias("search_keywords"))
