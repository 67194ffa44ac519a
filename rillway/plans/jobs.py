"""Whole jobs: all results of a task, and their writing."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.operators import categories, funnel, products, sessions
from rillway.params import TaskParams, task_params
from rillway.sinks import append, with_task


@contextmanager
def session_job(actions: DataFrame, users: DataFrame, params: TaskParams, extract: int = 100, n: int = 10):
    """The results of a session task by table name.

    Filtered sessions are what all results share; they are kept in memory, beyond it on disk, for as long as the
    block lasts. Their actions are found by a semi join, which needs no such copy.
    """
    kept = sessions.filtered_sessions(actions, users, params).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        wanted = sessions.actions_between(actions, params.start_date, params.end_date)
        detail = sessions.session_details(wanted, kept)
        drawn = sessions.extract_sessions(kept, extract)
        top = categories.top_categories(categories.category_counts(detail), n)
        best = categories.top_sessions(detail, top, n)
        yield {
            "session_aggr_stat": sessions.session_statistics(kept),
            "session_random_extract": drawn.select("session_id", "start_time", "search_keywords", "click_category_ids"),
            "session_detail": sessions.session_details(detail, drawn),
            "top10_category": top,
            "top10_session": best.select("category_id", "session_id", "click_count"),
            "top10_session_detail": categories.top_session_details(detail, best),
        }
    finally:
        kept.unpersist()


def funnel_job(actions: DataFrame, params: TaskParams) -> dict[str, DataFrame]:
    wanted = sessions.actions_between(actions, params.start_date, params.end_date)
    return {"page_split_convert_rate": funnel.conversion_text(funnel.conversion_rates(wanted, params.target_page_flow or ()))}


def product_job(actions: DataFrame, cities: DataFrame, goods: DataFrame, params: TaskParams, n: int = 3) -> dict[str, DataFrame]:
    wanted = sessions.actions_between(actions, params.start_date, params.end_date)
    return {"area_top3_product": products.area_top_products(products.product_clicks(wanted), cities, goods, n)}


def save(results: dict[str, DataFrame], folder: str, task_id: int, kind: str = "parquet") -> None:
    """Adds each result, with the task's id, to its table in the folder."""
    for name, df in results.items():
        append(with_task(df, task_id), f"{folder.rstrip('/')}/{name}", kind)


#: Kinds of task, as a task table names them.
SESSION, FUNNEL, PRODUCT = "session", "funnel", "product"


def run_task(tasks: DataFrame, task_id: int, tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> list[str]:
    """Runs the job of a task and writes its results; returns their names.

    tasks has task_id, task_type and task_param; tables are user_visit_action and, for the kinds that need them,
    user_info, product_info and city_info. An unknown id or kind, and a funnel without a flow, are errors.
    """
    params = task_params(tasks, task_id)
    wanted = tasks.where(F.col("task_id") == task_id).first()["task_type"]
    actions = tables["user_visit_action"]
    if wanted == SESSION:
        with session_job(actions, tables["user_info"], params) as results:
            save(results, folder, task_id, kind)
    elif wanted == FUNNEL:
        save(results := funnel_job(actions, params), folder, task_id, kind)
    elif wanted == PRODUCT:
        save(results := product_job(actions, tables["city_info"], tables["product_info"], params), folder, task_id, kind)
    else:
        raise ValueError(f"task {task_id} is of the unknown kind {wanted}")
    return sorted(results)
