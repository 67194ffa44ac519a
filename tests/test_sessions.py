import datetime

import pytest
from pyspark.sql import functions as F

from rillway.operators import categories, funnel, products, sessions, skew
from rillway.params import TaskParams, task_params
from rillway.plans import jobs
from rillway.sources.mock import mock_tables

ACTION = "date string, user_id long, session_id string, page_id long, action_time timestamp, action_id long, search_keyword string, click_category_id long, click_product_id long, order_category_ids string, pay_category_ids string, city_id long"
START = datetime.datetime(2024, 1, 1, 10)


def action(session, seconds=0, page=1, user=1, number=0, keyword=None, category=None, orders=None, pays=None, at=START):
    ts = at + datetime.timedelta(seconds=seconds)
    return (ts.date().isoformat(), user, session, page, ts, number, keyword, category, category, orders, pays, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, ACTION)


def statistics(spark, column, values):
    other = "step_length" if column == "visit_length" else "visit_length"
    rows = spark.createDataFrame([(v, 0) for v in values], f"{column} long, {other} long")
    return sessions.bucket_counts(rows).first().asDict()


def test_visit_buckets_at_their_edges(spark):
    edges = [0, 1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
    found = statistics(spark, "visit_length", edges)
    assert found["session_count"] == 18 and all(found[f"visit_{label}"] == 2 for label, _, high in sessions.VISIT_BUCKETS if high) and found["visit_30m"] == 1


def test_step_buckets_at_their_edges(spark):
    found = statistics(spark, "step_length", [1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61])
    assert all(found[f"step_{label}"] == 2 for label, _, high in sessions.STEP_BUCKETS if high) and found["step_60"] == 1


def test_aggregate(spark):
    rows = [action("s", 0, keyword="b"), action("s", 65, keyword="a"), action("s", 5, category=12), action("s", 7, category=2), action("s", 8, category=2)]
    row = sessions.aggregate_sessions(frame(spark, rows)).first()
    assert (row.visit_length, row.step_length, row.search_keywords, row.click_category_ids) == (65, 5, "a,b", "12,2")


def test_session_without_user_keyword_or_category(spark):
    made = sessions.aggregate_sessions(frame(spark, [action("s", user=None)]))
    row = made.first()
    assert (row.user_id, row.search_keywords, row.click_category_ids, row.visit_length) == (None, "", "", 0)
    users = spark.createDataFrame([(1, 20, "p", "c", "male")], "user_id long, age int, professional string, city string, sex string")
    assert sessions.with_users(made, users).count() == 0


def test_filter_ignores_missing_parameters(spark):
    rows = frame(spark, [action("s", keyword="kw1", category=12)])
    users = spark.createDataFrame([(1, 20, "p", "c", "male")], "user_id long, age int, professional string, city string, sex string")
    count = lambda **given: sessions.filtered_sessions(rows, users, TaskParams(**given)).count()
    assert count() == 1 and count(start_age=20, end_age=20) == 1 and count(start_age=21, end_age=30) == 0
    assert count(category_ids=("2",)) == 0 and count(category_ids=("12", "3")) == 1 and count(keywords=("kw",)) == 0 and count(sex="female") == 0


def test_statistics_of_nothing(spark):
    row = sessions.session_statistics(sessions.aggregate_sessions(frame(spark, []))).first()
    assert row.session_count == 0 and row.visit_1s_3s is None


def test_params():
    given = TaskParams.from_json('{"startAge":["10"],"cities":["a,b"],"keywords":["x","y"],"targetPageFlow":["1,2,3"]}')
    assert (given.start_age, given.end_age, given.cities, given.keywords, given.target_page_flow) == (10, None, ("a", "b"), ("x", "y"), (1, 2, 3))
    assert TaskParams.from_json(None) == TaskParams()


def test_task_lookup(spark):
    tasks = spark.createDataFrame([(1, '{"sex":["male"]}')], "task_id long, task_param string")
    assert task_params(tasks, 1).sex == "male"
    with pytest.raises(LookupError):
        task_params(tasks, 2)


def test_extraction_keeps_to_its_quotas(spark):
    rows = [action(f"d{d}h{h}s{s}", at=START.replace(hour=h) + datetime.timedelta(days=d)) for d in range(2) for h in range(3) for s in range(1 + 10 * h)]
    made = sessions.aggregate_sessions(frame(spark, rows))
    found = sessions.extract_sessions(made, 20).collect()
    assert len({r.session_id for r in found}) == len(found)
    by_hour = {(d, h): sum(r.session_id.startswith(f"d{d}h{h}") for r in found) for d in range(2) for h in range(3)}
    assert by_hour == {(d, h): min((1 + 10 * h) * 10 // 33, 1 + 10 * h) for d in range(2) for h in range(3)}
    assert sorted(r.session_id for r in found) == sorted(r.session_id for r in sessions.extract_sessions(made.repartition(3), 20).collect())


def test_extraction_over_more_days_than_the_target(spark):
    rows = [action(f"s{d}", at=START + datetime.timedelta(days=d)) for d in range(101)]
    assert sessions.extract_sessions(sessions.aggregate_sessions(frame(spark, rows)), 100).count() == 0


def test_categories(spark):
    rows = [action("s", category=1), action("s", orders="1,2,2,"), action("t", pays="3"), action("t", pays=None, orders="x")]
    counts = {r.category_id: (r.click_count, r.order_count, r.pay_count) for r in categories.category_counts(frame(spark, rows)).collect()}
    assert counts == {1: (1, 1, 0), 2: (0, 2, 0), 3: (0, 0, 1)}


def test_top_categories_with_ties_and_top_sessions_with_few(spark):
    rows = [action("b", category=9), action("a", category=9), action("a", category=3), action("b", category=3)]
    made = frame(spark, rows)
    top = categories.top_categories(categories.category_counts(made), 1)
    assert [r.category_id for r in top.collect()] == [3]
    best = categories.top_sessions(made, top)
    assert [(r.session_id, r.place) for r in best.orderBy("place").collect()] == [("a", 1), ("b", 2)]
    assert categories.top_session_details(made, best).count() == 4


def test_funnel(spark):
    rows = [action("s", 0, 1), action("s", 1, 2), action("s", 2, 3), action("t", 0, 1), action("t", 1, 3), action("u", 0, 1, number=1), action("u", 0, 2, number=2)]
    rates = funnel.conversion_rates(frame(spark, rows), (1, 2, 3, 4))
    assert [(r.split, r.pv, r.rate) for r in rates.orderBy("step").collect()] == [("1_2", 2, 0.67), ("2_3", 1, 0.5), ("3_4", 0, 0.0)]
    assert funnel.conversion_text(rates).first()[0] == "1_2=0.67|2_3=0.50|3_4=0.00"


def test_funnel_whose_start_nobody_sees(spark):
    rates = funnel.conversion_rates(frame(spark, [action("s", 0, 7)]), (1, 2, 3))
    assert [r.rate for r in rates.collect()] == [None, None]
    assert funnel.conversion_text(rates).first()[0] == "1_2=|2_3="


def test_products(spark):
    cities = spark.createDataFrame([(1, "上海", "华东"), (2, "北京", "华北")], "city_id long, city_name string, area string")
    goods = spark.createDataFrame([(p, f"p{p}", info) for p, info in enumerate(['{"product_status":0}', '{"product_status":1}', "{broken", "{}"])], "product_id long, product_name string, extend_info string")
    clicks = spark.createDataFrame([(1, p) for p in (3, 2, 1, 0)] + [(2, 0), (2, 0), (2, 9), (8, 0)], "city_id long, product_id long")
    found = {(r.area, r.place): (r.product_id, r.click_count, r.city_infos, r.product_status, r.area_level) for r in products.area_top_products(clicks, cities, goods).collect()}
    assert found == {
        ("华东", 1): (0, 1, "1:上海", "自营商品", "A级"), ("华东", 2): (1, 1, "1:上海", "第三方商品", "A级"), ("华东", 3): (2, 1, "1:上海", "第三方商品", "A级"),
        ("华北", 1): (0, 2, "2:北京", "自营商品", "D级"),
    }


def test_top_products_prune_before_the_shuffle(spark):
    counts = spark.range(10).selectExpr("string(id % 2) AS area", "id AS product_id", "id AS click_count")
    assert "WindowGroupLimit" in products.top_products(counts)._jdf.queryExecution().executedPlan().toString()


def test_salting_changes_nothing(spark):
    facts = spark.range(200).selectExpr("id", "id % 3 AS k")
    dimension = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k long, name string")
    plain = sorted(map(tuple, facts.join(dimension, "k").select("k", "id", "name").collect()))
    for joined in (skew.salted_join(facts, dimension, "k", ["id"]), skew.isolated_join(facts, dimension, "k", [1], ["id"]), skew.broadcast_join(facts, dimension, "k"), skew.broadcast_join(facts, dimension, "k", 0)):
        assert sorted(map(tuple, joined.select("k", "id", "name").collect())) == plain
    assert {r.k: r.n for r in skew.salted_count(facts, "k", ["id"]).collect()} == {0: 67, 1: 67, 2: 66}


def test_mock_tables_are_reproducible(spark):
    one, two = mock_tables(spark, seed=3), mock_tables(spark, seed=3)
    assert one["user_visit_action"].collect() == two["user_visit_action"].collect()
    kinds = F.expr("int(search_keyword IS NOT NULL) + int(click_category_id IS NOT NULL) + int(order_category_ids IS NOT NULL) + int(pay_category_ids IS NOT NULL)")
    assert one["user_visit_action"].where(kinds != 1).count() == 0


def test_session_job_writes_every_result(spark, tmp_path):
    made = mock_tables(spark, users=6, sessions=3, actions=20, seed=2)
    actions = made["user_visit_action"]
    with jobs.session_job(actions, made["user_info"], TaskParams(), extract=10) as results:
        jobs.save(results, f"file://{tmp_path}", 7)
    for name in results:
        rows = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert rows.count() > 0 and {r.task_id for r in rows.select("task_id").collect()} == {7}
    cities = spark.createDataFrame([(k, f"c{k}", "华东") for k in range(10)], "city_id long, city_name string, area string")
    found = jobs.product_job(actions, cities, made["product_info"], TaskParams())["area_top3_product"]
    assert found.count() == 3 and jobs.funnel_job(actions, TaskParams(target_page_flow=(1, 2)))["page_split_convert_rate"].count() == 1


def test_tasks_by_id(spark, tmp_path):
    made = mock_tables(spark, users=4, sessions=3, actions=20, seed=2)
    made["city_info"] = spark.createDataFrame([(k, f"c{k}", "华东") for k in range(10)], "city_id long, city_name string, area string")
    kinds = [(1, jobs.SESSION, None), (2, jobs.FUNNEL, '{"targetPageFlow":["1,2,3"]}'), (3, jobs.PRODUCT, None), (4, jobs.FUNNEL, None), (5, "other", None)]
    tasks = spark.createDataFrame(kinds, "task_id long, task_type string, task_param string")
    assert [len(jobs.run_task(tasks, k, made, f"file://{tmp_path}")) for k in (1, 2, 3)] == [6, 1, 1]
    for k, error in ((4, "flow"), (5, "unknown kind"), (6, "no task")):
        with pytest.raises((ValueError, LookupError), match=error):
            jobs.run_task(tasks, k, made, f"file://{tmp_path}")


def test_observed_counts_are_the_bucket_counts(spark):
    rows = spark.createDataFrame([(v, v) for v in (0, 2, 5, 70)], "visit_length long, step_length long")
    same, side = sessions.observed(rows)
    assert same.count() == 4 and side.get == sessions.bucket_counts(rows).first().asDict()
