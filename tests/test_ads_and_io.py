import datetime
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from rillway import embedded, sinks
from rillway.operators import ads
from rillway.plans.catalogue import SQL
from rillway.sources import logs, registry, streams
from rillway.streaming import ads as live

MINUTE = 60_000
T0 = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp() * 1000)


def line(ms, province="P", city="C", user=1, ad=1):
    return f"{T0 + ms} {province} {city} {user} {ad}"


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_malformed_lines_go(spark):
    bad = ["", "x P C 1 1", f"{T0} P C 1", f"{T0} P C one 1", f"{T0} P C 1 1 1"]
    assert ads.parse_clicks(lines(spark, [*bad, line(0)])).count() == 1


def test_blacklist_and_top(spark):
    clicks = ads.parse_clicks(lines(spark, [line(0, ad=a, user=u) for a in (4, 3, 2, 1) for u in (1, 2)]))
    allowed = ads.without_blacklisted(clicks, spark.createDataFrame([(2,), (2,), (None,)], "user_id long"))
    top = ads.province_top(ads.city_counts(allowed)).orderBy("place").collect()
    assert [(r.ad_id, r.click_count) for r in top] == [(1, 1), (2, 1), (3, 1)]
    assert [r.user_id for r in ads.blacklisted_users(ads.user_daily_counts(clicks), 2).collect()] == []


def test_trend_at_minute_boundaries(spark):
    clicks = ads.parse_clicks(lines(spark, [line(0), line(MINUTE - 1), line(MINUTE), line(61 * MINUTE)]))
    found = sorted((r.hour, r.minute, r.click_count) for r in ads.recent_trend(ads.minute_counts(clicks)).collect())
    assert found == [("00", "01", 1), ("01", "01", 1)]


def test_late_clicks_are_dropped_by_the_watermark(spark, tmp_path):
    folder, result = tmp_path / "in", sinks.VersionedTable(spark, f"file://{tmp_path}/out")
    folder.mkdir()
    for k, values in enumerate(([line(0), line(300 * MINUTE)], [line(1)])):
        (folder / f"{k}.txt").write_text("\n".join(values) + "\n")
        clicks = ads.parse_clicks(streams.file_lines(spark, f"file://{folder}"))
        live.start(live.minutes(clicks, "10 minutes"), lambda batch, n: result.upsert(batch, ["minute_start", "ad_id"], n), f"file://{tmp_path}/state", "update").awaitTermination()
    assert sorted(r.click_count for r in result.read().collect()) == [1, 1]


@pytest.mark.parametrize("in_state", [False, True])
def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, in_state):
    folder, result = tmp_path / "in", sinks.DatedTable(spark, f"file://{tmp_path}/out")
    folder.mkdir()
    none = spark.createDataFrame([], "user_id long")
    for k in range(3):
        (folder / f"{k}.txt").write_text(line(k) + "\n")
        clicks = ads.parse_clicks(streams.file_lines(spark, f"file://{folder}"))
        if in_state:
            live.start(live.in_state(clicks, none, live.DAILY), lambda batch, n: result.merge(batch, live.DAILY, n), f"file://{tmp_path}/state", "update").awaitTermination()
        else:
            live.counted(clicks, lambda: none, ads.user_daily_counts, live.DAILY, result, f"file://{tmp_path}/state").awaitTermination()
    assert [r.click_count for r in result.read().collect()] == [3]


def test_a_batch_costs_what_it_touches(spark, tmp_path):
    """What a batch writes doesn't grow with the history, and a repeated one adds nothing."""
    table, days = sinks.DatedTable(spark, f"file://{tmp_path}/t"), 6
    for k in range(days):
        rows = ads.user_daily_counts(ads.parse_clicks(lines(spark, [line(k * 1440 * MINUTE, user=u) for u in range(50)])))
        for _ in range(2):
            assert len(table.merge(rows, live.DAILY, k, add=["click_count"])) == 1
    assert [len([x for x in (tmp_path / "t" / f"batch-{k}").iterdir() if x.name.startswith("part=")]) for k in range(days)] == [1] * days
    assert table.read().agg(F.sum("click_count"), F.count("*")).first()[:] == (50 * days, 50 * days)
    for k in range(days, days + 4):  # the same day again: its older states go
        table.merge(ads.user_daily_counts(ads.parse_clicks(lines(spark, [line(0, user=1)]))), live.DAILY, k, add=["click_count"])
    assert len(list((tmp_path / "t").glob("batch-*/part=2024-01-01"))) == 2
    assert table.read().where("user_id = 1 AND date = DATE'2024-01-01'").first().click_count == 5
    added = sinks.BatchedTable(spark, f"file://{tmp_path}/b")
    for k in (0, 1, 1):
        added.add(spark.createDataFrame([(k,)], "n long"), k)
    assert sorted(r.n for r in added.read().collect()) == [0, 1]


def test_tops_replace_the_touched_days_only(spark, tmp_path):
    folder, result = tmp_path / "in", sinks.DatedTable(spark, f"file://{tmp_path}/out")
    folder.mkdir()
    for k, values in enumerate(([line(0, ad=1), line(1440 * MINUTE, ad=1)], [line(1, ad=2), line(2, ad=2)])):
        (folder / f"{k}.txt").write_text("\n".join(values) + "\n")
        clicks = ads.parse_clicks(streams.file_lines(spark, f"file://{folder}"))
        live.counted(clicks, None, ads.city_counts, live.CITY, result, f"file://{tmp_path}/state", then=live.top_of_days(f"file://{tmp_path}/top")).awaitTermination()
    found = sorted((str(r.date), r.place, r.ad_id, r.click_count) for r in spark.read.parquet(f"file://{tmp_path}/top").collect())
    assert found == [("2024-01-01", 1, 2, 2), ("2024-01-01", 2, 1, 1), ("2024-01-02", 1, 1, 1)]


def test_console(spark, capsys, tmp_path):
    sinks.console(spark.createDataFrame([("shown whole, however long it may be",)], "c string"))
    assert "shown whole, however long it may be" in capsys.readouterr().out
    (tmp_path / "a.txt").write_text("streamed\n")
    query = sinks.console(streams.file_lines(spark, f"file://{tmp_path}"))  # to another process's output
    query.awaitTermination()
    assert query.exception() is None and sum(p["numInputRows"] for p in query.recentProgress) == 1


def test_a_failed_load_leaves_what_was_there(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("1\t2024-01-01 05:07:00\n2\t2024-01-01 06:07:00\n")
    parse = logs.delimited(["n", "time"], "time")
    load = lambda p: logs.load_logs(spark, f"file://{tmp_path}/logs", p, F.to_timestamp("time"), f"file://{tmp_path}/out")
    assert load(parse).rows == 2
    assert not load(lambda d: parse(d).withColumn("n", F.when(F.col("n") == "2", F.raise_error(F.lit("broken"))).otherwise("9"))).ok
    assert sorted(r.n for r in logs.read_partitions(spark, f"file://{tmp_path}/out").collect()) == ["1", "2"]


def test_upsert_is_idempotent_by_version(spark, tmp_path):
    table = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(r, "k long, n long")
    table.upsert(rows((1, 1), (None, 5)), ["k"], 0)
    for _ in range(2):
        table.upsert(rows((2, 2), (None, 6)), ["k"], 1)
    assert sorted(map(tuple, table.read().collect()), key=str) == [(1, 1), (2, 2), (None, 6)]


def test_replace_touches_only_its_groups(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_groups(spark.createDataFrame([("a", 1), ("b", 2)], "g string, n long"), path, ["g"])
    sinks.replace_groups(spark.createDataFrame([("a", 3)], "g string, n long"), path, ["g"])
    assert sorted((r.g, r.n) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


def test_append_by_jdbc_and_registry(spark, tmp_path):
    url = "jdbc:derby:memory:rw;create=true"
    people = spark.createDataFrame([(1, "a"), (2, "b")], "DEPTNO int, ENAME string")
    sinks.append(sinks.with_task(people, 7), url, "jdbc", dbtable="EMP", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    (tmp_path / "dept.json").write_text('{"deptno":1,"loc":"x"}\n{"deptno":4,"loc":"y"}\n')
    rows = [
        {"datasource_type": registry.MYSQL, "url": url, "source_table": "EMP", "target_table": "emp_view", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"},
        {"datasource_type": registry.JSON, "url": f"file://{tmp_path}/dept.json", "target_table": "dept_view"},
    ]
    found = registry.federated(spark, rows, "SELECT ENAME, loc, task_id FROM emp_view e JOIN dept_view d ON e.DEPTNO = d.deptno").collect()
    assert [tuple(r) for r in found] == [("a", "x", 7)]
    with pytest.raises(ValueError):
        registry.register(spark, [{"datasource_type": registry.PHOENIX, "target_table": "x"}])


#: Runs a query where driver and executors are processes of their own, and prints its rows and what it leaves of the database.
ON_A_CLUSTER = """
import glob, json, sys, tempfile
from pyspark.sql import SparkSession
name, data, folder = sys.argv[1:]
tempfile.tempdir = folder
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.local.dir": f"{folder}/local",
        "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.driver.extraJavaOptions": f"-Dderby.system.home={folder}"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
import __spark_entry__
found = [list(r) for r in __spark_entry__.queries()[name](spark, data).collect()]
print("FOUND" + json.dumps([found, glob.glob(f"{folder}/rillway-derby-*")]))
"""


def on_a_cluster(name, data, folder):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"PYTHONPATH": os.pathsep.join([repo, os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, name, data, str(folder)], env=env, cwd=folder, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    rows, left = json.loads(done.stdout.split("FOUND")[1])
    assert left == []
    return sorted(map(tuple, rows), key=str)


def test_jdbc_source_where_executors_are_other_processes(sf_dir, duck, tmp_path):
    assert on_a_cluster("jdbc_source", sf_dir, tmp_path) == sorted(duck.sql(SQL["jdbc_source"]).fetchall(), key=str)


def test_upsert_jdbc_table_where_executors_are_other_processes(spark, duck, sf_dir, tmp_path):
    """With null and negative users too, who are in the SQL's result."""
    user = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN -user_id ELSE user_id END"
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("user_id", F.expr(user)).write.parquet(f"file://{tmp_path}/data/events.parquet")
    events = f"WITH events AS (SELECT * FROM '{tmp_path}/data/events.parquet/*.parquet') "
    assert on_a_cluster("upsert_jdbc_table", f"{tmp_path}/data", tmp_path) == sorted(duck.sql(events + SQL["upsert_jdbc_table"]).fetchall(), key=str)


def test_upsert_by_jdbc_of_many_keys(spark):
    """Without an index of the table, where comparing all pairs would not end; other columns and repeated rows of the table stay."""
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    keys = ["id % 300 AS K1", "date_add(DATE'2024-01-01', int(id / 300)) AS K2"]
    old = spark.range(60000).selectExpr(*keys, "IF(id < 0, NULL, 1) AS N", "IF(id < 0, NULL, id) AS KEPT")
    new = spark.range(30000, 90000).selectExpr(*keys, "2 AS N")
    with embedded.database(spark) as url:
        for df in (old, old.where("KEPT = 45000")):
            sinks.append(df, url, "jdbc", dbtable="T", **driver)
        sinks.upsert_jdbc(new, url, "T", ["K1", "K2"], **driver)
        found = registry.read_jdbc(spark, url, "T", **driver)
        tables = registry.read_jdbc(spark, url, "(SELECT tablename FROM sys.systables WHERE tabletype = 'T') q", **driver).collect()
    assert [r[0] for r in tables] == ["T"]
    assert {tuple(r) for r in found.groupBy("N", F.col("KEPT").isNull()).count().collect()} == {(1, False, 30000), (2, False, 30001), (2, True, 30000)}
    assert found.select("K1", "K2").distinct().count() == 90000


def test_embedded_databases_are_told_from_servers():
    assert all(embedded.is_embedded(f"jdbc:{x}") for x in ("derby:memory:a", "derby:/a;create=true", "h2:mem:a", "h2:~/a", "hsqldb:file:a", "sqlite:/a"))
    assert not any(embedded.is_embedded(f"jdbc:{x}") for x in ("derby://h:1527/a", "h2:tcp://h/a", "hsqldb:hsql://h/a", "mysql://h/a", "postgresql://h/a"))


@pytest.mark.parametrize("rows", [0, 1, 25])
def test_rows_pass_through_the_driver_in_chunks(spark, monkeypatch, rows):
    """All rows and types, nulls too, over many chunks; a second append adds its rows by column name."""
    monkeypatch.setattr(embedded, "GROUP_ROWS", 2)
    monkeypatch.setattr(embedded, "CHUNK_BYTES", 1)
    monkeypatch.setattr(embedded, "PART_BYTES", 2000)
    made = "id AS K, IF(id % 3 = 0, NULL, id / 7) AS D, IF(id % 4 = 0, NULL, repeat('ä', int(id))) AS S, cast(id AS decimal(20, 3)) AS M, id % 2 = 0 AS B, date_add(DATE'2024-01-01', int(id)) AS T, timestamp_millis(id * 1001) AS U, cast(NULL AS int) AS N"
    df, driver = spark.range(rows).select(F.expr(f"struct({made}) AS r")).select("r.*"), "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    with embedded.database(spark) as url:
        sinks.append(df, url, "jdbc", dbtable="A", driver=driver)
        sinks.append(df.select(*reversed(df.columns)).where("K > 20"), url, "jdbc", dbtable="A", driver=driver, batchsize=1)
        found = registry.read_jdbc(spark, url, "A", driver=driver)
        some = registry.read_jdbc(spark, url, "(SELECT K FROM A WHERE K < 3) q", driver=driver)
    assert dict(found.dtypes) == dict(df.dtypes)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, df.union(df.where("K > 20")).collect()), key=str)
    assert some.count() == min(rows, 3)


def test_hive_kind_reads_a_view_and_registrations_have_lower_names(spark):
    spark.range(3).createOrReplaceTempView("known")
    listed = spark.createDataFrame([(1, "known", "again")], "DATASOURCE_TYPE int, SOURCE_TABLE string, TARGET_TABLE string")
    assert registry.register(spark, registry.registrations(listed)) == ["again"] and spark.table("again").count() == 3


def test_log_load(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("1\t2024-01-01 05:07:00\n2\t2024-01-01 05:09:59\nbroken\n3\tno time\n4\t2024-01-01 23:55:00\n")
    parse = logs.delimited(["n", "time"], "time")
    done = logs.load_logs(spark, f"file://{folder}", parse, F.to_timestamp("time"), f"file://{tmp_path}/out")
    assert done.ok and done.rows == 3 and {(r["h"], r["m5"]) for r in done.partitions} == {("05", "05"), ("23", "55")}
    found = sorted((r.n, r.d, r.h, r.m5) for r in logs.read_partitions(spark, f"file://{tmp_path}/out").collect())
    assert found == [("1", "20240101", "05", "05"), ("2", "20240101", "05", "05"), ("4", "20240101", "23", "55")]
    assert not logs.load_logs(spark, f"file://{folder}", parse, F.to_timestamp("time"), f"file://{tmp_path}/out", expected_files=2, checks=1).ok
    assert logs.load_logs(spark, f"file://{folder}", lambda d: d.select("missing"), F.to_timestamp("time"), f"file://{tmp_path}/out").message.startswith("执行异常")


@pytest.mark.parametrize("count, keys", [(ads.user_daily_counts, live.DAILY), (ads.city_counts, live.CITY), (live.minutes_of, live.MINUTE)])
def test_a_changed_blacklist_holds_from_the_next_batch(spark, tmp_path, count, keys):
    folder, result = tmp_path / "in", sinks.DatedTable(spark, f"file://{tmp_path}/out")
    folder.mkdir()
    banned = []
    load = lambda: spark.createDataFrame([(u,) for u in banned], "user_id long")
    for k in range(3):
        (folder / f"{k}.txt").write_text(f"{line(k, user=1)}\n{line(k, user=2)}\n")
        clicks = ads.parse_clicks(streams.file_lines(spark, f"file://{folder}"))
        live.counted(clicks, load, count, keys, result, f"file://{tmp_path}/state").awaitTermination()
        banned = [2]
    assert result.read().agg(F.sum("click_count")).first()[0] == 4


def test_published_partitions_are_added_to_the_table(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("1\t2024-01-01 05:07:00\n")
    spark.sql(f"CREATE TABLE loaded (n STRING, time STRING, d STRING, h STRING, m5 STRING) USING orc PARTITIONED BY (d, h, m5) LOCATION 'file://{tmp_path}/out'")
    for _ in range(2):
        done = logs.load_logs(spark, f"file://{tmp_path}/logs", logs.delimited(["n", "time"], "time"), F.to_timestamp("time"), f"file://{tmp_path}/out", table="loaded")
        assert done.ok
    assert [tuple(r) for r in spark.table("loaded").select("n", "h", "m5").collect()] == [("1", "05", "05")]
    spark.sql("DROP TABLE loaded")
