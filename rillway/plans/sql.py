"""The queries of the catalogue in SQL, written apart from the DataFrame code."""

from __future__ import annotations

_ACTIONS = """
event AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS date FROM events),
action AS (
  SELECT date, user_id, CAST(user_id AS VARCHAR) || '_' || date AS session_id, k % 10 AS page_id, ts AS action_time, event_id AS action_id,
         CASE WHEN event_type = 'view' THEN 'kw' || CAST(k % 10 AS VARCHAR) END AS search_keyword,
         CASE WHEN event_type = 'click' THEN k END AS click_category_id,
         CASE WHEN event_type = 'click' THEN event_id % (SELECT count(*) FROM part) END AS click_product_id,
         CASE WHEN event_type = 'signup' THEN CAST(k AS VARCHAR) END AS order_category_ids,
         CASE WHEN event_type = 'purchase' THEN CAST(k AS VARCHAR) END AS pay_category_ids,
         user_id % 25 AS city_id
  FROM event)"""

_USERS = """
person AS (
  SELECT c_custkey AS user_id, c_name AS name, CAST(c_custkey % 60 AS INTEGER) AS age, c_mktsegment AS professional, n_name AS city,
         CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _session(where: str = "TRUE", name: str = "visit") -> str:
    return f"""
{name} AS (
  SELECT session_id, min(user_id) AS user_id,
         coalesce(array_to_string(list_sort(list(DISTINCT search_keyword) FILTER (search_keyword IS NOT NULL)), ','), '') AS search_keywords,
         coalesce(array_to_string(list_sort(list(DISTINCT CAST(click_category_id AS VARCHAR)) FILTER (click_category_id IS NOT NULL)), ','), '') AS click_category_ids,
         min(action_time) AS start_ts, max(action_time) AS end_ts,
         CAST(floor(epoch(max(action_time))) - floor(epoch(min(action_time))) AS BIGINT) AS visit_length, count(*) AS step_length,
         bool_or(coalesce(search_keyword IN ('kw1', 'kw2', 'kw3', 'kw4'), FALSE)) AS wanted
  FROM action WHERE {where} GROUP BY session_id)"""


_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_FILTERED = f"""{_ACTIONS}, {_USERS}, {_session("date BETWEEN '2024-01-03' AND '2024-01-25'")},
chosen AS (SELECT v.*, p.age, p.sex FROM visit v JOIN person p USING (user_id) WHERE p.age BETWEEN 5 AND 50 AND p.sex = 'male' AND v.wanted)"""

DATE_RANGE_SCAN = f"""WITH {_ACTIONS}
SELECT action_id, date, user_id, session_id, page_id, search_keyword, click_category_id, order_category_ids, pay_category_ids, city_id
FROM action WHERE date BETWEEN '2024-01-05' AND '2024-01-12'"""

SESSION_AGGREGATE = f"""WITH {_ACTIONS}, {_session()}
SELECT session_id, user_id, search_keywords, click_category_ids, {_TIME.format('start_ts')} AS start_time, {_TIME.format('end_ts')} AS end_time, visit_length, step_length FROM visit"""

SESSION_USER_JOIN = f"""WITH {_ACTIONS}, {_USERS}, {_session()}
SELECT session_id, user_id, visit_length, step_length, age, professional, city, sex FROM visit JOIN person USING (user_id)"""

SESSION_FILTER = f"WITH {_FILTERED} SELECT session_id, user_id, age, sex, search_keywords, visit_length, step_length FROM chosen"


def _share(name: str, condition: str) -> str:
    return f"CASE WHEN count(*) > 0 THEN ((200 * count(*) FILTER ({condition}) + count(*)) // (2 * count(*))) / 100.0 END AS {name}"


_BUCKETS = [
    ("visit_1s_3s", "visit_length BETWEEN 1 AND 3"), ("visit_4s_6s", "visit_length BETWEEN 4 AND 6"), ("visit_7s_9s", "visit_length BETWEEN 7 AND 9"),
    ("visit_10s_30s", "visit_length BETWEEN 10 AND 30"), ("visit_30s_60s", "visit_length > 30 AND visit_length <= 60"), ("visit_1m_3m", "visit_length > 60 AND visit_length <= 180"),
    ("visit_3m_10m", "visit_length > 180 AND visit_length <= 600"), ("visit_10m_30m", "visit_length > 600 AND visit_length <= 1800"), ("visit_30m", "visit_length > 1800"),
    ("step_1_3", "step_length BETWEEN 1 AND 3"), ("step_4_6", "step_length BETWEEN 4 AND 6"), ("step_7_9", "step_length BETWEEN 7 AND 9"),
    ("step_10_30", "step_length BETWEEN 10 AND 30"), ("step_30_60", "step_length > 30 AND step_length <= 60"), ("step_60", "step_length > 60"),
]
SESSION_AGGR_STAT = f"WITH {_FILTERED} SELECT count(*) AS session_count, {', '.join(_share(*b) for b in _BUCKETS)} FROM chosen"

SESSION_DETAIL = f"""WITH {_FILTERED}
SELECT action_id, session_id, page_id, {_TIME.format('action_time')} AS action_time, search_keyword, click_category_id, click_product_id, order_category_ids, pay_category_ids
FROM action WHERE session_id IN (SELECT session_id FROM chosen)"""

_EXTRACT = f"""{_ACTIONS}, {_session()},
placed AS (SELECT *, strftime(start_ts, '%Y-%m-%d') AS date, strftime(start_ts, '%H') AS hour FROM visit),
sized AS (
  SELECT *, count(*) OVER (PARTITION BY date) AS in_day, count(*) OVER (PARTITION BY date, hour) AS in_hour,
         row_number() OVER (PARTITION BY date, hour ORDER BY md5(session_id), session_id) AS place, 3000 // (SELECT count(DISTINCT date) FROM placed) AS per_day
  FROM placed),
drawn AS (SELECT * FROM sized WHERE place <= least(in_hour * per_day // in_day, in_hour))"""

SESSION_RANDOM_EXTRACT = f"WITH {_EXTRACT} SELECT session_id, date, hour, {_TIME.format('start_ts')} AS start_time, search_keywords, click_category_ids FROM drawn"
SESSION_EXTRACT_DETAIL = f"WITH {_EXTRACT} SELECT action_id, session_id, page_id FROM action WHERE session_id IN (SELECT session_id FROM drawn)"

SESSION_CONCAT = f"""WITH {_ACTIONS}, {_session()}
SELECT session_id, 'sessionid=' || session_id || '|searchKeywords=' || search_keywords || '|clickCategoryIds=' || click_category_ids || '|visitLength=' || CAST(visit_length AS VARCHAR) || '|stepLength=' || CAST(step_length AS VARCHAR) AS aggregated
FROM visit"""

SESSION_GAPS = f"""WITH {_ACTIONS},
paused AS (SELECT *, floor(epoch(action_time)) - floor(epoch(lag(action_time) OVER w)) AS pause FROM action WINDOW w AS (PARTITION BY user_id ORDER BY action_time, action_id))
SELECT action_id, user_id, CAST(sum(CASE WHEN pause > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY action_time, action_id) AS BIGINT) AS gap_session FROM paused"""

_CATEGORY = f"""{_ACTIONS},
tagged AS (
  SELECT click_category_id AS category_id, 'click' AS kind FROM action WHERE click_category_id IS NOT NULL
  UNION ALL SELECT CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT), 'order' FROM action WHERE order_category_ids IS NOT NULL
  UNION ALL SELECT CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT), 'pay' FROM action WHERE pay_category_ids IS NOT NULL),
counted AS (
  SELECT category_id, count(*) FILTER (kind = 'click') AS click_count, count(*) FILTER (kind = 'order') AS order_count, count(*) FILTER (kind = 'pay') AS pay_count
  FROM tagged GROUP BY category_id),
best AS (SELECT * FROM counted ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10),
clicks AS (SELECT click_category_id AS category_id, session_id, count(*) AS click_count FROM action WHERE click_category_id IS NOT NULL GROUP BY ALL),
topmost AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) AS INTEGER) AS place
  FROM clicks WHERE category_id IN (SELECT category_id FROM best))"""

CATEGORY_UNIVERSE = f"WITH {_CATEGORY} SELECT DISTINCT category_id FROM tagged"
CATEGORY_COUNTS = f"WITH {_CATEGORY} SELECT * FROM counted"
TOP10_CATEGORY = f"WITH {_CATEGORY} SELECT * FROM best"
SESSION_CATEGORY_CLICKS = f"WITH {_CATEGORY} SELECT * FROM clicks"
TOP10_SESSION = f"WITH {_CATEGORY} SELECT category_id, session_id, click_count, place FROM topmost WHERE place <= 10"
TOP10_SESSION_DETAIL = f"WITH {_CATEGORY} SELECT l.category_id, l.session_id, a.action_id, a.page_id FROM topmost l JOIN action a USING (session_id) WHERE l.place <= 10"

_FUNNEL = f"""{_ACTIONS},
steps AS (SELECT * FROM (VALUES (1, 1, 2), (2, 2, 3), (3, 3, 4)) v(step, page_from, page_to)),
pairs AS (SELECT page_id AS page_from, lead(page_id) OVER (PARTITION BY session_id ORDER BY action_time, action_id) AS page_to FROM action),
taken AS (
  SELECT s.step, CAST(s.page_from AS VARCHAR) || '_' || CAST(s.page_to AS VARCHAR) AS split, count(p.page_from) AS pv
  FROM steps s LEFT JOIN pairs p ON p.page_from = s.page_from AND p.page_to = s.page_to GROUP BY ALL),
started AS (SELECT count(*) FILTER (page_id = 1) AS start_pv FROM action),
rated AS (
  SELECT t.step, t.split, t.pv, coalesce(b.pv, (SELECT start_pv FROM started)) AS prior
  FROM taken t LEFT JOIN taken b ON b.step = t.step - 1),
rates AS (SELECT step, split, pv, CASE WHEN prior > 0 THEN ((200 * pv + prior) // (2 * prior)) / 100.0 END AS rate FROM rated)"""

PAGE_SPLIT_PV = f"WITH {_FUNNEL} SELECT step, split, pv FROM taken"
PAGE_SPLIT_LOGICAL = f"WITH {_FUNNEL.replace('ORDER BY action_time, action_id', 'ORDER BY action_time, page_id')} SELECT step, split, pv FROM taken"
PAGE_START_PV = f"WITH {_FUNNEL} SELECT start_pv FROM started"
PAGE_CONVERT_RATE = f"WITH {_FUNNEL} SELECT * FROM rates"
PAGE_CONVERT_STRING = f"WITH {_FUNNEL} SELECT string_agg(split || '=' || coalesce(printf('%.2f', rate), ''), '|' ORDER BY step) AS convert_rate FROM rates"

_PLACES = "place_of AS (SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey)"
_SOLD = f"""{_PLACES},
sold AS (SELECT CAST(s_nationkey AS BIGINT) AS city_id, l_partkey AS product_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
located AS (SELECT * FROM sold JOIN place_of USING (city_id)),
by_area AS (
  SELECT area, product_id, count(*) AS click_count, array_to_string(list_sort(list(DISTINCT CAST(city_id AS VARCHAR) || ':' || city_name)), ',') AS city_infos
  FROM located GROUP BY area, product_id)"""
_LEVEL = "CASE WHEN area IN ('ASIA', 'EUROPE') THEN 'A级' WHEN area = 'AMERICA' THEN 'B级' WHEN area = 'AFRICA' THEN 'C级' ELSE 'D级' END"
_STATUS = "CASE WHEN p_size % 2 = 0 THEN '自营商品' ELSE '第三方商品' END"

PRODUCT_CLICK_SCAN = f"WITH {_ACTIONS} SELECT city_id, click_product_id AS product_id FROM action WHERE click_product_id IS NOT NULL AND date BETWEEN '2024-01-05' AND '2024-01-12'"
CLICK_CITY_JOIN = f"WITH {_SOLD} SELECT city_id, product_id, city_name, area FROM located"
AREA_PRODUCT_CLICKS = f"WITH {_SOLD} SELECT * FROM by_area"
AREA_LEVEL = f"WITH {_PLACES} SELECT city_id, area, {_LEVEL} AS area_level FROM place_of"
PRODUCT_STATUS = f"SELECT p_partkey AS product_id, {_STATUS} AS product_status FROM part"
AREA_TOP3_PRODUCT = f"""WITH {_SOLD},
ranked AS (
  SELECT b.*, p_name AS product_name, {_STATUS} AS product_status, CAST(row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS INTEGER) AS place
  FROM by_area b JOIN part ON p_partkey = product_id)
SELECT area, {_LEVEL} AS area_level, product_id, city_infos, click_count, product_name, product_status, place FROM ranked WHERE place <= 3"""

SKEW_KEY_SAMPLE = """SELECT l_suppkey, count(*) AS n FROM lineitem
WHERE CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) < CAST(0.1 * 4294967296 AS BIGINT)
GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 5"""
OBSERVED_COUNTS = f"WITH {_FILTERED} SELECT count(*) AS session_count, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _BUCKETS)} FROM chosen"
SALTED_COUNT = "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag"
SALTED_GROUP_CONCAT = f"WITH {_SOLD} SELECT area, array_to_string(list_sort(list(DISTINCT city_name)), ',') AS joined FROM located GROUP BY area"
SALTED_JOIN = f"WITH {_SOLD} SELECT area, city_name, count(*) AS click_count FROM located GROUP BY area, city_name"

CONCAT_LONG_STRING = f"WITH {_PLACES} SELECT city_id, CAST(city_id AS VARCHAR) || ':' || city_name AS info FROM place_of"
GROUP_CONCAT_DISTINCT = f"WITH {_USERS} SELECT city, array_to_string(list_sort(list(DISTINCT professional)), ',') AS professionals FROM person GROUP BY city"
RANDOM_PREFIX_ROUNDTRIP = f"WITH {_PLACES} SELECT city_id, city_name, TRUE AS in_range FROM place_of"
STRING_FUNCTIONS = f"""WITH {_USERS}
SELECT user_id, professional AS segment, CAST(NULL AS VARCHAR) AS empty, CAST(NULL AS VARCHAR) AS odd, CAST(NULL AS VARCHAR) AS missing,
       'name=' || name || '|empty=|segment=X|odd=1=2|age=' || CAST(age AS VARCHAR) AS replaced, CAST(age AS VARCHAR) || ',,' || sex AS trimmed,
       CASE WHEN age BETWEEN 10 AND 99 THEN CAST(age AS VARCHAR) ELSE '0' || CAST(age AS VARCHAR) END AS padded,
       CAST(age AS VARCHAR) || ';' || sex AS listed, TRUE AS is_empty, TRUE AS is_not_empty
FROM person"""
DATE_FUNCTIONS = """WITH shown AS (SELECT event_id, date_trunc('second', ts) AS t, CASE WHEN event_id % 3 <> 0 THEN date_trunc('second', ts) END AS good FROM events)
SELECT event_id, strftime(t, '%Y-%m-%d_%H') AS date_hour, strftime(t, '%Y-%m-%d') AS day, strftime(t, '%Y-%m-%d %H:%M:%S') AS time, strftime(t, '%Y%m%d') AS date_key,
       strftime(t, '%Y%m%d%H%M') AS minute_key, coalesce(good < TIMESTAMP '2024-01-15 12:00:00', FALSE) AS is_before, coalesce(good > TIMESTAMP '2024-01-15 12:00:00', FALSE) AS is_after,
       coalesce(CAST(epoch(good) - epoch(TIMESTAMP '2024-01-15 12:00:00') AS BIGINT), 0) AS seconds, strftime(t, '%Y-%m-%d') AS parsed, good IS NULL AS is_bad,
       strftime(t, '%Y-%m-%d %H:%M:%S') AS from_millis
FROM shown"""
PREDICATE_FUNCTIONS = f"""WITH {_USERS}
SELECT user_id, age BETWEEN 10 AND 30 AS in_range, TRUE AS open_range, professional IN ('BUILDING', 'MACHINERY') AS is_one, sex = 'male' AS is_male,
       age > 30 AND sex = 'male' AS null_fails, ((200 * age + 59) // 118) / 100.0 AS share
FROM person"""

_ADS = f"""{_PLACES},
click AS (
  SELECT date_trunc('millisecond', ts) AS ts, replace(area, ' ', '_') AS province, replace(city_name, ' ', '_') AS city, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS ad_id
  FROM events JOIN customer ON c_custkey = user_id JOIN place_of ON city_id = c_nationkey WHERE event_type = 'click'),
allowed AS (SELECT * FROM click WHERE user_id % 7 <> 0),
in_city AS (SELECT strftime(ts, '%Y-%m-%d') AS date, province, city, ad_id, count(*) AS click_count FROM allowed GROUP BY ALL),
in_province AS (SELECT date, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM in_city GROUP BY ALL)"""

AD_BLACKLIST_FILTER = f"WITH {_ADS} SELECT {_TIME.format('ts')} AS ts, province, city, user_id, ad_id FROM allowed"
AD_USER_DAILY = f"WITH {_ADS} SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, ad_id, count(*) AS click_count FROM allowed GROUP BY ALL"
AD_BLACKLIST_GENERATE = f"WITH {_ADS} SELECT DISTINCT user_id FROM (SELECT user_id FROM click GROUP BY CAST(ts AS DATE), user_id, ad_id HAVING count(*) >= 2)"
AD_STAT = f"WITH {_ADS} SELECT * FROM in_city"
AD_PROVINCE_TOP3 = f"""WITH {_ADS}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY date, province ORDER BY click_count DESC, ad_id) AS INTEGER) AS place FROM in_province)
SELECT * FROM ranked WHERE place <= 3"""
AD_CLICK_TREND = f"""WITH {_ADS}, minutes AS (SELECT date_trunc('minute', ts) AS m, ad_id, count(*) AS click_count FROM click GROUP BY ALL)
SELECT strftime(m, '%Y-%m-%d') AS date, strftime(m, '%H') AS hour, strftime(m, '%M') AS minute, ad_id, click_count FROM minutes WHERE m >= (SELECT max(m) FROM minutes) - INTERVAL 1440 MINUTE"""

JSON_SOURCE = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
FEDERATED_JOIN = "SELECT r_name, n_name, count(*) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_name"
UPSERT_TABLE = "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN -count(*) ELSE count(*) END AS n FROM events GROUP BY user_id"
ORC_PARTITION_LOAD = """SELECT strftime(ts, '%Y%m%d') AS d, strftime(ts, '%H') AS h, printf('%02d', (extract(minute FROM ts) // 5) * 5) AS m5, count(*) AS n FROM events GROUP BY ALL"""

DAY_FUNCTIONS = """SELECT o_orderkey, '2024-03-01' AS today, '2024-02-29' AS yesterday, TRUE AS in_order, round(floor(o_totalprice / 7 * 1000) / 1000 + 0.00025, 2) AS price FROM orders"""
MOCK_SOURCE = "SELECT * FROM (VALUES ('user_visit_action', 0, TRUE), ('user_info', 0, TRUE), ('product_info', 0, TRUE)) v(name, bad, filled)"
REPLACE_GROUPS = "SELECT event_type, user_id, CASE WHEN event_type = 'click' THEN -count(*) ELSE count(*) END AS n FROM events GROUP BY event_type, user_id"
PUBLISHED_PARTITIONS = "SELECT DISTINCT strftime(ts, '%Y%m%d') AS d, strftime(ts, '%H') AS h, printf('%02d', (extract(minute FROM ts) // 5) * 5) AS m5 FROM events"
SESSION_JOB = f"SELECT CAST(7 AS BIGINT) AS task_id, (WITH {_FILTERED} SELECT count(*) FROM chosen) AS session_count, ({PAGE_CONVERT_STRING}) AS convert_rate"
