"""Dashboard aggregates on the driver's tables. Roles: lineitem - attendance (supplier as member, R as hare, A as paid),
orders - events, customer - kennel, events - run log and issue stream, part - rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dashboards as B
from ..operators import projection as P
from ..operators.aggregates import stale_keys
from ..plans.analytic import _outcomes, _OUTCOMES
from .registry import Tables, query

DAY = lambda s: F.lit(s).cast("date")
_ATT = "SELECT l_suppkey AS member, l_orderkey AS event_id, o_custkey AS kennel, CAST(o_orderdate AS DATE) AS d, l_returnflag = 'R' AS hare, l_returnflag = 'A' AS paid, o_orderpriority AS level, n_name AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _attendance(t: Tables) -> DataFrame:
    events = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = t.lineitem.join(events, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_suppkey").alias("member"), F.col("l_orderkey").alias("event_id"), F.col("o_custkey").alias("kennel"), F.to_date("o_orderdate").alias("d"), (F.col("l_returnflag") == "R").alias("hare"), (F.col("l_returnflag") == "A").alias("paid"), F.col("o_orderpriority").alias("level"), F.col("n_name").alias("region"))


@query("SELECT count(*) AS kennels FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def count_with_exists(t: Tables) -> DataFrame:
    held = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(held, "c_custkey", "left_semi").agg(F.count(F.lit(1)).alias("kennels"))


@query(f"""
    WITH a AS ({_ATT}), s AS (
      SELECT member, 'total' AS dimension, 'all' AS value, count(*) AS runs, count(*) FILTER (hare) AS hared FROM a GROUP BY 1
      UNION ALL SELECT member, 'region', region, count(*), count(*) FILTER (hare) FROM a GROUP BY 1, 3
      UNION ALL SELECT member, 'level', level, count(*), count(*) FILTER (hare) FROM a GROUP BY 1, 3
      UNION ALL SELECT member, 'year', CAST(year(d) AS VARCHAR), count(*), count(*) FILTER (hare) FROM a GROUP BY 1, 3
      UNION ALL SELECT m.member, 'weekday', CAST(w AS VARCHAR), count(a.member), count(*) FILTER (a.hare) FROM (SELECT DISTINCT member FROM a) m CROSS JOIN range(7) x(w) LEFT JOIN a ON a.member = m.member AND (dayofweek(a.d) + 6) % 7 = w GROUP BY 1, 3)
    SELECT member, dimension, value, runs, hared FROM s""")
def personal_stats_rollup(t: Tables) -> DataFrame:
    dims = {"region": F.col("region"), "level": F.col("level"), "year": F.year("d"), "weekday": F.weekday("d")}
    return B.with_weekday_spine(B.personal_stats(_attendance(t), "member", F.col("hare"), dims), "member")


@query(f"SELECT member, count(*) AS runs, count(*) FILTER (hare) AS hared, count(*) FILTER (paid) AS paid, min(d) AS first_run, max(d) AS last_run FROM ({_ATT}) GROUP BY 1")
def member_stats(t: Tables) -> DataFrame:
    return B.member_stats(_attendance(t), "member", F.col("hare"), F.col("paid"), "d")


@query(f"""
    WITH a AS ({_ATT}), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY member) AS k FROM a)
    , c AS (SELECT event_id, count(*) AS attendees, count(*) FILTER (hare) AS hares, count(*) FILTER (paid) AS paid_n FROM a GROUP BY 1)
    SELECT r.event_id, attendees, hares, paid_n, (k - 1) // 5 AS part, list(member ORDER BY member) AS names FROM r JOIN c ON c.event_id = r.event_id GROUP BY ALL""")
def event_history_lists(t: Tables) -> DataFrame:
    return B.event_history(_attendance(t), "event_id", "member", {"hares": F.col("hare"), "paid_n": F.col("paid")}, size=5)


@query("SELECT user_id % 20 AS src, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'never') AS never, count(*) AS total FROM events GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return B.dense_counts(t.events.withColumn("src", F.col("user_id") % 20), ["src"], "event_type", ["view", "click", "error", "never"])


@query("""
    SELECT (SELECT count(*) FROM customer) AS kennels, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS upcoming, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS members,
      (SELECT count(*) FROM events WHERE event_type = 'error') AS alerts, (SELECT count(*) FROM nation) AS regions""")
def dashboard_counters(t: Tables) -> DataFrame:
    return B.counters(kennels=t.customer, upcoming=t.orders.where("o_orderdate >= timestamp_ntz'1998-01-01'"), members=t.lineitem.select("l_suppkey").distinct(), alerts=t.events.where("event_type = 'error'"), regions=t.nation)


@query(f"""
    WITH {_OUTCOMES} SELECT confidence, count(*) FILTER (outcome = 'HIT') AS hit, count(*) FILTER (outcome = 'MISS') AS miss, count(*) FILTER (outcome = 'UNOBSERVED') AS unobserved, count(*) FILTER (outcome = 'PENDING') AS pending,
      count(*) FILTER (outcome = 'VOID') AS void, count(*) AS total FROM o GROUP BY 1""")
def outcome_tally(t: Tables) -> DataFrame:
    return B.dense_counts(_outcomes(t), ["confidence"], "outcome", ["HIT", "MISS", "UNOBSERVED", "PENDING", "VOID"])


@query("SELECT l_suppkey AS source, min(CAST(l_shipdate AS DATE)) FILTER (l_linestatus = 'O') AS first_maturity, count(*) FILTER (l_linestatus = 'O') AS pending FROM lineitem GROUP BY 1")
def first_maturity(t: Tables) -> DataFrame:
    open_row = F.col("l_linestatus") == "O"
    return t.lineitem.groupBy(F.col("l_suppkey").alias("source")).agg(F.min(F.when(open_row, F.to_date("l_shipdate"))).alias("first_maturity"), F.count_if(open_row).alias("pending"))


@query("""
    WITH r AS (SELECT p_partkey % 400 AS kennel_id, CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, p_type = 'ECONOMY' AS seasonal FROM part)
    SELECT count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'MEDIUM') AS medium, count(*) FILTER (confidence = 'LOW') AS low, count(*) FILTER (seasonal) AS seasonal,
      count(DISTINCT kennel_id) AS covered, greatest(0, (SELECT count(*) FROM customer) - count(DISTINCT kennel_id)) AS dark FROM r""")
def rule_coverage(t: Tables) -> DataFrame:
    size = F.col("p_size") % 3
    rules = t.part.select((F.col("p_partkey") % 400).alias("kennel_id"), F.when(size == 0, "HIGH").when(size == 1, "MEDIUM").otherwise("LOW").alias("confidence"), F.when(F.col("p_type") == "ECONOMY", "04-01").alias("season_start"))
    return B.rule_coverage(rules, t.customer.select(F.col("c_custkey").alias("kennel_id")))


@query("""
    WITH r AS (SELECT p_partkey % 400 AS kennel_id, p_size % 8 AS source, CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, p_type = 'ECONOMY' AS seasonal FROM part)
    SELECT source, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'MEDIUM') AS medium, count(*) FILTER (confidence = 'LOW') AS low, count(*) FILTER (seasonal) AS seasonal, count(*) AS rules, count(DISTINCT kennel_id) AS covered FROM r GROUP BY 1""")
def rule_coverage_by_source(t: Tables) -> DataFrame:
    size = F.col("p_size") % 3
    rules = t.part.select((F.col("p_partkey") % 400).alias("kennel_id"), (F.col("p_size") % 8).alias("source"), F.when(size == 0, "HIGH").when(size == 1, "MEDIUM").otherwise("LOW").alias("confidence"), F.when(F.col("p_type") == "ECONOMY", "04-01").alias("season_start"))
    return B.rule_coverage_by_source(rules)


_WEEK = "CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT)"


@query(f"""
    WITH e AS (SELECT o_custkey % 50 AS kennel_id, CASE WHEN o_orderkey % 4 > 0 THEN {_WEEK} + CAST(o_custkey % 50 % 7 AS INT) ELSE CAST(o_orderdate AS DATE) END AS date FROM orders), c AS (SELECT kennel_id, dayofweek(date) AS w, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT kennel_id, arg_max(w, n * 10 - w) AS weekday, max(n) AS n, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY 1),
    p AS (SELECT DISTINCT o_custkey % 50 AS kennel_id, (o_custkey % 50 % 7 + o_custkey % 2) % 7 AS w FROM orders)
    SELECT kennel_id, weekday, n, events FROM t WHERE events >= 4 AND n * 10 >= 6 * events AND kennel_id IN (SELECT kennel_id FROM p) AND NOT EXISTS (SELECT 1 FROM p WHERE p.kennel_id = t.kennel_id AND p.w = t.weekday)""")
def rule_drift(t: Tables) -> DataFrame:
    kennel, day = F.col("o_custkey") % 50, F.to_date("o_orderdate")
    sunday = F.date_sub(day, F.dayofweek(day) - 1)
    events = t.orders.select(kennel.alias("kennel_id"), F.when(F.col("o_orderkey") % 4 > 0, F.date_add(sunday, (kennel % 7).cast("int"))).otherwise(day).alias("date"))
    projected = t.orders.select(kennel.alias("kennel_id"), F.date_add(sunday, ((kennel % 7 + F.col("o_custkey") % 2) % 7).cast("int")).alias("date"))
    return P.weekday_drift(events, projected).select("kennel_id", F.col("weekday").cast("long").alias("weekday"), "n", "events")


@query("""
    SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day, CAST(sum(CASE WHEN event_type = 'view' THEN CAST(props->>'k' AS BIGINT) ELSE 0 END) AS BIGINT) AS title, CAST(sum(CASE WHEN event_type = 'error' THEN CAST(props->>'k' AS BIGINT) ELSE 0 END) AS BIGINT) AS hares FROM events GROUP BY 1""")
def category_trend_local(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    name = F.when(F.col("event_type") == "view", "title").when(F.col("event_type") == "error", "hares").otherwise("other")
    rows = t.events.select("ts", F.concat(F.lit('{"'), name, F.lit('":'), k, F.lit("}")).alias("counts"))
    return B.json_trend(rows, "ts", "counts", ["title", "hares"])


_FOUND = "SELECT user_id % 40 AS kennel_id, event_type AS rule, ts AS seen FROM events"


@query(f"""
    WITH f AS ({_FOUND}) SELECT kennel_id, rule, count(*) AS n, max(seen) AS last_at, rule = 'view' OR (rule = 'click' AND kennel_id = 3) OR (rule = 'error' AND kennel_id = 5) AS suppressed FROM f GROUP BY 1, 2 ORDER BY n DESC, kennel_id, rule LIMIT 20""")
def top_offenders(t: Tables) -> DataFrame:
    # a log a day and user class, whose findings are nested
    found = t.events.select((F.col("user_id") % 40).alias("kennel_id"), F.col("event_type").alias("rule"), "ts")
    logs = found.groupBy(F.col("ts").alias("at")).agg(F.collect_list(F.struct("kennel_id", "rule")).alias("findings"))
    return B.top_offenders(logs, _suppressions(t))


def _suppressions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(None, "view"), (3, "click"), (5, "error")], "kennel_id long, rule string")


@query(f"""
    WITH f AS ({_FOUND}), h AS (SELECT NULL AS kennel_id, rule FROM f WHERE rule = 'view' UNION ALL SELECT kennel_id, rule FROM f WHERE (kennel_id = 3 AND rule = 'click') OR (kennel_id = 5 AND rule = 'error'))
    SELECT kennel_id, rule, count(*) AS hidden, CAST((20 * count(*) + 30) // 60 AS BIGINT) AS per_day_tenths FROM h GROUP BY 1, 2""")
def suppression_impact(t: Tables) -> DataFrame:
    return B.suppression_impact(t.events.select((F.col("user_id") % 40).alias("kennel_id"), F.col("event_type").alias("rule")), _suppressions(t), 30)


@query("""
    WITH i AS (SELECT user_id % 7 AS stream, count(*) FILTER (event_type IN ('view', 'click')) AS open_now FROM events GROUP BY 1 HAVING count(*) FILTER (event_type IN ('view', 'click')) > 0),
    c AS (SELECT user_id % 7 AS stream, count(*) FILTER (event_type IN ('view', 'click')) - count(*) FILTER (event_type = 'purchase') AS net FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1)
    SELECT coalesce(i.stream, c.stream) AS stream, coalesce(open_now, 0) AS open_now, coalesce(open_now, 0) - coalesce(net, 0) AS open_then FROM i FULL JOIN c ON i.stream = c.stream""")
def open_counts_then(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "OPENED").when(F.col("event_type") == "click", "REOPENED").when(F.col("event_type") == "purchase", "CLOSED").otherwise("RELABELED")
    rows = t.events.select((F.col("user_id") % 7).alias("stream"), F.to_date("ts").alias("day"), kind.alias("kind"), F.when(F.col("event_type").isin("view", "click"), "open").otherwise("closed").alias("state"))
    return B.open_then(rows, rows, "stream", DAY("2024-01-24"))


@query("""
    SELECT user_id % 300 AS stream, count(*) FILTER (event_type <> 'signup') AS known, count(*) FILTER (event_type = 'error') AS hits,
      CASE WHEN count(*) FILTER (event_type <> 'signup') >= 5 THEN CAST((200 * count(*) FILTER (event_type = 'error') + count(*) FILTER (event_type <> 'signup')) // (2 * count(*) FILTER (event_type <> 'signup')) AS BIGINT) END AS percent
    FROM events GROUP BY 1""")
def close_reason_ratio(t: Tables) -> DataFrame:
    return B.floored_ratio(t.events.withColumn("stream", F.col("user_id") % 300), "stream", F.col("event_type") == "error", F.col("event_type") != "signup")


@query("""
    SELECT count(DISTINCT a.o_custkey) AS covered, count(DISTINCT c_custkey) AS total, CAST((200 * count(DISTINCT a.o_custkey) + count(DISTINCT c_custkey)) // (2 * count(DISTINCT c_custkey)) AS BIGINT) AS percent,
      CAST(ceil((count(DISTINCT c_custkey) - count(DISTINCT a.o_custkey)) / (SELECT CASE WHEN count(*) > 0 THEN CAST(count(*) AS DOUBLE) END FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderstatus = 'P')) AS BIGINT) AS weeks_left
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') a ON a.o_custkey = c_custkey""")
def deep_dive_coverage(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return B.coverage(t.customer, done, "c_custkey", F.count_if(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp_ntz")))


@query("""
    SELECT c_custkey, c_name, max(o_orderdate) AS last_at FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY last_at NULLS FIRST, c_name, c_custkey LIMIT 25""")
def deep_dive_queue(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return B.least_recent(t.customer.select("c_custkey", "c_name"), rows, "c_custkey", "o_orderdate", "c_name", 25)


@query("""
    WITH r AS (SELECT o_custkey, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-30') / 7.0) AS INT) AS w FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30')
    SELECT o_custkey, list_reduce(list_transform(range(12), lambda i: CASE WHEN list_contains(list(w), 11 - i) THEN '1' ELSE '0' END), lambda a, b: a || b) AS weeks, count(*) AS total FROM r WHERE w < 12 GROUP BY 1""")
def evidence_timeline(t: Tables) -> DataFrame:
    return B.evidence_timeline(t.orders.select("o_custkey", F.to_date("o_orderdate").alias("d")), "o_custkey", "d", DAY("1998-06-30"))


@query("""
    SELECT c_nationkey, dayofweek(o_orderdate) AS weekday, count(*) AS n, list(DISTINCT strftime(o_orderdate, '%Y-%m-%d') ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS dates
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1998-05-01' GROUP BY 1, 2""")
def weekday_facets(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderdate >= timestamp_ntz'1998-05-01'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return B.weekday_facets(rows, "c_nationkey", "o_orderdate").withColumn("weekday", F.col("weekday").cast("long"))


@query("""
    WITH r AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day, o_custkey % 3 AS stop, CASE WHEN o_orderkey % 4 > 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00' END AS start_time, o_orderkey % 50 AS distance, o_orderkey AS id FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY day, stop ORDER BY coalesce(start_time, '99:99'), distance, id) AS pos FROM r)
    SELECT day, (pos - 1) // 50 AS part, coalesce(list(id ORDER BY pos) FILTER (stop = 0), []) AS stop_0, coalesce(list(id ORDER BY pos) FILTER (stop = 1), []) AS stop_1, coalesce(list(id ORDER BY pos) FILTER (stop = 2), []) AS stop_2 FROM k GROUP BY 1, 2""")
def day_by_stop(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("day"), (F.col("o_custkey") % 3).cast("string").alias("stop"), F.when(k % 4 > 0, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00"))).alias("start_time"), (k % 50).alias("distance"), k.alias("id"))
    return B.day_by_stop(rows, ["0", "1", "2"])


_POINTS = "SELECT c_nationkey AS g, (c_custkey * 37) % 160 - 80 + (c_custkey % 100) / 100.0 AS lat, (c_custkey * 91) % 360 - 180 + (c_custkey % 97) / 97.0 AS lng FROM customer"


def _points(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    return t.customer.select(c, F.col("c_nationkey").alias("g"), ((c * 37) % 160 - 80 + (c % 100) / 100.0).alias("lat"), ((c * 91) % 360 - 180 + (c % 97) / 97.0).alias("lng"))


@query(f"""
    WITH p AS ({_POINTS}), k AS (SELECT CAST(floor(lat * 10000 + 0.5) AS BIGINT) AS lat_e4, CAST(floor(lng * 10000 + 0.5) AS BIGINT) AS lng_e4 FROM p) SELECT lat_e4, lng_e4, count(*) AS n FROM k GROUP BY 1, 2""")
def coordinate_buckets(t: Tables) -> DataFrame:
    e4 = lambda c: F.floor(F.col(c) * 10000 + 0.5)
    return _points(t).groupBy(e4("lat").alias("lat_e4"), e4("lng").alias("lng_e4")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH p AS ({_POINTS}), a AS (SELECT g, list_sort(list(lat)) AS la, list_sort(list(lng)) AS ln, len(list(lat)) AS n FROM p GROUP BY 1),
    q AS (SELECT g, n, la[CAST(floor(n * 0.25) AS INT) + 1] AS a1, la[CAST(floor(n * 0.75) AS INT) + 1] AS a3, ln[CAST(floor(n * 0.25) AS INT) + 1] AS o1, ln[CAST(floor(n * 0.75) AS INT) + 1] AS o3 FROM a),
    k AS (SELECT p.* FROM p JOIN q ON p.g = q.g WHERE n < 8 OR (lat BETWEEN a1 - 1.5 * (a3 - a1) AND a3 + 1.5 * (a3 - a1) AND lng BETWEEN o1 - 1.5 * (o3 - o1) AND o3 + 1.5 * (o3 - o1)))
    SELECT g, min(lat) - 0.5 AS south, min(lng) - 0.5 AS west, max(lat) + 0.5 AS north, max(lng) + 0.5 AS east, count(*) AS kept FROM k GROUP BY 1""")
def padded_bounds(t: Tables) -> DataFrame:
    return B.padded_bounds(_points(t), "g", "lat", "lng", 0.5)


@query("""
    SELECT l_orderkey, CASE min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS worst FROM lineitem GROUP BY 1""")
def worst_of_group(t: Tables) -> DataFrame:
    return B.worst_of(t.lineitem, "l_orderkey", "l_returnflag", ["R", "A", "N"])


@query("""
    WITH r AS (SELECT user_id % 20 AS src, event_type AS action, event_id, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY event_id) AS k FROM events)
    SELECT src, count(*) FILTER (action = 'signup') AS signup, count(*) FILTER (action = 'click') AS click, coalesce(list(event_id ORDER BY event_id) FILTER (action = 'signup' AND k <= 3), []) AS signup_samples,
      coalesce(list(event_id ORDER BY event_id) FILTER (action = 'click' AND k <= 3), []) AS click_samples FROM r GROUP BY 1""")
def batch_counters(t: Tables) -> DataFrame:
    return B.action_counters(t.events.withColumn("src", F.col("user_id") % 20), "src", "event_type", ["signup", "click"], "event_id")


_PROJ = "SELECT l_suppkey AS kennel_id, CASE WHEN l_quantity > 40 THEN 'HIGH' WHEN l_quantity > 15 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, date_diff('day', DATE '1997-06-01', CAST(l_shipdate AS DATE)) AS days_out, CAST(l_shipdate AS DATE) AS date FROM lineitem"


@query(f"""
    WITH p AS ({_PROJ}), k AS (SELECT s_suppkey AS kennel_id FROM supplier), x AS (SELECT k.kennel_id, h, min(CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 END) AS r
      FROM k CROSS JOIN (SELECT unnest([2, 10, 30]) AS h) LEFT JOIN p ON p.kennel_id = k.kennel_id AND days_out BETWEEN 0 AND h GROUP BY 1, 2)
    SELECT h AS horizon, CASE r WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'NONE' END AS bucket, count(*) AS kennels FROM x GROUP BY 1, 2""")
def coverage_census(t: Tables) -> DataFrame:
    p = t.lineitem.select(F.col("l_suppkey").alias("kennel_id"), F.when(F.col("l_quantity") > 40, "HIGH").when(F.col("l_quantity") > 15, "MEDIUM").otherwise("LOW").alias("confidence"), F.datediff(F.to_date("l_shipdate"), DAY("1997-06-01")).alias("days_out"))
    return B.census(t.supplier.select(F.col("s_suppkey").alias("kennel_id")), p, [2, 10, 30])


@query("""
    WITH p AS (SELECT DISTINCT o_custkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1), a AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT t AS tolerance, (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM a WHERE a.k = p.k AND a.d BETWEEN p.d - CAST(t AS INT) AND p.d + CAST(t AS INT))) AS hits, (SELECT count(*) FROM p) AS projected,
      (SELECT count(*) FROM a WHERE EXISTS (SELECT 1 FROM p WHERE a.k = p.k AND p.d BETWEEN a.d - CAST(t AS INT) AND a.d + CAST(t AS INT))) AS found, (SELECT count(*) FROM a) AS actual FROM (SELECT unnest([0, 1]) AS t)""")
def projection_backtest(t: Tables) -> DataFrame:
    events = t.orders.select("o_orderkey", F.col("o_custkey").alias("kennel_id"), F.to_date("o_orderdate").alias("date"))
    p = t.lineitem.where("l_linenumber = 1").join(events, F.col("l_orderkey") == F.col("o_orderkey")).select("kennel_id", F.to_date("l_shipdate").alias("date"))
    return B.backtest(p, events)


@query("""
    WITH d AS (SELECT user_id % 20 AS src, max(CAST(ts AS DATE)) AS last_day, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1),
    s AS (SELECT *, CASE WHEN failed * 4 > runs THEN 'FAILING' WHEN failed * 5 > runs THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM d)
    SELECT 'health' AS part, health AS name, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'stale', CAST(s_suppkey AS VARCHAR), coalesce(runs, 0) FROM (SELECT s_suppkey, src, runs FROM supplier LEFT JOIN s ON src = s_suppkey WHERE src IS NULL ORDER BY s_suppkey LIMIT 20)
    UNION ALL SELECT 'daily', CAST(day AS VARCHAR), ok FROM (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1)""")
def operational_health(t: Tables) -> DataFrame:
    """The bundle of the health page: sources by health, stale sources, successes by day, as (part, name, n)."""
    runs = t.events.select((F.col("user_id") % 20).alias("s_suppkey"), "ts", (F.col("event_type") == "error").alias("failed"))
    counted = runs.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failed"))
    health = F.when(F.col("failed") * 4 > F.col("runs"), "FAILING").when(F.col("failed") * 5 > F.col("runs"), "DEGRADED").otherwise("HEALTHY")
    row = lambda part, name, n: (F.lit(part).alias("part"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    by_health = counted.groupBy(health.alias("h")).agg(F.count(F.lit(1)).alias("c")).select(*row("health", F.col("h"), F.col("c")))
    stale = stale_keys(t.supplier.select("s_suppkey"), runs, "s_suppkey", "ts", F.lit("2000-01-01").cast("timestamp_ntz"), 20).select(*row("stale", F.col("s_suppkey"), F.lit(0)))
    daily = runs.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(~F.col("failed")).alias("ok")).select(*row("daily", F.col("day"), F.col("ok")))
    return by_health.unionByName(stale).unionByName(daily)
