"""Joins, aggregations, paging and set operations on the driver's tables.

Roles: region - region, nation - state group, customer - organiser or member, supplier - source, orders -
events, lineitem - attendance or raw rows, events - run log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import activity_status, week_start
from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import matching as M
from ..operators import merging as G
from .registry import Tables, query


def _located(t: Tables) -> DataFrame:
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.orders.join(places, F.col("o_custkey") == F.col("c_custkey"))


@query("""
    SELECT r_name, count(DISTINCT o_custkey) AS active_kennels, count(*) AS event_count
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderstatus <> 'P' GROUP BY r_name ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""")
def active_by_region(t: Tables) -> DataFrame:
    return A.active_by_region(_located(t).where("o_orderstatus <> 'P'"), F.lit("1995-01-01").cast("timestamp_ntz"), "o_custkey", "r_name", "o_orderdate")


@query("""
    WITH top AS (SELECT o_custkey, count(*) AS attendance FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
    SELECT o_custkey, attendance, (SELECT count(*) FROM orders o WHERE o.o_custkey = top.o_custkey) AS subscriptions FROM top""")
def top_entities_with_subs(t: Tables) -> DataFrame:
    attended = t.lineitem.select("l_orderkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.top_with_lookup(attended, "o_custkey", t.orders.select("o_custkey"), 20, "attendance", "subscriptions")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def monthly_trend(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT CAST(ts AS DATE) AS bucket, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS ok_runs,
           CAST((2000 * count(*) FILTER (event_type <> 'error') + count(*)) // (2 * count(*)) AS BIGINT) AS per_mille
    FROM events GROUP BY 1""")
def daily_success_rate(t: Tables) -> DataFrame:
    return A.success_rate(t.events, F.to_date("ts"), F.col("event_type") != "error")


@query("SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n, count(DISTINCT o_custkey) AS kennels FROM orders GROUP BY 1")
def weekly_accumulation(t: Tables) -> DataFrame:
    return t.orders.groupBy(week_start(F.to_date("o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("kennels"))


@query("SELECT n, count(*) AS keys FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def histogram_of_counts(t: Tables) -> DataFrame:
    return A.histogram_of_counts(t.orders, "o_custkey")


@query("""
    SELECT user_id % 25 AS grp, count(*) FILTER (event_type IN ('view', 'click')) AS healthy, count(*) FILTER (event_type = 'signup') AS degraded,
           count(*) FILTER (event_type IN ('error', 'purchase')) AS failing FROM events GROUP BY 1""")
def status_pivot(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 25).alias("grp"), "event_type")
    return A.status_by_group(rows, "grp", "event_type", {"healthy": ["view", "click"], "degraded": ["signup"], "failing": ["error", "purchase"]})


@query("""
    SELECT s_suppkey, max(l_shipdate) AS last_at FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R'
    GROUP BY 1 HAVING max(l_shipdate) IS NULL OR max(l_shipdate) < TIMESTAMP '2001-10-20' ORDER BY 2 NULLS FIRST, 1 LIMIT 20""")
def stale_sources(t: Tables) -> DataFrame:
    runs = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"), "l_shipdate")  # only runs that went well count
    return A.stale_keys(t.supplier.select("s_suppkey"), runs, "s_suppkey", "l_shipdate", F.lit("2001-10-20").cast("timestamp_ntz"), 20)


@query("""
    SELECT kennel, max(d) AS last_date FROM (SELECT o_custkey AS kennel, CAST(o_orderdate AS DATE) AS d FROM orders
    UNION ALL SELECT o_custkey, CAST(l_shipdate AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def last_event_backfill(t: Tables) -> DataFrame:
    direct = t.orders.select(F.col("o_custkey").alias("kennel"), F.to_date("o_orderdate").alias("d"))
    bridge = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("kennel"), F.to_date("l_shipdate").alias("d"))
    return A.last_dates(direct, bridge, "kennel", "d")


@query("""
    SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS last_7d, count(DISTINCT user_id) AS users,
           count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers FROM events""")
def engagement_counters(t: Tables) -> DataFrame:
    since = F.lit("2024-01-24").cast("timestamp_ntz")
    return t.events.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ts") >= since).alias("last_7d"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"))


@query("""
    SELECT source, CAST((200 * count(*) FILTER (text <> '') + count(*)) // (2 * count(*)) AS BIGINT) AS text_rate,
           CAST((200 * count(*) FILTER (lang = 'en') + count(*)) // (2 * count(*)) AS BIGINT) AS english_rate,
           CAST((200 * count(*) FILTER (n_chars > 1000) + count(*)) // (2 * count(*)) AS BIGINT) AS long_rate FROM documents GROUP BY 1""")
def fill_rates(t: Tables) -> DataFrame:
    return A.fill_rates(t.documents, "source", {"text_rate": F.col("text") != "", "english_rate": F.col("lang") == "en", "long_rate": F.col("n_chars") > 1000})


@query("""
    SELECT o_orderkey, o_orderdate, count(l_linenumber) AS attendees, count(*) FILTER (l_returnflag = 'A') AS paid,
           count(*) FILTER (l_returnflag = 'R') AS hares, count(*) FILTER (l_quantity < 5) AS virgins
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def history_summary(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy("o_orderkey", "o_orderdate").agg(F.count("l_linenumber").alias("attendees"), F.count_if(F.col("l_returnflag") == "A").alias("paid"), F.count_if(F.col("l_returnflag") == "R").alias("hares"), F.count_if(F.col("l_quantity") < 5).alias("virgins"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') OR EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = c_custkey AND l_quantity > 49)")
def semi_some(t: Tables) -> DataFrame:
    direct = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    bridge = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("c_custkey"))
    return M.some_of_either(t.customer.select("c_custkey"), "c_custkey", direct, bridge)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-06-01')")
def anti_none(t: Tables) -> DataFrame:
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("1997-06-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return M.none(t.customer.select("c_custkey", "c_mktsegment"), recent, "c_custkey")


@query("""
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def pending_confirmations(t: Tables) -> DataFrame:
    mine = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    attended = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.none(M.some(t.orders.select("o_orderkey", "o_custkey"), mine, "o_custkey"), attended, "o_orderkey")


@query("""
    WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N')
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'verified' WHEN a.k IS NOT NULL THEN 'user-only' ELSE 'official-only' END AS status
    FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_verification(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return M.verification(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'N'"), ["k"])


@query("""
    SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-05-05' OR (o_orderdate = TIMESTAMP '1996-05-05' AND o_orderkey < 1000)
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200""")
def keyset_page(t: Tables) -> DataFrame:
    import datetime

    return L.keyset_page(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", (datetime.datetime(1996, 5, 5), 1000), 200)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(100).limit(50)


@query("""
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS start_time
    FROM orders ORDER BY d DESC, start_time ASC NULLS LAST, o_orderkey LIMIT 100""")
def topk_nulls_last(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("start_time"))
    return rows.orderBy(F.desc("d"), F.asc_nulls_last("start_time"), "o_orderkey").limit(100)


@query("""
    WITH page AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + 1 END AS parent, l_shipdate
                  FROM lineitem ORDER BY l_shipdate DESC, id DESC LIMIT 1500)
    SELECT id, l_shipdate FROM page WHERE parent IS NULL OR parent NOT IN (SELECT id FROM page)""")
def cursor_child_suppression(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") * 10 + 1).alias("parent"), "l_shipdate")
    return L.without_children(L.keyset_page(rows, "l_shipdate", "id", None, 1500), "id", "parent").select("id", "l_shipdate")


_MATRIX = "SELECT user_id, 'd' || day AS header, n FROM (SELECT user_id, day(ts) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)"


@query(_MATRIX)
def unpivot_matrix(t: Tables) -> DataFrame:
    days = [f"d{i}" for i in range(1, 32)]
    rows = t.events.select("user_id", F.concat(F.lit("d"), F.day("ts").cast("string")).alias("header"))
    return rows.groupBy("user_id").pivot("header", days).count().unpivot("user_id", days, "header", "n").where("n is not null")


@query(_MATRIX)
def unpivot_matrix_month(t: Tables) -> DataFrame:
    return unpivot_matrix(t)


@query("""
    SELECT p_partkey, trim(u.x) AS name FROM part, unnest(string_split(p_name, ' ')) AS u(x) WHERE trim(u.x) <> ''
    QUALIFY row_number() OVER (PARTITION BY p_partkey, lower(trim(u.x)) ORDER BY u.x) = 1""")
def split_name_list(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(X.name_parts(F.regexp_replace("p_name", " ", ", "))).alias("name"))


@query("""
    SELECT c_custkey, CASE WHEN last IS NULL THEN 'unknown' WHEN date_diff('day', last, DATE '1998-08-01') < 90 THEN 'active'
           WHEN date_diff('day', last, DATE '1998-08-01') < 365 THEN 'possibly-inactive' ELSE 'inactive' END AS activity
    FROM customer LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def activity_by_kennel(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.to_date("o_orderdate")).alias("last"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", activity_status(F.col("last"), F.lit("1998-08-01").cast("date")).alias("activity"))


@query("""
    SELECT o_custkey, min(struct_pack(date := CAST(o_orderdate AS DATE), event_id := o_orderkey)).date AS date, min(struct_pack(date := CAST(o_orderdate AS DATE), event_id := o_orderkey)).event_id AS event_id
    FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1""")
def next_event_per_kennel(t: Tables) -> DataFrame:
    from ..operators.projection import next_per_kennel

    events = t.orders.select(F.col("o_custkey").alias("kennel_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("event_id"))
    return next_per_kennel(events, F.lit("1997-01-01").cast("date")).withColumnRenamed("kennel_id", "o_custkey")


@query("""
    SELECT day, stream, opened, closed, reopened, opened + reopened - closed AS net FROM (
      SELECT d AS day, s AS stream,
        (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = d AND ((event_type IN ('signup', 'purchase') AND user_id % 3 = s) OR (event_type = 'click' AND user_id % 3 = s))) AS opened,
        (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = d AND ((event_type = 'error' AND user_id % 3 = s) OR (event_type = 'click' AND (user_id + 1) % 3 = s))) AS closed,
        (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = d AND event_type = 'view' AND user_id % 3 = s) AS reopened
      FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), (SELECT unnest([0, 1, 2]) AS s))""")
def stream_trend(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "CLOSED").when(F.col("event_type") == "click", "RELABELED").when(F.col("event_type").isin("signup", "purchase"), "OPENED").when(F.col("event_type") == "view", "REOPENED")
    changes = t.events.select(F.to_date("ts").alias("day"), kind.alias("kind"), (F.col("user_id") % 3).alias("to_stream"), ((F.col("user_id") + 1) % 3).alias("from_stream")).where("kind is not null")
    spine = t.events.select(F.to_date("ts").alias("day")).distinct().select("day", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("stream"))
    return A.stream_trend(changes, spine)


@query("""
    WITH s AS (SELECT c_nationkey AS g, c_acctbal AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    q AS (SELECT g, max(n) AS n, max(CASE WHEN r = floor(n * 0.25) THEN x END) AS q1, max(CASE WHEN r = floor(n * 0.75) THEN x END) AS q3 FROM s GROUP BY g)
    SELECT s.g, min(x) AS lo, max(x) AS hi, count(*) AS kept, max(q.n) AS n FROM s JOIN q ON q.g = s.g
    WHERE q.n < 8 OR x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY s.g""")
def robust_bounds(t: Tables) -> DataFrame:
    return A.robust_bounds(t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x")), "g", "x")


@query("""
    SELECT source, trim(u.b) AS block, count(DISTINCT doc_id) AS documents FROM documents, unnest(string_split(text, chr(10))) AS u(b)
    WHERE trim(u.b) <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2""")
def boilerplate_blocks(t: Tables) -> DataFrame:
    return A.repeated_blocks(t.documents, "doc_id", "text", "source")


@query("""
    WITH b AS (SELECT source, trim(u.b) AS block FROM documents, unnest(string_split(text, chr(10))) AS u(b) WHERE trim(u.b) <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2),
    p AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY pos) AS text FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source = p.source AND b.block = trim(p.part)) GROUP BY 1)
    SELECT d.doc_id, md5(coalesce(k.text, '')) AS text_md5 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""")
def boilerplate_stripped(t: Tables) -> DataFrame:
    blocks = A.repeated_blocks(t.documents, "doc_id", "text", "source")
    return A.without_blocks(t.documents, blocks, "doc_id", "text", "source").select("doc_id", F.md5("text").alias("text_md5"))


@query("""
    SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum, max(json_extract_string(props, '$.k')) AS k_max FROM events GROUP BY 1""")
def json_trend(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(k.try_cast("long")).alias("k_sum"), F.max(k).alias("k_max"))


@query("""
    WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'closed' ELSE 'open' END AS state, c_custkey % 3 AS stream FROM customer WHERE c_custkey % 11 <> 0),
    l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'closed' ELSE 'open' END AS state, c_custkey % 2 AS stream FROM customer WHERE c_custkey % 13 <> 0)
    SELECT * FROM (SELECT coalesce(r.id, l.id) AS id, CASE WHEN l.state IS NULL AND r.state = 'open' THEN 'OPENED' WHEN l.state = 'open' AND r.state = 'closed' THEN 'CLOSED'
      WHEN l.state = 'closed' AND r.state = 'open' THEN 'REOPENED' WHEN l.state IS NOT NULL AND r.state IS NOT NULL AND r.stream <> l.stream THEN 'RELABELED' END AS kind, l.stream AS from_stream, r.stream AS to_stream
      FROM r FULL JOIN l ON r.id = l.id) WHERE kind IS NOT NULL""")
def mirror_diff(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    state = lambda k: F.when(c % k == 0, "closed").otherwise("open").alias("state")
    remote = t.customer.where(c % 11 != 0).select(c.alias("id"), state(7), (c % 3).alias("stream"))
    local = t.customer.where(c % 13 != 0).select(c.alias("id"), state(5), (c % 2).alias("stream"))
    return G.mirror_diff(remote, local, "id")


@query("""
    SELECT user_id, ev, merged_rows, any_error FROM (SELECT CASE WHEN user_id % 10 = 3 THEN user_id - 3 ELSE user_id END AS user_id, CAST(ts AS DATE) AS ev,
      bool_or(event_type = 'error') AS any_error, count(*) AS merged_rows FROM events GROUP BY 1, 2)""")
def attendance_merge(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.to_date("ts").alias("ev"), (F.col("event_type") == "error").alias("any_error"))
    mapping = t.events.where("user_id % 10 = 3").select(F.col("user_id").alias("old_id"), (F.col("user_id") - 3).alias("new_id")).distinct()
    return G.repointed(rows, mapping, "user_id", ["user_id", "ev"], ["any_error"])
