"""Window, matching, schedule and audit operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint
from ..functions.rrule import occurrences
from ..operators import aggregates as A
from ..operators import audit as U
from ..operators import matching as M
from ..operators import merging as G
from ..operators import projection as P
from ..operators import windows as W
from ..operators.linking import near_names
from ..storage import spread
from .registry import Tables, query


@query("""
    SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS a,
      row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY ts DESC, event_id DESC) AS b FROM events) WHERE a <= 30 OR (event_type <> 'error' AND b <= 10)""")
def dual_quota_retention(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    return W.dual_quota(rows, "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error").select("event_id", "user_id")


_DAILY = "SELECT user_id % 20 AS src, CAST(ts AS DATE) AS day, count(*) AS n, CAST(100 * count(*) FILTER (event_type <> 'error') // count(*) AS BIGINT) AS fill, (count(*) FILTER (event_type = 'error')) * 4 > count(*) AS failed FROM events GROUP BY 1, 2"


def _daily(t: Tables) -> DataFrame:
    rows = t.events.groupBy((F.col("user_id") % 20).alias("src"), F.to_date("ts").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.expr("100 * count_if(event_type <> 'error') div count(1)").alias("fill"), (F.count_if(F.col("event_type") == "error") * 4 > F.count(F.lit(1))).alias("failed"))


@query(f"""
    WITH d AS ({_DAILY}), b AS (SELECT *, sum(n) OVER w AS s, count(n) OVER w AS k FROM d WINDOW w AS (PARTITION BY src ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT src, day, n, CASE WHEN k > 0 AND s > 0 AND n = 0 THEN 'CRITICAL' WHEN k > 0 AND s > 5 * k AND 2 * n * k < s THEN 'WARNING' END AS anomaly FROM b""")
def rolling_baseline_anomaly(t: Tables) -> DataFrame:
    base = W.rolling_baseline(_daily(t), ["src"], ["day"], "n")
    return base.select("src", "day", "n", W.count_anomaly(F.col("n"), F.col("base_sum"), F.col("base_n")).alias("anomaly"))


@query(f"""
    WITH d AS ({_DAILY}), b AS (SELECT *, sum(fill) OVER w AS s, count(fill) OVER w AS k FROM d WINDOW w AS (PARTITION BY src ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT src, day, fill FROM b WHERE k > 0 AND s >= 50 * k AND s - fill * k > 30 * k""")
def fill_rate_drop(t: Tables) -> DataFrame:
    base = W.rolling_baseline(_daily(t), ["src"], ["day"], "fill")
    return base.where(W.fill_drop(F.col("fill"), F.col("base_sum"), F.col("base_n"))).select("src", "day", "fill")


@query(f"""
    WITH d AS ({_DAILY}), b AS (SELECT *, sum(CAST(failed AS INT)) OVER (PARTITION BY src ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f FROM d)
    SELECT src, day, failed AND coalesce(f, 0) >= 2 AS alarm FROM b""")
def consecutive_failures(t: Tables) -> DataFrame:
    return _daily(t).select("src", "day", W.consecutive_failures(F.col("failed"), ["src"], ["day"]).alias("alarm"))


@query("""
    SELECT l_orderkey, l_linenumber, score FROM (SELECT l_orderkey, l_linenumber, score, row_number() OVER (PARTITION BY l_orderkey, l_returnflag
      ORDER BY l_linestatus DESC, score DESC, l_shipdate, l_linenumber) AS r FROM (SELECT *, CAST(l_tax > 0 AS INT) + CAST(l_discount > 0 AS INT) + 1 AS score FROM lineitem)) WHERE r = 1""")
def canonical_pick(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumns({"tax": F.when(F.col("l_tax") > 0, "1").otherwise(""), "disc": F.when(F.col("l_discount") > 0, "1").otherwise("")})
    scored = rows.withColumn("score", W.completeness(["tax", "disc"], ["l_quantity"]))
    best = W.pick_best(scored, ["l_orderkey", "l_returnflag"], [F.desc("l_linestatus"), F.desc("score"), F.col("l_shipdate"), F.col("l_linenumber")])
    return best.select("l_orderkey", "l_linenumber", "score")


@query("""
    WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'),
    g AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER (PARTITION BY user_id ORDER BY d), d) BETWEEN 1 AND 2 THEN 0 ELSE 1 END AS brk FROM d),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS isl FROM g)
    SELECT user_id, min(d) AS parent, min(d) AS start_date, max(d) AS end_date, count(*) AS members FROM i GROUP BY user_id, isl HAVING count(*) >= 2 AND date_diff('day', min(d), max(d)) <= 7""")
def consecutive_islands(t: Tables) -> DataFrame:
    days = t.events.where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("d")).distinct().withColumn("key", F.col("d"))
    return W.consecutive_islands(days, ["user_id"], "d", "key")


@query("""
    WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), u AS (SELECT DISTINCT user_id FROM events), a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, true AS att FROM events),
    f AS (SELECT u.user_id, s.d, coalesce(a.att, false) AS att, row_number() OVER (PARTITION BY u.user_id ORDER BY s.d DESC) AS r FROM u CROSS JOIN s LEFT JOIN a ON a.user_id = u.user_id AND a.d = s.d)
    SELECT user_id, CAST(least(coalesce(min(CASE WHEN NOT att THEN r END) - 1, count(*)), 4) AS BIGINT) AS streak FROM f GROUP BY 1""")
def streak(t: Tables) -> DataFrame:
    attended = t.events.select("user_id", F.to_date("ts").alias("d"))
    return W.streaks(attended, attended, "user_id", "d")


@query("""
    SELECT event_id, user_id, milestone FROM (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS milestone FROM events) WHERE milestone IN (1, 5, 10, 25, 50, 69, 100)""")
def milestones(t: Tables) -> DataFrame:
    return W.milestones(t.events.select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], [1, 5, 10, 25, 50, 69, 100]).select("event_id", "user_id", "milestone")


@query("""
    WITH n AS (SELECT c_nationkey AS g, dayofweek(o_orderdate) AS w, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT g, arg_max(w, n * 10 - w) AS dominant, max(n) AS dominant_rows, CAST(sum(n) AS BIGINT) AS all_rows FROM n GROUP BY 1""")
def dominant_weekday(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("g"), (F.dayofweek("o_orderdate") - 1).cast("long").alias("w"))
    return A.dominant_value(rows, "g", "w")


_SNAPSHOTS = "SELECT l_orderkey * 10 + l_linenumber AS snapshot_id, o_custkey AS kennel_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_quantity > 30 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days_out FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_OUTCOMES = f"""s AS ({_SNAPSHOTS}), e AS (SELECT DISTINCT o_custkey AS kennel_id, CAST(o_orderdate AS DATE) AS d FROM orders),
    g AS (SELECT s.snapshot_id, min(abs(date_diff('day', e.d, s.date))) AS gap FROM s JOIN e ON e.kennel_id = s.kennel_id AND abs(date_diff('day', e.d, s.date)) <= 28 GROUP BY 1),
    o AS (SELECT s.*, CASE WHEN gap <= 1 THEN 'HIT' WHEN gap <= 14 THEN 'MISS' ELSE 'UNOBSERVED' END AS outcome FROM s LEFT JOIN g ON g.snapshot_id = s.snapshot_id)"""


def _outcomes(t: Tables) -> DataFrame:
    events = t.orders.select(F.col("o_custkey").alias("kennel_id"), F.to_date("o_orderdate").alias("date"))
    snaps = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("snapshot_id"), F.col("o_custkey").alias("kennel_id"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_quantity") > 30, "HIGH").otherwise("MEDIUM").alias("confidence"), F.datediff("l_shipdate", "o_orderdate").alias("days_out"))
    return P.outcomes(snaps, events)


@query(f"WITH {_OUTCOMES} SELECT snapshot_id, outcome FROM o")
def ledger_outcomes(t: Tables) -> DataFrame:
    return _outcomes(t).select("snapshot_id", "outcome")


@query(f"""
    WITH {_OUTCOMES}, b AS (SELECT *, CASE WHEN days_out BETWEEN 0 AND 45 THEN 0 WHEN days_out BETWEEN 46 AND 120 THEN 1 WHEN days_out BETWEEN 121 AND 200 THEN 2 WHEN days_out > 200 THEN 3 END AS bin FROM o),
    c AS (SELECT confidence, bin, count(*) FILTER (outcome = 'HIT') AS hits, count(*) FILTER (outcome = 'MISS') AS misses FROM b GROUP BY 1, 2)
    SELECT x.confidence, y.bin, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses, CASE WHEN hits + misses > 0 THEN CAST(1000 * hits // (hits + misses) AS BIGINT) END AS per_mille
    FROM (SELECT unnest(['HIGH', 'MEDIUM', 'LOW']) AS confidence) x CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS bin) y LEFT JOIN c ON c.confidence = x.confidence AND c.bin = y.bin""")
def precision_grid(t: Tables) -> DataFrame:
    return A.precision_grid(_outcomes(t), ["HIGH", "MEDIUM", "LOW"], [(0, 45), (46, 120), (121, 200), (201, None)])


@query("""
    SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key, date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE)) AS gap FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
    AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) BETWEEN 1 AND 2""")
def interval_match(t: Tables) -> DataFrame:
    a = t.orders.select("o_custkey", F.col("o_orderkey").alias("a_key"), F.to_date("o_orderdate").alias("a_date"))
    b = t.orders.select("o_custkey", F.col("o_orderkey").alias("b_key"), F.to_date("o_orderdate").alias("b_date"))
    return M.interval_join(a, b, ["o_custkey"], "a_date", "b_date", 2).select("a_key", "b_key", F.datediff("b_date", "a_date").cast("long").alias("gap"))


@query("""
    WITH n AS (SELECT lower(p_name) AS n, min(p_partkey) AS k FROM part GROUP BY 1)
    SELECT a.k AS a, b.k AS b, levenshtein(a.n, b.n) AS distance FROM n a JOIN n b ON a.k < b.k AND greatest(length(a.n), length(b.n)) - levenshtein(a.n, b.n) >= 0.7 * greatest(length(a.n), length(b.n))""")
def fuzzy_duplicates(t: Tables) -> DataFrame:
    names = t.part.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    pairs = near_names(names, names.select(F.col("name").alias("other"), F.col("k").alias("j")), "name", "other", [], 0.7).where("k < j")
    return pairs.select(F.col("k").alias("a"), F.col("j").alias("b"), F.levenshtein("name", "other").cast("long").alias("distance")).distinct()


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'O'), e AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F')
    SELECT r.o_orderkey, max(e.d) AS last_date FROM r LEFT JOIN e ON e.o_custkey = r.o_custkey AND e.d <= r.d GROUP BY 1""")
def asof_latest(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("d"))
    return M.asof_latest(rows.where("o_orderstatus = 'O'").drop("o_orderstatus"), rows.where("o_orderstatus = 'F'"), "o_custkey", "d", "d").select("o_orderkey", "last_date")


@query("""
    WITH p AS (SELECT c_custkey, (c_custkey * 37) % 160 - 80 + (c_custkey % 100) / 100.0 AS latitude, (c_custkey * 91) % 360 - 180 + (c_custkey % 97) / 97.0 AS longitude FROM customer),
    s AS (SELECT n_nationkey AS stop_id, (n_nationkey * 53) % 140 - 70.0 AS lat, (n_nationkey * 29) % 360 - 180.0 AS lng FROM nation),
    d AS (SELECT stop_id, c_custkey, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (SELECT *, pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lng) / 2), 2) AS a FROM s, p))
    SELECT stop_id, c_custkey, CASE WHEN km <= 10 THEN 'nearby' WHEN km <= 25 THEN 'area' ELSE 'drive' END AS distance_tier FROM d WHERE km <= 900""")
def radius_search(t: Tables) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    places = t.customer.select(c, ((c * 37) % 160 - 80 + (c % 100) / 100.0).alias("latitude"), ((c * 91) % 360 - 180 + (c % 97) / 97.0).alias("longitude"))
    stops = t.nation.select(n.alias("stop_id"), ((n * 53) % 140 - 70.0).alias("lat"), ((n * 29) % 360 - 180.0).alias("lng"))
    return M.radius_join(stops, places, 900.0).select("stop_id", "c_custkey", "distance_tier")


_RULES = """SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 3 = 0 THEN 'FREQ=WEEKLY;INTERVAL=2;BYDAY=SA' WHEN p_partkey % 3 = 1 THEN 'FREQ=MONTHLY;BYDAY=2WE' ELSE 'FREQ=MONTHLY;BYMONTHDAY=31' END AS rule FROM part"""


@query(f"""
    WITH r AS ({_RULES}), d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-09-30', INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT rule_id, date FROM r, d WHERE (rule_id % 3 = 0 AND dayofweek(date) = 6 AND (date_diff('day', DATE '2024-01-06', date) // 7) % 2 = 0)
      OR (rule_id % 3 = 1 AND dayofweek(date) = 3 AND day(date) BETWEEN 8 AND 14) OR (rule_id % 3 = 2 AND date = last_day(date))""")
def rrule_occurrences(t: Tables) -> DataFrame:
    return _occurrences(t.part)


def _occurrences(parts: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    rule = F.when(k % 3 == 0, "FREQ=WEEKLY;INTERVAL=2;BYDAY=SA").when(k % 3 == 1, "FREQ=MONTHLY;BYDAY=2WE").otherwise("FREQ=MONTHLY;BYMONTHDAY=31")
    day = lambda s: F.lit(s).cast("date")
    return spread(parts.select("p_partkey"), "p_partkey").select(k.alias("rule_id"), F.explode(occurrences(rule, day("2024-01-10"), day("2024-09-30"), day("2024-01-06"))).alias("date"))


@query("""
    WITH r AS (SELECT p_partkey AS rule_id FROM part), d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-09-30', INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT rule_id, date FROM r, d WHERE (rule_id % 3 = 0 AND dayofweek(date) = 6 AND (date_diff('day', DATE '2024-01-06', date) // 7) % 2 = 0)
      OR (rule_id % 3 = 1 AND dayofweek(date) = 3 AND day(date) BETWEEN 8 AND 14) OR (rule_id % 3 = 2 AND date = last_day(date))""")
def rrule_occurrences_all(t: Tables) -> DataFrame:
    return _occurrences(t.part)


@query("""
    SELECT o_orderkey FROM orders WHERE CASE WHEN o_custkey % 2 = 0 THEN strftime(o_orderdate, '%m-%d') BETWEEN '04-15' AND '09-30'
      ELSE strftime(o_orderdate, '%m-%d') >= '11-01' OR strftime(o_orderdate, '%m-%d') <= '03-01' END""")
def season_filter(t: Tables) -> DataFrame:
    from ..functions.dates import within_season

    even = F.col("o_custkey") % 2 == 0
    return t.orders.where(within_season(F.to_date("o_orderdate"), F.when(even, "04-15").otherwise("11-01"), F.when(even, "09-30").otherwise("03-01"))).select("o_orderkey")


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey AS kennel_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linestatus = 'O' THEN '10:00' END AS start_time, CASE WHEN l_quantity > 40 THEN 'HIGH' WHEN l_quantity > 15 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, l_orderkey * 10 + l_linenumber AS rule_id FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY kennel_id, date, start_time ORDER BY CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, rule_id) AS r FROM p),
    e AS (SELECT DISTINCT o_custkey AS kennel_id, CAST(o_orderdate AS DATE) AS date FROM orders)
    SELECT k.kennel_id, k.date, k.rule_id FROM k WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.kennel_id = k.kennel_id AND e.date = k.date)""")
def projection_dedupe(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("kennel_id"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_linestatus") == "O", "10:00").alias("start_time"), F.when(F.col("l_quantity") > 40, "HIGH").when(F.col("l_quantity") > 15, "MEDIUM").otherwise("LOW").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rule_id"))
    events = t.orders.select(F.col("o_custkey").alias("kennel_id"), F.to_date("o_orderdate").alias("date"), F.lit(None).cast("string").alias("start_time"))
    return P.not_confirmed(P.best_per_slot(rows), events).select("kennel_id", "date", "rule_id")


@query("""
    WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey, sha256(concat_ws('|', strftime(l_shipdate, '%Y-%m-%d'), l_returnflag || ',' || l_shipstat, CAST(l_partkey AS VARCHAR), l_linestatus)) AS fp
               FROM (SELECT *, 'S' || l_linestatus AS l_shipstat FROM lineitem)), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, fp ORDER BY l_orderkey, l_linenumber) AS r FROM f)
    SELECT l_orderkey, l_linenumber, fp FROM k WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.l_suppkey = k.l_suppkey AND g.fp = k.fp AND g.l_orderkey < 1000) AND l_orderkey >= 1000""")
def fingerprint_dedupe(t: Tables) -> DataFrame:
    tags = F.array(F.col("l_returnflag"), F.concat(F.lit("S"), F.col("l_linestatus")), F.col("l_returnflag"))
    fp = fingerprint(F.to_date("l_shipdate"), tags, [("part", F.col("l_partkey")), ("status", F.col("l_linestatus"))], gated=[("never", F.lit(None).cast("string"))])
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", fp.alias("fp"))
    new = G.insert_if_absent(rows.where("l_orderkey >= 1000"), rows.where("l_orderkey < 1000"), ["l_suppkey", "fp"], [F.col("l_orderkey"), F.col("l_linenumber")])
    return new.select("l_orderkey", "l_linenumber", "fp")


_SENDER = "CASE doc_id % 23 WHEN 0 THEN 'bh3   Trail ' || doc_id WHEN 1 THEN 'Boston trail' WHEN 2 THEN 'Wanna hare? ask' WHEN 3 THEN 'Hash runs on the first day' WHEN 4 THEN 'It meets every week' WHEN 5 THEN 'A &amp; B' WHEN 6 THEN '12:30pm' WHEN 7 THEN 'claim this trail' ELSE source END"
_HARES = "CASE doc_id % 19 WHEN 0 THEN 'X' WHEN 1 THEN 'X ' WHEN 2 THEN 'tbd' WHEN 3 THEN 'Hares needed now' WHEN 4 THEN 'http://x.example' WHEN 5 THEN 'see http://x.example' WHEN 6 THEN 'Al (415) 555-1212' WHEN 7 THEN 'Zed Location: the pub' WHEN 8 THEN 'HTTP://x.example' WHEN 9 THEN 'sign' || chr(160) || 'up' WHEN 10 THEN repeat('ab ', 70) ELSE source END"
_PLACE = "CASE doc_id % 17 WHEN 0 THEN 'https://x.example' WHEN 1 THEN 'N Main Road, north main rd, Town' WHEN 2 THEN 'Bar 415-555-1212' WHEN 3 THEN 'Inquire: a@b.org' WHEN 4 THEN 'Bar, Town' WHEN 5 THEN 'see https://x.example' ELSE 'Pub, ' || source END"
_RULED = """CASE doc_id % 23 WHEN 0 THEN 'title-raw-kennel-code' WHEN 2 THEN 'title-cta-text' WHEN 3 THEN 'title-schedule-description' WHEN 4 THEN 'title-schedule-description' WHEN 5 THEN 'title-html-entities' WHEN 6 THEN 'title-time-only' WHEN 7 THEN 'title-cta-text' END AS title_rule,
      CASE doc_id % 19 WHEN 0 THEN 'hare-single-char' WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'hare-cta-text' END WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'hare-cta-text' ELSE 'hare-boilerplate-leak' END WHEN 4 THEN 'hare-url' WHEN 6 THEN 'hare-phone-number' WHEN 7 THEN 'hare-boilerplate-leak' WHEN 9 THEN CASE WHEN doc_id % 2 = 0 THEN 'hare-cta-text' END WHEN 10 THEN 'hare-description-leak' END AS hares_rule,
      CASE doc_id % 17 WHEN 0 THEN 'location-url' WHEN 1 THEN 'location-duplicate-segments' WHEN 2 THEN 'location-phone-number' WHEN 3 THEN 'location-email-cta' END AS location_rule,
      CASE WHEN doc_id % 24 >= 23 OR doc_id % 24 <= 3 THEN 'event-improbable-time' END AS event_rule, CASE WHEN doc_id % 3 = 0 AND length(text) > 20 THEN 'description-dropped' END AS description_rule"""
_FINDINGS = "SELECT event_id, kennel_id, field, rule FROM (SELECT doc_id AS event_id, source AS kennel_id, unnest(['title', 'hares', 'location', 'event', 'description']) AS field, unnest([title_rule, hares_rule, location_rule, event_rule, description_rule]) AS rule FROM a) WHERE rule IS NOT NULL"
_AUDITED = f"SELECT doc_id, source, {_RULED} FROM documents"


def _findings(t: Tables) -> DataFrame:
    """All rules over rows that each bear one of some texts; the SQL states which rule each text breaks."""
    rows = t.documents.select(
        F.col("doc_id").alias("event_id"), F.col("source").alias("kennel_id"), F.expr(_SENDER.replace("chr(160)", "'\\u00a0'")).alias("title"), F.lit("bh3").alias("kennel_code"), F.lit("Boston").alias("kennel_short_name"), F.expr(_HARES.replace("chr(160)", "'\\u00a0'")).alias("hares"), F.expr(_PLACE).alias("location"),
        F.expr("if(doc_id % 2 = 0, date'2024-01-10', date'2024-03-01')").alias("date"), F.format_string("%02d:00", F.col("doc_id") % 24).alias("start_time"), F.when(F.col("doc_id") % 3 > 0, "x").alias("description"), F.col("text").alias("raw_description"),
    )
    return U.audit(rows, U.builtin_rules(F.lit("2024-01-01").cast("date")), ("event_id", "kennel_id"))


@query(f"WITH a AS ({_AUDITED}) {_FINDINGS}")
def audit_rules(t: Tables) -> DataFrame:
    return _findings(t)


@query("""
    SELECT doc_id FROM documents WHERE (source = 'src3' OR (lang = 'de' AND NOT starts_with(source, 'src1'))) AND length(coalesce(text, '')) > 100 AND NOT regexp_matches(coalesce(text, ''), '(?i)zz')""")
def matcher_language(t: Tables) -> DataFrame:
    rule = {"op": "and", "of": [
        {"op": "or", "of": [{"op": "equals", "field": "source", "value": "src3"}, {"op": "and", "of": [{"op": "equals", "field": "lang", "value": "de"}, {"op": "not", "of": {"op": "starts_with", "field": "source", "value": "src1"}}]}]},
        {"op": "length_gt", "field": "text", "value": 100}, {"op": "not", "of": {"op": "regex", "field": "text", "value": "zz", "ignore_case": True}},
    ]}
    return t.documents.where(U.compiled(rule)).select("doc_id")


@query(f"""
    WITH a AS ({_AUDITED}), f AS ({_FINDINGS}), r AS (SELECT *, row_number() OVER (PARTITION BY kennel_id, rule ORDER BY event_id) AS k FROM f)
    SELECT kennel_id, rule, CASE WHEN rule = 'hare-url' THEN 0 ELSE 1 END AS severity_rank, count(*) AS n, list(event_id ORDER BY event_id) FILTER (k <= 3) AS samples FROM r GROUP BY 1, 2 ORDER BY 3, 4 DESC, 1, 2 LIMIT 10""")
def audit_group_rank(t: Tables) -> DataFrame:
    return A.grouped_findings(_findings(t), F.when(F.col("rule") == "hare-url", 0).otherwise(1), 10)
