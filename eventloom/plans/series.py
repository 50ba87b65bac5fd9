"""Canonical rows, series, suggestions and run health on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cluster_key
from ..operators import merging as G
from ..operators import projection as P
from ..operators import series as S
from ..operators import windows as W
from .registry import Tables, query

DAY = lambda s: F.lit(s).cast("date")
_CAND = """SELECT l_orderkey * 100 + l_partkey % 100 AS event_id, l_suppkey % 10 AS kennel_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS INT) % 20 END AS run_number, CASE WHEN l_discount > 0.03 THEN 'u' || CAST(l_partkey % 5 AS VARCHAR) ELSE ' ' END AS source_url,
    CASE WHEN l_tax > 0.02 THEN '1' || CAST(l_partkey % 2 AS VARCHAR) || ':00' END AS start_time, 'T' || CAST(l_partkey % 3 AS VARCHAR) AS title, CASE WHEN l_returnflag = 'R' THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status, l_linenumber AS trust, l_partkey % 4 AS completeness, l_orderkey % 50 AS created_at FROM lineitem"""


def _candidates(t: Tables) -> DataFrame:
    p = F.col("l_partkey")
    return t.lineitem.select(
        (F.col("l_orderkey") * 100 + p % 100).alias("event_id"), (F.col("l_suppkey") % 10).alias("kennel_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int") % 20).alias("run_number"),
        F.when(F.col("l_discount") > 0.03, F.concat(F.lit("u"), (p % 5).cast("string"))).otherwise(" ").alias("source_url"), F.when(F.col("l_tax") > 0.02, F.concat(F.lit("1"), (p % 2).cast("string"), F.lit(":00"))).alias("start_time"), F.concat(F.lit("T"), (p % 3).cast("string")).alias("title"),
        F.when(F.col("l_returnflag") == "R", "CANCELLED").otherwise("CONFIRMED").alias("status"), F.col("l_linenumber").alias("trust"), (p % 4).alias("completeness"), (F.col("l_orderkey") % 50).alias("created_at"),
    )


@query(f"""
    WITH c AS ({_CAND}), s AS (SELECT *, CASE WHEN run_number IS NOT NULL THEN 'run#' || run_number || '::' || trim(source_url) ELSE coalesce(trim(start_time), '') || '::' || trim(source_url) || '::' || title END AS sig FROM c),
    g AS (SELECT kennel_id, date, run_number, sig, trim(min(source_url)) = '' AS bare, coalesce(list(DISTINCT start_time ORDER BY start_time) FILTER (start_time IS NOT NULL), []) AS times FROM s WHERE run_number IS NOT NULL GROUP BY 1, 2, 3, 4),
    x AS (SELECT a.kennel_id, a.date, a.sig, min(b.sig) AS peer FROM g a JOIN g b ON a.kennel_id = b.kennel_id AND a.date = b.date AND a.run_number = b.run_number AND a.bare AND NOT b.bare
      AND CASE WHEN len(a.times) = 0 THEN len(b.times) <= 1 WHEN len(b.times) = 0 THEN len(a.times) <= 1 ELSE a.times = b.times END GROUP BY 1, 2, 3 HAVING count(*) = 1),
    m AS (SELECT s.*, coalesce(x.peer, s.sig) AS own FROM s LEFT JOIN x ON x.kennel_id = s.kennel_id AND x.date = s.date AND x.sig = s.sig),
    r AS (SELECT *, row_number() OVER (PARTITION BY kennel_id, date, own ORDER BY status = 'CANCELLED', trust DESC, completeness DESC, created_at, event_id) AS k FROM m) SELECT kennel_id, date, event_id, status, trust FROM r WHERE k = 1""")
def canonical_rows(t: Tables) -> DataFrame:
    return S.canonical_rows(_candidates(t)).select("kennel_id", "date", "event_id", "status", "trust")


@query(f"WITH c AS ({_CAND}) SELECT event_id, CASE WHEN run_number IS NOT NULL THEN 'run#' || run_number || '::' || trim(source_url) ELSE coalesce(trim(start_time), '') || '::' || trim(source_url) || '::' || title END AS sig FROM c")
def event_signatures(t: Tables) -> DataFrame:
    return _candidates(t).select("event_id", W.signature(F.col("run_number"), F.col("source_url"), F.col("start_time"), F.col("title")).alias("sig"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, (l_returnflag <> '')::INT + (l_linestatus <> 'O')::INT + (l_quantity IS NOT NULL)::INT + (l_tax > 0 AND l_discount > 0)::INT AS score FROM lineitem""")
def completeness_scores(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumns({"status": F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).otherwise(""), "tax": F.when(F.col("l_tax") > 0, F.col("l_tax")), "disc": F.when(F.col("l_discount") > 0, F.col("l_discount"))})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", W.completeness(["l_returnflag", "status"], ["l_quantity"], [("tax", "disc")]).alias("score"))


_SER = "SELECT o_orderkey AS event_id, o_custkey % 40 AS series, CAST(o_orderdate AS DATE) AS date, o_orderkey % 17 = 0 AS is_parent, CASE WHEN o_orderstatus = 'P' OR o_custkey % 40 IN (3, 5) THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status, o_orderkey % 5 = 0 AS admin_locked FROM orders"


def _series(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 40
    return t.orders.select(k.alias("event_id"), c.alias("series"), F.to_date("o_orderdate").alias("date"), (k % 17 == 0).alias("is_parent"), F.when((F.col("o_orderstatus") == "P") | c.isin(3, 5), "CANCELLED").otherwise("CONFIRMED").alias("status"), (k % 5 == 0).alias("admin_locked"))


@query(f"WITH s AS ({_SER}), p AS (SELECT *, first(event_id) OVER (PARTITION BY series ORDER BY is_parent DESC, date, event_id) AS f FROM s) SELECT event_id, CASE WHEN f <> event_id THEN f END AS parent_id FROM p")
def series_parents(t: Tables) -> DataFrame:
    return S.series_parents(_series(t), "series").select("event_id", "parent_id")


@query(f"""
    WITH s AS ({_SER}), p AS (SELECT *, first(event_id) OVER (PARTITION BY series ORDER BY is_parent DESC, date, event_id) AS f FROM s), c AS (SELECT f, bool_and(status = 'CANCELLED') AS off FROM p WHERE f <> event_id GROUP BY 1)
    SELECT event_id, CASE WHEN admin_locked THEN status WHEN off AND status = 'CONFIRMED' THEN 'CANCELLED' WHEN NOT off AND status = 'CANCELLED' THEN 'CONFIRMED' ELSE status END AS status FROM p JOIN c ON c.f = p.event_id WHERE p.f = p.event_id""")
def series_cancellation(t: Tables) -> DataFrame:
    return S.cascaded_status(S.series_parents(_series(t), "series"))


@query("""
    WITH r AS (SELECT o_orderkey AS id, o_custkey % 60 AS k, CAST(o_orderdate AS DATE) AS d, 'camp weekend ' || CAST(o_custkey % 3 AS VARCHAR) AS title, o_orderkey % 23 = 0 AS linked FROM orders),
    g AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER w, d) BETWEEN 1 AND 2 THEN 0 ELSE 1 END AS brk FROM r WINDOW w AS (PARTITION BY k, title ORDER BY d, id)), i AS (SELECT *, sum(brk) OVER (PARTITION BY k, title ORDER BY d, id ROWS UNBOUNDED PRECEDING) AS isl FROM g)
    SELECT k, arg_min(id, CAST(strftime(d, '%Y%m%d') AS BIGINT) * 1000000000 + id) AS parent, max(d) AS end_date, count(*) AS members FROM i GROUP BY k, title, isl HAVING count(*) >= 2 AND date_diff('day', min(d), max(d)) <= 7 AND NOT bool_or(linked)""")
def same_title_runs(t: Tables) -> DataFrame:
    c, key = F.col("o_custkey"), F.col("o_orderkey")
    title = F.concat(F.lit("Camp Weekend #"), (c % 3).cast("string"), F.lit("x Trail"))
    rows = t.orders.select(key.alias("id"), (c % 60).alias("k"), F.to_date("o_orderdate").alias("d"), cluster_key(title).alias("title"), (key % 23 == 0).alias("linked"))
    return S.titled_runs(rows, ["k", "title"], "d", "id", "linked").select("k", "parent", "end_date", "members")


@query("""
    WITH r AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN DATE '2024-01-01' + CAST(user_id % 5000 AS INT) END AS d, event_id % 97 = 0 AS num FROM events), x AS (SELECT *, bool_or(num) OVER (PARTITION BY d) AS anyn FROM r) SELECT event_id FROM x WHERE d IS NULL OR num OR NOT anyn""")
def numeric_ids_first(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_id") % 9 > 0, F.date_add(DAY("2024-01-01"), (F.col("user_id") % 5000).cast("int"))).alias("d"), F.when(F.col("event_id") % 97 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("x"), "event_id")).alias("key"))
    return S.numeric_ids_first(rows, "d", "key").select("event_id")


_CAL = """SELECT event_id AS ordinal, CASE WHEN event_id % 3 = 0 THEN 'g' || CAST(event_id % 400 AS VARCHAR) END AS item_id, user_id % 5 AS tag, CAST(ts AS DATE) AS date, CASE WHEN event_type <> 'view' THEN '1' || CAST(event_id % 3 AS VARCHAR) || ':00' END AS start_time, event_type AS title, event_type = 'view' AS all_day,
    CASE WHEN user_id % 2 = 0 THEN 'h' || CAST(user_id AS VARCHAR) END AS hares, CASE WHEN event_id % 4 = 0 THEN 'l' || CAST(event_id AS VARCHAR) END AS location FROM events"""


@query(f"""
    WITH c AS ({_CAL}), a AS (SELECT * FROM c WHERE NOT (all_day AND hares IS NULL AND location IS NULL AND EXISTS (SELECT 1 FROM c b WHERE b.tag = c.tag AND b.date = c.date AND NOT b.all_day))),
    i AS (SELECT *, row_number() OVER (PARTITION BY coalesce('id:' || item_id, 'legacy:|' || CAST(date AS VARCHAR) || '|' || tag || '|' || coalesce(start_time, '') || '|' || coalesce(title, '')) ORDER BY ordinal) AS k FROM a)
    SELECT tag, date, start_time, title, min(ordinal) AS ordinal, arg_min(hares, ordinal) FILTER (hares IS NOT NULL) AS hares, arg_min(location, ordinal) FILTER (location IS NOT NULL) AS location FROM i WHERE k = 1 GROUP BY 1, 2, 3, 4""")
def calendar_dedupe(t: Tables) -> DataFrame:
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    rows = t.events.select(e.alias("ordinal"), F.when(e % 3 == 0, F.concat(F.lit("g"), (e % 400).cast("string"))).alias("item_id"), (u % 5).alias("tag"), F.to_date("ts").alias("date"), F.when(kind != "view", F.concat(F.lit("1"), (e % 3).cast("string"), F.lit(":00"))).alias("start_time"), kind.alias("title"), (kind == "view").alias("all_day"),
        F.when(u % 2 == 0, F.concat(F.lit("h"), u.cast("string"))).alias("hares"), F.when(e % 4 == 0, F.concat(F.lit("l"), e.cast("string"))).alias("location"))
    return S.calendar_dedupe(rows)


@query("""
    WITH e AS (SELECT o_orderkey AS event_id, o_custkey % 20 AS kennel_id, o_custkey % 10 AS roster_id, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-05' AND TIMESTAMP '1998-07-01'),
    a AS (SELECT DISTINCT l_suppkey % 25 AS hasher, e.* FROM lineitem JOIN e ON l_orderkey = event_id), r AS (SELECT DISTINCT event_id, kennel_id, roster_id, date FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY kennel_id ORDER BY date DESC, event_id) AS pos FROM r),
    kn AS (SELECT kennel_id, roster_id, count(*) AS ke FROM k GROUP BY 1, 2), rn AS (SELECT roster_id, count(*) AS re FROM r GROUP BY 1 HAVING count(*) >= 3), h AS (SELECT roster_id, hasher, count(*) AS rr, max(date) AS last FROM a GROUP BY 1, 2),
    o AS (SELECT a.kennel_id, hasher, count(*) AS runs, bool_or(pos = 1) AS p1, bool_or(pos = 2) AS p2, bool_or(pos = 3) AS p3, bool_or(pos = 4) AS p4 FROM a JOIN k ON k.event_id = a.event_id GROUP BY 1, 2),
    s AS (SELECT kn.kennel_id, h.hasher, ke, re, rr, last, coalesce(runs, 0) AS runs, CASE WHEN NOT coalesce(p1, false) THEN 0 WHEN NOT p2 THEN 1 WHEN NOT p3 THEN 2 WHEN NOT p4 THEN 3 ELSE 4 END AS streak FROM kn JOIN rn ON rn.roster_id = kn.roster_id JOIN h ON h.roster_id = kn.roster_id LEFT JOIN o ON o.kennel_id = kn.kennel_id AND o.hasher = h.hasher),
    f AS (SELECT kennel_id, hasher, streak, CAST(floor((0.35::DOUBLE * runs / ke + 0.15::DOUBLE * rr / re + 0.30::DOUBLE * greatest(0::DOUBLE, 1 - date_diff('day', last, DATE '1998-07-02')::DOUBLE / 180) + 0.20::DOUBLE * streak / 4) * 1000 + 0.5) AS BIGINT) AS score FROM s)
    SELECT kennel_id, hasher, score, streak FROM f WHERE score >= 300""")
def suggestion_scores(t: Tables) -> DataFrame:
    events = t.orders.where("o_orderdate between timestamp_ntz'1998-01-05' and timestamp_ntz'1998-07-01'").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 20).alias("kennel_id"), (F.col("o_custkey") % 10).alias("roster_id"), F.to_date("o_orderdate").alias("date"))
    attendance = t.lineitem.select((F.col("l_suppkey") % 25).alias("hasher"), F.col("l_orderkey").alias("event_id"))
    return S.suggestion_scores(events, attendance, DAY("1998-07-02"))


@query("""
    WITH s AS (SELECT l_suppkey AS kennel, l_orderkey, l_partkey, l_quantity AS q FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY kennel ORDER BY q DESC, l_orderkey, l_partkey) AS pos FROM s) SELECT kennel, l_orderkey, l_partkey, pos FROM r WHERE pos <= 10""")
def suggestion_top(t: Tables) -> DataFrame:
    w = Window.partitionBy("kennel").orderBy(F.desc("l_quantity"), "l_orderkey", "l_partkey")
    return t.lineitem.withColumn("kennel", F.col("l_suppkey")).withColumn("pos", F.row_number().over(w)).where("pos <= 10").select("kennel", "l_orderkey", "l_partkey", "pos")


@query("""
    WITH h AS (SELECT l_orderkey AS event_id, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey END AS user_id, CASE WHEN l_suppkey % 6 = 0 THEN ' ' ELSE 'H' || CAST(l_suppkey AS VARCHAR) END AS name FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT l_orderkey AS event_id, l_suppkey AS user_id, 'A' || CAST(l_partkey AS VARCHAR) AS name FROM lineitem WHERE l_returnflag <> 'R')
    SELECT event_id, user_id, CASE WHEN trim(name) = '' THEN 'Hare' ELSE trim(name) END AS name, true AS is_hare FROM h UNION ALL SELECT event_id, user_id, min(name), false FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.event_id = a.event_id AND h.user_id = a.user_id) GROUP BY 1, 2""")
def roster_assembly(t: Tables) -> DataFrame:
    s = F.col("l_suppkey")
    hares = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event_id"), F.when(s % 4 > 0, s).alias("user_id"), F.when(s % 6 == 0, " ").otherwise(F.concat(F.lit("H"), s.cast("string"))).alias("name"))
    others = t.lineitem.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("event_id"), s.alias("user_id"), F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("name"))
    return S.roster(hares, others)


_RUNS = """SELECT user_id % 15 AS src, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') * 4 > count(*) AS failed, CASE WHEN count(*) % 3 > 0 THEN 'h' || CAST(count(*) // 8 AS VARCHAR) END AS hash, CAST(100 * count(*) FILTER (event_type = 'view') // count(*) AS BIGINT) AS fill,
    count(*) FILTER (event_type = 'purchase') AS cancelled, list(DISTINCT event_type || CAST(user_id % 4 AS VARCHAR) ORDER BY event_type || CAST(user_id % 4 AS VARCHAR)) AS tags, user_id % 15 < 7 AND CAST(ts AS DATE) >= DATE '2024-01-15' AS cfg FROM events GROUP BY 1, 2, 9"""


def _runs(t: Tables) -> DataFrame:
    kind, n = F.col("event_type"), F.count(F.lit(1))
    rows = t.events.groupBy((F.col("user_id") % 15).alias("src"), F.to_date("ts").alias("day")).agg(
        n.alias("n"), (F.count_if(kind == "error") * 4 > n).alias("failed"), F.when(n % 3 > 0, F.concat(F.lit("h"), F.floor(n / 8).cast("string"))).alias("hash"), F.expr("100 * count_if(event_type = 'view') div count(1)").alias("fill"),
        F.count_if(kind == "purchase").alias("cancelled"), F.array_sort(F.collect_set(F.concat(kind, (F.col("user_id") % 4).cast("string")))).alias("tags"),
    )
    return rows.withColumn("cfg", (F.col("src") < 7) & (F.col("day") >= DAY("2024-01-15")))


@query(f"""
    WITH r AS ({_RUNS}), s AS (SELECT r.src, r.day, r.n, (SELECT sum(x.n) FROM (SELECT n FROM r b WHERE b.src = r.src AND b.cfg = r.cfg AND NOT b.failed AND b.day < r.day ORDER BY b.day DESC LIMIT 10) x) AS s, (SELECT count(*) FROM (SELECT n FROM r b WHERE b.src = r.src AND b.cfg = r.cfg AND NOT b.failed AND b.day < r.day ORDER BY b.day DESC LIMIT 10) x) AS k FROM r)
    SELECT src, day, CAST(s AS BIGINT) AS base_sum, k AS base_n, CASE WHEN k > 0 AND s > 0 AND n = 0 THEN 'CRITICAL' WHEN k > 0 AND s > 5 * k AND 2 * n * k < s THEN 'WARNING' END AS anomaly FROM s""")
def success_baseline(t: Tables) -> DataFrame:
    """Baseline over the previous ten successful runs of the same configuration."""
    base = W.success_baseline(_runs(t), ["src", "cfg"], ["day"], "n", F.col("failed"))
    return base.select("src", "day", "base_sum", "base_n", W.count_anomaly(F.col("n"), F.col("base_sum"), F.col("base_n")).alias("anomaly"))


@query(f"""
    WITH r AS ({_RUNS}), x AS (SELECT *, (SELECT b.hash FROM r b WHERE b.src = r.src AND b.day < r.day AND b.hash IS NOT NULL AND b.day >= r.day - 10 ORDER BY b.day DESC LIMIT 1) AS prev, avg(n) OVER w AS an, avg(fill) OVER w AS af FROM r WINDOW w AS (PARTITION BY src ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT src, day, CASE WHEN hash <> prev THEN CASE WHEN (floor(an + 0.5) - n) * 100 > 20.5 * floor(an + 0.5) OR (floor(an + 0.5) - n) * 100 = 20.5 * floor(an + 0.5) OR (af >= 50 AND af - fill > 15) THEN 'WARNING' ELSE 'INFO' END END AS alert FROM x""")
def structure_changes(t: Tables) -> DataFrame:
    return W.structure_alerts(_runs(t), ["src"], "day", "hash", "n", "fill").select("src", "day", "alert")


@query(f"""
    WITH r AS ({_RUNS}), o AS (SELECT src, day, tags, list(tags) OVER (PARTITION BY src ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS before FROM r) SELECT src, day, list_filter(tags, lambda x: NOT coalesce(list_contains(flatten(before), x), false)) AS novel FROM o""")
def novel_tags(t: Tables) -> DataFrame:
    return _runs(t).select("src", "day", F.array_sort(W.novel_items("tags", ["src"], ["day"])).alias("novel"))


@query(f"""
    WITH r AS ({_RUNS}), b AS (SELECT *, avg(n) OVER (PARTITION BY src ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean FROM r)
    SELECT src, day, cancelled > 10 OR coalesce(mean > 0 AND cancelled * 2 > mean, false) AS excessive, failed, n = 0 AS nothing, cancelled > n AS mismatch, CASE WHEN failed OR n = 0 THEN 'FAILING' WHEN cancelled > 10 OR (mean > 0 AND cancelled * 2 > mean) THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM b""")
def run_flags(t: Tables) -> DataFrame:
    base = W.rolling_baseline(_runs(t), ["src"], ["day"], "n")
    excessive = W.excessive_cancellations(F.col("cancelled"), F.col("base_sum"), F.col("base_n"))
    severity = F.when(F.col("failed") | (F.col("n") == 0), 2).when(excessive, 1).otherwise(0)
    return base.select("src", "day", excessive.alias("excessive"), "failed", (F.col("n") == 0).alias("nothing"), (F.col("cancelled") > F.col("n")).alias("mismatch"), W.overall_status(severity).alias("status"))


@query("""
    WITH c AS (SELECT user_id, count(*) AS reached FROM events GROUP BY 1) SELECT user_id, reached, list_filter([1, 5, 10, 25, 50, 69, 100], lambda x: x > reached)[1:3] AS next_targets FROM c""")
def next_milestones(t: Tables) -> DataFrame:
    return W.next_milestones(t.events, "user_id", [1, 5, 10, 25, 50, 69, 100]).select("user_id", "reached", "next_targets")


@query("""
    WITH x AS (SELECT o_custkey AS kennel_id, CAST(o_orderdate AS DATE) AS date, o_orderkey AS event_id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' UNION SELECT l_suppkey, CAST(o_orderdate AS DATE), o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
    r AS (SELECT *, row_number() OVER (PARTITION BY kennel_id ORDER BY date, event_id) AS k FROM x) SELECT kennel_id, date, event_id FROM r WHERE k = 1""")
def next_with_cohosts(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_custkey").alias("kennel_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("event_id"))
    hosts = t.lineitem.select(F.col("l_suppkey").alias("kennel_id"), F.col("l_orderkey").alias("event_id")).join(own.drop("kennel_id"), "event_id")
    return P.next_per_kennel(own.unionByName(hosts), DAY("1998-01-01")).select("kennel_id", "date", "event_id")


@query("""
    WITH p AS (SELECT l_orderkey, l_partkey, l_linenumber, date_diff('day', DATE '1997-06-01', CAST(l_shipdate AS DATE)) AS o, date_diff('day', DATE '1997-05-20', CAST(l_shipdate AS DATE)) AS b FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber, least(CASE WHEN abs(o - 30) <= 4 OR (b > 34 AND o < 26) THEN 30 END, CASE WHEN abs(o - 90) <= 4 OR (b > 94 AND o < 86) THEN 90 END, CASE WHEN abs(o - 180) <= 4 OR (b > 184 AND o < 176) THEN 180 END) AS band FROM p""")
def capture_bands(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", P.capture_band(F.to_date("l_shipdate"), DAY("1997-06-01"), DAY("1997-05-20")).alias("band"))


@query("SELECT s_suppkey, CAST(floor((row_number() OVER (ORDER BY s_suppkey) - 1) * 240.0 / ((SELECT count(*) FROM supplier) - 1)) AS BIGINT) AS delay_s FROM supplier")
def dispatch_stagger(t: Tables) -> DataFrame:
    return W.stagger(t.supplier.select("s_suppkey"), "s_suppkey").select("s_suppkey", "delay_s")


@query("""
    WITH r AS (SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_linenumber DESC, l_suppkey DESC) AS k FROM lineitem) SELECT l_orderkey, l_suppkey, l_partkey FROM r WHERE k = 1""")
def latest_raw_row(t: Tables) -> DataFrame:
    order = F.struct("l_shipdate", "l_partkey", "l_linenumber", "l_suppkey")
    return t.lineitem.groupBy("l_orderkey").agg(F.max(order).alias("m")).select("l_orderkey", "m.l_suppkey", "m.l_partkey")


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%m-%d') AS md, o_orderkey % 13 AS x FROM orders), s AS (SELECT *, CASE WHEN lag(md) OVER w > md THEN 1 ELSE 0 END AS back FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY x, o_orderkey)),
    y AS (SELECT *, 2000 + sum(back) OVER (PARTITION BY o_custkey ORDER BY x, o_orderkey ROWS UNBOUNDED PRECEDING) AS y FROM s)
    SELECT o_orderkey, CASE WHEN md = '02-29' AND NOT (y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)) THEN CAST(y AS VARCHAR) || '-02-28' ELSE CAST(y AS VARCHAR) || '-' || md END AS repaired FROM y""")
def year_repair(t: Tables) -> DataFrame:
    at = F.format_string("%02d-%012d", F.col("o_orderkey") % 13, F.col("o_orderkey"))
    rows = t.orders.select("o_custkey", "o_orderkey", at.alias("at"), F.concat(F.lit("2000-"), F.date_format("o_orderdate", "MM-dd")).cast("date").alias("d"))
    return W.repaired_years(rows, "o_custkey", "at", "d").select("o_orderkey", F.col("repaired").cast("string").alias("repaired"))


@query("""
    WITH e AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'P' THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status FROM orders), l AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey % 10 AS source_id FROM lineitem), m AS (SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 3 = 0)
    SELECT event_id FROM e WHERE status = 'CONFIRMED' AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND EXISTS (SELECT 1 FROM l WHERE l.event_id = e.event_id AND source_id = 4) AND NOT EXISTS (SELECT 1 FROM l WHERE l.event_id = e.event_id AND source_id <> 4) AND event_id NOT IN (SELECT event_id FROM m)""")
def stale_rows(t: Tables) -> DataFrame:
    events = t.orders.select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("CONFIRMED").alias("status"))
    links = t.lineitem.select(F.col("l_orderkey").alias("event_id"), (F.col("l_suppkey") % 10).alias("source_id"))
    return G.stale_events(events, links, events.where("event_id % 3 = 0"), F.lit(4), DAY("1996-01-01"), DAY("1997-12-31")).select("event_id")
