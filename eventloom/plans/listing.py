"""List, directory and detail pages on the driver's tables. Roles: orders - events, customer - kennels, nation - regions,
lineitem - links of events and hosts, events - runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import candidate_score
from ..functions.dates import round_half_up
from ..operators import filters as L
from ..operators import listing as V
from ..operators import matching as M
from ..operators import projection as P
from .registry import Tables, query
from .texts import cases

DAY = lambda s: F.lit(s).cast("date")
_EV = """SELECT o_orderkey AS event_id, o_custkey AS kennel_id, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'P' THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 7 = 0 END AS is_manual,
    o_orderkey % 11 <> 0 AS is_canonical, o_custkey % 13 <> 0 AS kennel_visible, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey - 1 END AS parent_event_id, CASE WHEN o_orderkey % 4 > 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30' END AS start_time, o_totalprice AS price, o_orderpriority AS title FROM orders"""


def _events(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("event_id"), F.col("o_custkey").alias("kennel_id"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("CONFIRMED").alias("status"), F.when(k % 5 != 0, k % 7 == 0).alias("is_manual"),
        (k % 11 != 0).alias("is_canonical"), (F.col("o_custkey") % 13 != 0).alias("kennel_visible"), F.when(k % 9 == 0, k - 1).alias("parent_event_id"), F.when(k % 4 > 0, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30"))).alias("start_time"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("title"),
    )


_SHOWN = "status <> 'CANCELLED' AND coalesce(is_manual, false) = false AND is_canonical AND kennel_visible"


@query(f"WITH e AS ({_EV}) SELECT event_id FROM e WHERE {_SHOWN} AND parent_event_id IS NULL")
def displayed_events(t: Tables) -> DataFrame:
    return _events(t).where(L.displayable()).select("event_id")


@query(f"WITH e AS ({_EV}) SELECT event_id FROM e WHERE {_SHOWN}")
def displayed_with_children(t: Tables) -> DataFrame:
    return _events(t).where(L.displayable(parent=None)).select("event_id")


@query(f"WITH e AS ({_EV}) SELECT event_id, date >= DATE '1998-01-14' AS is_upcoming, date < DATE '1998-01-16' AS is_past FROM e")
def upcoming_and_past(t: Tables) -> DataFrame:
    today = DAY("1998-01-15")
    return _events(t).select("event_id", L.upcoming(F.col("date"), today).alias("is_upcoming"), L.past(F.col("date"), today).alias("is_past"))


@query(f"""
    WITH e AS ({_EV}), b AS (SELECT 'all' AS bucket, event_id FROM e UNION ALL SELECT 'upcoming', event_id FROM e WHERE date >= DATE '1998-01-15' UNION ALL SELECT 'past', event_id FROM e WHERE date < DATE '1998-01-15'
      UNION ALL SELECT '4w', event_id FROM e WHERE date BETWEEN DATE '1998-01-15' AND DATE '1998-02-12' UNION ALL SELECT '12w', event_id FROM e WHERE date BETWEEN DATE '1998-01-15' AND DATE '1998-04-09') SELECT bucket, count(*) AS n, min(event_id) AS least FROM b GROUP BY 1""")
def time_buckets(t: Tables) -> DataFrame:
    today, e = DAY("1998-01-15"), _events(t)
    flags = F.array(*(F.when(L.time_bucket(F.col("date"), today, b), b) for b in ("all", "upcoming", "past", "4w", "12w")))
    return e.select("event_id", F.explode(F.array_compact(flags)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))


@query("""
    SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_7') AND (lower(c_name) LIKE '%1%' OR lower(c_mktsegment) LIKE '%1%')""")
def contains_search(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation.where(F.col("n_name").isin("NATION_1", "NATION_2", "NATION_7")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.where(L.contains_any(" 1 ", "c_name", "c_mktsegment")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%omer#00000001%' OR c_mktsegment ILIKE '%furn%'")
def ilike_search(t: Tables) -> DataFrame:
    return t.customer.where(L.contains_any("OMER#00000001", "c_name") | L.contains_any("FURN", "c_mktsegment")).select("c_custkey")


_LIST = f"SELECT e.*, n_name AS region, (kennel_id * 37) % 160 - 80.0 AS latitude, (kennel_id * 91) % 360 - 180.0 AS longitude FROM ({_EV}) e JOIN customer ON kennel_id = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(f"""
    WITH e AS ({_LIST}) SELECT event_id FROM e WHERE date BETWEEN DATE '1998-01-15' AND DATE '1998-04-09' AND region IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_9') AND dayofweek(date) IN (0, 6)
      AND lower(title) LIKE '%u%' AND latitude BETWEEN -60 AND 60 AND longitude BETWEEN -170 AND 170""")
def composite_filter(t: Tables) -> DataFrame:
    rows = _events(t).join(t.customer, F.col("kennel_id") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("kennel_id")
    rows = rows.withColumns({"region": F.col("n_name"), "latitude": (k * 37) % 160 - 80.0, "longitude": (k * 91) % 360 - 180.0})
    found = L.list_filter(rows, DAY("1998-01-15"), "12w", regions=[f"NATION_{i}" for i in (1, 2, 3, 4, 9)], weekdays=[0, 6], query="U", box=(-60.0, 60.0, -170.0, 170.0), text_columns=("title",))
    return found.select("event_id")


_KEN = "SELECT c_custkey AS kennel_id, c_name AS name, n_name AS region, n_nationkey AS region_id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 7 END AS flat_day FROM customer JOIN nation ON c_nationkey = n_nationkey"
_RUL = "SELECT p_partkey % 150 AS kennel_id, p_size % 7 AS weekday, CASE WHEN p_size % 2 = 0 THEN 'Weekly' ELSE 'Monthly' END AS frequency FROM part"


def _kennels(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(c.alias("kennel_id"), F.col("c_name").alias("name"), F.col("n_name").alias("region"), F.col("n_nationkey").alias("region_id"), F.when(c % 3 > 0, c % 7).alias("flat_day"))


def _rules(t: Tables) -> DataFrame:
    return t.part.select((F.col("p_partkey") % 150).alias("kennel_id"), (F.col("p_size") % 7).alias("weekday"), F.when(F.col("p_size") % 2 == 0, "Weekly").otherwise("Monthly").alias("frequency"))


@query(f"""
    WITH k AS ({_KEN}), r AS ({_RUL}), d AS (SELECT kennel_id, CAST(weekday AS BIGINT) AS w FROM r UNION SELECT kennel_id, flat_day FROM k WHERE flat_day IS NOT NULL)
    SELECT k.kennel_id, coalesce((SELECT list(w ORDER BY w) FROM d WHERE d.kennel_id = k.kennel_id), []) AS weekdays, coalesce((SELECT list(DISTINCT frequency ORDER BY frequency) FROM r WHERE r.kennel_id = k.kennel_id), []) AS frequencies FROM k""")
def schedule_facets(t: Tables) -> DataFrame:
    out = V.schedule_facets(F.col("flat_day"), _rules(t), _kennels(t), "kennel_id")
    return out.select("kennel_id", F.col("weekdays").cast("array<long>").alias("weekdays"), "frequencies")


@query(f"""
    WITH k AS ({_KEN}), r AS ({_RUL}), n AS (SELECT o_custkey AS kennel_id, min(CAST(o_orderdate AS DATE)) AS next_date FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' GROUP BY 1)
    SELECT k.kennel_id FROM k JOIN n ON n.kennel_id = k.kennel_id WHERE region IN ('NATION_3', 'NATION_5', 'NATION_8') AND (flat_day IN (0, 6) OR EXISTS (SELECT 1 FROM r WHERE r.kennel_id = k.kennel_id AND weekday IN (0, 6)))
      AND EXISTS (SELECT 1 FROM r WHERE r.kennel_id = k.kennel_id AND frequency = 'Weekly')""")
def directory_filter(t: Tables) -> DataFrame:
    coming = P.next_per_kennel(_events(t), DAY("1998-06-01")).select("kennel_id", F.col("date").alias("next_date"))
    rows = V.schedule_facets(F.col("flat_day"), _rules(t), _kennels(t), "kennel_id").join(coming, "kennel_id", "left")
    return V.directory(rows, ["NATION_3", "NATION_5", "NATION_8"], [0, 6], ["Weekly"], upcoming=True).select("kennel_id")


@query("""
    WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey * 37) % 160 - 80.0 END AS a, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey * 91) % 360 - 180.0 END AS o, (c_nationkey * 53) % 140 - 70.0 AS ca, (c_nationkey * 29) % 360 - 180.0 AS co FROM customer),
    q AS (SELECT c_custkey, coalesce(a, ca) AS lat, coalesce(o, co) AS lng FROM p), h AS (SELECT c_custkey, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lng - 20) / 2), 2) AS x FROM q)
    SELECT c_custkey FROM h WHERE 2 * 6371.0 * atan2(sqrt(x), sqrt(1 - x)) <= 3000""")
def radius_with_centroid(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    rows = t.customer.select(c, F.col("c_nationkey").alias("region_id"), F.when(c % 4 > 0, (c * 37) % 160 - 80.0).alias("latitude"), F.when(c % 4 > 0, (c * 91) % 360 - 180.0).alias("longitude"))
    n = F.col("n_nationkey")
    regions = t.nation.select(n.alias("region_id"), ((n * 53) % 140 - 70.0).alias("centroid_lat"), ((n * 29) % 360 - 180.0).alias("centroid_lng"))
    return V.within_radius(V.with_centroids(rows, regions), 10.0, 20.0, 3000.0).select("c_custkey")


@query("SELECT DISTINCT n_name AS metro FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR n_name = 'NATION_3' OR n_regionkey = 1")
def region_selection(t: Tables) -> DataFrame:
    h = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("country"), F.col("n_regionkey").cast("string").alias("state"), F.col("n_name").alias("metro"))
    chosen = t.spark.createDataFrame([("country", "ASIA"), ("metro", "NATION_3"), ("state", "1")], "kind string, value string")
    return L.expand_regions(chosen, h)


@query(f"WITH e AS ({_EV}) SELECT event_id FROM e WHERE date BETWEEN DATE '1997-12-16' AND DATE '1998-02-14'")
def fetch_window(t: Tables) -> DataFrame:
    return V.fetch_window(_events(t), "date", DAY("1998-01-15"), 30).select("event_id")


@query("""
    SELECT event_id, NOT (event_type = 'view' AND user_id % 10 = 3 OR event_type = 'click' AND user_id % 10 = 4) OR event_id % 5 = 0 AS kept FROM events""")
def silent_skips(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([(3, "^vi"), (4, "(?i)CLICK"), (4, "never")], "source_id long, pattern string")
    rows = t.events.select("event_id", "event_type", (F.col("user_id") % 10).alias("source_id"), (F.col("event_id") % 5 == 0).alias("genuine"))
    keep, gone = L.silent_skips(rows, rules, "event_type", "event_id")
    return keep.select("event_id", F.lit(True).alias("kept")).union(gone.select("event_id", F.lit(False)))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N')")
def independent_evidence(t: Tables) -> DataFrame:
    backed = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.some(t.orders.select("o_orderkey"), backed, "o_orderkey")


@query("""
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE date_diff('day', DATE '1997-01-01', CAST(l_shipdate AS DATE)) <= 180 OR (date_diff('day', DATE '1997-01-01', CAST(l_shipdate AS DATE)) <= 365 AND l_returnflag IN ('R', 'A'))""")
def horizon_gate(t: Tables) -> DataFrame:
    level = F.when(F.col("l_returnflag") == "R", "HIGH").when(F.col("l_returnflag") == "A", "LOW").otherwise("MEDIUM")
    return t.lineitem.where(P.within_horizon(F.to_date("l_shipdate"), DAY("1997-01-01"), level)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R', 'A') AND (CASE WHEN l_quantity <= 10 THEN 'nearby' WHEN l_quantity <= 25 THEN 'area' ELSE 'drive' END) IN ('nearby', 'area') AND dayofweek(l_shipdate) = 6")
def result_facets(t: Tables) -> DataFrame:
    from ..functions.geo import distance_tier

    return t.lineitem.where(F.col("l_returnflag").isin("R", "A") & distance_tier(F.col("l_quantity")).isin("nearby", "area") & (F.dayofweek("l_shipdate") - 1).isin(6)).select("l_orderkey", "l_linenumber")


@query("""
    WITH e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 END AS parent, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 1 THEN CAST(o_orderdate AS DATE) ELSE DATE '1998-01-01' END AS d, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE 'x' END AS place FROM orders)
    SELECT id FROM e WHERE NOT (trim(place) = '' AND EXISTS (SELECT 1 FROM e c WHERE c.parent = e.id AND c.d = e.d))""")
def umbrella_suppression(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select(k.alias("id"), F.when(k % 3 == 1, k - 1).alias("parent"), F.when((k % 3 == 1) & (k % 2 == 1), F.to_date("o_orderdate")).otherwise(DAY("1998-01-01")).alias("d"), F.when(k % 6 == 0, " ").otherwise("x").alias("place"))
    return V.without_umbrellas(rows, "id", "parent", "d", ["place"]).select("id")


@query("""
    SELECT s_suppkey, last IS NULL OR date_diff('second', last, TIMESTAMP '2024-01-31 00:00:00') >= CASE s_suppkey % 5 WHEN 0 THEN 3600 WHEN 1 THEN 21600 WHEN 2 THEN 86400 WHEN 3 THEN 604800 ELSE 86400 END - 600 AS due
    FROM supplier LEFT JOIN (SELECT user_id % 60 AS u, date_trunc('second', max(ts)) AS last FROM events GROUP BY 1) ON u = s_suppkey""")
def due_sources(t: Tables) -> DataFrame:
    last = t.events.groupBy((F.col("user_id") % 60).alias("s_suppkey")).agg(F.date_trunc("second", F.max("ts").cast("timestamp")).alias("last"))
    names = F.array(*map(F.lit, ("hourly", "every_6h", "Daily", "weekly", "yearly")))
    freq = F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int"))
    return t.supplier.join(last, "s_suppkey", "left").select("s_suppkey", L.due_for_refresh(F.col("last"), freq, F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("due"))


@query("SELECT event_id FROM events WHERE NOT (event_type = 'view' OR (event_type = 'click' AND user_id % 40 = 3))")
def suppressed_findings(t: Tables) -> DataFrame:
    own = t.spark.createDataFrame([(None, "view"), (3, "click")], "kennel_id long, rule string")
    return L.suppressed(t.events.select("event_id", (F.col("user_id") % 40).alias("kennel_id"), F.col("event_type").alias("rule")), own).select("event_id")


@query(f"""
    WITH e AS ({_EV}), h AS (SELECT DISTINCT l_orderkey AS event_id, c_name AS cohost FROM lineitem JOIN customer ON l_suppkey = c_custkey)
    SELECT e.event_id, c_name AS name, coalesce((SELECT list(cohost ORDER BY cohost) FROM h WHERE h.event_id = e.event_id), []) AS cohosts FROM e JOIN customer ON kennel_id = c_custkey""")
def list_rows(t: Tables) -> DataFrame:
    hosts = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("kennel_id"))
    return V.list_rows(_events(t).select("event_id", "kennel_id"), _kennels(t).select("kennel_id", "name"), hosts).select("event_id", "name", "cohosts")


@query("""
    WITH h AS (SELECT o_orderkey, o_custkey % 10 AS primary_host, list(l_suppkey % 10 ORDER BY l_linenumber, l_suppkey, l_partkey) AS hosts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT o_orderkey, CASE WHEN primary_host IN (1, 4, 7) THEN primary_host ELSE list_filter(hosts, lambda x: x IN (1, 4, 7))[1] END AS host FROM h""")
def pivot_hosts(t: Tables) -> DataFrame:
    own = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", (F.col("o_custkey") % 10).alias("p")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("h"))  # a few lines of one order
    near = F.array(F.lit(1), F.lit(4), F.lit(7)).cast("array<long>")
    return own.select("o_orderkey", V.pivot_host(F.col("p"), F.transform("h", lambda x: x["l_suppkey"] % 10), near).alias("host"))


@query("""
    SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'https://a.example|Site|website https://www.facebook.com/x|Facebook|facebook' WHEN 1 THEN 'https://meetup.com/' || s_suppkey || '|Group|meetup' ELSE '' END AS links FROM supplier""")
def source_links(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    link = lambda u, l: F.struct((u if not isinstance(u, str) else F.lit(u)).alias("url"), F.lit(l).alias("label"))  # noqa: E731, E741
    a = F.array(link("https://a.example", " Site "), link("javascript:x", "Bad"), link("https://www.facebook.com/x", "Facebook"), link("https://a.example", "Again"))
    b = F.array(link(F.concat(F.lit("https://meetup.com/"), k.cast("string")), "Group"), link("https://b.example", "  "))
    c = F.array(link("ftp://x", "No"))
    found = V.source_links(F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c))
    return t.supplier.select(k, F.array_join(F.transform(found, lambda x: F.concat_ws("|", x["url"], x["label"], x["type"])), " ").alias("links"))


@query("""
    WITH o AS (SELECT o_custkey, year(min(o_orderdate)) AS y FROM orders GROUP BY 1), k AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1985 WHEN 1 THEN 0 END AS founded, y FROM customer LEFT JOIN o ON o_custkey = c_custkey)
    SELECT c_custkey, CAST(CASE WHEN founded > 0 THEN founded ELSE y END AS BIGINT) AS since, CAST(2000 - CASE WHEN founded > 0 THEN founded ELSE y END AS BIGINT) AS years, CASE WHEN founded > 0 THEN false WHEN y IS NOT NULL THEN true END AS approximate FROM k""")
def years_active(t: Tables) -> DataFrame:
    oldest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("oldest"))
    k = F.col("c_custkey") % 3
    out = V.years_active(F.when(k == 0, 1985).when(k == 1, 0), F.col("oldest"), 2000)
    return t.customer.join(oldest, "c_custkey", "left").select("c_custkey", out["since"].cast("long").alias("since"), out["years"].cast("long").alias("years"), out["approximate"].alias("approximate"))


_TRAVEL = f"SELECT *, row_number() OVER (ORDER BY date, coalesce(start_time, '99:99'), price % 97, event_id) AS pos FROM ({_EV})"


@query(f"SELECT event_id, pos FROM ({_TRAVEL}) WHERE pos <= 200")
def travel_order(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    top = _events(t).withColumn("distance_km", F.col("price") % 97).orderBy(*V.travel_order(), "event_id").limit(200)
    return top.select("event_id", F.row_number().over(Window.orderBy(*V.travel_order(), "event_id")).cast("long").alias("pos"))  # of 200 rows


@query(f"""
    WITH k AS ({_KEN}), n AS (SELECT o_custkey, min(o_orderdate) AS nx FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-20' GROUP BY 1)
    SELECT kennel_id, region, row_number() OVER (ORDER BY nx NULLS LAST, region, name) AS pos FROM k LEFT JOIN n ON o_custkey = kennel_id ORDER BY pos LIMIT 60""")
def directory_sort(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    coming = t.orders.where("o_orderdate >= timestamp_ntz'1998-07-20'").groupBy(F.col("o_custkey").alias("kennel_id")).agg(F.min("o_orderdate").alias("nx"))
    order = [F.asc_nulls_last("nx"), F.asc("region"), F.asc("name")]
    top = _kennels(t).join(coming, "kennel_id", "left").orderBy(*order).limit(60)
    return top.select("kennel_id", "region", F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"))  # of 60 rows


@query(f"WITH e AS ({_EV}) SELECT event_id, (SELECT count(*) FROM e) AS total, CAST(ceil((SELECT count(*) FROM e) / 25.0) AS BIGINT) AS pages FROM e ORDER BY date DESC, event_id LIMIT 25 OFFSET 50")
def offset_page_total(t: Tables) -> DataFrame:
    return V.offset_page(_events(t).select("event_id", "date"), [F.desc("date"), F.asc("event_id")], 3, 25).select("event_id", "total", "pages")


@query(f"WITH e AS ({_EV}) SELECT count(*) AS fetched, count(*) >= 200 AS has_more FROM (SELECT * FROM e WHERE date < DATE '1998-01-01' ORDER BY date DESC, event_id DESC LIMIT 200)")
def page_has_more(t: Tables) -> DataFrame:
    page = L.keyset_page(_events(t).where("date < date'1998-01-01'"), "date", "event_id", None, 200)
    return V.has_more(page, 200)


@query("""
    WITH s AS (SELECT p_partkey, p_name, CAST(floor(greatest(0, 1 - levenshtein(lower(p_name), 'cold widget') / greatest(length(p_name), 11)) * 1000 + 0.5) AS BIGINT) AS base, (contains(lower(p_name), 'cold widget') OR contains('cold widget', lower(p_name))) AND least(length(p_name), 11) >= 6 AS held FROM part),
    m AS (SELECT p_name, min(p_partkey) AS k, max(least(1000, base + CASE WHEN held AND base < 1000 THEN 300 ELSE 0 END)) AS score FROM s GROUP BY 1) SELECT k AS part, score FROM m WHERE score > 200 ORDER BY score DESC, k LIMIT 5""")
def top_fuzzy(t: Tables) -> DataFrame:
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("part"))
    score = round_half_up(candidate_score(F.lit("Cold Widget"), F.array("p_name")) * 1000)
    return names.select("part", score.alias("score")).where("score > 200").orderBy(F.desc("score"), "part").limit(5)


@query("""
    SELECT c_nationkey AS region, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS tags, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1""")
def distinct_tags(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_nationkey").alias("region")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("tags"), F.countDistinct("c_mktsegment").alias("n"))


@query("SELECT DISTINCT o_custkey AS kennel_id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(t: Tables) -> DataFrame:
    ring = t.orders.where("o_orderdate >= timestamp_ntz'1998-01-01'").select(F.col("o_custkey").alias("kennel_id")).distinct()
    return M.none(ring, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("kennel_id")), "kennel_id")


@query("SELECT DISTINCT o_custkey AS kennel_id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' INTERSECT SELECT l_suppkey FROM lineitem")
def set_intersection(t: Tables) -> DataFrame:
    scope = t.orders.where("o_orderdate >= timestamp_ntz'1998-01-01'").select(F.col("o_custkey").alias("kennel_id")).distinct()
    return M.some(scope, t.lineitem.select(F.col("l_suppkey").alias("kennel_id")), "kennel_id")


@query(f"""
    WITH e AS ({_EV}), a AS (SELECT event_id FROM e ORDER BY date DESC, event_id DESC LIMIT 40), b AS (SELECT event_id FROM e ORDER BY date DESC, event_id DESC LIMIT 40 OFFSET 30) SELECT event_id FROM a UNION SELECT event_id FROM b""")
def merged_pages(t: Tables) -> DataFrame:
    rows = _events(t).select("event_id", "date").orderBy(F.desc("date"), F.desc("event_id"))
    return V.merged_pages(rows.limit(40), rows.offset(30).limit(40), "event_id").select("event_id")


@query(f"""
    WITH e AS ({_EV}), r AS (SELECT date, event_id, row_number() OVER (PARTITION BY date ORDER BY start_time NULLS FIRST, event_id) AS k FROM e) SELECT date, n, (k - 1) // 10 AS part, list(event_id ORDER BY k) AS keys FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM r) GROUP BY 1, 2, 3""")
def date_sections(t: Tables) -> DataFrame:
    return V.sections(_events(t), "date", "event_id", ["start_time", "event_id"], size=10)


@query("""
    WITH x AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_suppkey, l_partkey) AS tags FROM lineitem GROUP BY 1), y AS (SELECT l_orderkey, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM x)
    SELECT l_orderkey, tag, min(pos) = 1 AS is_primary FROM y GROUP BY 1, 2""")
def multi_tags(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"))).alias("h"))  # a few lines of one order
    return V.exploded_tags(rows.withColumn("tags", F.transform("h", lambda x: x["l_returnflag"])), "l_orderkey", "tags")


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice % 97, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k = 1""")
def nearest_per_kennel(t: Tables) -> DataFrame:
    return V.first_per_key(t.orders, "o_custkey", [F.asc(F.col("o_totalprice") % 97), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


cases("sources_detected", V.detected_source, [
    ("https://docs.google.com/spreadsheets/d/{k}", "GOOGLE_SHEETS"), ("https://calendar.google.com/calendar/embed?src={k}", "GOOGLE_CALENDAR"), ("https://www.hashrego.com/{k}", "HASHREGO"), ("https://meetup.com/g{k}/", "MEETUP"), ("webcal://x.org/{k}", "ICAL_FEED"), ("https://x.org/{k}.ICS", "ICAL_FEED"),
    ("https://x.org/e?ical=1", "ICAL_FEED"), ("https://x.org/{k}/feed/", "RSS_FEED"), ("https://x.org/?feed=rss2", "RSS_FEED"), ("https://x.org/{k}", None), ("not a url", None), (None, None), ("https://x.org/?format=ical&z", "ICAL_FEED"), ("https://notmeetup.com/a", None),
])
