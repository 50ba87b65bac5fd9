"""Linking joins, merges and change logs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as GEO
from ..functions import hashing as H
from ..functions import text as X
from ..functions.dates import round_half_up, time_gap_minutes
from ..operators import filters as L
from ..operators import linking as K
from ..operators import matching as M
from ..operators import merging as G
from ..operators import rules as RT
from ..operators import series as S
from ..operators import windows as W
from .registry import Tables, query

DAY = lambda s: F.lit(s).cast("date")


@query("""
    SELECT s_suppkey, coalesce(n_name, '-') AS region, count(*) AS links FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b ON l_suppkey = s_suppkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def bridge_chain(t: Tables) -> DataFrame:
    bridge = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    rows = t.supplier.join(bridge, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("s_suppkey", F.coalesce("n_name", F.lit("-")).alias("region")).agg(F.count(F.lit(1)).alias("links"))


@query("""
    WITH a AS (SELECT DISTINCT event_id % 3 AS source_id, CASE event_id % 8 WHEN 0 THEN ' code' || user_id % 30 WHEN 1 THEN 'NAME' || user_id % 30 WHEN 2 THEN 'Alias' || user_id % 30 || ' ' WHEN 3 THEN 'the pattern seven run' WHEN 4 THEN ' ' WHEN 5 THEN 'nothing' || user_id % 9 WHEN 6 THEN 'shared' ELSE 'Code' || user_id % 30 END AS tag FROM events),
    l AS (SELECT 'code' || k AS value, k AS kennel_id, 1 AS tier FROM range(25) t(k) UNION ALL SELECT 'name' || k, k + 100, 2 FROM range(25) t(k) UNION ALL SELECT 'alias' || k, k + 200, 3 FROM range(25) t(k) UNION ALL SELECT 'shared', 5, 3 UNION ALL SELECT 'shared', 9, 3 UNION ALL SELECT 'code3', 1003, 3),
    y AS (SELECT source_id, tag, lower(trim(tag)) AS v, 0 AS base FROM a UNION ALL SELECT source_id, tag, 'name7', 3 FROM a WHERE lower(tag) LIKE '%pattern seven%'),
    h AS (SELECT y.source_id, y.tag, l.kennel_id, y.base + l.tier AS tier, row_number() OVER (PARTITION BY y.source_id, y.tag ORDER BY y.base + l.tier, l.kennel_id <> 9 OR y.source_id <> 1, l.kennel_id) AS r FROM y JOIN l ON l.value = y.v WHERE y.v <> '')
    SELECT a.source_id, a.tag, h.kennel_id, h.tier FROM a LEFT JOIN h ON h.source_id = a.source_id AND h.tag = a.tag AND r = 1""")
def tag_resolution(t: Tables) -> DataFrame:
    e, u = F.col("event_id") % 8, (F.col("user_id") % 30).cast("string")
    tag = F.when(e == 0, F.concat(F.lit(" code"), u)).when(e == 1, F.concat(F.lit("NAME"), u)).when(e == 2, F.concat(F.lit("Alias"), u, F.lit(" "))).when(e == 3, "the pattern seven run").when(e == 4, " ").when(e == 5, F.concat(F.lit("nothing"), (F.col("user_id") % 9).cast("string"))).when(e == 6, "shared").otherwise(F.concat(F.lit("Code"), u))
    tags = t.events.select((F.col("event_id") % 3).alias("source_id"), tag.alias("tag"))
    k = t.spark.range(25)
    table = lambda prefix, shift: k.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("value"), (F.col("id") + shift).alias("kennel_id"))
    aliases = table("alias", 200).union(t.spark.createDataFrame([("shared", 5), ("shared", 9), ("code3", 1003)], "value string, kennel_id long"))
    linked = t.spark.createDataFrame([(1, 9)], "source_id long, kennel_id long")
    return M.resolve_tags(tags, table("code", 0), table("name", 100), aliases, [("pattern seven", "name7"), ("seven", "code1")], linked).select("source_id", "tag", "kennel_id", "tier")


@query("""
    SELECT p_partkey, CASE WHEN p_name LIKE '%cold%' OR p_name LIKE '%hot%' THEN array_to_string(list_sort(list_distinct(list_concat(CASE WHEN p_name LIKE '%cold%' THEN ['a', 'b'] ELSE [] END, CASE WHEN p_name LIKE '%hot%' THEN ['b', 'c'] ELSE [] END))), ',')
      WHEN p_name LIKE '%widget%' THEN 'w' WHEN p_name LIKE '%small%' THEN 's' ELSE '' END AS tags FROM part""")
def pattern_routing(t: Tables) -> DataFrame:
    rules = [("WIDGET", "w"), ("cold", ["a", "b"]), ("small", "s"), ("hot", ["b", "c"])]
    return t.part.select("p_partkey", F.array_join(F.array_sort(K.routed_tags(t.part, "p_name", rules)), ",").alias("tags"))


@query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND contains(lower(o_orderpriority), 'urgent') THEN 'u,x' WHEN contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderpriority), 'low') THEN 'hl'
      WHEN o_custkey IN (SELECT p_partkey FROM part) THEN 't' || o_custkey ELSE '' END AS tags FROM orders""")
def rule_table(t: Tables) -> DataFrame:
    """A rule for each part, and lists of tags for words, of one source and of all."""
    k = F.col("p_partkey")
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 3).cast("long").alias("source_id"), F.concat("o_orderpriority", F.lit(" for "), F.col("o_custkey").cast("string")).alias("text"))
    own = t.part.select(F.lit(None).cast("long").alias("source_id"), k.cast("long").alias("ordinal"), F.concat(F.lit(r"\bfor "), k.cast("string"), F.lit("$")).alias("pattern"), F.lit(False).alias("many"), F.array(F.concat(F.lit("t"), k.cast("string"))).alias("tags"))
    lists = t.spark.createDataFrame([(0, -1, "urgent", True, ["u", "x"]), (None, 5, r"\b(?:high|low)\b", True, ["hl"])], own.schema)
    return RT.routed(rows, own.unionByName(lists)).select("o_orderkey", F.array_join("tags", ",").alias("tags"))


_IN = "SELECT l_orderkey * 1000 + l_partkey % 1000 AS ordinal, l_suppkey % 30 AS kennel_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 's' || CAST(l_partkey % 7 AS VARCHAR) AS source_url, CASE WHEN l_linenumber > 2 THEN CAST(l_quantity AS INT) % 6 END AS run_number, CASE WHEN l_tax > 0.02 THEN '1' || CAST(l_linenumber % 4 AS VARCHAR) || ':00' END AS start_time, l_returnflag AS title FROM lineitem"
_EX = "SELECT o_orderkey AS event_id, o_custkey % 30 AS kennel_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, 's' || CAST(o_orderkey % 7 AS VARCHAR) AS source_url, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 6 END AS run_number, CASE WHEN o_orderkey % 5 > 0 THEN '1' || CAST(o_orderkey % 4 AS VARCHAR) || ':00' END AS start_time, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'R' ELSE 'X' END AS title FROM orders"


def _incoming(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000).alias("ordinal"), (F.col("l_suppkey") % 30).alias("kennel_id"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.concat(F.lit("s"), (F.col("l_partkey") % 7).cast("string")).alias("source_url"),
        F.when(F.col("l_linenumber") > 2, F.col("l_quantity").cast("int") % 6).alias("run_number"), F.when(F.col("l_tax") > 0.02, F.concat(F.lit("1"), (F.col("l_linenumber") % 4).cast("string"), F.lit(":00"))).alias("start_time"), F.col("l_returnflag").alias("title"))


def _existing(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("event_id"), (F.col("o_custkey") % 30).alias("kennel_id"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"), F.concat(F.lit("s"), (k % 7).cast("string")).alias("source_url"), F.when(k % 3 > 0, k % 6).alias("run_number"), F.when(k % 5 > 0, F.concat(F.lit("1"), (k % 4).cast("string"), F.lit(":00"))).alias("start_time"), F.when(k % 4 == 0, "a").when(k % 4 == 1, "R").otherwise("X").alias("title"))


@query(f"""
    WITH i AS ({_IN}), e AS ({_EX}), p AS (SELECT i.ordinal, e.event_id, e.source_url = i.source_url AS u, e.run_number = i.run_number AS r, e.start_time = i.start_time AS s, lower(e.title) = lower(i.title) AS b, e.run_number <> i.run_number AS o FROM i LEFT JOIN e ON e.kennel_id = i.kennel_id AND e.date = i.date),
    g AS (SELECT ordinal, count(event_id) AS n, min(event_id) AS sole, count(*) FILTER (o) AS others, count(*) FILTER (u) AS nu, min(event_id) FILTER (u) AS iu, count(*) FILTER (r) AS nr, min(event_id) FILTER (r) AS ir, count(*) FILTER (s) AS ns, min(event_id) FILTER (s) AS isx, count(*) FILTER (b) AS nb, min(event_id) FILTER (b) AS ib FROM p GROUP BY 1)
    SELECT ordinal, CASE WHEN nu = 1 THEN iu WHEN nr = 1 THEN ir WHEN ns = 1 THEN isx WHEN nb = 1 THEN ib WHEN n = 1 AND others = 0 THEN sole END AS event_id, CASE WHEN nu = 1 THEN 'url' WHEN nr = 1 THEN 'run' WHEN ns = 1 THEN 'time' WHEN nb = 1 THEN 'title' WHEN n = 1 AND others = 0 THEN 'sole' ELSE 'new' END AS tier FROM g""")
def same_day_match(t: Tables) -> DataFrame:
    return M.same_day_match(_incoming(t), _existing(t))


@query("""
    WITH i AS (SELECT l_orderkey * 1000 + l_partkey % 1000 AS ordinal, l_suppkey % 40 AS kennel_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_linenumber % 3 AS source_id, CASE l_partkey % 4 WHEN 0 THEN '' ELSE 'theme ' || CAST(l_partkey % 4 AS VARCHAR) END AS theme FROM lineitem),
    e AS (SELECT o_orderkey AS event_id, o_custkey % 40 AS kennel_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderkey % 3 AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'theme ' || CAST(o_orderkey % 4 AS VARCHAR) END AS theme FROM orders),
    g AS (SELECT ordinal, count(*) AS n, min(i.theme) AS theme, count(*) FILTER (i.source_id <> e.source_id AND i.theme <> '' AND i.theme = e.theme) AS ns, min(event_id) FILTER (i.source_id <> e.source_id AND i.theme <> '' AND i.theme = e.theme) AS s, count(*) FILTER (e.theme <> '') AS nr, min(event_id) FILTER (e.theme <> '') AS r, min(event_id) AS a FROM i JOIN e ON e.kennel_id = i.kennel_id AND e.date = i.date GROUP BY 1),
    f AS (SELECT ordinal, CASE WHEN ns = 1 THEN s WHEN theme = '' AND nr = 1 THEN r WHEN theme <> '' AND n = 1 AND nr = 0 THEN a END AS event_id FROM g) SELECT * FROM f WHERE event_id IS NOT NULL""")
def theme_twins(t: Tables) -> DataFrame:
    p, k = F.col("l_partkey") % 4, F.col("o_orderkey")
    i = t.lineitem.select((F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000).alias("ordinal"), (F.col("l_suppkey") % 40).alias("kennel_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), (F.col("l_linenumber") % 3).alias("source_id"), F.when(p == 0, "").otherwise(F.concat(F.lit("theme "), p.cast("string"))).alias("theme"))
    e = t.orders.select(k.alias("event_id"), (F.col("o_custkey") % 40).alias("kennel_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"), (k % 3).alias("source_id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("theme "), (k % 4).cast("string"))).alias("theme"))
    return K.theme_twins(i, e)


@query("""
    WITH i AS (SELECT l_orderkey * 1000 + l_partkey % 1000 AS ordinal, l_suppkey % 20 AS kennel_id, CAST(l_shipdate AS DATE) AS date, l_linenumber AS source_id, substr(p_name, 1, 12) AS title, CASE WHEN l_linenumber > 3 THEN CAST(l_quantity AS INT) % 9 END AS run, CASE WHEN l_tax > 0.03 THEN '1' || CAST(l_linenumber % 4 AS VARCHAR) || ':30' END AS st FROM lineitem JOIN part ON l_partkey = p_partkey),
    e AS (SELECT o_orderkey AS event_id, o_custkey % 20 AS kennel_id, CAST(o_orderdate AS DATE) AS date, o_orderkey % 5 AS source_id, o_orderkey % 7 AS trust, substr(p_name, 1, 12) AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 END AS run, CASE WHEN o_orderkey % 3 > 0 THEN '1' || CAST(o_orderkey % 4 AS VARCHAR) || ':00' END AS st FROM orders JOIN part ON p_partkey = o_orderkey % 200),
    p AS (SELECT ordinal, event_id, trust, abs(date_diff('day', i.date, e.date)) AS gap FROM i JOIN e ON i.kennel_id = e.kennel_id AND abs(date_diff('day', i.date, e.date)) BETWEEN 1 AND 2 AND length(trim(i.title)) >= 4 AND levenshtein(lower(trim(i.title)), lower(trim(e.title))) <= 4 AND i.source_id <> e.source_id
      AND (i.run IS NULL OR e.run IS NULL OR i.run = e.run) AND (i.st IS NULL OR e.st IS NULL OR abs((CAST(substr(i.st, 1, 2) AS INT) * 60 + 30) - CAST(substr(e.st, 1, 2) AS INT) * 60) <= 120)),
    r AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY trust DESC, gap, event_id) AS k FROM p) SELECT ordinal, event_id FROM r WHERE k = 1""")
def fuzzy_window_duplicates(t: Tables) -> DataFrame:
    part = t.part.select("p_partkey", F.substring("p_name", 1, 12).alias("title"))
    k = F.col("o_orderkey")
    i = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000).alias("ordinal"), (F.col("l_suppkey") % 20).alias("kennel_id"), F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").alias("source_id"), "title",
        F.when(F.col("l_linenumber") > 3, F.col("l_quantity").cast("int") % 9).alias("run_number"), F.when(F.col("l_tax") > 0.03, F.concat(F.lit("1"), (F.col("l_linenumber") % 4).cast("string"), F.lit(":30"))).alias("start_time"), F.lit(None).cast("string").alias("location"))
    e = t.orders.join(part, k % 200 == F.col("p_partkey")).select(k.alias("event_id"), (F.col("o_custkey") % 20).alias("kennel_id"), F.to_date("o_orderdate").alias("date"), (k % 5).alias("source_id"), (k % 7).alias("trust"), "title", F.when(k % 2 == 0, k % 9).alias("run_number"), F.when(k % 3 > 0, F.concat(F.lit("1"), (k % 4).cast("string"), F.lit(":00"))).alias("start_time"), F.lit("x").alias("location"))
    return M.fuzzy_window_duplicates(i, e).select("ordinal", "event_id")


@query("""
    WITH i AS (SELECT l_orderkey * 1000 + l_partkey % 1000 AS ordinal, l_suppkey % 10 AS k, l_partkey % 20 AS u, CAST(l_quantity AS INT) % 3 AS run, CAST(l_shipdate AS DATE) AS date, l_linenumber AS trust FROM lineitem), e AS (SELECT o_orderkey AS event_id, o_custkey % 10 AS k, o_orderkey % 20 AS u, o_orderkey % 3 AS run, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS trust, o_orderkey % 11 AS upd FROM orders),
    p AS (SELECT ordinal, event_id, d AS old_date, date, row_number() OVER (PARTITION BY ordinal ORDER BY upd DESC, event_id) AS r FROM i JOIN e ON i.k = e.k AND i.u = e.u AND i.run = e.run AND abs(date_diff('day', date, d)) BETWEEN 1 AND 30 AND i.trust >= e.trust) SELECT ordinal, event_id, old_date, date FROM p WHERE r = 1""")
def moved_dates(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    i = t.lineitem.select((F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000).alias("ordinal"), (F.col("l_suppkey") % 10).alias("kennel_id"), (F.col("l_partkey") % 20).alias("source_url"), (F.col("l_quantity").cast("int") % 3).alias("run_number"), F.lit("a").alias("label"), F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").alias("trust"))
    e = t.orders.select(k.alias("event_id"), (F.col("o_custkey") % 10).alias("kennel_id"), (k % 20).alias("source_url"), (k % 3).alias("run_number"), F.lit("a").alias("label"), F.to_date("o_orderdate").alias("date"), (k % 6).alias("trust"), (k % 11).alias("updated_at"))
    return K.moved_dates(i, e)


@query("""
    WITH RECURSIVE p AS (SELECT l_orderkey AS slot, l_linenumber * 10000 + l_partkey AS ordinal, l_suppkey % 4 AS event_id, CAST(l_quantity AS INT) % 3 AS rank FROM lineitem), d AS (SELECT slot, ordinal, event_id, min(rank) AS rank FROM p GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY rank, ordinal, event_id) AS k FROM d),
    w AS (SELECT slot, 1 AS k, [ordinal] AS o, [event_id] AS e FROM n WHERE k = 1 UNION ALL SELECT n.slot, n.k, CASE WHEN list_contains(w.o, n.ordinal) OR list_contains(w.e, n.event_id) THEN w.o ELSE list_append(w.o, n.ordinal) END, CASE WHEN list_contains(w.o, n.ordinal) OR list_contains(w.e, n.event_id) THEN w.e ELSE list_append(w.e, n.event_id) END FROM w JOIN n ON n.slot = w.slot AND n.k = w.k + 1)
    SELECT slot, unnest(o) AS ordinal, unnest(e) AS event_id FROM (SELECT slot, arg_max(o, k) AS o, arg_max(e, k) AS e FROM w GROUP BY 1)""")
def one_to_one(t: Tables) -> DataFrame:
    pairs = t.lineitem.groupBy(F.col("l_orderkey").alias("slot"), (F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("ordinal"), (F.col("l_suppkey") % 4).alias("event_id")).agg(F.min(F.col("l_quantity").cast("int") % 3).alias("rank"))
    return M.assign_one_to_one(pairs, ["slot"]).select("slot", "ordinal", "event_id")


@query("""
    WITH r AS (SELECT p_brand AS g, min(p_partkey) AS k, p_name AS a, substr(p_name, 2) || 'x' AS b FROM part GROUP BY 1, 3), s AS (SELECT x.k AS a, y.k AS b, greatest(1 - levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a)), 1 - levenshtein(x.b, y.b) / greatest(length(x.b), length(y.b)), 1 - levenshtein(x.a, y.b) / greatest(length(x.a), length(y.b))) AS v FROM r x JOIN r y ON x.g = y.g AND x.k < y.k)
    SELECT a, b, CAST(floor(v * 1000 + 0.5) AS BIGINT) AS score FROM s WHERE v >= 0.9""")
def fuzzy_best_of_three(t: Tables) -> DataFrame:
    # rows of one name and brand are one entity
    rows = t.part.groupBy(F.col("p_brand").alias("g"), F.col("p_name").alias("a")).agg(F.min("p_partkey").alias("k")).withColumn("b", F.concat(F.substring("a", 2, 100), F.lit("x")))
    # pairs of names meet first, then the rows that bear them
    names = rows.select("g", F.explode(F.array("a", "b")).alias("name")).distinct()
    near = K.near_names(names, names.withColumnRenamed("name", "other"), "name", "other", ["g"], 0.9).select("g", "name", "other", X.name_similarity(F.col("name"), F.col("other")).alias("v")).distinct()
    pairs = None
    for left, right in (("a", "a"), ("b", "b"), ("a", "b")):
        one = near.join(rows.select("g", F.col("k").alias("i"), F.col(left).alias("name")), ["g", "name"]).join(rows.select("g", F.col("k").alias("j"), F.col(right).alias("other")), ["g", "other"]).where("i < j").select("i", "j", "v")
        pairs = one if pairs is None else pairs.unionByName(one)
    return pairs.groupBy(F.col("i").alias("a"), F.col("j").alias("b")).agg(round_half_up(F.max("v") * 1000).alias("score"))


_NAMES = "SELECT c_nationkey AS group_id, c_custkey AS hasher_id, 'Hash ' || c_name AS hash_name, CASE WHEN c_custkey % 3 > 0 THEN 'nerd' || CAST(c_custkey AS VARCHAR) END AS nerd_name FROM customer"


@query(f"""
    WITH r AS ({_NAMES}), e AS (SELECT group_id, hasher_id, hash_name AS known FROM r UNION ALL SELECT group_id, hasher_id, nerd_name FROM r WHERE nerd_name IS NOT NULL), n AS (SELECT DISTINCT c_nationkey AS group_id, CASE c_custkey % 4 WHEN 0 THEN ' hash ' || upper(c_name) WHEN 1 THEN 'NERD' || c_custkey WHEN 2 THEN 'Hush ' || c_name ELSE 'zzz' || c_custkey END AS name FROM customer),
    x AS (SELECT n.group_id, n.name, min(hasher_id) AS hasher_id FROM n JOIN e ON n.group_id = e.group_id AND lower(trim(n.name)) = lower(trim(known)) GROUP BY 1, 2),
    f AS (SELECT n.group_id, n.name, hasher_id, known, 1 - levenshtein(lower(trim(n.name)), lower(known)) / greatest(length(trim(n.name)), length(known)) AS v FROM n JOIN e ON n.group_id = e.group_id WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.group_id = n.group_id AND x.name = n.name)),
    b AS (SELECT *, CAST(floor(v * 1000 + 0.5) AS BIGINT) AS score, row_number() OVER (PARTITION BY group_id, name ORDER BY CAST(floor(v * 1000 + 0.5) AS BIGINT) DESC, hasher_id, known) AS k FROM f WHERE v >= 0.8)
    SELECT group_id, name, hasher_id, 'exact' AS kind, 1000 AS score FROM x UNION ALL SELECT group_id, name, hasher_id, 'fuzzy', score FROM b WHERE k = 1""")
def csv_names(t: Tables) -> DataFrame:
    c, k = F.col("c_name"), F.col("c_custkey")
    roster = t.customer.select(F.col("c_nationkey").alias("group_id"), k.alias("hasher_id"), F.concat(F.lit("Hash "), c).alias("hash_name"), F.when(k % 3 > 0, F.concat(F.lit("nerd"), k.cast("string"))).alias("nerd_name"))
    name = F.when(k % 4 == 0, F.concat(F.lit(" hash "), F.upper(c))).when(k % 4 == 1, F.concat(F.lit("NERD"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("Hush "), c)).otherwise(F.concat(F.lit("zzz"), k.cast("string")))
    return K.matched_names(t.customer.select(F.col("c_nationkey").alias("group_id"), name.alias("name")).distinct(), roster, 0.8)


@query("""
    WITH h AS (SELECT p_size % 5 AS sheet, p_partkey AS pos, CASE p_partkey % 4 WHEN 0 THEN '1997-0' || CAST(1 + p_partkey % 9 AS VARCHAR) || '-15' WHEN 1 THEN '#' || CAST(p_partkey % 50 AS VARCHAR) WHEN 2 THEN ' ' ELSE 'notes' END AS header FROM part), e AS (SELECT o_custkey % 5 AS sheet, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS date, o_orderkey % 60 AS run FROM orders)
    SELECT sheet, pos AS "at", header, coalesce(CASE WHEN header LIKE '1997%' THEN (SELECT min(event_id) FROM e WHERE e.sheet = h.sheet AND CAST(e.date AS VARCHAR) = trim(header)) END, CASE WHEN header LIKE '1997%' THEN (SELECT min(event_id) FROM e WHERE e.sheet = h.sheet AND e.run = 1997) WHEN header LIKE '#%' THEN (SELECT min(event_id) FROM e WHERE e.sheet = h.sheet AND '#' || CAST(e.run AS VARCHAR) = header) END) AS event_id FROM h WHERE trim(header) <> ''""")
def csv_headers(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    header = F.when(p % 4 == 0, F.concat(F.lit("1997-0"), (1 + p % 9).cast("string"), F.lit("-15"))).when(p % 4 == 1, F.concat(F.lit("#"), (p % 50).cast("string"))).when(p % 4 == 2, " ").otherwise("notes")
    events = t.orders.select((F.col("o_custkey") % 5).alias("sheet"), F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 60).alias("run_number"))
    return K.matched_headers(t.part.select((F.col("p_size") % 5).alias("sheet"), p.alias("at"), header.alias("header")), events)


@query("""
    WITH c AS (SELECT l_suppkey AS hasher_id, l_orderkey AS event_id, CASE l_linenumber WHEN 1 THEN ' X ' WHEN 2 THEN 'p' WHEN 3 THEN 'H' WHEN 4 THEN '' ELSE 'no' END AS cell FROM lineitem)
    SELECT hasher_id, event_id, bool_or(cell = 'p') AS paid, bool_or(cell = 'H') AS hared, NOT (event_id % 3 = 0 AND hasher_id % 2 = 0) AS is_new FROM c WHERE cell IN (' X ', 'p', 'H') GROUP BY 1, 2""")
def csv_records(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    cells = t.lineitem.select(F.col("l_suppkey").alias("hasher_id"), F.col("l_orderkey").alias("event_id"), F.when(n == 1, " X ").when(n == 2, "p").when(n == 3, "H").when(n == 4, "").otherwise("no").alias("cell"))
    return K.import_records(cells, cells.where("event_id % 3 = 0 and hasher_id % 2 = 0"), ["x", "1"], ["P"], ["h"])


@query("""
    WITH f AS (SELECT n_nationkey AS found_id, CASE WHEN n_nationkey % 3 = 0 THEN 'harbor-hash-' ELSE 'hhnr' END || CAST(100 + n_nationkey AS VARCHAR) AS slug, 'harbourr ' || CASE WHEN n_nationkey % 2 = 0 THEN 'hash' ELSE 'runners' END || ' nr' || CAST(100 + n_nationkey AS VARCHAR) AS name, n_regionkey AS country FROM nation),
    k AS (SELECT c_custkey AS kennel_id, CASE WHEN c_custkey % 50 = 7 THEN 'hash nr' ELSE 'harbour hash nr' END || CAST(100 + c_custkey AS VARCHAR) AS name, c_custkey % 5 AS country FROM customer),
    q AS (SELECT found_id, country, 'slug' AS how, slug AS t FROM f UNION ALL SELECT found_id, country, 'name', name FROM f),
    s AS (SELECT found_id, kennel_id, how, q.country AS c, k.country AS kc, least(1, 1 - levenshtein(t, k.name) / greatest(length(t), length(k.name)) + CASE WHEN least(length(t), length(k.name)) >= 6 AND (contains(t, k.name) OR contains(k.name, t)) AND t <> k.name THEN 0.3 ELSE 0 END) AS v FROM q, k),
    e AS (SELECT *, row_number() OVER (PARTITION BY found_id, how ORDER BY v DESC, kennel_id) AS pos FROM s),
    b AS (SELECT found_id, kennel_id, CAST(floor((max(v) - CASE WHEN any_value(c) <> any_value(kc) THEN 0.3 ELSE 0 END) * 1000 + 0.5) AS BIGINT) AS score FROM e WHERE pos <= 5 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY found_id ORDER BY score DESC, kennel_id) AS rank, max(score) OVER (PARTITION BY found_id) >= 950 AS auto FROM b WHERE score >= 600) SELECT found_id, kennel_id, score, rank, auto FROM r WHERE CASE WHEN auto THEN rank = 1 ELSE rank <= 3 END""")
def discovery_matches(t: Tables) -> DataFrame:
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    none = F.lit(None).cast("double")
    slug = F.concat(F.when(n % 3 == 0, "harbor-hash-").otherwise("hhnr"), (100 + n).cast("string"))
    found = t.nation.select(n.alias("found_id"), slug.alias("slug"), F.concat(F.lit("harbourr "), F.when(n % 2 == 0, "hash").otherwise("runners"), F.lit(" nr"), (100 + n).cast("string")).alias("name"), F.col("n_regionkey").alias("country"), none.alias("lat"), none.alias("lng"))
    known = t.customer.select(c.alias("kennel_id"), F.concat(F.when(c % 50 == 7, "hash nr").otherwise("harbour hash nr"), (100 + c).cast("string")).alias("name"), (c % 5).alias("country"), none.alias("lat"), none.alias("lng"))
    return K.discovery_matches(found, known)


@query("""
    WITH g AS (SELECT c_custkey AS kennel_id, c_custkey % 20 AS group_id FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey AS kennel_id, c_custkey AS member FROM customer WHERE c_custkey % 3 <> 0 UNION SELECT a.kennel_id, b.kennel_id FROM g a JOIN g b ON a.group_id = b.group_id""")
def roster_scope(t: Tables) -> DataFrame:
    groups = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("kennel_id"), (F.col("c_custkey") % 20).alias("group_id"))
    return K.roster_scope(t.customer.select(F.col("c_custkey").alias("kennel_id")), groups)


@query("""
    WITH w AS (SELECT l_suppkey AS u, l_orderkey AS e FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT l_suppkey AS u, l_orderkey AS e FROM lineitem WHERE l_linestatus = 'O')
    SELECT u, e, 'add' AS action FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT u, e, 'delete' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)""")
def hare_credit_sync(t: Tables) -> DataFrame:
    rows = lambda c: t.lineitem.where(c).select(F.col("l_suppkey").alias("u"), F.col("l_orderkey").alias("e"))
    return G.credit_sync(rows("l_returnflag = 'R'"), rows("l_linestatus = 'O'"), ["u", "e"])


@query("""
    SELECT l_orderkey, l_suppkey - l_suppkey % 3 AS l_suppkey, bool_or(l_linenumber = 1) AS is_primary FROM lineitem GROUP BY 1, 2""")
def entity_merge_bridge(t: Tables) -> DataFrame:
    mapping = t.supplier.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("old_id"), (F.col("s_suppkey") - F.col("s_suppkey") % 3).alias("new_id"))
    return K.merged_bridge(t.lineitem.withColumn("is_primary", F.col("l_linenumber") == 1), mapping, "l_suppkey", "l_orderkey", "is_primary")


_P = "SELECT c_custkey, (c_custkey * 37) % 160 - 80 + (c_custkey % 100) / 100.0 AS latitude, (c_custkey * 91) % 360 - 180 + (c_custkey % 97) / 97.0 AS longitude FROM customer"
_D = f"SELECT stop_id, c_custkey, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (SELECT *, pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lng) / 2), 2) AS a FROM (SELECT n_nationkey AS stop_id, (n_nationkey * 53) % 140 - 70.0 AS lat, (n_nationkey * 29) % 360 - 180.0 AS lng FROM nation) s, ({_P}) p)"


def _places(t: Tables) -> tuple[DataFrame, DataFrame]:
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    places = t.customer.select(c, ((c * 37) % 160 - 80 + (c % 100) / 100.0).alias("latitude"), ((c * 91) % 360 - 180 + (c % 97) / 97.0).alias("longitude"))
    return t.nation.select(n.alias("stop_id"), ((n * 53) % 140 - 70.0).alias("lat"), ((n * 29) % 360 - 180.0).alias("lng")), places


@query(f"""
    WITH d AS ({_D}) SELECT stop_id, c_custkey, km > 250 AS broader FROM d WHERE km <= 250 OR (km <= 750 AND stop_id NOT IN (SELECT stop_id FROM d WHERE km <= 250))""")
def radius_with_ring(t: Tables) -> DataFrame:
    stops, places = _places(t)
    return K.wider_ring(M.radius_join(stops, places, 250.0), M.radius_join(stops, places, 750.0), "c_custkey")


@query(f"WITH d AS ({_D}) SELECT stop_id, count(*) AS n FROM d WHERE km <= 500 GROUP BY 1")
def destination_counts(t: Tables) -> DataFrame:
    return M.radius_join(*_places(t), 500.0).groupBy("stop_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH e AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS date, (o_custkey % 7) * 10 + 3 AS lat, (o_custkey % 5) * 20 AS lng FROM orders), n AS (SELECT * FROM e WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-01-11'), c AS (SELECT lat, lng FROM n GROUP BY 1, 2 ORDER BY min(date), CAST(CAST(lat AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(lng AS DOUBLE) AS VARCHAR) LIMIT 15)
    SELECT event_id, lat + day(date) AS temperature FROM n WHERE (lat, lng) IN (SELECT (lat, lng) FROM c) AND day(date) % 2 = 1""")
def weather_lookup(t: Tables) -> DataFrame:
    e = t.orders.select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("date"), ((F.col("o_custkey") % 7) * 10 + 3).cast("double").alias("lat"), ((F.col("o_custkey") % 5) * 20).cast("double").alias("lng"))
    forecast = e.where(F.day("date") % 2 == 1).select(GEO.coords_key(F.col("lat"), F.col("lng"), 1).alias("cell"), "date", (F.col("lat").cast("long") + F.day("date")).alias("temperature")).distinct()
    return K.weather_for(e, forecast, DAY("1998-01-01")).select("event_id", "temperature")


@query("""
    WITH e AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, [o_orderkey % 4, o_orderkey % 3] AS s FROM orders), p AS (SELECT l_orderkey * 1000 + l_partkey % 1000 AS snapshot_id, o_custkey AS k, CAST(l_shipdate AS DATE) AS d, [l_suppkey % 4] AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1)
    SELECT snapshot_id, EXISTS (SELECT 1 FROM e WHERE e.k = p.k AND abs(date_diff('day', e.d, p.d)) <= 14 AND list_has_any(e.s, p.s)) AS hit FROM p""")
def frozen_source_hits(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("kennel_id"), F.to_date("o_orderdate").alias("e_date"), F.array(F.col("o_orderkey") % 4, F.col("o_orderkey") % 3).alias("e_sources"))
    snaps = t.lineitem.where("l_linenumber = 1").join(o.select("o_orderkey", "kennel_id"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000).alias("snapshot_id"), "kennel_id", F.to_date("l_shipdate").alias("date"), F.array(F.col("l_suppkey") % 4).alias("sources"))
    return K.window_hits(snaps, o.drop("o_orderkey"), 14)


_SCORE = "CAST(floor((CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 3 * 2.0 / 3 END + 2 * CASE o_orderkey % 4 WHEN 0 THEN -0.25 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.3 ELSE greatest(0, 1 - (o_orderkey % 7) * 30 / 120.0) END + CASE WHEN o_orderkey % 2 = 0 THEN 0.2 ELSE 0 END) * 1000 + 0.5) AS BIGINT)"


@query(f"WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderkey, {_SCORE} AS score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, date ORDER BY score DESC, o_orderkey) AS k FROM s WHERE score >= 2000) SELECT o_custkey, date, o_orderkey, score FROM r WHERE k = 1")
def activity_matches(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    km = F.when(k % 4 == 1, 4.0).when(k % 4 == 2, 20.0).when(k % 4 == 3, 90.0)
    a, b = F.lit("12:00"), F.concat(F.lpad((12 + F.floor((k % 7) / 2)).cast("string"), 2, "0"), F.when((k % 7) % 2 == 1, ":30").otherwise(":00"))
    minutes = F.when(k % 3 > 0, time_gap_minutes(a, b))
    score = M.activity_score(F.when(k % 5 == 0, "Morning Run").otherwise("abc"), F.lit("abd"), km, k % 4 == 0, minutes, k % 2 == 0)
    events = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderkey", round_half_up(score * 1000).alias("score")).where("score >= 2000")
    return W.pick_best(events, ["o_custkey", "date"], [F.desc("score"), F.asc("o_orderkey")])


@query("""
    WITH o AS (SELECT o_orderkey AS event_id, CAST(floor(o_totalprice) AS BIGINT) % 100 AS v, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS w FROM orders), n AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 7 END AS v, CASE WHEN o_orderkey % 6 = 0 THEN 'new' END AS w FROM orders WHERE o_orderkey % 2 = 0) SELECT o.event_id, coalesce(n.v, o.v) AS v, coalesce(n.w, o.w) AS w FROM o LEFT JOIN n ON n.event_id = o.event_id""")
def bulk_update(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    old = t.orders.select(k.alias("event_id"), (F.floor("o_totalprice") % 100).alias("v"), F.when(k % 4 > 0, F.col("o_orderpriority")).alias("w"))
    new = t.orders.where("o_orderkey % 2 = 0").select(k.alias("event_id"), F.when(k % 3 == 0, F.lit(7).cast("long")).alias("v"), F.when(k % 6 == 0, "new").alias("w"))
    return G.update_from(old, new, ["event_id"], ["v", "w"])


@query("SELECT c_custkey, greatest(DATE '1997-06-01', max(CAST(o_orderdate AS DATE))) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def max_update(t: Tables) -> DataFrame:
    table = t.customer.select("c_custkey", DAY("1997-06-01").alias("last"))
    return G.update_if_newer(table, t.orders.select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("last")), ["c_custkey"], "last")


@query("""
    WITH o AS (SELECT l_orderkey AS e, l_suppkey AS k, l_partkey AS v, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_partkey) AS r FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT l_orderkey AS e, l_suppkey AS k, min(l_partkey) AS v FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2)
    SELECT e, k, v FROM o WHERE r = 1 UNION ALL SELECT e, k, v FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.e = n.e AND o.k = n.k)""")
def upsert_cohosts(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("e"), F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("v"), "l_linenumber")
    table = rows.where("l_linenumber <= 2").groupBy("e", "k").agg(F.min("v").alias("v"))
    return G.upsert(rows.where("l_linenumber > 2").drop("l_linenumber"), table, ["e", "k"], [F.asc("v")])


@query("""
    WITH e AS (SELECT o_orderkey AS event_id, o_custkey % 100 AS kennel_id FROM orders) SELECT event_id, kennel_id, true AS is_primary FROM e UNION ALL SELECT DISTINCT event_id, l_suppkey, false FROM e JOIN lineitem ON l_orderkey = event_id WHERE l_suppkey <> kennel_id""")
def event_with_bridge(t: Tables) -> DataFrame:
    events = t.orders.select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 100).alias("kennel_id"))
    hosts = t.lineitem.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_set("l_suppkey").alias("cohosts"))  # a few lines of one order
    return G.with_bridge(events.join(hosts, "event_id", "left"))[1]


@query("""
    SELECT o_orderkey, CASE WHEN trust >= old_trust THEN CASE WHEN cleared THEN NULL WHEN n IS NOT NULL THEN n ELSE o END ELSE coalesce(o, n) END AS place FROM (SELECT o_orderkey, o_orderkey % 5 AS trust, o_orderkey % 3 AS old_trust, o_orderkey % 11 = 0 AS cleared, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey END AS n, CASE WHEN o_orderkey % 7 > 2 THEN 'o' || o_orderkey END AS o FROM orders)""")
def merge_rules(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select(k, F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("in_place"), F.when(k % 7 > 2, F.concat(F.lit("o"), k.cast("string"))).alias("place"), F.when(k % 11 == 0, F.array(F.lit("place"))).otherwise(F.array().cast("array<string>")).alias("cleared"))
    return rows.select(k, G.merged_field("place", k % 5, k % 3, F.col("cleared")).alias("place"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 THEN 'CONFIRMED' WHEN o_orderstatus = 'P' THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status FROM orders")
def restored_events(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("CONFIRMED")
    return t.orders.select(k, G.restored(status, k % 2 == 0, F.when(k % 3 == 0, True)).alias("status"))


@query("""
    SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderkey % 2 = 0 THEN 'status:' || o_orderstatus || '>X' END, CASE WHEN o_orderkey % 3 = 0 THEN 'note:->n' END) AS changes FROM orders""")
def field_change_log(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    old = {"status": F.col("o_orderstatus"), "note": F.lit(None).cast("string"), "same": F.lit(None).cast("string")}
    new = {"status": F.when(k % 2 == 0, "X").otherwise(F.col("o_orderstatus")), "note": F.when(k % 3 == 0, "n"), "same": F.lit(None).cast("string")}
    text = lambda x: F.concat(x["field"], F.lit(":"), F.coalesce(x["old"], F.lit("-")), F.lit(">"), F.coalesce(x["new"], F.lit("-")))
    return t.orders.select(k, F.array_join(F.transform(G.field_changes(old, new), text), ";").alias("changes"))


@query("""
    SELECT o_orderkey, sha256('1997-01-02|a,b|' || CASE o_orderkey % 3 WHEN 0 THEN chr(0) || 'null' WHEN 1 THEN '' ELSE 'v' || o_orderkey END || CASE WHEN o_orderkey % 4 = 0 THEN '|end=' || o_orderkey ELSE '' END) AS fp FROM orders WHERE o_orderkey % 3 > 0""")
def fingerprint_tri_state(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 2, F.concat(F.lit("v"), k.cast("string")))
    fp = H.fingerprint(DAY("1997-01-02"), F.array(F.lit("b"), F.lit("a"), F.lit("b")), [("v", value)], [("end", F.when(k % 4 == 0, k.cast("string")))], F.array(F.lit("other")))
    return t.orders.where("o_orderkey % 3 > 0").select(k, fp.alias("fp"))


@query("SELECT o_orderkey, sha256(o_orderstatus || chr(10) || o_orderpriority || chr(10) || '1' || chr(10)) AS semantic FROM orders")
def audit_hashes(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", H.content_hash(F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(1), F.lit(None)).alias("semantic"))


@query("""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'other' END AS first, sha256('{"a":[' || (event_id % 5) || ',null],"k":{"x":true,"y":"' || event_type || '"}}') AS config_hash FROM events""")
def config_hashes(t: Tables) -> DataFrame:
    text = F.concat(F.lit('{"k": {"y": "'), "event_type", F.lit('", "x": true}, "a": ['), (F.col("event_id") % 5).cast("string"), F.lit(", null]}"))
    return t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, "view").otherwise("other").alias("first"), H.config_hash(text).alias("config_hash"))
