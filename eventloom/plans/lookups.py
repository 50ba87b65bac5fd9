"""Lookups, small texts, links between members and users, and inserts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import round_half_up
from ..functions.text import candidate_score, name_similarity
from ..operators import lookups as Q
from ..operators.linking import nearest_names
from ..storage import shared_folder
from ..streaming import runs as S
from .registry import Tables, query
from .texts import cases

ZONES = ("America/New_York", "Europe/Berlin", "Asia/Tokyo")


@query("""
    SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'America/Chicago' WHEN 2 THEN 'Europe/Berlin' WHEN 3 THEN 'America/New_York' ELSE 'Asia/Tokyo' END AS timezone,
      CASE s_suppkey % 5 WHEN 0 THEN 'Berlin State' WHEN 1 THEN 'Illinois' WHEN 2 THEN 'Berlin, DE' WHEN 3 THEN 'Nowhere' ELSE 'Tokyo' END AS state_group, CASE s_suppkey % 5 WHEN 0 THEN 'Germany' WHEN 4 THEN 'Japan' ELSE 'United States' END AS country FROM supplier""")
def region_lookups(t: Tables) -> DataFrame:
    dimension = t.spark.createDataFrame([(1, "Berlin", "Berlin State", "Germany", "Europe/Berlin"), (2, "Chicago, IL", "Illinois", None, "America/Chicago"), (3, "Tokyo", None, "Japan", "Asia/Tokyo")], "place int, name string, state_group string, country string, timezone string")
    names = F.array(*map(F.lit, ("berlin", " Chicago, IL", "Berlin, DE", "Nowhere", "Tokyo")))
    rows = t.supplier.select("s_suppkey", F.get(names, (F.col("s_suppkey") % 5).cast("int")).alias("region"))
    return Q.located_regions(rows, "region", dimension).select("s_suppkey", "timezone", "state_group", "country")


@query("SELECT doc_id, source || ' --> ' || lang AS note, CAST(n_chars AS VARCHAR) AS n FROM documents")
def canonical_blocks(t: Tables) -> DataFrame:
    payload = F.struct(F.concat_ws(" --> ", "source", "lang").alias("note"), F.col("n_chars").alias("n"))
    body = F.concat(F.lit("Issue text\n"), Q.emitted_block(payload), F.lit("\nend -->"))
    return t.documents.select("doc_id", Q.parsed_block(body, "note").alias("note"), Q.parsed_block(body, "n").alias("n"))


cases("blocks_parsed", lambda b: Q.parsed_block(b, "x"), [
    ("no block {k}", None), ('<!-- audit-canonical: {"v":2,"data":{"x":"a"}} -->', None), ('a <!-- audit-canonical: {"v":1,"data":{"x":"b"}} --> z', "b"), ('<!-- audit-canonical: {"v":1,"data":{"x":"open"}}', None), ("<!-- audit-canonical: broken -->", None), (None, None),
])
cases("lists_parsed", lambda v: F.array_join(Q.listed(v), ";"), [("a | b,c |", "a;b,c"), ("x, y{k},", "x;y{k}"), ("one {k}", "one {k}"), (" ", ""), (None, "")])
cases("items_toggled", lambda v, x: F.array_join(Q.toggled(F.split(v, ","), x), ","), [("a,b", "b", "a"), ("a,b", "c{k}", "a,b,c{k}"), ("a", "a", "")])
cases("schedules_in_words", Q.schedule_text, [("Saturday", "14:00", "Weekly", "Saturdays at 2:00 PM · Weekly"), ("Friday", None, None, "Fridays"), (None, "19:30", "Monthly", "7:30 PM · Monthly"), (None, None, "Biweekly", "Biweekly"), (None, None, None, None)])
cases("timezones_checked", lambda v: Q.known_timezone(v, ZONES), [("UTC", "true"), ("Europe/Berlin", "true"), ("Berlin", "false"), ("Mars/Base{k}", "false"), (None, "false")])


@query("""
    WITH h AS (SELECT c_custkey AS hasher, c_nationkey AS g, 'member ' || substr(c_name, 10) AS name FROM customer WHERE c_custkey % 2 = 0), u AS (SELECT c_custkey AS usr, c_nationkey AS g, 'membre ' || substr(c_name, 10) AS uname FROM customer WHERE c_custkey % 3 = 0),
    p AS (SELECT hasher, usr, CAST(floor((1 - levenshtein(name, uname) / greatest(length(name), length(uname))) * 1000 + 0.5) AS BIGINT) AS score, row_number() OVER (PARTITION BY hasher ORDER BY CAST(floor((1 - levenshtein(name, uname) / greatest(length(name), length(uname))) * 1000 + 0.5) AS BIGINT) DESC, usr) AS k FROM h JOIN u ON h.g = u.g WHERE 1 - levenshtein(name, uname) / greatest(length(name), length(uname)) >= 0.7)
    SELECT hasher, usr, score FROM p WHERE k = 1""")
def user_link_suggestions(t: Tables) -> DataFrame:
    c, tail = F.col("c_custkey"), F.substring("c_name", 10, 100)
    hashers = t.customer.where("c_custkey % 2 = 0").select(c.alias("hasher"), F.col("c_nationkey").alias("g"), F.concat(F.lit("member "), tail).alias("name"))
    users = t.customer.where("c_custkey % 3 = 0").select(c.alias("usr"), F.col("c_nationkey").alias("g"), F.concat(F.lit("membre "), tail).alias("uname"))
    # rows of one name have one answer: the first user of the name that is most alike
    first = users.groupBy("g", "uname").agg(F.min("usr").alias("usr"))
    score = round_half_up(name_similarity(F.col("name"), F.col("uname")) * 1000)
    best = nearest_names(hashers.select("g", "name").distinct(), first, "name", "uname", ["g"], 0.7, ["g", "name"], score, [F.asc("usr")], (0.87, 0.81))
    return hashers.join(best.select("g", "name", "usr", "score"), ["g", "name"]).select("hasher", "usr", "score")


@query("""
    WITH n AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1), q AS (SELECT unnest(['cold widgets', 'small gear']) AS asked), s AS (SELECT asked, k, CAST(floor((1 - levenshtein(lower(p_name), asked) / greatest(length(p_name), length(asked))) * 1000 + 0.5) AS BIGINT) AS base, (contains(lower(p_name), asked) OR contains(asked, lower(p_name))) AND least(length(p_name), length(asked)) >= 6 AS held FROM n, q),
    r AS (SELECT asked, k, least(1000, base + CASE WHEN held AND base < 1000 THEN 300 ELSE 0 END) AS score FROM s), w AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, k) AS pos FROM r WHERE score > 600) SELECT asked, k, score FROM w WHERE pos <= 3""")
def similar_entities(t: Tables) -> DataFrame:
    """A stated set of two queries against all names."""
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    asked = names.select("k", "p_name", F.explode(F.array(F.lit("cold widgets"), F.lit("small gear"))).alias("asked"))
    scored = asked.select("asked", "k", round_half_up(candidate_score(F.col("asked"), F.array("p_name")) * 1000).alias("score")).where("score > 600")
    from pyspark.sql import Window

    return scored.withColumn("pos", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "k"))).where("pos <= 3").drop("pos")


@query("""
    WITH i AS (SELECT l_orderkey * 1000 + l_partkey % 1000 AS raw_id, l_suppkey AS s, l_partkey % 50 AS fp FROM lineitem WHERE l_linenumber > 2), t AS (SELECT l_suppkey AS s, l_partkey % 50 AS fp, min(l_orderkey) AS raw_id, bool_and(l_returnflag = 'R') AS orphan FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
    f AS (SELECT *, min(raw_id) OVER (PARTITION BY s, fp) AS f FROM i) SELECT f.raw_id, CASE WHEN t.raw_id IS NOT NULL AND orphan AND f.raw_id = f.f THEN 'adopted' WHEN t.raw_id IS NOT NULL THEN 'duplicate' WHEN f.raw_id = f.f THEN 'created' ELSE 'duplicate' END AS outcome, coalesce(t.raw_id, f.f) AS row_id FROM f LEFT JOIN t ON t.s = f.s AND t.fp = f.fp""")
def insert_outcomes(t: Tables) -> DataFrame:
    key = [F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 50).alias("fp")]
    incoming = t.lineitem.where("l_linenumber > 2").select((F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000).alias("raw_id"), *key)
    table = t.lineitem.where("l_linenumber = 1").groupBy(*key).agg(F.min("l_orderkey").alias("raw_id"), F.max(F.when(F.col("l_returnflag") != "R", 1)).alias("event_id"))
    return Q.insert_or_adopt(incoming, table, ["s", "fp"], [F.asc("raw_id")])


@query("SELECT user_id % 30 AS source_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def stream_per_source(t: Tables) -> DataFrame:
    """Each micro-batch goes to its sources' merge, which keeps a total of each batch; batches are added up."""
    folder = shared_folder(t.spark, "per-source")
    rows = S.landed(t.spark, f"{t.sf_dir}/events.parque[t]", t.events.schema).select((F.col("user_id") % 30).alias("source_id"), "event_id")

    def merge(batch: DataFrame, i: int) -> None:
        batch.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")).write.mode("overwrite").parquet(f"{folder}/batch={i}")

    S.each_source(rows, "source_id", merge, "per-source")
    return t.spark.read.option("recursiveFileLookup", True).parquet(folder).groupBy("source_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
