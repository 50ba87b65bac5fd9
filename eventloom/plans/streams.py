"""Streams over the driver's ``events`` table, drained to tables, with the SQL of the whole batch as their oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_folder
from ..streaming import runs as S
from ..streaming import timed
from .registry import Tables, query

LANDING_ROWS = 100_000  # of a file, at the least


def _stream(t: Tables) -> DataFrame:
    return S.landed(t.spark, f"{t.sf_dir}/events.parque[t]", t.events.schema)  # a pattern, for a stream wants folders, and this may be a file


@query("SELECT user_id % 500 AS source_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_insert_once(t: Tables) -> DataFrame:
    rows = _stream(t).select((F.col("user_id") % 500).alias("source_id"), "event_type", "event_id")
    return S.insert_once(rows, ["source_id", "event_type"], [F.asc("event_id")], "insert-once")


@query("SELECT event_id FROM events")
def stream_unique(t: Tables) -> DataFrame:
    twice = _stream(t).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return S.drained(S.unique_within(twice, ["event_id"], "ts", "40 days").select("event_id"), "unique")


@query("""
    SELECT CAST(ts AS DATE) AS day, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1 HAVING CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_matured_days(t: Tables) -> DataFrame:
    days = S.matured_days(_stream(t), "ts", "2 days", F.count(F.lit(1)).alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return S.drained(days, "matured")


@query("""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id % 5 AS src FROM events), s AS (SELECT DISTINCT day + CAST(i AS INT) AS last, src FROM d, range(7) r(i)) SELECT CAST(last - 6 AS TIMESTAMP) AS start, src, (SELECT count(*) FROM d WHERE d.src = s.src AND day BETWEEN last - 6 AND last) AS n FROM s""")
def stream_sliding(t: Tables) -> DataFrame:
    rows = _stream(t).withColumn("src", F.col("user_id") % 5)
    found = S.drained(S.sliding(rows, "ts", "7 days", "1 day", "60 days", ["src"], F.count(F.lit(1)).alias("n")), "sliding", "update")
    return S.latest(found.select("start", "src", "n", "_batch"), ["start", "src"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
    WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 DAY THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_sessions(t: Tables) -> DataFrame:
    found = S.drained(S.sessions(_stream(t), "ts", "2 days", "1 day", ["user_id"], F.count(F.lit(1)).alias("n")), "sessions")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""
    WITH v AS (SELECT event_id % 2000 AS item, event_id AS version, CAST(ts AS DATE) AS day FROM events), n AS (SELECT item, arg_max(day, version) AS bucket FROM v GROUP BY 1) SELECT bucket, count(*) AS n FROM n GROUP BY 1""")
def stream_corrections(t: Tables) -> DataFrame:
    rows = _stream(t).select((F.col("event_id") % 2000).alias("item"), F.col("event_id").alias("version"), F.to_date("ts").alias("day"))
    return S.recomputed_buckets(rows, "item", F.col("day"), "corrections")


@query("""
    WITH RECURSIVE e AS (SELECT user_id % 60 AS source_id, ts, event_type, event_id, row_number() OVER (PARTITION BY user_id % 60 ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT source_id, CAST(0 AS BIGINT) AS k, 'NONE' AS status, 0 AS opened, 0 AS reopened, CAST(NULL AS TIMESTAMP) AS until FROM (SELECT DISTINCT source_id FROM e)
      UNION ALL SELECT w.source_id, e.k, CASE WHEN event_type = 'click' AND status = 'OPEN' THEN 'ACKNOWLEDGED' WHEN event_type = 'signup' AND status IN ('OPEN', 'ACKNOWLEDGED') THEN 'SNOOZED' WHEN event_type = 'error' AND status IN ('NONE', 'RESOLVED') THEN 'OPEN' WHEN event_type = 'error' AND status = 'SNOOZED' AND until < ts THEN 'OPEN' WHEN event_type = 'view' AND status IN ('OPEN', 'ACKNOWLEDGED') THEN 'RESOLVED' ELSE status END,
      opened + CASE WHEN event_type = 'error' AND status IN ('NONE', 'RESOLVED') THEN 1 ELSE 0 END, reopened + CASE WHEN event_type = 'error' AND status = 'SNOOZED' AND until < ts THEN 1 ELSE 0 END, CASE WHEN event_type = 'signup' AND status IN ('OPEN', 'ACKNOWLEDGED') THEN ts + INTERVAL 1 DAY WHEN event_type = 'error' AND (status IN ('NONE', 'RESOLVED') OR (status = 'SNOOZED' AND until < ts)) THEN NULL ELSE until END
      FROM w JOIN e ON e.source_id = w.source_id AND e.k = w.k + 1)
    SELECT source_id, arg_max(status, k) AS status, CAST(max(opened) AS BIGINT) AS opened, CAST(max(reopened) AS BIGINT) AS reopened FROM w GROUP BY 1""")
def stream_alerts(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "error", "raised").when(kind == "click", "ack").when(kind == "signup", "snooze").when(kind == "view", "cleared").otherwise("none")
    rows = _stream(t).select((F.col("user_id") % 60).alias("source_id"), F.lit("health").alias("type"), F.col("ts").alias("at"), action.alias("action"), F.col("event_id").alias("ordinal"))
    return S.latest(S.drained(S.alerts(rows, 86400), "alerts", "update"), ["source_id"]).select("source_id", "status", "opened", "reopened")


@query("""
    WITH RECURSIVE e AS (SELECT user_id % 60 AS source_id, ts, event_type, event_id, row_number() OVER (PARTITION BY user_id % 60 ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT source_id, CAST(0 AS BIGINT) AS k, 'NONE' AS status, 0 AS opened, 0 AS reopened, CAST(NULL AS TIMESTAMP) AS until FROM (SELECT DISTINCT source_id FROM e)
      UNION ALL SELECT source_id, k, CASE WHEN event_type = 'error' AND status IN ('NONE', 'RESOLVED') THEN 'OPEN' WHEN event_type = 'click' AND status = 'OPEN' THEN 'ACKNOWLEDGED' WHEN event_type = 'signup' AND status IN ('OPEN', 'ACKNOWLEDGED') THEN 'SNOOZED' WHEN event_type = 'view' AND status IN ('OPEN', 'ACKNOWLEDGED') THEN 'RESOLVED' ELSE status END,
        opened + CASE WHEN event_type = 'error' AND status IN ('NONE', 'RESOLVED') THEN 1 ELSE 0 END, reopened, CASE WHEN event_type = 'signup' AND status IN ('OPEN', 'ACKNOWLEDGED') THEN ts + INTERVAL 2 DAY WHEN status = 'SNOOZED' THEN until END
      FROM (SELECT w.source_id, e.k, e.ts, event_type, CASE WHEN status = 'SNOOZED' AND until <= ts THEN 'OPEN' ELSE status END AS status, opened, reopened + CASE WHEN status = 'SNOOZED' AND until <= ts THEN 1 ELSE 0 END AS reopened, until FROM w JOIN e ON e.source_id = w.source_id AND e.k = w.k + 1)),
    z AS (SELECT source_id, arg_max(status, k) AS status, max(opened) AS opened, arg_max(reopened, k) AS reopened, arg_max(coalesce(until, TIMESTAMP '9999-01-01'), k) AS until FROM w GROUP BY 1), m AS (SELECT max(ts) - INTERVAL 21 DAY AS mark FROM events)
    SELECT source_id, CASE WHEN status = 'SNOOZED' AND until <= mark THEN 'OPEN' ELSE status END AS status, CAST(opened AS BIGINT) AS opened, CAST(reopened + CASE WHEN status = 'SNOOZED' AND until <= mark THEN 1 ELSE 0 END AS BIGINT) AS reopened FROM z, m""")
def stream_timed_alerts(t: Tables) -> DataFrame:
    """Three landings in order of time, of which each fifth row comes one landing late."""
    kind = F.col("event_type")
    action = F.when(kind == "error", "raised").when(kind == "click", "ack").when(kind == "signup", "snooze").when(kind == "view", "cleared").otherwise("none")
    rows = t.events.select((F.col("user_id") % 60).alias("source_id"), F.lit("health").alias("type"), F.col("ts").cast("timestamp").alias("at"), action.alias("action"), F.col("event_id").alias("ordinal"))
    landing = F.least(F.lit(2), F.floor((F.dayofmonth("at") - 1) / 10)) + (F.col("ordinal") % 5 == 0).cast("int")
    folder = shared_folder(t.spark, "timed-landings")
    # all landings have the same number of files, a batch's, and enough rows that no file is missing
    sizes = {r["i"]: r["count"] for r in rows.groupBy(landing.alias("i")).count().collect()}
    files = 1 + min(sizes.get(i, 0) for i in range(4)) // LANDING_ROWS
    for i in range(4):
        own = rows.where(landing == i)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(folder)
    stream = S.landed(t.spark, folder, rows.schema, files)
    with timed.stores(t.spark):
        found = S.drained(timed.timed_alerts(stream, 2 * 86400, "21 days", 10**9), "timed-alerts", "update")
    return S.latest(found.drop("at", "reason"), ["source_id", "type"]).select("source_id", "status", "opened", "reopened")


@query("""
    WITH e AS (SELECT user_id AS issue_id, ts, event_id, event_type, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM events), c AS (SELECT issue_id, ep, count(*) FILTER (event_type IN ('error', 'view')) AS n FROM e GROUP BY 1, 2)
    SELECT issue_id, arg_max(n, ep) AS count, count(*) FILTER (n >= 5) AS escalations FROM c GROUP BY 1""")
def stream_recurrences(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "signup", "reopened").when(kind.isin("error", "view"), "seen").otherwise("none")
    rows = _stream(t).select(F.col("user_id").alias("issue_id"), F.col("ts").alias("at"), action.alias("action"), F.col("event_id").alias("ordinal"))
    return S.latest(S.drained(S.recurrences(rows), "recurrences", "update"), ["issue_id"])


@query("""
    WITH r AS (SELECT user_id % 40 AS source_id, ts, date_diff('day', CAST(ts AS DATE), DATE '2024-02-10') AS d, lag(date_diff('day', CAST(ts AS DATE), DATE '2024-02-10')) OVER (PARTITION BY user_id % 40 ORDER BY ts) AS b FROM events), x AS (SELECT r.*, band FROM r, (SELECT unnest([35, 25, 15]) AS band))
    SELECT source_id, band, count(*) AS hits FROM x WHERE abs(d - band) <= 1 OR (b > band + 1 AND d < band - 1) GROUP BY 1, 2""")
def stream_bands(t: Tables) -> DataFrame:
    rows = _stream(t).select((F.col("user_id") % 40).alias("source_id"), F.col("ts").alias("at"))
    found = S.drained(S.crossed_bands(rows, datetime(2024, 2, 10), (35, 25, 15), 1), "bands")
    return found.groupBy("source_id", F.col("band").cast("int").alias("band")).agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT user_id FROM events GROUP BY 1 HAVING date_trunc('second', max(ts)) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_expired(t: Tables) -> DataFrame:
    rows = _stream(t).select("user_id", "ts")
    return S.drained(S.expired(rows, "user_id", "ts", 24, "1 day"), "expired").select("user_id")
