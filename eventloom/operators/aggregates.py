"""Aggregations over events, attendance and run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import first_values


def active_by_region(events: DataFrame, since: Column, key: str, region: str, date: str = "date", k: int = 20) -> DataFrame:
    """Organisers with an event since a date, and these events, for each region; the ``k`` most active."""
    rows = events.where(F.col(date) >= since).groupBy(region).agg(F.countDistinct(key).alias("active_kennels"), F.count(F.lit(1)).alias("event_count"))
    return rows.orderBy(F.desc("active_kennels"), F.desc("event_count"), region).limit(k)


def top_with_lookup(rows: DataFrame, key: str, others: DataFrame, k: int, name: str, other_name: str) -> DataFrame:
    """The ``k`` keys with most rows, then another table's count of each (0 if none). The second
    count reads only rows of the keys that are left."""
    top = rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key).limit(k)
    own = others.join(F.broadcast(top.select(key)), key, "left_semi")  # k rows
    return top.join(own.groupBy(key).agg(F.count(F.lit(1)).alias(other_name)), key, "left").withColumn(other_name, F.coalesce(other_name, F.lit(0)))


def histogram_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """How many keys have each number of rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


def status_by_group(rows: DataFrame, group: str, status: str, columns: dict[str, Sequence[str]]) -> DataFrame:
    """Counts of rows in each set of statuses."""
    return rows.groupBy(group).agg(*(F.count_if(F.col(status).isin(*v)).alias(k) for k, v in columns.items()))


def success_rate(rows: DataFrame, bucket: Column, ok: Column) -> DataFrame:
    """Runs, successes and per mille (exact integers: halves up) in each bucket."""
    counted = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("ok_runs"))
    return counted.withColumn("per_mille", F.floor((2000 * F.col("ok_runs") + F.col("runs")) / (2 * F.col("runs"))).cast("long"))


def stale_keys(keys: DataFrame, rows: DataFrame, key: str, at: str, cutoff: Column, k: int) -> DataFrame:
    """Keys whose last row is before a cutoff or missing, the missing first."""
    last = keys.join(rows.groupBy(key).agg(F.max(at).alias("last_at")), key, "left")
    return last.where(F.col("last_at").isNull() | (F.col("last_at") < cutoff)).orderBy(F.asc_nulls_first("last_at"), key).limit(k)


def last_dates(direct: DataFrame, bridge: DataFrame, key: str, date: str) -> DataFrame:
    """The latest date of each key over rows that name it directly or over a bridge."""
    return direct.select(key, date).unionByName(bridge.select(key, date)).groupBy(key).agg(F.max(date).alias("last_date"))


def changed(new: DataFrame, old: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of ``new`` whose value differs from the old one, nulls being equal."""
    previous = old.select(key, F.col(column).alias("_old"))
    return new.join(previous, key, "left").where(~F.col(column).eqNullSafe(F.col("_old"))).drop("_old")


def fill_rates(rows: DataFrame, group: str, fields: dict[str, Column]) -> DataFrame:
    """Whole percent of rows whose field is filled, halves up."""
    rate = lambda c: F.floor((200 * F.count_if(F.coalesce(c, F.lit(False))) + F.count(F.lit(1))) / (2 * F.count(F.lit(1)))).cast("long")
    return rows.groupBy(group).agg(*(rate(c).alias(n) for n, c in fields.items()))


def dominant_value(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of a group (the least one of equals), its rows, and all rows."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("dominant"), F.max("n").alias("dominant_rows"), F.sum("n").alias("all_rows"))


def precision_grid(outcomes: DataFrame, confidences: Sequence[str], bins: Sequence[tuple[int, int | None]]) -> DataFrame:
    """Hits, misses and permille precision for each confidence and bin of days out, on the full grid."""
    spark = outcomes.sparkSession
    spine = spark.createDataFrame([(c, i) for c in confidences for i in range(len(bins))], "confidence string, bin int")
    binned = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(bins))):
        binned = F.when((F.col("days_out") >= lo) & (F.lit(True) if hi is None else F.col("days_out") <= hi), i).otherwise(binned)
    counts = outcomes.withColumn("bin", binned).groupBy("confidence", "bin").agg(F.count_if(F.col("outcome") == "HIT").alias("hits"), F.count_if(F.col("outcome") == "MISS").alias("misses"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    dense = spine.join(counts, ["confidence", "bin"], "left").withColumns({"hits": zero("hits"), "misses": zero("misses")})
    return dense.withColumn("per_mille", F.floor(F.try_divide(1000 * F.col("hits"), F.col("hits") + F.col("misses"))).cast("long"))


def grouped_findings(findings: DataFrame, severity_rank: Column, k: int, samples: int = 3) -> DataFrame:
    """Findings by (kennel_id, rule): count and the first samples by event id; errors first, then the most. Samples are looked for in the
    ``k`` groups that are left, and a few of each partition at most are shuffled."""
    out = findings.groupBy("kennel_id", "rule").agg(F.min(severity_rank).alias("severity_rank"), F.count(F.lit(1)).alias("n"))
    top = out.orderBy("severity_rank", F.desc("n"), "kennel_id", "rule").limit(k)
    own = findings.join(F.broadcast(top.select("kennel_id", "rule")), ["kennel_id", "rule"], "left_semi")  # k rows
    few = first_values(own, ["kennel_id", "rule"], ["event_id"], "event_id", samples, "samples")
    return top.join(few, ["kennel_id", "rule"]).orderBy("severity_rank", F.desc("n"), "kennel_id", "rule")


def repeated_blocks(docs: DataFrame, key: str, text: str, group: str, separator: str = r"\n", least: int = 2) -> DataFrame:
    """Blocks that occur in ``least`` documents of a group or more, with the number of documents."""
    blocks = docs.select(group, key, F.explode(F.array_distinct(F.transform(F.split(text, separator), lambda b: F.trim(b)))).alias("block")).where("block <> ''").distinct()
    return blocks.groupBy(group, "block").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= least)


def without_blocks(docs: DataFrame, boilerplate: DataFrame, key: str, text: str, group: str, separator: str = r"\n") -> DataFrame:
    """Texts without the blocks of their group's boilerplate, in order. Blocks are joined one by one,
    so no group's boilerplate need fit a task."""
    parts = docs.select(key, group, F.posexplode(F.split(text, separator)).alias("pos", "part")).withColumn("block", F.trim("part"))
    kept = parts.join(boilerplate.select(group, "block"), [group, "block"], "left_anti")
    rebuilt = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"))
    return docs.select(key).join(rebuilt, key, "left").select(key, F.coalesce(F.array_join(F.col("p.part"), "\n"), F.lit("")).alias(text))


def robust_bounds(points: DataFrame, group: str, x: str, least: int = 8) -> DataFrame:
    """Minimum and maximum without Tukey outliers where a group has ``least`` values or more. Quartiles are the
    values at sorted place floor(n q), found through counts of values: the window runs over different values, pre-aggregated."""
    values = points.where(F.col(x).isNotNull()).groupBy(group, F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    run = values.withColumns({"upto": F.sum("c").over(Window.partitionBy(group).orderBy("v")), "all": F.sum("c").over(Window.partitionBy(group))})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("all") * q), F.col("v")))
    stats = run.groupBy(group).agg(F.max("all").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = values.join(stats, group).where((F.col("n") < least) | F.col("v").between(F.col("q1") - fence, F.col("q3") + fence))
    return inside.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("kept"), F.first("n").alias("n"))


def stream_trend(changes: DataFrame, spine: DataFrame) -> DataFrame:
    """Opened, reopened, closed and net per day and stream on a dense spine (day, stream). A relabelled item closes in the
    stream it leaves and opens in the one it joins; a reopened one counts by itself."""
    delta = lambda stream, opened, closed, reopened=0: F.struct(stream.alias("stream"), F.lit(opened).alias("opened"), F.lit(closed).alias("closed"), F.lit(reopened).alias("reopened"))
    deltas = F.when(F.col("kind") == "CLOSED", F.array(delta(F.col("to_stream"), 0, 1))).when(F.col("kind") == "RELABELED", F.array(delta(F.col("to_stream"), 1, 0), delta(F.col("from_stream"), 0, 1))).when(F.col("kind") == "REOPENED", F.array(delta(F.col("to_stream"), 0, 0, 1))).otherwise(F.array(delta(F.col("to_stream"), 1, 0)))
    rows = changes.select("day", F.explode(deltas).alias("d")).select("day", "d.*").groupBy("day", "stream").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"), F.sum("reopened").alias("reopened"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return spine.join(rows, ["day", "stream"], "left").withColumns({c: zero(c) for c in ("opened", "closed", "reopened")}).withColumn("net", F.col("opened") + F.col("reopened") - F.col("closed"))
