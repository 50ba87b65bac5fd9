"""Series of events and canonical rows: absorption of repeated rows, parents, cascades, shells of whole days, suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import pick_best, signature


def canonical_rows(rows: DataFrame) -> DataFrame:
    """The canonical row of each group of (kennel_id, date): live rows before cancelled ones, then trust, completeness, creation, id.
    Rows are grouped by their signature; a group of a run number without a link is absorbed by the one linked group of its
    run whose start times fit. Columns: event_id, kennel_id, date, run_number, source_url, start_time, title, status, trust, completeness, created_at."""
    slot = ["kennel_id", "date"]
    own = rows.withColumn("_sig", signature(F.col("run_number"), F.col("source_url"), F.col("start_time"), F.col("title")))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    times = F.array_sort(F.collect_set(F.when(~blank("start_time"), F.trim("start_time"))))  # times of one run on one day
    groups = own.where("run_number is not null").groupBy(*slot, "run_number", "_sig").agg(F.first(blank("source_url")).alias("bare"), times.alias("times"))
    left = groups.where("bare").select(*slot, "run_number", F.col("_sig").alias("_sig"), F.col("times").alias("t"))
    right = groups.where(~F.col("bare")).select(*slot, "run_number", F.col("_sig").alias("peer"), F.col("times").alias("p"))
    fits = F.when(F.size("t") == 0, F.size("p") <= 1).when(F.size("p") == 0, F.size("t") <= 1).otherwise(F.col("t") == F.col("p"))
    sole = left.join(right, [*slot, "run_number"]).where(fits).groupBy(*slot, "_sig").agg(F.count(F.lit(1)).alias("n"), F.min("peer").alias("peer")).where("n = 1").drop("n")
    merged = own.join(sole, [*slot, "_sig"], "left").withColumn("_sig", F.coalesce("peer", "_sig"))
    order = [F.asc(F.col("status") == "CANCELLED"), F.desc("trust"), F.desc("completeness"), F.asc("created_at"), F.asc("event_id")]
    return pick_best(merged, [*slot, "_sig"], order).drop("_sig", "peer")


def series_parents(rows: DataFrame, series: str) -> DataFrame:
    """Rows of series with their parent: an explicit one, else the first by date and id. Columns: event_id, date, is_parent."""
    w = Window.partitionBy(series).orderBy(F.desc("is_parent"), "date", "event_id")
    first = F.first("event_id").over(w)
    return rows.withColumn("parent_id", first).withColumn("parent_id", F.when(F.col("parent_id") != F.col("event_id"), F.col("parent_id")))


def cascaded_status(rows: DataFrame) -> DataFrame:
    """Parents (event_id) of series with the status that their children give them: cancelled if all are, confirmed again
    if not all are; an admin's cancellation stays. Columns: event_id, parent_id, status, admin_locked."""
    children = rows.where("parent_id is not null").groupBy(F.col("parent_id").alias("event_id")).agg(F.bool_and(F.col("status") == "CANCELLED").alias("all_off"))
    parents = rows.where("parent_id is null").join(children, "event_id")
    new = F.when(F.col("admin_locked"), F.col("status")).when(F.col("all_off") & (F.col("status") == "CONFIRMED"), "CANCELLED").when(~F.col("all_off") & (F.col("status") == "CANCELLED"), "CONFIRMED").otherwise(F.col("status"))
    return parents.select("event_id", new.alias("status"))


def titled_runs(rows: DataFrame, group: Sequence[str], date: str, key: str, linked: str, max_gap: int = 2, max_span: int = 7) -> DataFrame:
    """Runs of rows of one title key whose gaps are 1 to ``max_gap`` days, of two rows or more, at most ``max_span`` days long and
    without a member that is linked already: parent (first row), last date, rows."""
    w = Window.partitionBy(*group).orderBy(date, key)
    flagged = rows.withColumn("_new", F.when(F.datediff(F.col(date), F.lag(date).over(w)).between(1, max_gap), 0).otherwise(1))
    islands = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(*group, "_island").agg(F.min(F.struct(date, key))[key].alias("parent"), F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("members"), F.bool_or(linked).alias("_linked"))
    return out.where((F.col("members") >= 2) & (F.datediff("end_date", "start_date") <= max_span) & ~F.col("_linked")).drop("_island", "_linked")


def numeric_ids_first(rows: DataFrame, date: str, key: str) -> DataFrame:
    """Rows of a date whose id is a number, or all of them if none is; rows without a date stay."""
    numeric = F.col(key).rlike(r"^\d+$")
    best = F.max(numeric).over(Window.partitionBy(date))
    return rows.withColumn("_any", best).where(F.col(date).isNull() | numeric | ~F.col("_any")).drop("_any")


def calendar_dedupe(rows: DataFrame) -> DataFrame:
    """Rows of one calendar pull without repeats: all-day shells without content go where their (tag, date) has a timed row, then the first row of
    each id, then one row of each (tag, date, time, title), whose fields are the first known ones. Columns: ordinal, item_id, tag, date, start_time, title,
    all_day, hares, location."""
    timed = rows.where(~F.col("all_day")).select("tag", "date").distinct()
    bare = F.col("all_day") & F.col("hares").isNull() & F.col("location").isNull()
    shells = rows.where(bare).join(timed, ["tag", "date"], "left_semi").select("ordinal")
    left = rows.join(shells, "ordinal", "left_anti")
    id_key = F.coalesce(F.concat(F.lit("id:"), "item_id"), F.concat_ws("|", F.lit("legacy:"), F.col("date").cast("string"), "tag", F.coalesce("start_time", F.lit("")), F.coalesce("title", F.lit(""))))
    once = pick_best(left.withColumn("_id", id_key), ["_id"], [F.asc("ordinal")]).drop("_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c)
    return once.groupBy("tag", "date", "start_time", "title").agg(F.min("ordinal").alias("ordinal"), first("hares"), first("location"))


def suggestion_scores(events: DataFrame, attendance: DataFrame, reference: Column, lookback: int = 180, least_events: int = 3, least: float = 0.3) -> DataFrame:
    """Likely attendees of each kennel: 0.35 x share of its recorded events + 0.15 x share of its roster's + 0.30 x recency + 0.20 x
    streak (of at most 4). ``events``: event_id, kennel_id, roster_id, date, all in the lookback; ``attendance``: hasher, event_id. Recorded are events that
    someone attended; a roster needs ``least_events`` of them. Scores are thousandths, so that they compare exactly."""
    att = attendance.join(events, "event_id").select("hasher", "event_id", "kennel_id", "roster_id", "date").distinct()
    recorded = att.select("event_id", "kennel_id", "roster_id", "date").distinct()
    ranked = recorded.withColumn("at", F.row_number().over(Window.partitionBy("kennel_id").orderBy(F.desc("date"), "event_id")))
    kennels = ranked.groupBy("kennel_id", "roster_id").agg(F.count(F.lit(1)).alias("kennel_events"))
    rosters = recorded.groupBy("roster_id").agg(F.count(F.lit(1)).alias("roster_events")).where(F.col("roster_events") >= least_events)
    hashers = att.groupBy("roster_id", "hasher").agg(F.count(F.lit(1)).alias("roster_runs"), F.max("date").alias("last"))
    own = att.join(ranked.select("event_id", "at"), "event_id").groupBy("kennel_id", "hasher").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("at") <= 4).alias("_recent"), F.bit_or(F.when(F.col("at") <= 4, F.expr("shiftleft(1, at - 1)")).otherwise(0)).alias("bits"))
    rows = kennels.join(rosters, "roster_id").join(hashers, "roster_id").join(own, ["kennel_id", "hasher"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    bit = lambda i: zero("bits").bitwiseAND(F.lit(1 << i)) > 0
    streak = F.when(~bit(0), 0).when(~bit(1), 1).when(~bit(2), 2).when(~bit(3), 3).otherwise(4)
    recency = F.greatest(F.lit(0.0), 1 - F.datediff(reference, "last") / lookback)
    score = 0.35 * zero("runs") / F.col("kennel_events") + 0.15 * F.col("roster_runs") / F.col("roster_events") + 0.30 * recency + 0.20 * streak / 4
    out = rows.select("kennel_id", "hasher", F.floor(score * 1000 + 0.5).cast("long").alias("score"), streak.cast("long").alias("streak"))
    return out.where(F.col("score") >= int(least * 1000))


def roster(hares: DataFrame, attendees: DataFrame) -> DataFrame:
    """Past roster of each event: hares (event_id, user_id or null, name), then attendees (event_id, user_id, name) that aren't hares, one for each user."""
    h = hares.select("event_id", "user_id", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Hare")).alias("name"), F.lit(True).alias("is_hare"))
    a = attendees.join(hares.where("user_id is not null").select("event_id", "user_id"), ["event_id", "user_id"], "left_anti")
    a = a.groupBy("event_id", "user_id").agg(F.min("name").alias("name")).select("event_id", "user_id", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Hasher")).alias("name"), F.lit(False).alias("is_hare"))
    return h.unionByName(a)
