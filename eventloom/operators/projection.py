"""Forward projection of recurring schedules, and scoring of past forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ordinal, within_season
from ..functions.rrule import occurrences
from .windows import pick_best

RANKS = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


def confidence_rank(c: Column) -> Column:
    out = F.lit(9)
    for name, rank in RANKS.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def scored_confidence(base: Column, events: Column, validated_days: Column, inactive_days: Column) -> Column:
    """Low stays low. Three events and a validation within 30 days raise medium; a validation over 180 days ago or no event
    for 90 days lowers high; medium without an event is low. Unknown days change nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    up = F.when((base == "MEDIUM") & (events >= 3) & yes(validated_days < 30), "HIGH").otherwise(base)
    down = F.when((up == "HIGH") & (yes(validated_days > 180) | yes(inactive_days > 90)), "MEDIUM").otherwise(up)
    return F.when((down == "MEDIUM") & (events == 0), "LOW").otherwise(down)


def project(rules: DataFrame, start: Column, end: Column) -> DataFrame:
    """Dated rows of rules (kennel_id, rule_id, rule, anchor, start_time, confidence, season_start, season_end); a rule that
    can't be expanded gives one row without a date."""
    dates = occurrences(F.col("rule"), start, end, F.col("anchor"))
    dates = F.filter(dates, lambda d: within_season(d, F.col("season_start"), F.col("season_end")))
    return rules.select("kennel_id", "rule_id", "start_time", "confidence", F.explode(F.when(dates.isNull(), F.array(F.lit(None).cast("date"))).otherwise(dates)).alias("date"))


def best_per_slot(projections: DataFrame) -> DataFrame:
    """One projection for each (kennel, date, time), the surest, then the least rule; one dateless for each kennel."""
    slot = F.when(F.col("date").isNull(), F.lit("")).otherwise(F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), F.coalesce("start_time", F.lit("-"))))
    return pick_best(projections.withColumn("_slot", slot), ["kennel_id", "_slot"], [confidence_rank(F.col("confidence")), F.col("rule_id")]).drop("_slot")


def not_confirmed(projections: DataFrame, events: DataFrame) -> DataFrame:
    """Projections without those that an event confirms: of the same day and time, of the same day where either has no
    time, and dateless ones of kennels that have any event."""
    e = events.select("kennel_id", F.col("date").alias("_d"), F.col("start_time").alias("_t")).distinct()
    same = (projections["kennel_id"] == e["kennel_id"]) & (projections["date"] == e["_d"]) & (projections["start_time"].isNull() | e["_t"].isNull() | (projections["start_time"] == e["_t"]))
    dated = projections.where("date is not null").join(e, (projections["kennel_id"] == e["kennel_id"]) & same, "left_anti")
    return dated.unionByName(projections.where("date is null").join(e.select("kennel_id").distinct(), "kennel_id", "left_anti"))


def within_horizon(date: Column, today: Column, confidence: Column) -> Column:
    """Up to 180 days for all, to 365 for sure and for possible ones; dateless rows stay."""
    days = F.datediff(date, today)
    return F.coalesce((days <= 180) | ((days <= 365) & confidence.isin("HIGH", "LOW")), F.lit(True))


PERIOD = 26  # observed windows to a period


def outcomes(snapshots: DataFrame, events: DataFrame, near: int = 1, observed: int = 14) -> DataFrame:
    """Outcome of each forecast (snapshot_id, kennel_id, date): HIT with an event within ``near`` days, MISS if
    the kennel has one within ``observed`` days, else UNOBSERVED; the nearest event of all rows of an id counts.

    Forecasts and event days of a kennel and a period are one sorted stream, over which the last and the next event day run, so no row is
    copied but the event days within reach of a period's border."""
    reach = max(near, observed)
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    period = lambda d: F.floor(d / (PERIOD * reach)).cast("int")
    own = snapshots.withColumns({"_t": day(F.col("date")), "_d": F.lit(None).cast("int")}).withColumn("_p", period(F.col("_t")))
    days = events.select("kennel_id", day(F.col("date")).alias("_t")).where("kennel_id is not null and _t is not null").distinct()
    days = days.select("kennel_id", "_t", F.col("_t").alias("_d"), F.explode(F.sequence(period(F.col("_t") - reach), period(F.col("_t") + reach))).alias("_p"))
    both = own.withColumn("_event", F.lit(False)).unionByName(days.withColumn("_event", F.lit(True)), allowMissingColumns=True)
    slot = Window.partitionBy("kennel_id", "_p")
    past = F.last("_d", ignorenulls=True).over(slot.orderBy("_t", F.desc("_event")).rowsBetween(Window.unboundedPreceding, 0))
    coming = F.last("_d", ignorenulls=True).over(slot.orderBy(F.desc("_t"), F.desc("_event")).rowsBetween(Window.unboundedPreceding, 0))
    gaps = both.withColumns({"_past": past, "_next": coming}).where("not _event").withColumn("_gap", F.least(F.col("_t") - F.col("_past"), F.col("_next") - F.col("_t")))
    gap = F.when(F.col("snapshot_id").isNotNull(), F.min("_gap").over(Window.partitionBy("snapshot_id")))
    found = F.when(gap <= near, "HIT").when(gap <= observed, "MISS").otherwise("UNOBSERVED")
    return gaps.withColumn("outcome", found).select(*snapshots.columns, "outcome")


def capture_band(date: Column, today: Column, last_run: Column, bands: tuple[int, ...] = (180, 90, 30), slack: int = 4) -> Column:
    """The smallest band that a date is within ``slack`` days of, or has crossed since the last run."""
    out, before = F.datediff(date, today), F.datediff(date, last_run)
    hits = F.array(*(F.when((F.abs(out - b) <= slack) | ((before > b + slack) & (out < b - slack)), b) for b in bands))
    return F.array_min(F.array_compact(hits))


def weekday_drift(events: DataFrame, projected: DataFrame, least_events: int = 4, least_share: float = 0.6) -> DataFrame:
    """Kennels whose dominant weekday (share of ``least_share`` or more, ``least_events`` events) isn't projected."""
    counts = events.groupBy("kennel_id", (F.dayofweek("date") - 1).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("kennel_id").agg(F.max_by("weekday", F.struct("n", -F.col("weekday"))).alias("weekday"), F.max("n").alias("n"), F.sum("n").alias("events"))
    days = projected.groupBy("kennel_id").agg(F.collect_set(F.dayofweek("date") - 1).alias("projected"))  # seven at most
    return top.where((F.col("events") >= least_events) & (F.col("n") >= least_share * F.col("events"))).join(days, "kennel_id").where(~F.array_contains("projected", F.col("weekday")))


def next_per_kennel(events: DataFrame, today: Column) -> DataFrame:
    return events.where(F.col("date") >= today).groupBy("kennel_id").agg(F.min_by(F.struct("date", "event_id"), F.struct("date", "event_id")).alias("next")).select("kennel_id", "next.*")


def nth_latest(rows: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def explanation(freq: Column, weekday: Column, nth: Column, month_day: Column, interval: Column, label: Column, season_start: Column, season_end: Column) -> Column:
    """A rule in words, with its season's label and months where it has them."""
    day = F.get(F.array(*map(F.lit, WEEKDAYS)), weekday)
    which = F.when(nth == -1, "last").otherwise(ordinal(nth))
    monthly = F.when(month_day.isNotNull(), F.concat(F.lit("Runs on the "), ordinal(month_day), F.lit(" of each month"))).otherwise(F.concat(F.lit("Runs on the "), which, F.lit(" "), day, F.lit(" of each month")))
    weekly = F.when(interval > 1, F.concat(F.lit("Runs every "), interval.cast("string"), F.lit(" weeks on "), day)).otherwise(F.concat(F.lit("Runs every "), day))
    month = lambda c: F.get(F.array(*map(F.lit, MONTHS)), F.split_part(c, F.lit("-"), F.lit(1)).cast("int") - 1)
    months = F.when(season_start.isNotNull() & season_end.isNotNull(), F.concat(month(season_start), F.lit(" – "), month(season_end)))
    hint = F.concat_ws(", ", F.nullif(F.trim(label), F.lit("")), months)
    return F.concat(F.when(freq == "WEEKLY", weekly).otherwise(monthly), F.when(hint != "", F.concat(F.lit(" ("), hint, F.lit(")"))).otherwise(""))
