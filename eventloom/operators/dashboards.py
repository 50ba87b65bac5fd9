"""Aggregates behind dashboards: personal and member statistics, ledger scorecards, audit trends, facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import first_values, value_parts



def personal_stats(attendance: DataFrame, user: str, hare: Column, dimensions: dict[str, Column]) -> DataFrame:
    """user, dimension, value, runs and hared runs: in all (dimension ``total``) and by each dimension, in one pass.
    Weekdays that a user has no run on are left to :func:`with_weekday_spine`."""
    parts = [F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dimensions.items())]
    rows = attendance.select(user, hare.alias("_hare"), F.inline(F.array(*parts)))
    return rows.groupBy(user, "dimension", "value").agg(F.count(F.lit(1)).alias("runs"), F.count_if("_hare").alias("hared"))


def with_weekday_spine(stats: DataFrame, user: str) -> DataFrame:
    """All seven weekdays (Monday 0) for each user, those without a run with zeros."""
    days = stats.where("dimension = 'total'").select(user, F.lit("weekday").alias("dimension"), F.explode(F.sequence(F.lit(0), F.lit(6)).cast("array<string>")).alias("value"))
    missing = days.join(stats.where("dimension = 'weekday'"), [user, "dimension", "value"], "left_anti")
    return stats.unionByName(missing.withColumns({"runs": F.lit(0).cast("long"), "hared": F.lit(0).cast("long")}))


def member_stats(attendance: DataFrame, member: str, hare: Column, paid: Column, date: str) -> DataFrame:
    """Runs, hared and paid runs, first and last run of each member."""
    return attendance.groupBy(member).agg(F.count(F.lit(1)).alias("runs"), F.count_if(hare).alias("hared"), F.count_if(paid).alias("paid"), F.min(date).alias("first_run"), F.max(date).alias("last_run"))


def event_history(attendance: DataFrame, event: str, name: str, flags: dict[str, Column], size: int = 20) -> DataFrame:
    """Attendees and flag counts of each event, with all its names in order, in parts of ``size`` names."""
    counts = attendance.groupBy(event).agg(F.count(F.lit(1)).alias("attendees"), *(F.count_if(c).alias(n) for n, c in flags.items()))
    return counts.join(value_parts(attendance, [event], [name], name, size, "names"), event)


def dense_counts(rows: DataFrame, group: Sequence[str], column: str, levels: Sequence[str]) -> DataFrame:
    """A count for each level, absent ones as 0, and ``total``, per group."""
    return rows.groupBy(*group).agg(*(F.count_if(F.col(column) == v).alias(v.lower()) for v in levels), F.count(F.lit(1)).alias("total"))


def counters(**counts: DataFrame) -> DataFrame:
    """One row of independent counts: each table gives one number, and these are added up by name."""
    parts = None
    for name, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(*(F.col("n").alias(c) if c == name else F.lit(None).cast("long").alias(c) for c in counts))
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(*(F.sum(c).alias(c) for c in counts))


def _rule_counts() -> list[Column]:
    return [*(F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("HIGH", "MEDIUM", "LOW")), F.count_if(F.col("season_start").isNotNull()).alias("seasonal")]


def rule_coverage_by_source(rules: DataFrame) -> DataFrame:
    """Rules of each source by confidence, seasonal ones, and its kennels with a rule."""
    return rules.groupBy("source").agg(*_rule_counts(), F.count(F.lit(1)).alias("rules"), F.countDistinct("kennel_id").alias("covered"))


def rule_coverage(rules: DataFrame, kennels: DataFrame) -> DataFrame:
    """One row: rules by confidence, kennels with a rule, seasonal rules, and dark kennels (those without)."""
    told = rules.agg(*_rule_counts(), F.countDistinct("kennel_id").alias("covered"))
    return told.crossJoin(kennels.agg(F.countDistinct("kennel_id").alias("kennels"))).withColumn("dark", F.greatest(F.lit(0), F.col("kennels") - F.col("covered"))).drop("kennels")  # one row by one row


def json_trend(rows: DataFrame, at: str, json: str, categories: Sequence[str], zone: str = "America/New_York") -> DataFrame:
    """Sums per category of a JSON map of counts, by the local day of an instant in UTC."""
    day = F.to_date(F.from_utc_timestamp(F.col(at).cast("timestamp_ntz").cast("timestamp"), zone))
    counts = F.from_json(json, "map<string,long>")
    return rows.groupBy(day.alias("day")).agg(*(F.sum(F.coalesce(F.try_element_at(counts, F.lit(c)), F.lit(0))).alias(c) for c in categories))


def top_offenders(logs: DataFrame, suppressions: DataFrame, k: int = 20) -> DataFrame:
    """(kennel_id, rule) of the findings nested in logs (findings: array of structs, at): how often, when last, and whether
    a suppression of the kennel or of all kennels covers them."""
    flat = logs.select("at", F.inline("findings")).groupBy("kennel_id", "rule").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))
    everywhere = suppressions.where("kennel_id is null").select("rule", F.lit(True).alias("_all")).distinct()
    own = suppressions.where("kennel_id is not null").select("kennel_id", "rule", F.lit(True).alias("_own")).distinct()
    told = flat.join(everywhere, "rule", "left").join(own, ["kennel_id", "rule"], "left")
    told = told.withColumn("suppressed", F.coalesce("_all", "_own", F.lit(False))).drop("_all", "_own")
    return told.orderBy(F.desc("n"), "kennel_id", "rule").limit(k)


def suppression_impact(findings: DataFrame, suppressions: DataFrame, days: int) -> DataFrame:
    """Findings that each suppression (kennel_id or null for all, rule) hides, and tenths of that per day."""
    own = suppressions.where("kennel_id is not null").distinct()
    everywhere = suppressions.where("kennel_id is null").select("rule").distinct()
    hits = findings.join(own, ["kennel_id", "rule"], "left_semi").select("kennel_id", "rule").unionByName(findings.join(everywhere, "rule", "left_semi").select(F.lit(None).cast(findings.schema["kennel_id"].dataType).alias("kennel_id"), "rule"))
    return hits.groupBy("kennel_id", "rule").agg(F.count(F.lit(1)).alias("hidden")).withColumn("per_day_tenths", F.floor((20 * F.col("hidden") + days) / (2 * days)).cast("long"))


def open_then(items: DataFrame, changes: DataFrame, stream: str, since: Column) -> DataFrame:
    """Open items of each stream now and at ``since``: open now less the net of the changes from then on."""
    now = items.where("state = 'open'").groupBy(stream).agg(F.count(F.lit(1)).alias("open_now"))
    up, down = F.col("kind").isin("OPENED", "REOPENED"), F.col("kind") == "CLOSED"
    net = changes.where(F.col("day") >= since).groupBy(stream).agg((F.count_if(up) - F.count_if(down)).alias("net"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return now.join(net, stream, "full").select(stream, zero("open_now").alias("open_now"), (zero("open_now") - zero("net")).alias("open_then"))


def floored_ratio(rows: DataFrame, group: str, hit: Column, known: Column, least: int = 5) -> DataFrame:
    """Whole percent of the known rows that hit; null for fewer than ``least``."""
    n, k = F.count_if(known & hit), F.count_if(known)
    return rows.groupBy(group).agg(k.alias("known"), n.alias("hits")).withColumn("percent", F.when(F.col("known") >= least, F.floor((200 * F.col("hits") + F.col("known")) / (2 * F.col("known"))).cast("long")))


def coverage(items: DataFrame, done: DataFrame, key: str, done_per_week: Column) -> DataFrame:
    """One row: covered and all items, whole percent, and weeks until the rest is covered at the recent pace."""
    got = items.select(key).distinct().join(done.select(key, F.lit(1).alias("_done")).distinct(), key, "left")
    told = got.agg(F.count("_done").alias("covered"), F.count(F.lit(1)).alias("total"))
    pace = done.agg(done_per_week.alias("pace"))
    told = told.crossJoin(pace)  # one row by one row
    percent = F.floor(F.try_divide(200 * F.col("covered") + F.col("total"), 2 * F.col("total"))).cast("long")
    return told.select("covered", "total", percent.alias("percent"), F.when(F.col("pace") > 0, F.ceil((F.col("total") - F.col("covered")) / F.col("pace"))).cast("long").alias("weeks_left"))


def least_recent(keys: DataFrame, rows: DataFrame, key: str, at: str, name: str, k: int) -> DataFrame:
    """Keys by their last row, those without one first, then the oldest, then by name."""
    last = keys.join(rows.groupBy(key).agg(F.max(at).alias("last_at")), key, "left")
    return last.orderBy(F.asc_nulls_first("last_at"), name, key).limit(k)


def evidence_timeline(rows: DataFrame, key: str, date: str, end: Column, weeks: int = 12) -> DataFrame:
    """For each key whether each of the last ``weeks`` weeks up to ``end`` (oldest first) has a row, as a string of 0
    and 1, and the rows in them."""
    week = F.floor(F.datediff(end, F.col(date)) / 7)
    own = rows.withColumn("_w", week).where((F.col("_w") >= 0) & (F.col("_w") < weeks))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(_w as int))"))
    told = own.groupBy(key).agg(bits.alias("_bits"), F.count(F.lit(1)).alias("total"))
    return told.select(key, F.lpad(F.bin("_bits"), weeks, "0").alias("weeks"), "total")


def weekday_facets(rows: DataFrame, group: str, date: str) -> DataFrame:
    """Rows of each weekday (Sunday 0) and its dates in order; dates are few, as each is taken once."""
    return rows.groupBy(group, (F.dayofweek(date) - 1).alias("weekday")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.date_format(date, "yyyy-MM-dd"))).alias("dates"))


def day_by_stop(rows: DataFrame, stops: Sequence[str], size: int = 50) -> DataFrame:
    """A row for each day, with the ids of each stop in order of time and distance; a stop with more than ``size`` goes on in
    further parts of the day. A null day comes last."""
    lists = value_parts(rows, ["day", "stop"], [F.coalesce(F.col("start_time"), F.lit("99:99")), F.col("distance"), F.col("id")], "id", size, "ids")
    none = F.array().cast(lists.schema["ids"].dataType)
    cell = lambda s: F.coalesce(F.first(F.when(F.col("stop") == s, F.col("ids")), ignorenulls=True), none)
    return lists.groupBy("day", "part").agg(*(cell(s).alias(f"stop_{s}") for s in stops)).orderBy(F.asc_nulls_last("day"), "part")


def worst_of(rows: DataFrame, group: str, column: str, order: Sequence[str]) -> DataFrame:
    """The value of a group that comes first in a precedence."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return rows.where(rank > 0).groupBy(group).agg(F.min_by(column, rank).alias("worst"))


def action_counters(rows: DataFrame, group: str, action: str, actions: Sequence[str], key: str, samples: int = 3) -> DataFrame:
    """Rows of each action of a batch, and the first keys of each as samples, a bounded list."""
    counts = rows.groupBy(group).agg(*(F.count_if(F.col(action) == a).alias(a) for a in actions))
    lists = first_values(rows.where(F.col(action).isin(list(actions))), [group, action], [key], key, samples, "_s")
    none = F.array().cast(lists.schema["_s"].dataType)
    few = lists.groupBy(group).agg(*(F.first(F.when(F.col(action) == a, F.col("_s")), ignorenulls=True).alias(f"{a}_samples") for a in actions))
    return counts.join(few, group, "left").withColumns({f"{a}_samples": F.coalesce(f"{a}_samples", none) for a in actions})


def census(kennels: DataFrame, projections: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Best confidence of each kennel within each horizon of days, none where it has no projection, counted."""
    rank = F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).when(F.col("confidence") == "LOW", 2)
    best = projections.groupBy("kennel_id").agg(*(F.min(F.when(F.col("days_out").between(0, h), rank)).alias(f"h{h}") for h in horizons))
    full = kennels.select("kennel_id").distinct().join(best, "kennel_id", "left")
    name = lambda c: F.when(F.col(c) == 0, "HIGH").when(F.col(c) == 1, "MEDIUM").when(F.col(c) == 2, "LOW").otherwise("NONE")
    cells = full.select(F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), name(f"h{h}").alias("bucket")) for h in horizons))))
    return cells.groupBy("horizon", "bucket").agg(F.count(F.lit(1)).alias("kennels"))


def backtest(projections: DataFrame, actuals: DataFrame, tolerances: Sequence[int] = (0, 1)) -> DataFrame:
    """Per tolerance of days: projections with an event of their kennel, all projections, events with a
    projection, all events. Both sides meet by kennel and day, spread over the tolerance."""
    p, a = projections.select("kennel_id", "date").distinct(), actuals.select("kennel_id", "date").distinct()
    out = None
    for t in tolerances:
        spread = lambda df, t=t: df.select("kennel_id", "date", F.explode(F.transform(F.sequence(F.lit(-t), F.lit(t)), lambda k: F.date_add("date", k))).alias("near"))
        hit = lambda x, y, s=spread: s(x).join(y.select("kennel_id", F.col("date").alias("near")), ["kennel_id", "near"], "left_semi").select("kennel_id", "date").distinct()
        one = counters(hits=hit(p, a), projected=p, found=hit(a, p), actual=a).withColumn("tolerance", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


def padded_bounds(points: DataFrame, group: str, lat: str, lng: str, pad: float, least: int = 8) -> DataFrame:
    """Box of a group's points, without Tukey outliers on either axis where it has ``least`` points, with padding. Quartiles
    are the values at place floor(n q), found through counts of values, not by a list of the group."""
    def axis(x: str) -> DataFrame:
        values = points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).groupBy(group, F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        run = values.withColumns({"upto": F.sum("n").over(Window.partitionBy(group).orderBy("v")), "all": F.sum("n").over(Window.partitionBy(group))})
        at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("all") * q), F.col("v")))
        return run.groupBy(group).agg(F.max("all").alias("n"), at(0.25).alias(f"q1_{x}"), at(0.75).alias(f"q3_{x}"))

    stats = axis(lat).join(axis(lng).drop("n"), group)
    inside = lambda x: F.col(x).between(F.col(f"q1_{x}") - 1.5 * (F.col(f"q3_{x}") - F.col(f"q1_{x}")), F.col(f"q3_{x}") + 1.5 * (F.col(f"q3_{x}") - F.col(f"q1_{x}")))
    kept = points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).join(stats, group).where((F.col("n") < least) | (inside(lat) & inside(lng)))
    return kept.groupBy(group).agg((F.min(lat) - pad).alias("south"), (F.min(lng) - pad).alias("west"), (F.max(lat) + pad).alias("north"), (F.max(lng) + pad).alias("east"), F.count(F.lit(1)).alias("kept"))
