"""Ordered-analytic operators: retention, baselines, islands, streaks, best picks, milestones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def dual_quota(rows: DataFrame, group: str, order: Sequence[Column], good: Column, any_rows: int = 30, good_rows: int = 10) -> DataFrame:
    """Rows among the newest ``any_rows`` of a group, or among the newest ``good_rows`` good ones."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    ranked = ranked.withColumns({"_any": F.row_number().over(w), "_nth": F.row_number().over(Window.partitionBy(group, "_good").orderBy(*order))})
    return ranked.where((F.col("_any") <= any_rows) | (F.col("_good") & (F.col("_nth") <= good_rows))).drop("_good", "_any", "_nth")


def rolling_baseline(runs: DataFrame, group: Sequence[str], order: Sequence[str], value: str, depth: int = 10) -> DataFrame:
    """Sum and number of the previous ``depth`` values of the same regime. Sums of integers stay exact."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-depth, -1)
    return runs.withColumns({"base_sum": F.sum(value).over(w), "base_n": F.count(value).over(w)})


def success_baseline(runs: DataFrame, regime: Sequence[str], order: Sequence[str], value: str, failed: Column, depth: int = 10) -> DataFrame:
    """Sum and number of the previous ``depth`` successful values of the same regime. Successes are numbered as they come, so
    the frame is a range over that number: failed rows in between take no place in it."""
    w = Window.partitionBy(*regime).orderBy(*order)
    good = F.when(failed, 0).otherwise(1)
    seen = runs.withColumn("_seen", F.coalesce(F.sum(good).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = seen.withColumn("_v", F.when(~failed, F.col(value)))
    frame = Window.partitionBy(*regime).orderBy("_seen").rangeBetween(-depth, -1)
    return kept.withColumns({"base_sum": F.sum("_v").over(frame), "base_n": F.count("_v").over(frame)}).drop("_seen", "_v")


def excessive_cancellations(cancelled: Column, base_sum: Column, base_n: Column, most: int = 10) -> Column:
    """Over ``most`` cancellations, or over half of the mean count."""
    return (cancelled > most) | F.coalesce((base_n > 0) & (base_sum > 0) & (2 * cancelled * base_n > base_sum), F.lit(False))


def structure_alerts(runs: DataFrame, group: Sequence[str], day: str, hash_col: str, count: str, fill: str, depth: int = 10) -> DataFrame:
    """Rows with ``alert``: null while a hash equals the last one known, else WARNING if the count is over 20 per cent below its mean or the
    fill rate over 15 points below one of 50 or more, INFO if not."""
    w = Window.partitionBy(*group).orderBy(day).rowsBetween(-depth, -1)
    last, mean, rate = F.last(hash_col, ignorenulls=True).over(w), F.floor(F.avg(count).over(w) + 0.5), F.avg(fill).over(w)
    drop = F.when(mean > 0, F.floor((mean - F.col(count)) / mean * 100 + 0.5)).otherwise(0)
    hit = (drop > 20) | F.coalesce((rate >= 50) & (rate - F.col(fill) > 15), F.lit(False))
    return runs.withColumn("alert", F.when(F.col(hash_col) != last, F.when(hit, "WARNING").otherwise("INFO")))


def count_anomaly(value: Column, base_sum: Column, base_n: Column, benign: Column | None = None) -> Column:
    """CRITICAL for zero against a positive mean, WARNING for less than half of a mean over 5."""
    found = F.when((base_n > 0) & (base_sum > 0) & (value == 0), "CRITICAL").when((base_n > 0) & (base_sum > 5 * base_n) & (2 * value * base_n < base_sum), "WARNING")
    return found if benign is None else F.when(~F.coalesce(benign, F.lit(False)), found)


def fill_drop(value: Column, base_sum: Column, base_n: Column, least: int = 50, drop: int = 30) -> Column:
    """Whether a rate fell by over ``drop`` points from a mean of ``least`` or more."""
    return (base_n > 0) & (base_sum >= least * base_n) & (base_sum - value * base_n > drop * base_n)


def structure_change(hash_col: str, group: Sequence[str], order: Sequence[str], depth: int = 10) -> Column:
    """Whether a hash differs from the last one known among the previous rows."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-depth, -1)
    last = F.last(hash_col, ignorenulls=True).over(w)
    return F.coalesce(F.col(hash_col) != last, F.lit(False))


def novel_items(items: str, group: Sequence[str], order: Sequence[str], depth: int = 10) -> Column:
    """Items of a row's array that none of the previous rows had."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-depth, -1)
    return F.array_except(F.col(items), F.flatten(F.collect_list(items).over(w)))


def consecutive_failures(failed: Column, group: Sequence[str], order: Sequence[str], look: int = 3, least: int = 2) -> Column:
    """A failure with ``least`` failures or more among the ``look`` rows before it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-look, -1)
    return failed & (F.coalesce(F.sum(failed.cast("int")).over(w), F.lit(0)) >= least)


def overall_status(severity_ranks: Column) -> Column:
    return F.when(severity_ranks >= 2, "FAILING").when(severity_ranks >= 1, "DEGRADED").otherwise("HEALTHY")


def pick_best(rows: DataFrame, slot: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each slot."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*slot).orderBy(*order))).where("_at = 1").drop("_at")


def completeness(truthy: Sequence[str], present: Sequence[str], pairs: Sequence[tuple[str, str]] = ()) -> Column:
    """Fields filled: text fields that aren't empty, others that aren't null, pairs as one."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    parts = [one(F.col(c).cast("string") != "") for c in truthy] + [one(F.col(c).isNotNull()) for c in present] + [one(F.col(a).isNotNull() & F.col(b).isNotNull()) for a, b in pairs]
    return sum(parts[1:], parts[0])


def signature(run_number: Column, url: Column, time: Column, title: Column) -> Column:
    """Key of rows that are one event in a slot: run number and URL, else time, URL and title."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.when(run_number.isNotNull(), F.concat(F.lit("run#"), run_number.cast("string"), F.lit("::"), t(url))).otherwise(F.concat_ws("::", t(time), t(url), t(title)))


def consecutive_islands(rows: DataFrame, group: Sequence[str], date: str, key: str, max_gap: int = 2, max_span: int = 7) -> DataFrame:
    """Runs of rows of a group whose gaps are 1 to ``max_gap`` days, of two rows or more and at most ``max_span``
    days: island's first row (parent), first and last date, rows. A gap of 0 ends a run as well."""
    w = Window.partitionBy(*group).orderBy(date, key)
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    flagged = rows.withColumn("_new", F.when(gap.between(1, max_gap), 0).otherwise(1))
    islands = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(*group, "_island").agg(F.min(F.struct(date, key))[key].alias("parent"), F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("members"))
    return out.where((F.col("members") >= 2) & (F.datediff("end_date", "start_date") <= max_span)).drop("_island")


def first_values(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: str, k: int, name: str) -> DataFrame:
    """The first ``k`` values of each group in an order, as an array. The filter on the row number is taken before the shuffle too, so a
    very large group sends ``k`` rows of each partition."""
    top = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_at") <= k)
    return top.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(name))


def value_parts(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: str, size: int, name: str) -> DataFrame:
    """All values of each group in an order, as arrays of at most ``size``: ``part`` numbers them from 0."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    placed = rows.withColumn("_at", at).withColumn("part", F.floor(F.col("_at") / size))
    return placed.groupBy(*group, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(name))


def streaks(attended: DataFrame, slots: DataFrame, group: str, order: str, cap: int = 4) -> DataFrame:
    """Most recent slots in a row that a member attended, at most ``cap``. Only the last ``cap`` slots matter, so they are
    numbered once and a member's attendances are bits; members who missed the last slot have 0."""
    last = slots.select(order).distinct().orderBy(F.desc(order)).limit(cap)
    numbered = last.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(order))) - 1)  # of ``cap`` rows
    bits = attended.select(group, order).distinct().join(F.broadcast(numbered), order).groupBy(group).agg(F.bit_or(F.expr("shiftleft(1, _r)")).alias("_b"))
    out = attended.select(group).distinct().join(bits, group, "left")
    b = F.coalesce("_b", F.lit(0))
    first_gap = F.coalesce(*(F.when(b.bitwiseAND(F.lit(1 << i)) == 0, i) for i in range(cap)), F.lit(cap))
    return out.select(group, first_gap.cast("long").alias("streak"))


def milestones(rows: DataFrame, group: str, order: Sequence[str], targets: Sequence[int]) -> DataFrame:
    """Rows that are a group's Nth for the targets."""
    ranked = rows.withColumn("milestone", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("milestone").isin(list(targets)))


def next_milestones(rows: DataFrame, group: str, targets: Sequence[int], k: int = 3) -> DataFrame:
    """The next ``k`` targets that a group hasn't reached."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("reached"))
    open_targets = F.filter(F.array(*map(F.lit, sorted(targets))), lambda t: t > F.col("reached"))
    return counts.withColumn("next_targets", F.slice(open_targets, 1, k))


def stagger(rows: DataFrame, key: str, window_seconds: int = 240, buckets: int = 64) -> DataFrame:
    """Delay of each row of a dispatch: floor(i / (n - 1) * window). Rows are numbered in range buckets of their
    key, and the rows of earlier buckets are added, so no window holds all rows. The buckets are written first: a second
    run of the partitioning would sample the keys anew and cut elsewhere."""
    parts = written(rows.repartitionByRange(buckets, key).withColumn("_p", F.spark_partition_id()), "stagger")
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    counts = counts.select("_p", F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_before"), F.sum("_n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    placed = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key))).join(F.broadcast(counts), "_p")
    delay = F.floor((F.col("_before") + F.col("_i") - 1) * window_seconds / F.greatest(F.lit(1), F.col("_all") - 1)).cast("long")
    return placed.withColumn("delay_s", delay).drop("_p", "_i", "_before", "_all")


def repaired_years(rows: DataFrame, group: str, ordinal: str, date: str) -> DataFrame:
    """Dates of an ordered list without years: when month and day go back, a year has passed. 29 February
    becomes the 28th where the year has none."""
    w = Window.partitionBy(group).orderBy(ordinal)
    day = F.date_format(date, "MM-dd")
    stepped = rows.withColumn("_md", day).withColumn("_back", F.coalesce(F.lag("_md").over(w) > F.col("_md"), F.lit(False)).cast("int"))
    return stepped.withColumn("repaired", F.add_months(date, (12 * F.sum("_back").over(w)).cast("int"))).drop("_md", "_back")
