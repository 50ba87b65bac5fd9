"""Lunar phases: instants of new and full moons, their local dates, and schedules on them.

A phase's instant is the mean one plus the periodic terms over about a hundredth of a day (published low-precision series for
phases), which is right to some minutes. The lunations of a window are a small table, built by a formula in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dates import shift_to_weekday

# Mean synodic month in days, and the Julian day of the new moon of 6 January 2000.
SYNODIC, EPOCH = 29.530588861, 2451550.09766
UNIX_EPOCH = 2440587.5
TERMS = {  # sine terms (days) by multiples of the sun's anomaly M, the moon's M' and its argument F, for new and for full moon
    "new": (((0, 1, 0), -0.40720), ((1, 0, 0), 0.17241), ((0, 2, 0), 0.01608), ((0, 0, 2), 0.01039), ((-1, 1, 0), 0.00739), ((1, 1, 0), -0.00514), ((2, 0, 0), 0.00208)),
    "full": (((0, 1, 0), -0.40614), ((1, 0, 0), 0.17302), ((0, 2, 0), 0.01614), ((0, 0, 2), 0.01043), ((-1, 1, 0), 0.00734), ((1, 1, 0), -0.00515), ((2, 0, 0), 0.00209)),
}


def phase_julian_day(lunation: Column, phase: str) -> Column:
    """Julian day of a lunation's new (k) or full (k + 0.5) moon."""
    k = lunation + (0.5 if phase == "full" else 0.0)
    t = k / 1236.85
    sun, moon, node = (F.radians(a + b * k + c * t * t) for a, b, c in ((2.5534, 29.10535670, -0.0000014), (201.5643, 385.81693528, 0.0107582), (160.7108, 390.67050284, -0.0016118)))
    day = F.lit(EPOCH) + SYNODIC * k + 0.00015437 * t * t
    for (a, b, c), size in TERMS[phase]:
        day = day + size * F.sin(a * sun + b * moon + c * node)
    return day


def phase_instant(lunation: Column, phase: str) -> Column:
    return F.timestamp_seconds(F.floor((phase_julian_day(lunation, phase) - UNIX_EPOCH) * 86400))


def phases(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """lunation, phase, instant of all new and full moons of some years."""
    lo, hi = int((first_year - 2000) * 12.3685) - 1, int((last_year + 1 - 2000) * 12.3685) + 2
    k = spark.range(lo, hi).withColumnRenamed("id", "lunation")
    rows = None
    for phase in ("new", "full"):
        one = k.select("lunation", F.lit(phase).alias("phase"), phase_instant(F.col("lunation"), phase).alias("instant"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.where(F.year("instant").between(first_year, last_year))


def lunar_dates(moons: DataFrame, phase: str, tz: Column, weekday: int | None = None) -> DataFrame:
    """Local dates of a phase, moved to the nearest given weekday (Sunday 0) if there is one."""
    day = F.to_date(F.from_utc_timestamp("instant", tz))
    return moons.where(F.col("phase") == phase).withColumn("date", day if weekday is None else shift_to_weekday(day, weekday))
