"""Date, time and rounding column functions. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Rounding with halves towards positive infinity (``round`` takes them away from zero)."""
    return F.floor(x + 0.5)


def weekday_sunday0(d: Column) -> Column:
    return F.dayofweek(d) - 1


def week_start(d: Column) -> Column:
    """Monday of the week."""
    return F.trunc(d, "week")


def minutes_of(hhmm: Column) -> Column:
    """Minutes since midnight of "HH:MM"; null for anything else."""
    ok = hhmm.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")
    return F.when(ok, F.split_part(hhmm, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(hhmm, F.lit(":"), F.lit(2)).cast("int"))


def time_gap_minutes(a: Column, b: Column) -> Column:
    return F.abs(minutes_of(a) - minutes_of(b))


def implausible_end(start: Column, end: Column, max_hours: int = 12) -> Column:
    """An end before the start that, taken as past midnight, comes more than ``max_hours`` after it."""
    s, e = minutes_of(start), minutes_of(end)
    return F.coalesce((e < s) & (e + 24 * 60 - s > max_hours * 60), F.lit(False))


def start_utc(d: Column, hhmm: Column, tz: Column) -> Column:
    """Instant of a local date and time in a time zone; null without a time."""
    local = F.try_to_timestamp(F.concat_ws(" ", F.date_format(d, "yyyy-MM-dd"), F.lpad(hhmm, 5, "0")), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(minutes_of(hhmm).isNotNull(), F.to_utc_timestamp(local, tz))


def parse_12_hour(text: Column) -> Column:
    """The first "7:30 pm" of a text as "HH:MM"; minutes over 59 run on; null if there is none."""
    part = lambda k: F.regexp_extract(text, r"(?i)(\d{1,2}):(\d{2,3})\s*(am|pm)", k)
    hour, minute, half = part(1).try_cast("int"), part(2).try_cast("int"), F.lower(part(3))
    h24 = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    return F.when(half != "", F.format_string("%02d:%02d", F.pmod(h24 + F.floor(minute / 60).cast("int"), F.lit(24)), F.pmod(minute, F.lit(60))))


DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date that the first fitting format gives, a weekday before it and endings of ordinals left out; null for
    none (invalid days don't roll over)."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^(?:sun|mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?)(?:day)?,?\s+", "")
    cleaned = F.regexp_replace(bare, r"(?<=\d)(st|nd|rd|th)\b", "")
    return F.coalesce(*(F.try_to_timestamp(cleaned, F.lit(f)) for f in formats)).cast("date")


def shift_to_weekday(d: Column, weekday: Column | int) -> Column:
    """The nearest day of a weekday (Sunday 0), at most three days either way."""
    w = weekday if isinstance(weekday, Column) else F.lit(weekday)
    forward = F.pmod(w - weekday_sunday0(d), F.lit(7))
    return F.date_add(d, F.when(forward > 3, forward - 7).otherwise(forward))


def within_season(d: Column, start: Column, end: Column) -> Column:
    """Whether a date's MM-DD lies in a season given as MM-DD strings, both ends included; a season
    whose start is after its end runs over the new year; without both ends it is always on."""
    day = F.date_format(d, "MM-dd")
    inside = F.when(start <= end, day.between(start, end)).otherwise((day >= start) | (day <= end))
    return F.when(start.isNull() | end.isNull(), True).otherwise(inside)


def activity_status(last: Column, today: Column, upcoming: Column | None = None) -> Column:
    """By the days since the last event; an upcoming one makes active."""
    days = F.datediff(today, last)
    found = F.when(last.isNull(), "unknown").when(days < 90, "active").when(days < 365, "possibly-inactive").otherwise("inactive")
    return found if upcoming is None else F.when(F.coalesce(upcoming, F.lit(False)), "active").otherwise(found)


def format_time_12(hhmm: Column) -> Column:
    m = minutes_of(hhmm)
    hour = F.floor(m / 60)
    return F.when(m.isNotNull(), F.format_string("%d:%02d %s", F.when(F.pmod(hour, F.lit(12)) == 0, 12).otherwise(F.pmod(hour, F.lit(12))).cast("int"), F.pmod(m, F.lit(60)).cast("int"), F.when(hour < 12, "AM").otherwise("PM")))


def ordinal(n: Column) -> Column:
    teen = F.pmod(n, F.lit(100)).between(11, 13)
    last = F.pmod(n, F.lit(10))
    suffix = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def format_date_range(start: Column, end: Column) -> Column:
    """"Mar 3", or from first to last day with what differs between them."""
    one = F.date_format(start, "MMM d")
    year, month = F.year(start) != F.year(end), F.month(start) != F.month(end)
    dash = F.lit(" \u2013 ")
    spans = F.when(year, F.concat(F.date_format(start, "MMM d, yyyy"), dash, F.date_format(end, "MMM d, yyyy"))).when(month, F.concat(one, dash, F.date_format(end, "MMM d"))).otherwise(F.concat(one, dash, F.day(end).cast("string")))
    return F.when(end > start, spans).otherwise(one)


def format_distance(meters: Column) -> Column:
    return F.format_string("%.1f mi", meters / 1609.344)


def format_duration(seconds: Column) -> Column:
    h, m = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h "))).otherwise(""), m.cast("string"), F.lit("m"))


def format_drive(km: Column) -> Column:
    """Driving time at 80 km/h, in steps of five minutes, at least one."""
    total = F.greatest(F.lit(5), round_half_up(km / 80 * 60 / 5) * 5).cast("long")
    h, m = F.floor(total / 60), F.pmod(total, F.lit(60))
    return F.when(total < 60, F.concat(F.lit("~"), total.cast("string"), F.lit(" min drive"))).when(m == 0, F.concat(F.lit("~"), h.cast("string"), F.lit("h drive"))).otherwise(F.concat(F.lit("~"), h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m drive")))


def shifted_weekday(d: Column, time: Column, start: int, to: int, placeholder: str | None = None, default: str | None = None) -> dict[str, Column]:
    """Date and time of a row that a source puts on weekday ``start`` (Sunday 0) for one on ``to``, by the shortest way; with a
    placeholder time only rows of that time move, and get the default one."""
    delta = (to - start + 3) % 7 - 3
    move = (weekday_sunday0(d) == start) & F.lit(delta != 0)
    if placeholder is not None:
        move = move & time.eqNullSafe(F.lit(placeholder))
    return {"date": F.when(move, F.date_add(d, delta)).otherwise(d), "start_time": F.when(move & F.lit(default is not None), F.lit(default)).otherwise(time)}


def local_day(instant: Column, tz: Column) -> Column:
    """Calendar day of an instant in a time zone."""
    return F.to_date(F.from_utc_timestamp(instant, tz))


def tz_abbreviation(instant: Column, tz: Column) -> Column:
    """Offset of a time zone at an instant as "UTC+2" or "UTC-3:30"."""
    minutes = (F.unix_timestamp(F.from_utc_timestamp(instant, tz)) - F.unix_timestamp(instant)) / 60
    h, m = F.floor(F.abs(minutes) / 60).cast("string"), F.pmod(F.abs(minutes), F.lit(60)).cast("int")
    return F.concat(F.lit("UTC"), F.when(minutes >= 0, "+").otherwise("-"), h, F.when(m > 0, F.format_string(":%02d", m)).otherwise(""))


REFERENCE_INSTANT = "2026-01-15 12:00:00"  # fixed, so that a pair of zones always compares alike


def offset_minutes(tz: Column) -> Column:
    """Minutes that a time zone is ahead of UTC at the reference instant."""
    at = F.lit(REFERENCE_INSTANT).cast("timestamp")
    return ((F.unix_timestamp(F.from_utc_timestamp(at, tz)) - F.unix_timestamp(at)) / 60).cast("int")


def zoned_gap_minutes(a: Column, tz_a: Column, b: Column, tz_b: Column) -> Column:
    """Minutes between two local times of day, taken to UTC first where both zones are known and differ."""
    x, y = minutes_of(a), minutes_of(b)
    day = F.lit(24 * 60)
    utc = F.abs(F.pmod(x - offset_minutes(tz_a), day) - F.pmod(y - offset_minutes(tz_b), day))
    return F.when(F.coalesce(tz_a != tz_b, F.lit(False)), utc).otherwise(F.abs(x - y))
