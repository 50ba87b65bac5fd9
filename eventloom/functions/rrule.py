"""Recurrence rules as column functions: a rule's text becomes an array of dates in a window.

Supported are WEEKLY (INTERVAL, BYDAY) and MONTHLY (BYDAY with an ordinal, BYMONTHDAY, INTERVAL), both
with BYMONTH. A list of days, BYSETPOS, a month out of 1 to 12 and any other frequency give null, so that callers see it. COUNT and UNTIL
don't end a rule: the window does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("SU", "MO", "TU", "WE", "TH", "FR", "SA")


def rule_part(rule: Column, name: str) -> Column:
    """A part's value, or null."""
    found = F.regexp_extract(F.upper(rule), rf"(?:^|;|:){name}=([^;]+)", 1)
    return F.when(found != "", found)


def rule_fields(rule: Column) -> dict[str, Column]:
    freq, by_day = rule_part(rule, "FREQ"), rule_part(rule, "BYDAY")
    by_day = F.coalesce(by_day, F.lit(""))
    nth = F.regexp_extract(by_day, r"^([+-]?\d+)[A-Z]{2}$", 1)
    month_day = rule_part(rule, "BYMONTHDAY").try_cast("int")
    interval = F.coalesce(rule_part(rule, "INTERVAL").try_cast("int"), F.lit(1))
    weekday = F.array_position(F.array(*map(F.lit, DAYS)), F.regexp_extract(by_day, r"^(?:[+-]?\d+)?([A-Z]{2})$", 1)).cast("int") - 1
    known = freq.isin("WEEKLY", "MONTHLY") & rule_part(rule, "BYSETPOS").isNull() & (interval >= 1)
    known = known & F.when(freq == "WEEKLY", F.coalesce(weekday >= 0, F.lit(False))).otherwise(F.coalesce(weekday >= 0, F.lit(False)) | F.coalesce(month_day.between(1, 31), F.lit(False)))
    months = F.transform(F.split(rule_part(rule, "BYMONTH"), ","), lambda m: F.trim(m).try_cast("int"))
    nth = F.when(nth != "", nth.try_cast("int"))
    wrong_day = (by_day != "") & ((weekday < 0) | F.coalesce(nth == 0, F.lit(False)))
    known = known & ~wrong_day & F.coalesce(F.forall(months, lambda m: F.coalesce(m.between(1, 12), F.lit(False))), F.lit(True))
    return {"freq": F.when(known, freq), "weekday": weekday, "nth": nth, "month_day": month_day, "interval": interval, "months": months}


def weekly_dates(start: Column, end: Column, weekday: Column, interval: Column, anchor: Column) -> Column:
    """Dates of a weekday every ``interval`` weeks; the anchor date's week is on, the start's if null."""
    first = F.date_add(start, F.pmod(weekday - (F.dayofweek(start) - 1), F.lit(7)).cast("int"))
    base = F.coalesce(anchor, first)
    base = F.date_add(base, F.pmod(weekday - (F.dayofweek(base) - 1), F.lit(7)).cast("int"))
    late = F.pmod(F.floor(F.datediff(first, base) / 7), interval)
    first = F.date_add(first, (F.pmod(interval - late, interval) * 7).cast("int"))
    n = F.floor(F.datediff(end, first) / (7 * interval))
    return F.when(first <= end, F.transform(F.sequence(F.lit(0), n.cast("int")), lambda k: F.date_add(first, (k * 7 * interval).cast("int")))).otherwise(F.array().cast("array<date>"))


def month_starts(start: Column, end: Column, interval: Column, anchor: Column) -> Column:
    """First days of the months in the window, every ``interval`` months counted from the anchor."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    base = F.trunc(F.coalesce(anchor, start), "month")
    return F.filter(months, lambda m: F.pmod(F.months_between(m, base).cast("int"), interval) == 0)


def nth_weekday(month: Column, weekday: Column, nth: Column) -> Column:
    """The nth weekday of a month, from its end if negative; null where the month has none."""
    first = F.date_add(month, F.pmod(weekday - (F.dayofweek(month) - 1), F.lit(7)).cast("int"))
    last_day = F.last_day(month)
    last = F.date_sub(last_day, F.pmod((F.dayofweek(last_day) - 1) - weekday, F.lit(7)).cast("int"))
    found = F.when(nth > 0, F.date_add(first, ((nth - 1) * 7).cast("int"))).otherwise(F.date_add(last, ((nth + 1) * 7).cast("int")))
    return F.when(F.trunc(found, "month") == month, found)


def occurrences(rule: Column, start: Column, end: Column, anchor: Column) -> Column:
    """All dates of a rule from ``start`` to ``end``, both included; null for an unsupported rule."""
    f = rule_fields(rule)
    months = month_starts(start, end, f["interval"], anchor)
    by_month_day = F.transform(months, lambda m: F.date_add(m, F.least(f["month_day"], F.day(F.last_day(m))) - 1))
    by_nth = F.filter(F.transform(months, lambda m: nth_weekday(m, f["weekday"], F.coalesce(f["nth"], F.lit(1)))), lambda d: d.isNotNull())
    monthly = F.filter(F.when(f["month_day"].isNotNull(), by_month_day).otherwise(by_nth), lambda d: d.between(start, end))
    dates = F.when(f["freq"] == "WEEKLY", weekly_dates(start, end, f["weekday"], f["interval"], anchor)).when(f["freq"] == "MONTHLY", monthly)
    return F.when(f["months"].isNull(), dates).otherwise(F.filter(dates, lambda d: F.array_contains(f["months"], F.month(d))))
