"""Dates in words, resolved against a reference day: a grammar of a few phrases, each a pattern and what its parts mean.

Known are ISO dates, "5 May 26", "Saturday 21st of February 2026", "May 5th", "21/02/2026", "3-7" in front of a text, "today", "tomorrow", "in two
weeks", "three days ago", "next month", "Saturday", "this", "next" and "last" Saturday. The phrase that comes first in a text counts;
one that names no day of the calendar gives null, and so does a text without any.

A day without a year is the one nearest to the reference day, or with ``forward`` the first that isn't before it; a weekday likewise.
"Next Saturday" is that of the week (from Monday) after the reference day's. Years of two digits run from 1950 to 2049.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import bound
from .dates import week_start, weekday_sunday0

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
COUNTS = ("a", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t(?:ember)?|ember|ober)?\b\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_WEEKDAY = r"(sun|mon|tue|wed|thu|fri|sat)(?:day|s|sday|nesday|r|rs|rsday|urday)?"
_COUNT = r"(\d{1,3}|an?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
_UNIT = r"(day|week|month|year)s?"

ISO = r"\b(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)"
DAY_MONTH = rf"\b{_DAY}(?:\s+of)?[\s-]+{_MONTH}(?:,?[\s-]+(\d{{4}}|'?\d{{2}})(?![\d:]))?"
MONTH_DAY = rf"\b{_MONTH}\s+{_DAY}\b(?![:/])(?:,?\s+(\d{{4}})\b)?"
NUMBERS = r"\b(\d{1,2})(?:/(\d{1,2})(?:/(\d{4}|\d{2}))?|-(\d{1,2})-(\d{4}|\d{2})|\.(\d{1,2})\.(\d{4}))(?![\d/])"
LEADING = r"^(\d{1,2})-(\d{1,2})(?![\d-])"
WORD = r"\b(today|tonight|tomorrow|yesterday)\b"
AHEAD = rf"\bin\s+{_COUNT}\s+{_UNIT}\b"
AWAY = rf"\b{_COUNT}\s+{_UNIT}\s+(ago|from\s+now|later)\b"
STEP = r"\b(next|last)\s+(week|month|year)\b"
WEEKDAY = rf"\b(?:(this|next|last)\s+)?{_WEEKDAY}\b(?!,?\s+(?:the\s+)?(?:\d|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)))"


def _day(year: Column, month: Column, day: Column) -> Column:
    """A day of the calendar, or null."""
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")))


def _year(text: Column) -> Column:
    """A year of two or four digits; null for none."""
    n = F.regexp_replace(text, "'", "").try_cast("int")
    return F.when(F.length(F.regexp_replace(text, "'", "")) == 2, n + F.when(n < 50, 2000).otherwise(1900)).otherwise(n)


def _dated(year: Column, month: Column, day: Column, reference: Column, forward: Column) -> Column:
    """A day whose year may be null."""

    def guessed(years: Column) -> Column:
        days = F.filter(F.transform(years, lambda y: _day(y, month, day)), lambda d: d.isNotNull())
        near = F.array_min(F.transform(days, lambda d: F.struct(F.abs(F.datediff(d, reference)).alias("far"), d.alias("d"))))["d"]
        return F.when(forward, F.array_min(F.filter(days, lambda d: d >= reference))).otherwise(near)

    now = F.year(reference)
    around = F.array(*(now + i for i in range(-1, 9)))  # 29 February may be eight years off
    near_years = F.when((month == 2) & (day == 29), around).otherwise(F.slice(around, 1, 3))
    return F.when(year.isNotNull(), _day(year, month, day)).otherwise(bound(near_years, guessed))


def _moved(reference: Column, n: Column, unit: Column) -> Column:
    return F.when(unit == "day", F.date_add(reference, n)).when(unit == "week", F.date_add(reference, n * 7)).when(unit == "month", F.add_months(reference, n)).otherwise(F.add_months(reference, n * 12))


def spoken_date(text: Column, reference: Column, day_first: Column | bool = False, forward: Column | bool = False) -> Column:
    """The date that a text speaks of, null if of none. ``day_first`` reads 3/4 as 3 April."""
    day_first, forward = (F.lit(x) if isinstance(x, bool) else x for x in (day_first, forward))

    def read(t: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(t, pattern, i)
        number = lambda pattern, i: part(pattern, i).try_cast("int")
        month = lambda pattern, i: F.array_position(F.array(*map(F.lit, MONTHS)), part(pattern, i)).cast("int")
        count = lambda c: F.coalesce(c.try_cast("int"), F.greatest(F.lit(1), F.array_position(F.array(*map(F.lit, COUNTS)), c).cast("int") - 1))

        def numbers(a: Column, b: Column, year: Column) -> Column:
            # what can't be a month is the day
            first_is_day = (day_first | (a > 12)) & ~(b > 12)
            return _dated(year, F.when(first_is_day, b).otherwise(a), F.when(first_is_day, a).otherwise(b), reference, forward)

        def weekday(how: Column, day: Column) -> Column:
            ahead = F.pmod(day - weekday_sunday0(reference), F.lit(7)).cast("int")
            behind = F.pmod(weekday_sunday0(reference) - day, F.lit(7)).cast("int")
            following = F.date_add(week_start(reference), (7 + F.pmod(day - 1, F.lit(7))).cast("int"))
            near = F.when(forward | (ahead <= 3), F.date_add(reference, ahead)).otherwise(F.date_sub(reference, behind))
            return F.when(how == "next", following).when(how == "last", F.date_sub(reference, F.when(behind == 0, 7).otherwise(behind))).when(how == "this", F.date_add(reference, ahead)).otherwise(near)

        second, year = F.coalesce(number(NUMBERS, 2), number(NUMBERS, 4), number(NUMBERS, 6)), F.concat(part(NUMBERS, 3), part(NUMBERS, 5), part(NUMBERS, 7))
        word = part(WORD, 1)
        rules = [
            (ISO, _day(number(ISO, 1), number(ISO, 2), number(ISO, 3))),
            (DAY_MONTH, _dated(_year(part(DAY_MONTH, 3)), month(DAY_MONTH, 2), number(DAY_MONTH, 1), reference, forward)),
            (MONTH_DAY, _dated(_year(part(MONTH_DAY, 3)), month(MONTH_DAY, 1), number(MONTH_DAY, 2), reference, forward)),
            (NUMBERS, numbers(number(NUMBERS, 1), second, _year(year))),
            (LEADING, numbers(number(LEADING, 1), number(LEADING, 2), F.lit(None).cast("int"))),
            (WORD, F.date_add(reference, F.when(word == "tomorrow", 1).when(word == "yesterday", -1).otherwise(0))),
            (AHEAD, _moved(reference, count(part(AHEAD, 1)), part(AHEAD, 2))),
            (AWAY, _moved(reference, F.when(part(AWAY, 3) == "ago", -1).otherwise(1) * count(part(AWAY, 1)), part(AWAY, 2))),
            (STEP, _moved(reference, F.when(part(STEP, 1) == "last", -1).otherwise(1), part(STEP, 2))),
            (WEEKDAY, weekday(part(WEEKDAY, 1), F.array_position(F.array(*map(F.lit, DAYS)), part(WEEKDAY, 2)).cast("int") - 1)),
        ]
        places = F.array(*(F.struct(F.regexp_instr(t, F.lit(pattern)).alias("at"), F.lit(i).alias("rule")) for i, (pattern, _) in enumerate(rules)))
        first = F.array_min(F.filter(places, lambda p: p["at"] > 0))["rule"]

        def resolved(rule: Column) -> Column:
            out = F.lit(None).cast("date")
            for i, (_, day) in reversed(list(enumerate(rules))):
                out = F.when(rule == i, day).otherwise(out)
            return out

        return bound(first, resolved)

    return bound(F.lower(F.trim(text)), read)
