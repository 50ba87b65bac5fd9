"""Text-quality audit: a small rule language that compiles to columns, and the built-in rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import EMAIL_CALL, HARE_BOILERPLATE, HARE_CALLS, PHONE, TIME_ONLY, any_of, normal_address


def compiled(rule: dict) -> Column:
    """Column of a matcher tree: regex, starts_with, equals, length_eq, length_gt on a field, and and / or / not over
    others. A missing value matches nothing; its length is 0."""
    op = rule["op"]
    if op in ("and", "or"):
        parts = [compiled(r) for r in rule["of"]]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts, F.lit(op == "and"))
    if op == "not":
        return ~compiled(rule["of"])
    field = F.col(rule["field"])
    if op in ("length_eq", "length_gt"):
        n = F.coalesce(F.length(field), F.lit(0))
        return n == rule["value"] if op == "length_eq" else n > rule["value"]
    found = {"regex": lambda: field.rlike(("(?i)" if rule.get("ignore_case") else "") + rule["value"]), "starts_with": lambda: field.startswith(rule["value"]), "equals": lambda: field == rule["value"]}[op]()
    return F.coalesce(found, F.lit(False))


# Patterns and limits that the audit's results depend on.
TITLE_CALL = r"(?i)\b(?:wanna\s+hare|available\s+dates|check\s+out\s+our|sign\s*up)\b"
TITLE_SCHEDULES = (
    r"(?i)\b(?:runs?\s+on\s+the\s+(?:first|second|third|fourth|last))\b",
    r"(?i)\b(?:meets?\s+every|runs?\s+every)\b",
    r"(?i)\b(?:hashes?\s+on\s+the\s+(?:first|second|third|fourth|last))\b",
)
TITLE_ENTITIES = r"(?i)&(?:amp|lt|gt|quot|apos|#\d+|#x[\da-f]+);"
HARE_CALL = r"(?i)^(?:tbd|tba|tbc|n/a|sign[\s\u00A0]*up!?|volunteer|needed|required)$"
HARE_CALL_DAYS = 14
HARE_LENGTH = 200
LATE_HOUR, EARLY_HOUR = 23, 3
DROPPED_LENGTH = 20


def is_link(c: Column) -> Column:
    return c.startswith("https://") | c.startswith("http://")


def builtin_rules(today: Column) -> dict[str, list[tuple[str, Column]]]:
    """Ordered rules of each field; a row gets at most the first that holds. Columns: title, kennel_code,
    kennel_short_name, hares, location, start_time, date, description, raw_description."""
    title, hares, place, code = F.col("title"), F.col("hares"), F.col("location"), F.lower("kennel_code")
    raw_code = F.lower(title).startswith(code) & F.substr(title, F.length(code) + 1).rlike(r"(?i)^\s+trail") & ~title.startswith(F.col("kennel_short_name"))
    parts = F.split(place, ", ")
    a, b = normal_address(F.get(parts, F.lit(0))), normal_address(F.get(parts, F.lit(1)))
    hour = F.regexp_extract(F.split_part("start_time", F.lit(":"), F.lit(1)), r"^\s*(\d+)", 1).try_cast("int")
    schedule = reduce(lambda x, y: x | y, (title.rlike(p) for p in TITLE_SCHEDULES))
    return {
        "title": [("title-raw-kennel-code", raw_code), ("title-cta-text", title.rlike(TITLE_CALL) | any_of(title, HARE_CALLS)), ("title-schedule-description", schedule), ("title-html-entities", title.rlike(TITLE_ENTITIES)), ("title-time-only", title.rlike(TIME_ONLY))],
        "hares": [("hare-single-char", F.length(hares) == 1), ("hare-cta-text", (hares.rlike(HARE_CALL) | any_of(hares, HARE_CALLS)) & (F.datediff("date", today) <= HARE_CALL_DAYS)), ("hare-url", is_link(hares)), ("hare-description-leak", F.length(hares) > HARE_LENGTH), ("hare-phone-number", hares.rlike(PHONE)), ("hare-boilerplate-leak", hares.rlike(HARE_BOILERPLATE))],
        "location": [("location-url", is_link(place)), ("location-duplicate-segments", (F.size(parts) >= 3) & (a.contains(b) | b.contains(a))), ("location-phone-number", place.rlike(PHONE)), ("location-email-cta", place.rlike(EMAIL_CALL))],
        "event": [("event-improbable-time", (hour >= LATE_HOUR) | (hour <= EARLY_HOUR))],
        "description": [("description-dropped", F.col("description").isNull() & (F.length("raw_description") > DROPPED_LENGTH))],
    }


def audit(rows: DataFrame, rules: dict[str, list[tuple[str, Column]]], keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """A row for each field's first rule that holds: keys, field, rule."""
    first = {}
    for field, ordered in rules.items():
        found = F.lit(None).cast("string")
        for name, hit in reversed(ordered):
            found = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(found)
        first[field] = found
    findings = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), r.alias("rule")) for f, r in first.items())), lambda x: x["rule"].isNotNull())
    return rows.select(*keep, F.inline(findings))
