"""Reusable predicates and projections of event rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are given; true if there is none."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def displayable(status: str = "status", manual: str = "is_manual", canonical: str = "is_canonical", visible: str = "kennel_visible", parent: str | None = "parent_event_id") -> Column:
    """Rows that lists show. Null counts as not manual, and with ``parent`` children of a series are left out."""
    return all_of(F.col(status) != "CANCELLED", ~F.coalesce(F.col(manual), F.lit(False)), F.col(canonical), F.col(visible), F.col(parent).isNull() if parent else None)


def upcoming(date: Column, today: Column) -> Column:
    """From yesterday on, so that no time zone loses its day."""
    return date >= F.date_sub(today, 1)


def past(date: Column, today: Column) -> Column:
    return date < F.date_add(today, 1)


def time_bucket(date: Column, today: Column, bucket: str) -> Column:
    """upcoming, past, all, or a number of weeks ("4w": the next 28 days, the last included)."""
    if bucket == "all":
        return F.lit(True)
    if bucket == "past":
        return date < today
    if bucket == "upcoming":
        return date >= today
    return date.between(today, F.date_add(today, 7 * int(bucket.removesuffix("w"))))


def contains_any(query: str | None, *columns: str) -> Column | None:
    """Case-insensitive substring of any column; None without a query."""
    if not query or not query.strip():
        return None
    needle = query.strip().lower()
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in columns))


def in_box(lat: str, lng: str, box: tuple[float, float, float, float] | None) -> Column | None:
    return None if box is None else F.col(lat).between(box[0], box[1]) & F.col(lng).between(box[2], box[3])


def list_filter(df: DataFrame, today: Column, bucket: str = "upcoming", regions: list[str] | None = None, organisers: list[str] | None = None, weekdays: list[int] | None = None, query: str | None = None, box: tuple[float, float, float, float] | None = None, text_columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """The list page's filter: conditions are built for the arguments given alone."""
    return df.where(
        all_of(
            time_bucket(F.col("date"), today, bucket),
            F.col("region").isin(regions) if regions else None,
            F.col("kennel_id").isin(organisers) if organisers else None,
            (F.dayofweek("date") - 1).isin(weekdays) if weekdays else None,
            contains_any(query, *text_columns),
            in_box("latitude", "longitude", box),
        )
    )


def expand_regions(selections: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Metros of selections (kind, value) in a hierarchy (country, state, metro)."""
    keys = hierarchy.select("metro", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("country", "state", "metro")))).alias("k")).select("metro", "k.kind", "k.value")
    return keys.join(selections, ["kind", "value"], "left_semi").select("metro").distinct()


HOURS = {"hourly": 1, "every_6h": 6, "daily": 24, "weekly": 168}


def due_for_refresh(last: Column, frequency: Column, now: Column, slack_minutes: int = 10) -> Column:
    """Whether an interval has passed, less some slack; never run is due, an unknown frequency is daily."""
    hours = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in HOURS.items() for x in kv)), F.lower(frequency)), F.lit(24))
    return last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= hours * 3600 - slack_minutes * 60)


def silent_skips(df: DataFrame, rules: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows that a rule (source_id, pattern) drops. A row that looks genuine (flag
    ``genuine``) stays. Rules are configuration: a few for each source, joined by source."""
    hits = df.join(rules, "source_id").where(F.expr(f"{column} rlike pattern") & ~F.coalesce(F.col("genuine"), F.lit(False))).select(key).distinct()
    return df.join(hits, key, "left_anti"), df.join(hits, key, "left_semi")


def suppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings without those of a suppression (kennel_id, rule), whose null kennel_id covers all."""
    everywhere = suppressions.where("kennel_id is null").select("rule").distinct()
    own = suppressions.where("kennel_id is not null").select("kennel_id", "rule").distinct()
    return findings.join(everywhere, "rule", "left_anti").join(own, ["kennel_id", "rule"], "left_anti")


def keyset_page(df: DataFrame, order: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """A page in descending (order, key) after a cursor; the predicate reaches the scan."""
    if after is not None:
        o, k = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col(order) < o) | ((F.col(order) == o) & (F.col(key) < k)))
    return df.orderBy(F.desc(order), F.desc(key)).limit(size)


def without_children(page: DataFrame, key: str, parent: str) -> DataFrame:
    """A page's rows without children whose parent is on it."""
    parents = page.select(F.col(key).alias(parent)).distinct()
    return page.join(parents, parent, "left_anti")
