"""Merging of ingested rows: insert-if-absent, field rules, reconciliation, change logs, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import pick_best


def insert_if_absent(incoming: DataFrame, table: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Incoming rows to append: the first of each key that the table doesn't have."""
    return pick_best(incoming, key, order).join(table, list(key), "left_anti")


def upsert(incoming: DataFrame, table: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The table with the incoming rows added, the first in ``order`` of each key; rows of known keys stay as they are."""
    return table.unionByName(pick_best(incoming, key, order).join(table, list(key), "left_anti"), allowMissingColumns=True)


def with_bridge(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (event_id, kennel_id, cohosts: array) and their bridge rows (event_id, kennel_id, is_primary), the primary one first and once."""
    others = F.filter(F.array_distinct(F.coalesce("cohosts", F.array().cast(events.schema["cohosts"].dataType))), lambda k: k != F.col("kennel_id"))
    row = lambda k, p: F.struct(k.alias("kennel_id"), F.lit(p).alias("is_primary"))
    bridge = events.select("event_id", F.inline(F.concat(F.array(row(F.col("kennel_id"), True)), F.transform(others, lambda k: row(k, False)))))
    return events.drop("cohosts"), bridge


def update_from(table: DataFrame, changes: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The table with the columns' new values where a change row has them."""
    new = changes.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    return table.join(new, list(key), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def update_if_newer(table: DataFrame, changes: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    new = changes.groupBy(*key).agg(F.max(column).alias("_new"))
    return table.join(new, list(key), "left").withColumn(column, F.greatest(column, "_new")).drop("_new")


def merged_field(name: str, incoming_trust: Column, existing_trust: Column, cleared: Column) -> Column:
    """Value of a field after a merge of ``in_<name>`` to ``<name>``: a source of equal or more trust overwrites, and clears
    what it clears on purpose; one of less trust fills what is empty."""
    new, old = F.col(f"in_{name}"), F.col(name)
    strong = F.when(F.array_contains(cleared, name), F.lit(None)).when(new.isNotNull(), new).otherwise(old)
    return F.when(incoming_trust >= existing_trust, strong).otherwise(F.coalesce(old, new))


def field_changes(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Array of (field, old, new) for the fields that differ, nulls being equal."""
    rows = [F.struct(F.lit(n).alias("field"), old[n].cast("string").alias("old"), new[n].cast("string").alias("new"), (~old[n].eqNullSafe(new[n])).alias("differs")) for n in new]
    return F.transform(F.filter(F.array(*rows), lambda r: r["differs"]), lambda r: F.struct(r["field"].alias("field"), r["old"].alias("old"), r["new"].alias("new")))


def stale_events(events: DataFrame, links: DataFrame, matched: DataFrame, source_id: Column, start: Column, end: Column) -> DataFrame:
    """Confirmed events of a source within its window that the last run didn't match and that no other source backs."""
    mine = links.where(F.col("source_id") == source_id).select("event_id").distinct()
    backed = links.where(F.col("source_id") != source_id).select("event_id").distinct()
    linked = events.where(F.col("date").between(start, end) & (F.col("status") == "CONFIRMED")).join(mine, "event_id", "left_semi")
    return linked.join(matched.select("event_id").distinct(), "event_id", "left_anti").join(backed, "event_id", "left_anti")


def restored(status: Column, seen_again: Column, locked: Column) -> Column:
    """A cancelled event that a source shows again is confirmed, unless an admin locked it."""
    return F.when((status == "CANCELLED") & seen_again & ~F.coalesce(locked, F.lit(False)), "CONFIRMED").otherwise(status)


def repointed(rows: DataFrame, mapping: DataFrame, key: str, slot: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Rows whose key moves to the entity it was merged to; rows that then meet in a slot are one, with
    their flags or-ed."""
    moved = rows.join(mapping.select(F.col("old_id").alias(key), "new_id"), key, "left").withColumn(key, F.coalesce("new_id", key)).drop("new_id")
    return moved.groupBy(*slot).agg(*(F.bool_or(f).alias(f) for f in flags), F.count(F.lit(1)).alias("merged_rows"))


def mirror_diff(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Transitions between two snapshots (key, state, stream)."""
    a, b = remote.select(key, F.col("state").alias("r_state"), F.col("stream").alias("to_stream")), local.select(key, F.col("state").alias("l_state"), F.col("stream").alias("from_stream"))
    kind = (
        F.when(F.col("l_state").isNull() & (F.col("r_state") == "open"), "OPENED")
        .when((F.col("l_state") == "open") & (F.col("r_state") == "closed"), "CLOSED")
        .when((F.col("l_state") == "closed") & (F.col("r_state") == "open"), "REOPENED")
        .when(F.col("l_state").isNotNull() & F.col("r_state").isNotNull() & ~F.col("to_stream").eqNullSafe(F.col("from_stream")), "RELABELED")
    )
    return a.join(b, key, "full").withColumn("kind", kind).where("kind is not null").select(key, "kind", "from_stream", "to_stream")


def credit_sync(expected: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows to add and to delete so that ``existing`` becomes ``expected``."""
    a, b = expected.select(*key, F.lit(1).alias("_want")).distinct(), existing.select(*key, F.lit(1).alias("_have")).distinct()
    return a.join(b, list(key), "full").where(F.col("_want").isNull() | F.col("_have").isNull()).select(*key, F.when(F.col("_want").isNull(), "delete").otherwise("add").alias("action"))
