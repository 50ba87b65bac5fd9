"""Lookups in small dimensions, embedded blocks, schedules in words, and inserts that adopt orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import format_time_12
from .windows import pick_best

# The marks and version of an embedded block, and what an unknown region falls back to.
BLOCK_START, BLOCK_END, BLOCK_VERSION = "<!-- audit-canonical:", "-->", 1
DEFAULT_TIMEZONE, DEFAULT_COUNTRY = "America/New_York", "United States"


def located_regions(rows: DataFrame, region: str, regions: DataFrame) -> DataFrame:
    """Rows with the time zone, state group and country of a region's name. ``regions``: name, state_group (or null), country (or null), timezone, place (its order). An
    unknown name takes the time zone of the first region that holds it or that it holds, else the default; it is its own
    state group, in the default country. Names are looked up once each, so only unknown ones are compared with the dimension."""
    low = lambda c: F.lower(F.trim(c))
    names = rows.select(F.col(region).alias("_n")).distinct()
    known = names.join(regions.select(low(F.col("name")).alias("_k"), "state_group", "country", "timezone"), low(F.col("_n")) == F.col("_k"), "left").drop("_k")
    table = regions.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", low(F.col("name")).alias("k"), F.col("timezone").alias("z")))), lambda x: F.struct(x["k"].alias("k"), x["z"].alias("z"))).alias("_t"))  # the dimension, one row
    near = lambda n: F.get(F.filter("_t", lambda x: x["k"].contains(n) | n.contains(x["k"])), F.lit(0))["z"]
    told = known.join(F.broadcast(table)).withColumn("timezone", F.coalesce("timezone", near(low(F.col("_n"))), F.lit(DEFAULT_TIMEZONE))).drop("_t")
    told = told.withColumns({"state_group": F.coalesce("state_group", "_n"), "country": F.coalesce("country", F.lit(DEFAULT_COUNTRY))})
    return rows.join(told, F.col(region).eqNullSafe(F.col("_n")), "left").drop("_n")


def emitted_block(payload: Column) -> Column:
    """A struct as a comment block that texts carry; what would end the comment is escaped."""
    json = F.to_json(F.struct(F.lit(BLOCK_VERSION).alias("v"), payload.alias("data")))
    return F.concat(F.lit(f"{BLOCK_START} "), F.replace(json, F.lit("-->"), F.lit("--&gt;")), F.lit(f" {BLOCK_END}"))


def parsed_block(body: Column, field: str) -> Column:
    """A field of the first block of a text; null without a whole block of a known version."""
    rest = F.when(body.contains(BLOCK_START), F.regexp_replace(body, rf"(?s)^.*?{BLOCK_START}", ""))
    json = F.when(rest.contains(BLOCK_END), F.trim(F.replace(F.split_part(rest, F.lit(BLOCK_END), F.lit(1)), F.lit("--&gt;"), F.lit("-->"))))
    return F.when(F.get_json_object(json, "$.v") == str(BLOCK_VERSION), F.get_json_object(json, f"$.data.{field}"))


def toggled(items: Column, value: Column) -> Column:
    return F.when(F.array_contains(items, value), F.filter(items, lambda x: x != value)).otherwise(F.array_append(items, value))


def listed(text: Column) -> Column:
    """Items of a list with bars, else commas, else one item; empty for none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parts = F.when(t.contains("|"), F.split(t, r"\|")).when(t.contains(","), F.split(t, ",")).otherwise(F.array(t))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def schedule_text(day: Column, time: Column, frequency: Column) -> Column:
    """"Saturdays at 2:00 PM · Weekly" from what is known of it; null for nothing."""
    first = F.concat(F.concat(day, F.lit("s")), F.coalesce(F.concat(F.lit(" at "), format_time_12(time)), F.lit("")))
    text = F.concat_ws(" · ", F.coalesce(first, format_time_12(time)), frequency)
    return F.when(text != "", text)


def known_timezone(name: Column, zones: Sequence[str]) -> Column:
    """Whether a name is UTC or an area's zone that exists."""
    return F.coalesce((name == "UTC") | (name.contains("/") & name.isin(list(zones))), F.lit(False))


def insert_or_adopt(incoming: DataFrame, table: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Outcome of each incoming row against the stored ones (key, raw_id, event_id): ``created`` for the first of a new key, ``duplicate`` with the stored row that
    won for the others, and ``adopted`` where the stored row never got an event. A later row of a new key loses to the first one."""
    stored = table.select(*key, F.col("raw_id").alias("winner"), F.col("event_id").isNull().alias("orphan"))
    first = pick_best(incoming, list(key), list(order)).select(*key, F.col("raw_id").alias("first_id"))
    told = incoming.join(stored, list(key), "left").join(first, list(key))
    outcome = F.when(F.col("winner").isNotNull(), F.when(F.col("orphan") & (F.col("raw_id") == F.col("first_id")), "adopted").otherwise("duplicate")).when(F.col("raw_id") == F.col("first_id"), "created").otherwise("duplicate")
    return told.select("raw_id", outcome.alias("outcome"), F.coalesce("winner", "first_id").alias("row_id"))
