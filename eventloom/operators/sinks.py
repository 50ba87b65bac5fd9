"""Output forms: calendar texts and links, structured data, audit rows, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import minutes_of

HOURS = 3  # length of an event without an end


def fnv1a(text: Column) -> Column:
    """FNV-1a of a text's code units in eight hex digits. Products stay below 2**63, as the hash has 32 bits and the prime 25."""
    units = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(0x01000193), F.lit(1 << 32))
    return F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(0x811C9DC5).cast("long"), step))), 8, "0")


def ics_escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def calendar_times(date: Column, start: Column) -> dict[str, Column]:
    """Stamps of an event: all day without a time, else ``HOURS`` long; an end past midnight is on the next day."""
    m = minutes_of(start)
    stamp = lambda total: F.concat(F.date_format(F.date_add(date, F.floor(total / 1440).cast("int")), "yyyyMMdd"), F.lit("T"), F.format_string("%02d%02d00", F.floor(F.pmod(total, F.lit(1440)) / 60).cast("int"), F.pmod(total, F.lit(60)).cast("int")))
    ymd = F.date_format(date, "yyyyMMdd")
    return {"day": ymd, "start": F.when(m.isNull(), ymd).otherwise(stamp(m)), "end": F.when(m.isNull(), F.date_format(F.date_add(date, 1), "yyyyMMdd")).otherwise(stamp(m + HOURS * 60)), "all_day": m.isNull()}


def vevent(rows: DataFrame, stamp: str, domain: str) -> Column:
    """A calendar block of each row (title, date, start_time, location, description, tz, kennel, run_number), lines ended as the format asks."""
    c, t = F.col, calendar_times(F.col("date"), F.col("start_time"))
    seed = F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), F.coalesce("start_time", F.lit("allday")), F.coalesce("title", F.lit("")), F.coalesce("location", F.lit("")), c("kennel"), F.coalesce(c("run_number").cast("string"), F.lit("")))
    zone = F.when(c("tz").isNotNull(), F.concat(F.lit(";TZID="), "tz")).otherwise("")
    when = lambda name, value: F.concat(F.lit(name), F.when(t["all_day"], ";VALUE=DATE").otherwise(zone), F.lit(":"), value)
    optional = lambda name, col: F.when(F.coalesce(c(col), F.lit("")) != "", F.concat(F.lit(f"{name}:"), ics_escaped(c(col))))
    return F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.lit(f"DTSTAMP:{stamp}"), F.concat(F.lit("UID:"), t["day"], F.lit("-"), fnv1a(seed), F.lit(f"@{domain}")), F.concat(F.lit("SUMMARY:"), ics_escaped(c("title"))), when("DTSTART", t["start"]), when("DTEND", t["end"]), optional("LOCATION", "location"), optional("DESCRIPTION", "description"), F.lit("END:VEVENT"))


def calendar_file(block: Column, name: str) -> Column:
    """A calendar of one block; :func:`calendar_of_group` is that of many."""
    return F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:-//{name}//EN"), block, F.lit("END:VCALENDAR"))


def calendar_of_group(rows: DataFrame, group: str, key: str, block: str, name: str, at_most: int = 500) -> DataFrame:
    """One calendar text of each group, events in order of their keys; a calendar holds ``at_most`` events, further ones fill further parts."""
    from pyspark.sql import Window

    part = F.floor((F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1) / at_most)
    blocks = rows.withColumn("part", part).groupBy(group, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, block))), lambda x: x[block]), "\r\n").alias("b"))
    return blocks.select(group, "part", calendar_file(F.col("b"), name).alias("text"))


def calendar_link(title: Column, date: Column, start: Column, details: Column, place: Column, tz: Column) -> Column:
    """Address that opens a new calendar entry with an event's fields."""
    t = calendar_times(date, start)
    part = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"&{name}="), F.url_encode(value))).otherwise("")
    zone = F.when(~t["all_day"], tz)
    return F.concat(F.lit("https://calendar.google.com/calendar/render?action=TEMPLATE"), part("text", title), part("details", F.coalesce(details, F.lit(""))), part("dates", F.concat(t["start"], F.lit("/"), t["end"])), part("ctz", zone), part("location", place))


def event_json_ld() -> Column:
    """Structured data of an event row; absent fields are left out."""
    place = F.when(F.col("location").isNotNull(), F.struct(F.lit("Place").alias("@type"), F.col("location").alias("name")))
    start = F.concat(F.date_format("date", "yyyy-MM-dd"), F.when(F.col("start_time").isNotNull(), F.concat(F.lit("T"), "start_time", F.lit(":00"))).otherwise(""))
    status = F.when(F.col("status") == "CANCELLED", "https://schema.org/EventCancelled").otherwise("https://schema.org/EventScheduled")
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("SportsEvent").alias("@type"), F.col("title").alias("name"), start.alias("startDate"), status.alias("eventStatus"), place.alias("location")))


def item_list_json_ld(rows: DataFrame, group: str, name: str, at_most: int = 100) -> DataFrame:
    """Structured list of each group's names in order, the first ``at_most``."""
    from pyspark.sql import Window

    own = rows.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(name))).where(F.col("_at") <= at_most)
    items = F.array_sort(F.collect_list(F.struct(F.col("_at").alias("position"), F.col(name).alias("name"))))
    return own.groupBy(group).agg(F.to_json(F.struct(F.lit("ItemList").alias("@type"), items.alias("itemListElement"))).alias("json"))


def audit_log(findings: DataFrame, log: str, size: int = 1000) -> DataFrame:
    """A run's findings in all, counts by category as a map, and all its findings by event: one row, and further parts beyond ``size`` findings."""
    from pyspark.sql import Window

    counts = findings.groupBy(log, "category").agg(F.count(F.lit(1)).alias("n")).groupBy(log).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    own = findings.withColumn("_at", F.row_number().over(Window.partitionBy(log).orderBy("event_id", "rule"))).withColumn("part", F.floor((F.col("_at") - 1) / size))
    nested = own.groupBy(log, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "event_id", "rule"))), lambda x: F.struct(x["event_id"].alias("event_id"), x["rule"].alias("rule"))).alias("findings"))
    return counts.join(nested, log)
