"""Readers of landed feeds. A source's pages are text in a table or in files; each reader turns a text column into rows
of events and sends what it can't read to ``errors`` instead of failing the run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selectors import page_rows

EVENT = "uid string, title string, date string, start_time string, location string, url string, description string"
FIELDS = [f.split()[0] for f in EVENT.split(", ")]


def parsed(documents: DataFrame, key: str, text: str, parse: Callable[[str], list[dict]]) -> tuple[DataFrame, DataFrame]:
    """Events and errors (key, error) of a text column, a few texts at a time. Each of the two runs the parser for itself; :mod:`~.adapter` gives both, and more, of one parse."""
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, errors = [], {f: [] for f in FIELDS}, []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found, error = parse(t or ""), None
                except (ValueError, KeyError, IndexError) as e:
                    found, error = [{}], str(e) or type(e).__name__
                for r in found:
                    keys.append(k)
                    errors.append(error)
                    for f in FIELDS:
                        rows[f].append(r.get(f))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array(rows[f], pa.string()) for f in FIELDS), pa.array(errors, pa.string())], names=[key, *FIELDS, "error"])

    both = documents.select(key, text).mapInArrow(run, f"{key} {kind.simpleString()}, {EVENT}, error string")
    return both.where("error is null").drop("error"), both.where("error is not null").select(key, "error")


def unfolded(text: str) -> list[str]:
    """Lines of a calendar text: a line that starts with a blank goes on from the one before."""
    out: list[str] = []
    for line in text.splitlines():
        if line[:1] in (" ", "\t") and out:
            out[-1] += line[1:]
        elif line:
            out.append(line)
    return out


def ical_events(text: str) -> list[dict]:
    """VEVENTs of a calendar. Values are unescaped; a date without a time has none. A calendar that never ends is an error."""
    lines = unfolded(text)
    if not lines or lines[0].strip().upper() != "BEGIN:VCALENDAR":
        raise ValueError("no calendar")
    if lines[-1].strip().upper() != "END:VCALENDAR":
        raise ValueError("the calendar is cut short")
    out, own = [], None
    for line in lines:
        head, _, value = line.partition(":")
        name = head.split(";")[0].upper()
        if name == "BEGIN" and value.upper() == "VEVENT":
            own = {}
        elif name == "END" and value.upper() == "VEVENT" and own is not None:
            stamp = own.get("DTSTART", "")
            if len(stamp) >= 8 and stamp[:8].isdigit() and own.get("STATUS", "").upper() != "CANCELLED":
                clock = stamp[9:13] if stamp[8:9] == "T" else ""
                out.append({"uid": own.get("UID"), "title": own.get("SUMMARY"), "date": f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}", "start_time": f"{clock[:2]}:{clock[2:]}" if len(clock) == 4 else None, "location": own.get("LOCATION"), "url": own.get("URL"), "description": own.get("DESCRIPTION")})
            own = None
        elif own is not None:
            own[name] = value.replace("\\n", "\n").replace("\\N", "\n").replace("\\,", ",").replace("\\;", ";").replace("\\\\", "\\")
    return out


def coalesced_endpoints(events: DataFrame) -> DataFrame:
    """Of the rows of one (key, title) on two successive days of which the later has no time, the first, with ``end_date``: feeds that give an
    event's last day as a row of its own."""
    later = events.where("start_time is null").select(F.col("page_id").alias("_k"), F.col("title").alias("_t"), F.date_sub(F.col("date").cast("date"), 1).alias("_d")).distinct()
    first = events.join(later, (F.col("page_id") == F.col("_k")) & F.col("title").eqNullSafe(F.col("_t")) & (F.col("date").cast("date") == F.col("_d")) & F.col("start_time").isNotNull(), "left")
    heads = first.withColumn("end_date", F.when(F.col("_d").isNotNull(), F.date_add("_d", 1))).drop("_k", "_t", "_d")
    ends = heads.where("end_date is not null").select(F.col("page_id").alias("_k"), F.col("title").alias("_t"), F.col("end_date").cast("string").alias("_e")).distinct()
    return heads.join(ends, (F.col("page_id") == F.col("_k")) & F.col("title").eqNullSafe(F.col("_t")) & (F.col("date") == F.col("_e")) & F.col("start_time").isNull(), "left_anti")


def rss_items(xml: Column) -> Column:
    """Items of a feed as an array of (title, url, date): RSS ``item`` and Atom ``entry``, markup and entities decoded once."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    tag = lambda x, name: F.regexp_replace(F.regexp_extract(x, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    none = lambda c: F.when(F.trim(c) != "", F.trim(c))

    def item(x: Column) -> Column:
        link = F.coalesce(none(tag(x, "link")), none(F.regexp_extract(x, r"(?is)<link\b[^>]*\bhref=[\"']([^\"']*)", 1)))
        stamp = F.coalesce(none(tag(x, "pubDate")), none(tag(x, "published")), none(tag(x, "updated")))
        day = F.coalesce(F.regexp_extract(stamp, r"(\d{4}-\d{2}-\d{2})", 1))
        spoken = F.to_date(F.try_to_timestamp(F.regexp_extract(stamp, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("d MMM yyyy")))
        title = tag(x, "title")
        for entity, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            title = F.regexp_replace(title, entity, value)
        return F.struct(none(title).alias("title"), link.alias("url"), F.coalesce(F.when(day != "", day), spoken.cast("string")).alias("date"))

    return F.transform(items, item)


def html_rows(row: str, columns: dict[str, str], container: str | None = None, references: Sequence[str] | None = None) -> Callable[[str], list[dict]]:
    """Parser of pages by configuration: selectors of the container, of row elements and of each field within them ("a@href" for an attribute);
    ``references``: the names of those that are decoded, all if None."""
    select = page_rows(row, columns, container, references)

    def parse(page: str) -> list[dict]:
        return [{f: " ".join(v.split()) or None for f, v in r.items()} for r in select(page) if any(v.strip() for v in r.values())]

    return parse


def routed_adapter(url: Column, overrides: Sequence[tuple[str, str]], table: Sequence[tuple[str, str]], default: str) -> Column:
    """Adapter of an address: a configured override first, then the first pattern of the table that fits."""
    return F.coalesce(*(F.when(url.rlike(f"(?i){p}"), name) for p, name in (*overrides, *table)), F.lit(default))


def json_items(text: Column, path: str, fields: dict[str, str]) -> Column:
    """Array of structs of a JSON feed: items at ``path`` (of names, "" for the whole), each field by its path."""
    items = F.from_json(F.get_json_object(text, f"$.{path}" if path else "$"), "array<string>", {"mode": "PERMISSIVE"})
    return F.transform(items, lambda x: F.struct(*(F.get_json_object(x, f"$.{p}").alias(n) for n, p in fields.items())))


def resolved_references(nodes: DataFrame, reference: str) -> DataFrame:
    """Nodes (page, node_id, ...) of a state cache whose ``reference`` names another node of the page, with that node's name as ``venue``."""
    other = nodes.select(F.col("page").alias("_p"), F.col("node_id").alias("_r"), F.col("name").alias("venue"))
    return nodes.join(other, (F.col("page") == F.col("_p")) & (F.col(reference) == F.col("_r")), "left").drop("_p", "_r")


def day_sections(rows: DataFrame, key: str, text: str, date: str) -> DataFrame:
    """A row for each "Day N:" section of a text, N days after the first; a text without sections is one row."""
    parts = F.filter(F.split(text, r"(?i)(?=\bDay \d+:)"), lambda x: x.rlike(r"(?i)^Day \d+:"))
    sections = F.when(F.size(parts) > 0, F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"(?i)^Day (\d+):", 1).cast("int").alias("day"), F.trim(F.regexp_replace(x, r"(?i)^Day \d+:", "")).alias("body")))).otherwise(F.array(F.struct(F.lit(1).alias("day"), F.trim(F.col(text)).alias("body"))))
    return rows.select(key, date, F.inline(sections)).select(key, F.date_add(date, F.col("day") - 1).alias("date"), "body")


def sheet_rows(lines: DataFrame, spark_csv_columns: Sequence[str]) -> DataFrame:
    """Rows of comma-separated lines (sheet, line), quotes honoured, by the columns' names."""
    schema = ", ".join(f"{c} string" for c in spark_csv_columns)
    return lines.select("sheet", F.from_csv("line", F.lit(schema)).alias("r")).select("sheet", "r.*")


def scheduled_rows(rules: DataFrame, dates: Column, template: Column, first_run: Column, anchor: Column, every_days: Column) -> DataFrame:
    """Generated rows of recurrence rules: a date each, its title by a template ({dayName}, {monthName}, {date}, {iso}) and its run
    number, counted on from the anchor's."""
    rows = rules.withColumn("date", F.explode(dates))
    d = F.col("date")
    title = template
    for token, value in (("{dayName}", F.date_format(d, "EEEE")), ("{monthName}", F.date_format(d, "MMMM")), ("{date}", F.concat(F.date_format(d, "MMMM"), F.lit(" "), F.day(d).cast("string"))), ("{iso}", d.cast("string"))):
        title = F.replace(title, F.lit(token), value)
    run = first_run + F.floor(F.datediff(d, anchor) / every_days + 0.5)
    return rows.withColumns({"title": title, "run_number": run.cast("int")})
