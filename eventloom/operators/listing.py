"""List and directory pages: filters, projections, orders, pages, groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.text import safe_url
from .filters import all_of
from .windows import value_parts


def with_centroids(rows: DataFrame, regions: DataFrame, region: str = "region_id") -> DataFrame:
    """Rows with coordinates: their own pair, else that of their region (region_id, centroid_lat, centroid_lng)."""
    joined = rows.join(regions.select(region, "centroid_lat", "centroid_lng"), region, "left")
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return joined.withColumns({"lat": F.when(own, F.col("latitude")).otherwise(F.col("centroid_lat")), "lng": F.when(own, F.col("longitude")).otherwise(F.col("centroid_lng"))}).drop("centroid_lat", "centroid_lng")


def within_radius(rows: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    """Rows at most ``km`` from a point; rows without coordinates are dropped. A box on plain columns comes first, so that
    it can reach the scan."""
    d = km / 111.0
    box = F.col("lat").between(lat - d, lat + d)
    far = rows.where(box).withColumn("distance_km", haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))
    return far.where(F.col("distance_km") <= km)


def directory(rows: DataFrame, regions: Sequence[str] = (), weekdays: Sequence[int] = (), frequencies: Sequence[str] = (), upcoming: bool = False, active: bool = False, query: Column | None = None) -> DataFrame:
    """Organisers of a directory: ``weekdays`` and ``frequencies`` are arrays of what a flat field and rules name."""
    return rows.where(
        all_of(
            F.col("region").isin(list(regions)) if regions else None,
            F.arrays_overlap("weekdays", F.array(*map(F.lit, weekdays))) if weekdays else None,
            F.arrays_overlap("frequencies", F.array(*map(F.lit, frequencies))) if frequencies else None,
            F.col("next_date").isNotNull() if upcoming else None,
            F.col("status").isin("active", "possibly-inactive") if active else None,
            query,
        )
    )


def schedule_facets(flat_day: Column, rules: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the weekdays and frequencies of their flat field and of their rules (key, weekday, frequency)."""
    own = rules.groupBy(key).agg(F.array_sort(F.collect_set("weekday")).alias("_days"), F.array_sort(F.collect_set("frequency")).alias("frequencies"))  # seven days, a few frequencies
    empty = F.array().cast("array<int>")
    days = F.array_sort(F.array_union(F.coalesce("_days", empty), F.array_compact(F.array(flat_day.cast("int")))))
    return rows.join(own, key, "left").withColumns({"weekdays": days, "frequencies": F.coalesce("frequencies", F.array().cast("array<string>"))}).drop("_days")


def fetch_window(rows: DataFrame, date: str, today: Column, days: int) -> DataFrame:
    return rows.where(F.col(date).between(F.date_sub(today, days), F.date_add(today, days)))


def without_umbrellas(rows: DataFrame, key: str, parent: str, date: str, content: Sequence[str]) -> DataFrame:
    """Rows without series parents that hold nothing of their own and have a child on their day."""
    children = rows.where(F.col(parent).isNotNull()).select(F.col(parent).alias(key), F.col(date)).distinct()
    bare = all_of(*(F.coalesce(F.trim(c) == "", F.lit(True)) for c in content))
    empty = rows.where(bare).join(children, [key, date], "left_semi").select(key)
    return rows.join(empty, key, "left_anti")


def list_rows(events: DataFrame, kennels: DataFrame, cohosts: DataFrame) -> DataFrame:
    """Events with their organiser and the others that host them, by name: a list of a few names for each event."""
    others = cohosts.join(kennels.select(F.col("kennel_id"), F.col("name").alias("cohost")), "kennel_id").groupBy("event_id").agg(F.array_sort(F.collect_set("cohost")).alias("cohosts"))
    return events.join(kennels, "kennel_id").join(others, "event_id", "left").withColumn("cohosts", F.coalesce("cohosts", F.array().cast("array<string>")))


def pivot_host(primary: Column, hosts: Column, near: Column) -> Column:
    """The host that puts an event on a nearby list: the primary one if it is near, else the first other that is."""
    others = F.filter(hosts, lambda h: F.array_contains(near, h))
    return F.when(F.array_contains(near, primary), primary).otherwise(F.get(others, F.lit(0)))


def source_links(links: Column) -> Column:
    """Links (url, label) in order with a safe scheme and a label, the first of each address, typed by site."""
    clean = F.transform(links, lambda x: F.struct(safe_url(x["url"]).alias("url"), F.trim(x["label"]).alias("label")))
    clean = F.filter(clean, lambda x: x["url"].isNotNull() & (x["label"] != ""))
    urls = F.transform(clean, lambda x: x["url"])
    first = F.filter(clean, lambda x, i: F.array_position(urls, x["url"]) == i + 1)
    kind = lambda t: F.when(t.contains("facebook.com") | t.contains("fb.com"), "facebook").when(t.contains("instagram.com"), "instagram").when(t.contains("hashrego.com"), "hashrego").when(t.contains("meetup.com"), "meetup").otherwise("website")
    return F.transform(first, lambda x: F.struct(x["url"].alias("url"), x["label"].alias("label"), kind(F.lower(F.concat_ws(" ", x["url"], x["label"]))).alias("type")))


def years_active(founded: Column, oldest: Column, year: int) -> dict[str, Column]:
    """Years since a foundation, or approximately since the oldest event."""
    known = F.coalesce(founded != 0, F.lit(False))
    since = F.when(known, founded).otherwise(F.year(oldest))
    return {"since": since, "years": F.lit(year) - since, "approximate": F.when(since.isNotNull(), ~known)}


def travel_order() -> list[Column]:
    return [F.asc_nulls_last("date"), F.coalesce(F.col("start_time"), F.lit("99:99")).asc(), F.asc_nulls_last("distance_km")]


def first_per_key(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_at = 1").drop("_at")


def offset_page(rows: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """A page of rows with the number of all rows and of pages."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    told = total.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(told)  # one row


def has_more(page: DataFrame, size: int) -> DataFrame:
    """One row: rows of a page fetched with a limit of ``size``, and whether there may be more."""
    return page.agg(F.count(F.lit(1)).alias("fetched")).withColumn("has_more", F.col("fetched") >= size)


def merged_pages(shown: DataFrame, older: DataFrame, key: str) -> DataFrame:
    """Rows shown and those of an older page that aren't among them."""
    return shown.unionByName(older.join(shown.select(key), key, "left_anti"))


def sections(rows: DataFrame, group: str, key: str, order: Sequence[str], size: int = 100) -> DataFrame:
    """Groups of a page with all their keys in order, in parts of ``size`` keys, and the number of keys of the whole group."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).join(value_parts(rows, [group], list(order), key, size, "keys"), group)


def exploded_tags(rows: DataFrame, key: str, tags: str) -> DataFrame:
    """A row for each different tag of a row; the first is the primary one."""
    return rows.select(key, F.posexplode(F.array_distinct(tags)).alias("at", "tag")).select(key, "tag", (F.col("at") == 0).alias("is_primary"))


def detected_source(url: Column) -> Column:
    """Type of the source that an address names; null for none."""
    u = F.regexp_replace(url, "(?i)^webcal://", "https://")
    host = F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://[^/?#]+([^?#]*)", 1)), "/$", "")
    query = F.concat(F.lit("&"), F.regexp_extract(u, r"\?([^#]*)", 1), F.lit("&"))
    of = lambda d: (host == d) | host.endswith("." + d)
    ical = path.endswith(".ics") | F.lower(query).contains("&format=ical&") | query.rlike("&ical(=[^&]*)?&") | url.rlike("(?i)^webcal://")
    rss = path.rlike(r"(?:/feed|/rss|/feed\.xml|/rss\.xml|/atom\.xml)$") | query.contains("&feed=rss2&") | query.contains("&format=rss&")
    found = F.when((host == "docs.google.com") & path.startswith("/spreadsheets"), "GOOGLE_SHEETS").when(host == "calendar.google.com", "GOOGLE_CALENDAR").when(of("hashrego.com"), "HASHREGO").when(of("meetup.com"), "MEETUP").when(ical, "ICAL_FEED").when(rss, "RSS_FEED")
    return F.when(host != "", found)


