"""Matching joins: lookup cascades, fuzzy and interval joins, radius search, as-of, assignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import geo as G
from ..functions import text as T
from ..storage import written
from .windows import pick_best


def some(rows: DataFrame, others: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return rows.join(others, key, "left_semi")


def none(rows: DataFrame, others: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return rows.join(others, key, "left_anti")


def some_of_either(rows: DataFrame, key: str, direct: DataFrame, bridge: DataFrame) -> DataFrame:
    """Semi-join on keys of two tables: one semi-join on their union instead of an OR."""
    return rows.join(direct.select(key).unionByName(bridge.select(key)).distinct(), key, "left_semi")


def verification(user_rows: DataFrame, official_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join: verified (both sides), user-only, or official-only."""
    a, b = user_rows.select(*keys, F.lit(True).alias("by_user")).distinct(), official_rows.select(*keys, F.lit(True).alias("official")).distinct()
    status = F.when(F.col("by_user") & F.col("official"), "verified").when(F.col("by_user"), "user-only").otherwise("official-only")
    return a.join(b, list(keys), "full").select(*keys, status.alias("status"))


def resolve_tags(tags: DataFrame, codes: DataFrame, names: DataFrame, aliases: DataFrame, patterns: Sequence[tuple[str, str]], linked: DataFrame) -> DataFrame:
    """Organiser of each (source_id, tag): by code, then short name, then alias, then the first pattern that
    fits, whose code goes through the first three tiers. Case and outer blanks don't count; a row linked
    to the source beats others of its tier, the least id the rest; blank tags match nothing.

    ``codes``, ``names``, ``aliases``: (value, kennel_id). All three lookups are one equi-join."""
    norm = lambda c: F.lower(F.trim(c))
    lookup = None
    for tier, table in enumerate((codes, names, aliases), 1):
        part = table.select(norm(F.col("value")).alias("value"), "kennel_id", F.lit(tier).alias("tier"))
        lookup = part if lookup is None else lookup.unionByName(part)
    mapped = F.lit(None).cast("string")
    for pattern, code in reversed(patterns):
        mapped = F.when(norm(F.col("tag")).rlike(pattern), norm(F.lit(code))).otherwise(mapped)
    asked = tags.select("source_id", "tag").distinct()
    tries = asked.select("source_id", "tag", F.explode(F.array(F.struct(norm(F.col("tag")).alias("value"), F.lit(0).alias("base")), F.struct(mapped.alias("value"), F.lit(3).alias("base")))).alias("t")).select("source_id", "tag", "t.*").where("value <> ''")
    hits = tries.join(lookup, "value").join(linked.select("source_id", "kennel_id", F.lit(1).alias("linked")).distinct(), ["source_id", "kennel_id"], "left")
    best = pick_best(hits.withColumn("tier", F.col("base") + F.col("tier")), ["source_id", "tag"], [F.col("tier"), F.desc(F.coalesce("linked", F.lit(0))), F.col("kennel_id")])
    return asked.join(best.select("source_id", "tag", "kennel_id", "tier"), ["source_id", "tag"], "left")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_date: str, right_date: str, days: int) -> DataFrame:
    """Pairs of equal keys whose dates are at most ``days`` apart, 0 excluded. Dates meet by buckets of ``days``
    days: the left side goes to its bucket and both neighbours, so the join stays an equi-join."""
    epoch = F.lit("1970-01-01").cast("date")
    bucket = lambda c: F.floor(F.datediff(F.col(c), epoch) / days)
    a = left.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: bucket(left_date) + k)))
    b = right.withColumn("_b", bucket(right_date))
    gap = F.abs(F.datediff(F.col(left_date), F.col(right_date)))
    return a.join(b, [*keys, "_b"]).where(gap.between(1, days)).drop("_b")


def best_match(rows: DataFrame, candidates: DataFrame, block: Sequence[str], score: Column, order: Sequence[Column], least: float, key: Sequence[str]) -> DataFrame:
    """The best candidate of each row within its block, if its score reaches ``least``."""
    return pick_best(rows.join(candidates, list(block)).withColumn("score", score).where(F.col("score") >= least), key, [F.desc("score"), *order])


DENSE_PLACES = 4096
FINEST = 64


def radius_join(stops: DataFrame, places: DataFrame, radius_km: float) -> DataFrame:
    """Places within a radius of each stop (stop_id, lat, lng). Both sides meet by grid cells of the radius's size: a
    stop goes to the cells that its bounding box touches. Longitude cells wrap at the date line. A cell with more than ``DENSE_PLACES`` places
    is split, up to ``FINEST`` times each way, and a stop goes to the parts that its box touches, so a city isn't one key."""
    cell = radius_km / G.KM_PER_DEGREE
    columns = max(1, int(360 // cell))
    y = lambda c: (c + 90) / cell
    x = lambda c: (c + 180) / 360 * columns
    # the whole circle: near a pole it has all longitudes
    high = radius_km / G.KM_PER_DEGREE
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(radius_km / 6371.0)) / F.cos(F.radians("lat"))))) + 1e-6
    wide = F.when(F.abs("lat") + high >= 90, 180.0).otherwise(wide)
    box = {"min_lat": F.col("lat") - high, "max_lat": F.col("lat") + high, "min_lng": F.col("lng") - wide, "max_lng": F.col("lng") + wide}
    known = stops.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumns({"_y0": y(box["min_lat"]), "_y1": y(box["max_lat"]), "_x0": x(box["min_lng"]), "_x1": x(box["max_lng"])})
    span = F.least(F.floor("_x1") - F.floor("_x0"), F.lit(columns - 1))
    cells = known.withColumn("_r", F.explode(F.sequence(F.floor("_y0"), F.floor("_y1")))).withColumn("_k", F.explode(F.sequence(F.floor("_x0"), F.floor("_x0") + span))).withColumn("_c", F.pmod("_k", F.lit(columns)))
    own = places.withColumns({"_y": y(F.col("latitude")), "_x": x(F.col("longitude"))}).withColumns({"_r": F.floor("_y"), "_c": F.pmod(F.floor("_x"), F.lit(columns))})
    dense = own.groupBy("_r", "_c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > DENSE_PLACES)
    dense = dense.select("_r", "_c", F.least(F.lit(FINEST), F.ceil(F.sqrt(F.col("_n") / DENSE_PLACES))).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    within = lambda c: F.least(parts - 1, F.greatest(F.lit(0), F.floor(c * parts))).cast("int")
    own = own.join(dense, ["_r", "_c"], "left").withColumns({"_pr": within(F.col("_y") - F.floor("_y")), "_pc": within(F.col("_x") - F.floor("_x"))}).drop("_y", "_x", "_parts")
    # a box that goes round the earth touches all parts of its columns
    around = F.floor("_x1") - F.floor("_x0") > columns - 1
    first = F.when(around, 0).otherwise(within(F.col("_x0") - F.col("_k")))
    last = F.when(around, parts - 1).otherwise(within(F.col("_x1") - F.col("_k")))
    cells = cells.join(dense, ["_r", "_c"], "left").withColumn("_pr", F.explode(F.sequence(within(F.col("_y0") - F.col("_r")), within(F.col("_y1") - F.col("_r"))))).withColumn("_pc", F.explode(F.sequence(first, last)))
    cells = cells.drop("_y0", "_y1", "_x0", "_x1", "_k", "_parts")
    key = ["_r", "_c", "_pr", "_pc"]
    near = cells.join(own, key).withColumn("distance_km", G.haversine_km(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude")))
    return near.where(F.col("distance_km") <= radius_km).drop(*key).withColumn("distance_tier", G.distance_tier(F.col("distance_km")))


def asof_latest(refs: DataFrame, rows: DataFrame, key: str, ref_date: str, row_date: str) -> DataFrame:
    """Each reference row with the last row date of its key on or before it: both sides are one sorted
    stream, over which the last date runs."""
    a = refs.withColumns({"_t": F.col(ref_date), "_side": F.lit(1), "_d": F.lit(None).cast(refs.schema[ref_date].dataType)})
    b = rows.select(key, F.col(row_date).alias("_t"), F.lit(0).alias("_side"), F.col(row_date).alias("_d")).distinct()
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("last_date", F.last("_d", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_t", "_side", "_d")


def same_day_match(incoming: DataFrame, existing: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The event of each incoming row on its (kennel_id, date): by URL, else run number, else start time, else title;
    a tier counts if it has exactly one candidate. A slot's sole event is taken where no tier speaks against it.

    Events are counted by slot and by each tier's value first, so a row meets one row for each tier, however many events its slot has. What
    rows ask is made distinct before, so the rows themselves are shuffled once to meet their answers and once by ordinal, not for each tier."""
    slot = ["kennel_id", "date"]
    norm = lambda c: F.lower(F.trim(c))
    tiers = {"url": F.col("source_url"), "run": F.col("run_number"), "time": F.col("start_time"), "title": norm(F.col("title"))}
    ask = [*slot, *(f"v_{t}" for t in tiers)]
    incoming = incoming.select(ordinal, *slot, *(c.alias(f"v_{t}") for t, c in tiers.items()))
    rows = incoming.select(*ask).distinct()
    slots = existing.groupBy(*slot).agg(F.count("event_id").alias("candidates"), F.min("event_id").alias("sole"), F.count("run_number").alias("runs"))
    rows = rows.join(slots, slot, "left")
    for t, c in tiers.items():
        values = existing.select(*slot, "event_id", c.alias(f"v_{t}")).where(F.col(f"v_{t}").isNotNull())
        rows = rows.join(values.groupBy(*slot, f"v_{t}").agg(F.count("event_id").alias(f"n_{t}"), F.min("event_id").alias(f"id_{t}")), [*slot, f"v_{t}"], "left")
    other = F.when(F.col("v_run").isNotNull(), F.coalesce("runs", F.lit(0)) - F.coalesce("n_run", F.lit(0))).otherwise(0)
    # a row that asks as others do has their answer; one without candidates needs none
    told = rows.withColumn("other", other).where(F.col("candidates") > 0)
    told = told.select(*ask, "candidates", "sole", "other", *(c for t in tiers for c in (f"n_{t}", f"id_{t}")))
    rows = incoming.join(told, _equal(incoming, told, ask), "left").select(incoming[ordinal], *(c for c in told.columns if c not in ask))
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    picked = rows.groupBy(ordinal).agg(total("candidates").alias("candidates"), F.min("sole").alias("sole"), total("other").alias("other_runs"), *(x for t in tiers for x in (total(f"n_{t}").alias(f"n_{t}"), F.min(f"id_{t}").alias(f"id_{t}"))))
    chosen = F.coalesce(*(F.when(F.col(f"n_{t}") == 1, F.col(f"id_{t}")) for t in tiers), F.when((F.col("candidates") == 1) & (F.col("other_runs") == 0), F.col("sole")))
    tier = F.coalesce(*(F.when(F.col(f"n_{t}") == 1, t) for t in tiers), F.when((F.col("candidates") == 1) & (F.col("other_runs") == 0), "sole"), F.lit("new"))
    return picked.select(ordinal, chosen.alias("event_id"), tier.alias("tier"))


STREAM_PAIRS = 1 << 22
GAIN = 0.05


def _equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def _dominant(pairs: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Pairs that are the first of both their sides, which the greedy order takes whatever else it takes."""
    place = F.struct(F.col("rank").isNull().alias("none"), "rank", "ordinal", "event_id")
    by_row = pairs.groupBy(*slot, "ordinal").agg(F.min(place).alias("p")).select(*slot, "ordinal", "p.event_id", "p.rank")
    by_event = pairs.groupBy(*slot, "event_id").agg(F.min(place).alias("p")).select(*slot, "p.ordinal", "event_id", "p.rank")
    return by_row.join(by_event, _equal(by_row, by_event, [*slot, "ordinal", "event_id", "rank"]), "left_semi")


def _in_order(pairs: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Greedy choice over pairs that come sorted, in one pass: the sides taken in the current slot are all it holds."""
    names = list(slot)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, events = None, set(), set()
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in (*names, "ordinal", "event_id")}
            keep = []
            for key, o, e in zip(zip(*(columns[c] for c in names), strict=True), columns["ordinal"], columns["event_id"], strict=True):
                if key != now:
                    now, rows, events = key, set(), set()
                keep.append(free := o not in rows and e not in events)
                if free:
                    rows.add(o)
                    events.add(e)
            yield batch.filter(pa.array(keep))

    dealt = pairs.repartition(*slot).sortWithinPartitions(*slot, F.asc_nulls_last("rank"), "ordinal", "event_id")
    return dealt.mapInArrow(choose, pairs.schema)


def assign_one_to_one(pairs: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Greedy assignment in each slot: pairs (ordinal, event_id, rank) are taken by rank (null last), ordinal and id, each side once. A pair without one of its
    sides is none; a null slot is a slot.

    Slots are sorted and read through once. A slot of over ``STREAM_PAIRS`` pairs is cut down before, in rounds: all pairs that are first for both
    sides are taken and both sides go, until it is small enough or a round takes few away."""
    pairs = pairs.select(*slot, "ordinal", "event_id", "rank").where("ordinal is not null and event_id is not null")
    spark = pairs.sparkSession
    sizes = pairs.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > STREAM_PAIRS)
    large = written(sizes.drop("_n"), "large-slots")
    if large.isEmpty():
        return _in_order(pairs, slot)
    small = pairs.join(large, _equal(pairs, large, slot), "left_anti")
    left = written(pairs.join(large, _equal(pairs, large, slot), "left_semi"), "slots-left")
    taken, n = spark.createDataFrame([], pairs.schema), left.count()
    while n:
        first = written(_dominant(left, slot), "slots-taken")
        taken = taken.unionByName(first)
        rest = left.join(first, _equal(left, first, [*slot, "ordinal"]), "left_anti")
        left = written(rest.join(first, _equal(rest, first, [*slot, "event_id"]), "left_anti"), "slots-left")
        before, n = n, left.count()
        if n > (1 - GAIN) * before or left.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > STREAM_PAIRS).isEmpty():
            break
    return _in_order(small.unionByName(left), slot).unionByName(taken)


TITLE_PAIRS = 1 << 26  # different titles of both sides that are compared with each other
FIRST = 8  # candidates that a row looks at before the others


def fuzzy_window_duplicates(incoming: DataFrame, existing: DataFrame, days: int = 2, title_distance: int = 4, minutes: int = 120, place_distance: int = 8) -> DataFrame:
    """The event (ordinal, event_id) that an incoming row repeats within ``days`` days: near title (of four characters or more), equal
    or missing run number, near time and place, another source; the most trusted first, then the nearest in days.

    Different titles are compared first. The ``FIRST`` events of each kennel, day and asked title are listed in the order of choice, so a row that fits one of
    them has its best without meeting the others; only rows that fit none of a list that goes on meet all events of their window. Where
    there are too many different titles to be compared, all rows do."""
    low = lambda c: F.lower(F.trim(c))
    side = lambda df, *own: df.select(*own, "kennel_id", "date", "source_id", low("title").alias("title"), "run_number", F.col("start_time").isNotNull().alias("timed"), D.minutes_of(F.col("start_time")).alias("minute"), low("location").alias("location"))
    asked = side(incoming, "ordinal").where("length(title) >= 4 and source_id is not null")
    e = side(existing, "event_id", "trust").where("title is not null and source_id is not null").withColumnRenamed("date", "e_date")

    def fits(row, event) -> Column:
        time = ~row("timed") | ~event("timed") | F.coalesce(F.abs(row("minute") - event("minute")) <= minutes, F.lit(False))
        run = row("run_number").isNull() | event("run_number").isNull() | (row("run_number") == event("run_number"))
        place = row("location").isNull() | event("location").isNull() | (F.levenshtein(row("location"), event("location"), place_distance) >= 0)
        return (row("source_id") != event("source_id")) & run & time & place

    order = lambda gap: F.struct(F.col("trust").isNull().alias("none"), (-F.col("trust")).alias("trust"), gap.alias("gap"), "event_id")
    attributes = ["source_id", "run_number", "timed", "minute", "location"]

    def among_all(rows: DataFrame, near: DataFrame | None) -> DataFrame:
        events = e.select("kennel_id", "e_date", "event_id", "trust", *(F.col(c).alias(f"e_{c}") for c in ("title", *attributes)))
        pairs = interval_join(rows, events, ["kennel_id"], "date", "e_date", days)
        pairs = pairs.where(F.levenshtein("title", "e_title", title_distance) >= 0) if near is None else pairs.join(near, ["title", "e_title"])
        pairs = pairs.where(fits(F.col, lambda c: F.col(f"e_{c}")))
        return pairs.groupBy("ordinal").agg(F.min(order(F.abs(F.datediff("date", "e_date")))).alias("found"))

    ours, theirs = written(asked.select("title").distinct(), "asked-titles"), written(e.select(F.col("title").alias("e_title")).distinct(), "event-titles")
    if ours.count() * theirs.count() > TITLE_PAIRS:
        return among_all(asked, None).select("ordinal", "found.event_id")
    near = written(ours.crossJoin(theirs).where(F.levenshtein("title", "e_title", title_distance) >= 0), "near-titles")

    def firsts(rows: DataFrame, slot: Sequence[str]) -> DataFrame:
        best = Window.partitionBy(*slot).orderBy("order")
        return rows.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= FIRST + 1)

    listed = e.withColumnRenamed("title", "e_title").join(near, "e_title").drop("e_title")
    listed = firsts(listed.withColumn("order", order(F.lit(0))), ["kennel_id", "e_date", "title"])
    listed = listed.withColumn("_gap", F.explode(F.array(*(F.lit(d) for d in range(-days, days + 1) if d)))).withColumn("date", F.date_add("e_date", F.col("_gap")))
    slot = ["kennel_id", "date", "title"]
    listed = firsts(listed.withColumn("order", order(F.abs("_gap"))), slot)
    lists = listed.groupBy(*slot).agg(F.array_sort(F.collect_list(F.struct("order", *attributes))).alias("listed"))  # FIRST + 1 at most
    found = F.get(F.filter(F.slice("listed", 1, FIRST), lambda x: fits(F.col, lambda c: x[c])), F.lit(0))["order"]
    told = asked.join(lists, slot).withColumn("found", found)
    more = F.col("found").isNull() & (F.size("listed") > FIRST)
    told = written(told.where(F.col("found").isNotNull() | more).select("ordinal", *slot, *attributes, "found"), "first-candidates")
    chosen = told.where("found is not null").select("ordinal", "found").unionByName(among_all(told.where("found is null").drop("found"), near))
    return chosen.groupBy("ordinal").agg(F.min("found").alias("found")).select("ordinal", "found.event_id")


# Fixed value: names of activities that say nothing.
GENERIC_NAME = r"(?i)^(?:morning|lunch|afternoon|evening|night)\s+(?:run|trail run|walk|hike|ride|workout|activity)$"


def activity_score(name_a: Column, name_b: Column, km: Column, one_sided: Column, minutes: Column, sport_ok: Column) -> Column:
    """3 x name + 2 x nearness + time + 0.2 for a run. A generic name counts 0; nearness is 1 to 5 km, a half to 25, and -0.25 where only
    one side has a position; a missing time counts 0.3."""
    name = F.when(F.trim(name_a).rlike(GENERIC_NAME), 0.0).otherwise(T.name_similarity(name_a, name_b))
    geo = F.when(one_sided, -0.25).when(km <= 5, 1.0).when(km <= 25, 0.5).otherwise(0.0)
    time = F.when(minutes.isNull(), F.lit(0.3)).otherwise(F.greatest(F.lit(0.0), 1 - minutes / 120))
    return 3 * name + 2 * geo + time + F.when(sport_ok, 0.2).otherwise(0.0)
