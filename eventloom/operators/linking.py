"""Joins that link rows of different origins: routing by patterns, placeholders, corrected dates, rosters and imports, discovery, weather."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import coords_key, haversine_km
from ..functions.text import candidate_score, name_similarity
from ..storage import spread, written
from .matching import interval_join
from .similarity import holding_pairs, similar_pairs
from .windows import pick_best

TASK_ROWS = 1 << 20


def routed_tags(rows: DataFrame, text: str, rules: Sequence[tuple[str, str | Sequence[str]]]) -> Column:
    """Tags that ordered rules (pattern, tag or list of tags) give a text: the union of the lists that fit; else the first
    single tag that fits. Rules are a source's configuration, so they become one expression."""
    fits = lambda p: F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False))
    empty = F.array().cast("array<string>")
    lists = [F.when(fits(p), F.array(*map(F.lit, tags))).otherwise(empty) for p, tags in rules if not isinstance(tags, str)]
    united = reduce(F.array_union, lists, empty)
    single = F.coalesce(*(F.when(fits(p), tag) for p, tag in rules if isinstance(tag, str)), F.lit(None).cast("string"))
    return F.when(F.size(united) > 0, united).when(single.isNotNull(), F.array(single)).otherwise(empty)


def theme_twins(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The one event of another source with the incoming row's theme on its (kennel_id, date); where the incoming theme is
    empty, the day's only themed event; where the day's only event has none, that one. Columns of both: kennel_id, date, source_id, theme; ordinal; event_id.

    Events are counted by slot, by theme and by source first; a theme's two first sources are enough to name the one event that isn't of the row's own.
    Rows are dealt by ordinal to tasks of about ``TASK_ROWS`` and summed there by numbers alone, so no task sorts its share of the input."""
    slot = ["kennel_id", "date"]
    real = F.col("theme") != ""
    slots = existing.groupBy(*slot).agg(F.count(F.lit(1)).alias("n"), F.count_if(real).alias("n_real"), F.min(F.when(real, F.col("event_id"))).alias("real"), F.min("event_id").alias("any"))
    by_source = existing.where(real & F.col("source_id").isNotNull()).groupBy(*slot, "theme", "source_id").agg(F.count(F.lit(1)).alias("n_own"), F.min("event_id").alias("id"))
    by_theme = by_source.groupBy(*slot, "theme").agg(F.sum("n_own").alias("n_theme"), F.min(F.struct("source_id", "id")).alias("low"), F.max(F.struct("source_id", "id")).alias("high"))
    rows = incoming.select("ordinal", *slot, "source_id", "theme").join(slots, slot)
    rows = rows.join(by_theme, [*slot, "theme"], "left").join(by_source.drop("id"), [*slot, "theme", "source_id"], "left")
    n_same = F.when(F.col("source_id").isNotNull(), F.coalesce("n_theme", F.lit(0)) - F.coalesce("n_own", F.lit(0))).otherwise(0)
    # with one event of another source, that source is the least or the greatest of at most two
    same = F.when(n_same == 1, F.when(F.col("low.source_id") != F.col("source_id"), F.col("low.id")).otherwise(F.col("high.id")))
    rows = rows.withColumns({"n_same": n_same, "same": same})
    # the least theme is empty or not: 0 or 1 in its place are summed without a sort
    themed = F.when(F.col("theme") == "", 0).when(F.col("theme") != "", 1).alias("themed")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, incoming.count() // TASK_ROWS + 1)
    rows = rows.select("ordinal", "n", themed, "n_same", "same", "n_real", "real", "any").repartition(tasks, "ordinal")
    told = rows.groupBy("ordinal").agg(F.sum("n").alias("n"), F.min("themed").alias("themed"), F.sum("n_same").alias("n_same"), F.min("same").alias("same"), F.sum("n_real").alias("n_real"), F.min("real").alias("real"), F.min("any").alias("any"))
    found = F.when(F.col("n_same") == 1, F.col("same")).when((F.col("themed") == 0) & (F.col("n_real") == 1), F.col("real")).when((F.col("themed") == 1) & (F.col("n") == 1) & (F.col("n_real") == 0), F.col("any"))
    return told.select("ordinal", found.alias("event_id")).where("event_id is not null")


def moved_dates(incoming: DataFrame, existing: DataFrame, days: int = 30) -> DataFrame:
    """Events whose source now shows them on another day: equal kennel, link, run and label, at most ``days`` days
    apart, trust not below the event's; the last updated event of each row.

    Of the events of a key, day and trust only the first one can be chosen, and only where no less trusted one of the day comes before it. These meet the different
    questions (key, day, trust) of the rows, so neither many events nor many rows of a key and day make pairs."""
    keys = ["kennel_id", "source_url", "run_number", "label"]
    first = [F.desc("updated_at"), F.asc("event_id")]
    e = existing.select(*keys, "event_id", F.col("date").alias("old_date"), F.col("trust").alias("e_trust"), "updated_at")
    e = pick_best(e.where("old_date is not null and e_trust is not null"), [*keys, "old_date", "e_trust"], first)
    e = e.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*first)))
    before = F.min("_rank").over(Window.partitionBy(*keys, "old_date").orderBy("e_trust").rowsBetween(Window.unboundedPreceding, -1))
    e = written(e.withColumn("_before", before).where("_before is null or _rank < _before").drop("_before"), "moved-dates")
    ask = [*keys, "date", "trust"]
    pairs = interval_join(incoming.select(*ask).distinct(), e.select(*keys, "old_date", "e_trust", "_rank"), keys, "date", "old_date", days).where(F.col("trust") >= F.col("e_trust"))
    told = pairs.groupBy(*ask).agg(F.min("_rank").alias("_rank")).join(e.drop("e_trust"), [*keys, "_rank"])
    return pick_best(incoming.select("ordinal", *ask).join(told, ask), ["ordinal"], [*first, F.asc("date")]).select("ordinal", "event_id", "old_date", "date")


def near_names(left: DataFrame, right: DataFrame, name: str, other: str, group: Sequence[str], least: float) -> DataFrame:
    """Rows of a group whose names are ``least`` alike, case and outer blanks aside, with these names as _n and _m. Different names
    meet first (:func:`~.similarity.similar_pairs`), then the rows that bear them."""
    norm = lambda c: F.lower(F.trim(c))
    a = left.withColumn("_n", norm(name)).where("_n <> ''")
    b = right.withColumn("_m", norm(other)).where("_m <> ''")
    pairs = similar_pairs(a.withColumnRenamed("_n", "t"), b.withColumnRenamed("_m", "t"), group, least)
    pairs = pairs.withColumnsRenamed({"a": "_n", "b": "_m"})
    return a.join(pairs, [*group, "_n"]).join(b, [*group, "_m"])


STEPS = (0.95, 0.88)
ROUNDING = 0.001


def nearest_names(left: DataFrame, right: DataFrame, name: str, other: str, group: Sequence[str], least: float, key: Sequence[str], score: Column, order: Sequence[Column], steps: Sequence[float] = STEPS) -> DataFrame:
    """The best of :func:`near_names` for each ``key`` of ``left`` (which tells its rows apart and holds no null), by ``score`` and then ``order``; the score is
    the likeness of the two names, rounded to ``ROUNDING`` or finer.

    Names are asked for in steps from very alike down to ``least``: a row that has found one leaves, as all that is better was found as well. So few names come
    to the loose steps, where common pieces of names bring many together."""
    out, rest = None, left
    for step in [*(s for s in steps if s > least), least]:
        near = near_names(rest, right, name, other, group, step).withColumn("score", score)
        best = pick_best(near, list(key), [F.desc("score"), *order])
        if step > least:  # what is less alike than the step may not round to the same score
            best = best.where(name_similarity(F.col("_n"), F.col("_m")) >= step + ROUNDING)
        best = written(best, "nearest-names")
        out = best if out is None else out.unionByName(best)
        if step > least:
            rest = written(rest.join(best.select(*key), list(key), "left_anti"), "names-left")
            if rest.isEmpty():
                break
    return out


def matched_names(names: DataFrame, roster: DataFrame, least: float) -> DataFrame:
    """Roster entry of each imported name: equal to either name of one (case and blanks aside), else the nearest that is
    ``least`` alike. ``names``: group_id, name; ``roster``: group_id, hasher_id, hash_name, nerd_name."""
    either = roster.select("group_id", "hasher_id", F.explode(F.array_compact(F.array("hash_name", "nerd_name"))).alias("known"))
    norm = lambda c: F.lower(F.trim(c))
    exact = names.join(either, (names["group_id"] == either["group_id"]) & (norm(names["name"]) == norm(either["known"])), "inner").groupBy(names["group_id"], names["name"]).agg(F.min("hasher_id").alias("hasher_id"))
    exact = exact.select("group_id", "name", "hasher_id", F.lit("exact").alias("kind"), F.lit(1000).cast("long").alias("score"))
    rest = written(names.join(exact, ["group_id", "name"], "left_anti"), "names-left")
    score = F.floor(name_similarity(F.col("name"), F.col("known")) * 1000 + 0.5).cast("long")
    best = nearest_names(rest, either, "name", "known", ["group_id"], least, ["group_id", "name"], score, [F.asc("hasher_id"), F.asc("known")])
    return exact.unionByName(best.select("group_id", "name", "hasher_id", F.lit("fuzzy").alias("kind"), "score"))


def matched_headers(headers: DataFrame, events: DataFrame) -> DataFrame:
    """Event of each header of an attendance sheet: by its date, else by its run number ("#12" or "12"). ``headers``: sheet, at, header."""
    h = headers.where(F.trim("header") != "").withColumns({"_d": F.expr("try_to_date(trim(header), 'yyyy-MM-dd')"), "_r": F.regexp_extract(F.trim("header"), r"^#?(\d+)", 1).try_cast("int")})
    by_day = events.groupBy("sheet", F.col("date").alias("_d")).agg(F.min("event_id").alias("by_day"))
    by_run = events.groupBy("sheet", F.col("run_number").alias("_r")).agg(F.min("event_id").alias("by_run"))
    return h.join(by_day, ["sheet", "_d"], "left").join(by_run, ["sheet", "_r"], "left").select("sheet", "at", "header", F.coalesce("by_day", "by_run").alias("event_id"))


def import_records(cells: DataFrame, existing: DataFrame, attended: Sequence[str], paid: Sequence[str], hare: Sequence[str]) -> DataFrame:
    """Records (hasher_id, event_id, paid, hared, is_new) of an attendance sheet's cells: any marker counts as attended, others are left out;
    records that exist already are told apart. Markers compare without case and outer blanks."""
    v = F.lower(F.trim("cell"))
    among = lambda m: v.isin([x.lower() for x in m])
    rows = cells.where(among([*attended, *paid, *hare])).groupBy("hasher_id", "event_id").agg(F.bool_or(among(paid)).alias("paid"), F.bool_or(among(hare)).alias("hared"))
    old = existing.select("hasher_id", "event_id", F.lit(False).alias("is_new")).distinct()
    return rows.join(old, ["hasher_id", "event_id"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))


def discovery_matches(found: DataFrame, known: DataFrame, keep: float = 0.6, sure: float = 0.95, top: int = 3, each: int = 5) -> DataFrame:
    """Known organisers (kennel_id, name, country, lat, lng) like each found one (found_id, slug, name, country, lat, lng): the ``each`` best of its slug and of its
    name, the better score of both, less 0.3 for another country and 0.2 over 200 km away; ``auto`` from ``sure``, else up to ``top`` candidates from ``keep``.

    A candidate scores ``keep`` by likeness alone, or with 0.3 less if one text holds the other; both meet by exact indexes."""
    norm = lambda c: F.lower(F.trim(c))
    asked = found.select("found_id", F.explode(F.array(F.struct(F.lit("slug").alias("by"), norm("slug").alias("t")), F.struct(F.lit("name").alias("by"), norm("name").alias("t")))).alias("q")).select("found_id", "q.*").where("t <> ''")
    names = known.select("kennel_id", norm("name").alias("t")).where("t <> ''")
    met = similar_pairs(asked, names, [], keep).unionByName(holding_pairs(asked, names, [], 6, keep - 0.3)).distinct()
    # of the organisers of one name only the first ones can be among the best
    first = names.withColumn("_at", F.row_number().over(Window.partitionBy("t").orderBy("kennel_id"))).where(F.col("_at") <= each).select("kennel_id", F.col("t").alias("b"))
    hits = met.join(asked.withColumnRenamed("t", "a"), "a").join(first, "b").withColumn("text_score", candidate_score(F.col("a"), F.array("b")))
    best = Window.partitionBy("found_id", "by").orderBy(F.desc("text_score"), "kennel_id")
    hits = hits.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= each).groupBy("found_id", "kennel_id").agg(F.max("text_score").alias("text_score"))
    rows = hits.join(found.drop("name", "slug"), "found_id").join(known.select("kennel_id", F.col("country").alias("k_country"), F.col("lat").alias("k_lat"), F.col("lng").alias("k_lng")), "kennel_id")
    far = haversine_km(F.col("lat"), F.col("lng"), F.col("k_lat"), F.col("k_lng")) > 200
    score = F.col("text_score") - F.when(F.col("country") != F.col("k_country"), 0.3).otherwise(0.0) - F.when(F.coalesce(far, F.lit(False)), 0.2).otherwise(0.0)
    scored = rows.withColumn("score", F.floor(score * 1000 + 0.5).cast("long")).where(F.col("score") >= int(keep * 1000))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("found_id").orderBy(F.desc("score"), "kennel_id")))
    auto = F.max("score").over(Window.partitionBy("found_id")) >= int(sure * 1000)
    return ranked.withColumn("auto", auto).where((F.col("auto") & (F.col("rank") == 1)) | (~F.col("auto") & (F.col("rank") <= top))).select("found_id", "kennel_id", "score", "rank", "auto")


SCOPE_BLOCK = 1 << 14  # members of a group that are packed as one
SCOPE_SLICE = 1 << 12  # kennels that meet a block in one task


def roster_scope(kennels: DataFrame, groups: DataFrame) -> DataFrame:
    """All kennels of each kennel's roster group, itself if it has none.

    The pairs of a group are its result, so they are not shuffled: members are packed in blocks of about ``SCOPE_BLOCK``, a slice of about ``SCOPE_SLICE``
    kennels meets each block in one task, and a kennel's pairs are taken out of one block at a time. So a group moves some bytes for each thousand pairs,
    and no task holds a group. Only a kennel of several groups may have a member twice; its members are made distinct by themselves."""
    own = kennels.select("kennel_id").where("kennel_id is not null").distinct()
    g = groups.select("kennel_id", "group_id").where("kennel_id is not null and group_id is not null").distinct()
    n = F.count(F.lit(1))
    sizes = g.groupBy("group_id").agg(F.ceil(n / SCOPE_BLOCK).cast("int").alias("_blocks"), F.ceil(n / SCOPE_SLICE).cast("int").alias("_slices"))
    several = g.groupBy("kennel_id").agg((F.count(F.lit(1)) > 1).alias("_several"))
    rows = own.join(several, "kennel_id", "left")
    tile = ["group_id", "_slice", "_block"]
    dealt = lambda most: F.pmod(F.xxhash64("kennel_id"), F.col(most)).cast("int")
    each = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    blocks = g.join(sizes, "group_id").withColumn("_block", dealt("_blocks")).groupBy("group_id", "_slices", "_block").agg(F.collect_list("kennel_id").alias("_members"))
    # few bytes make all pairs of a tile, so tiles are spread over as many tasks as shuffles have
    blocks = spread(blocks.withColumn("_slice", each("_slices")).select(*tile, "_members"), *tile)

    def pairs(c: str) -> DataFrame:
        asked = rows.where(c).join(g, "kennel_id").join(sizes, "group_id").withColumn("_slice", dealt("_slices")).withColumn("_block", each("_blocks"))
        return spread(asked.select("kennel_id", *tile), *tile).join(blocks, tile).select("kennel_id", F.explode("_members").alias("member"))

    alone = rows.where("_several is null").select("kennel_id", F.col("kennel_id").alias("member"))
    missing = kennels.where("kennel_id is null").select("kennel_id", F.col("kennel_id").alias("member")).distinct()
    return pairs("not _several").unionByName(pairs("_several").distinct()).unionByName(alone).unionByName(missing)


def wider_ring(primary: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """The wide ring's rows (stop_id, key) of stops without any primary row, and the primary rows of others."""
    stops = primary.select("stop_id").distinct()
    return primary.select("stop_id", key, F.lit(False).alias("broader")).unionByName(wide.join(stops, "stop_id", "left_anti").select("stop_id", key, F.lit(True).alias("broader")))


def weather_for(events: DataFrame, forecast: DataFrame, today: Column, days: int = 10, cells: int = 15) -> DataFrame:
    """Forecast of each event within ``days`` days by its cell of a tenth of a degree and its day; the ``cells`` cells with the soonest
    events are looked up. ``forecast``: cell, date, temperature."""
    near = events.where(F.col("date").between(today, F.date_add(today, days)) & F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumn("cell", coords_key(F.col("lat"), F.col("lng"), 1))
    chosen = near.groupBy("cell").agg(F.min("date").alias("_d")).orderBy("_d", "cell").limit(cells).select("cell")
    return near.join(F.broadcast(chosen), "cell", "left_semi").join(forecast, ["cell", "date"])


def merged_bridge(bridge: DataFrame, mapping: DataFrame, key: str, other: str, primary: str) -> DataFrame:
    """Bridge rows (other, key, primary) after entities merged: keys move, rows that meet are one, primary if any was."""
    moved = bridge.join(mapping.select(F.col("old_id").alias(key), "new_id"), key, "left").withColumn(key, F.coalesce("new_id", key))
    return moved.groupBy(other, key).agg(F.bool_or(primary).alias(primary))


def window_hits(snapshots: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """Snapshots with an event of one of the sources that were frozen with them, at most ``days`` days away. ``snapshots``: snapshot_id, kennel_id, date, sources
    (array); ``events``: kennel_id, e_date, e_sources (array). What a snapshot asks for decides, not its id, so rows that share an id are judged each for itself."""
    ask = ["kennel_id", "date", "sources"]
    asked = snapshots.select(*ask).distinct()
    same = asked.join(events.withColumnRenamed("e_date", "date"), ["kennel_id", "date"], "inner")
    near = interval_join(asked, events, ["kennel_id"], "date", "e_date", days)
    hit = lambda df: df.where(F.arrays_overlap("sources", "e_sources")).select(*ask)
    found = hit(same).unionByName(hit(near)).distinct().withColumn("hit", F.lit(True))
    return snapshots.join(found, ask, "left").select("snapshot_id", F.coalesce("hit", F.lit(False)).alias("hit"))
