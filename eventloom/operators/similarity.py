"""Exact joins of similar texts by an index of segments.

Texts are ``least`` alike if at most ``(1 - least) * longer length`` edits lie between them. The shorter text of a pair is cut into one segment more than
that many edits, so an edit can't reach all of them: one segment stands in the longer text, at a place that the number of
edits and the difference of lengths bound. Texts meet by (lengths, place of the segment, segment), which is an equi-join, and
the distance decides. Where there are fewer characters than segments, every character is one: alike texts share a character.

What all texts of a side of a group begin with tells none of them apart, so only what is behind it is cut. If these beginnings of both sides differ by
so many edits at least, no more than the others are left for the rest, which is cut into fewer and longer segments.

A segment that very many texts of a group hold brings too many together. Such texts meet again by a second
segment, cut from what the first one left over, which must hold one that is untouched as well. What is still too common, or too short
to be cut again, is dealt out in slices.

Where one side of a group has at most ``FEW`` texts, all its pairs are compared, in slices: that grows as the other side does, and an index would cost
more, for it cuts each text into hundreds of pieces.

Null and empty texts are like nothing. Equal pairs are returned once, whatever number of segments they share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import spread, written

HOT = 1 << 22  # pairs of texts that meet by one segment at a place
FEW = 1024
DIRECT = 1 << 21  # pairs of a slice where all are compared
EPSILON = 1e-9
FRAME = 64  # characters of a common beginning that are looked at


def _start(i: Column, k: Column, length: Column) -> Column:
    """Where segment ``i`` of ``k`` begins; the first ones are longer by one character where it doesn't work out even."""
    return (i * F.floor(length / k) + F.least(i, length % k)).cast("int")


def _size(i: Column, k: Column, length: Column) -> Column:
    return (F.floor(length / k) + (i < length % k).cast("int")).cast("int")


def _other_lengths(rows: DataFrame, lengths: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Rows whose ``name`` is the length of a text on the other side. There are few lengths in a group."""
    return rows.join(lengths.select(*group, "side", F.col("n").alias(name)), [*group, "side", name], "left_semi")


def _frames(texts: DataFrame, group: Sequence[str]) -> DataFrame:
    """For the shorter texts of each group and ``side``: the length ``skip`` of their common beginning, the edits ``cost`` that lie between it and any
    beginning of the other side's texts at least, and the characters ``lead`` by which these edits shift what is behind it at most; ``other``, the length
    of the other side's beginning, and ``gains``, by the number of edits that texts may have, how many fewer what is behind both beginnings has at least."""
    low, high = F.substring("low", 1, FRAME), F.substring("high", 1, FRAME)
    same = F.filter(F.sequence(F.lit(1), F.least(F.length(low), F.length(high))), lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n))
    # what the least and the greatest text begin with, all between them do
    ends = texts.groupBy(*group, "side").agg(F.min("t").alias("low"), F.max("t").alias("high")).select(*group, "side", F.substring("low", F.lit(1), F.size(same)).alias("p"))
    both = ends.groupBy(*group).agg(F.max(F.when(F.col("side") == 0, F.col("p"))).alias("p"), F.max(F.when(F.col("side") == 1, F.col("p"))).alias("q"))
    p, q = F.col("p"), F.col("q")

    def until(a: Column, b: Column) -> Column:
        """Edits and shift of ``a`` against each beginning of ``b``: an alignment of two texts leaves one of their beginnings first, at some place of the other."""
        return F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: F.named_struct(F.lit("cost"), F.levenshtein(a, F.substring(b, F.lit(1), j)), F.lit("shift"), F.abs(F.length(a) - j), F.lit("over"), F.length(b) - j))

    ways = F.concat(until(p, q), until(q, p))
    cost, slack = F.array_min(F.transform(ways, lambda w: w["cost"])), F.array_max(F.transform(ways, lambda w: w["shift"] - w["cost"]))
    gains = F.transform(F.sequence(F.lit(0), F.lit(FRAME)), lambda e: F.array_min(F.transform(F.filter(ways, lambda w: w["cost"] <= e), lambda w: w["cost"] - w["over"])))
    of = lambda side, a, b: F.struct(F.lit(side).alias("side"), F.length(a).alias("skip"), F.length(b).alias("other"))
    return both.select(*group, F.explode(F.array(of(0, p, q), of(1, q, p))).alias("f"), cost.alias("cost"), (cost + slack).alias("lead"), gains.alias("gains")).select(*group, "f.*", "cost", "lead", "gains")


def _framed(rows: DataFrame) -> DataFrame:
    """Rows with the edits of their lengths, and the frame where it leaves characters enough for all segments."""
    rows = rows.where("cost <= edits").withColumn("room", F.col("edits") - F.coalesce(F.get("gains", F.col("edits")), F.lit(0))).drop("gains")
    enough = F.col("short") - F.col("skip") > F.col("edits") - F.col("cost")
    rows = rows.withColumns({c: F.when(enough, F.col(c)).otherwise(0) for c in ("skip", "cost", "lead")})
    return rows.withColumn("k", F.least(F.col("edits") - F.col("cost") + 1, F.col("short") - F.col("skip")))


def _cut(texts: DataFrame, least: float, lengths: DataFrame, frames: DataFrame, group: Sequence[str]) -> DataFrame:
    """Segments of texts as the shorter ones, for every length that a longer one has."""
    n = F.length("t")
    rows = texts.withColumn("short", n).withColumn("long", F.explode(F.sequence(n, F.floor(n / least + EPSILON).cast("int"))))
    rows = _other_lengths(rows, lengths, group, "long")
    rows = rows.where("side = 0 or short < `long`").join(frames.withColumn("begin", F.col("skip")), [*group, "side"]).withColumn("edits", F.floor((1 - least) * F.col("long") + EPSILON).cast("int"))
    rows = _framed(rows).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    i, k, rest = F.col("i"), F.col("k"), n - F.col("skip")
    rows = rows.withColumns({"at": F.col("skip") + _start(i, k, rest), "size": _size(i, k, rest)})
    return rows.withColumn("segment", F.substring("t", F.col("at") + 1, F.col("size")))


def _window(row: Callable[[str], Column]) -> tuple[Column, Column, Column]:
    """The places at which segment ``i`` of a text of length ``short`` may stand in one of length ``long``, and the segment's size."""
    i, k, edits, short, long, skip, cost, lead = map(row, ("i", "k", "edits", "short", "long", "skip", "cost", "lead"))
    p, size, more = skip + _start(i, k, short - skip), _size(i, k, short - skip), long - short
    # edits before the segment are at most as many as segments before it, if this is the first one that is whole; likewise behind
    whole = k == edits - cost + 1
    before, behind = i + lead, edits - cost - i
    low = F.when(whole, F.greatest(p - before, p + more - behind)).otherwise(p - edits)
    high = F.when(whole, F.least(p + before, p + more + behind)).otherwise(p + edits)
    return F.greatest(F.lit(0), low).cast("int"), F.least(long - size, high).cast("int"), size


def _probes(texts: DataFrame, least: float, lengths: DataFrame, frames: DataFrame, group: Sequence[str]) -> DataFrame:
    """The places of texts, as the longer ones, at which a segment of a shorter one may stand: ``segments`` (segment, at)."""
    n = F.length("t")
    rows = texts.withColumn("long", n).withColumn("edits", F.floor((1 - least) * n + EPSILON).cast("int"))
    rows = rows.withColumn("short", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(least * n - EPSILON).cast("int")), n)))
    rows = _other_lengths(rows, lengths, group, "short").where("side = 1 or short < `long`")
    rows = rows.join(frames.withColumn("side", 1 - F.col("side")).withColumnRenamed("other", "begin"), [*group, "side"])
    rows = _framed(rows).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    low, high, size = _window(F.col)
    rows = rows.withColumns({"low": low, "high": high, "size": size}).where("low <= high")
    return rows.withColumn("places", F.sequence("low", "high")).drop("low", "high")


def _once(rows: DataFrame) -> DataFrame:
    """A row for each different segment at a text's places."""
    return rows.withColumn("segment", F.explode(F.array_distinct(F.transform("places", lambda at: F.substring(F.col("t"), at + 1, F.col("size"))))))


def _each(rows: DataFrame) -> DataFrame:
    """A row for each place."""
    return rows.withColumn("at", F.explode("places")).withColumn("segment", F.substring("t", F.col("at") + 1, F.col("size")))


def _rest(rows: DataFrame, skip: Column) -> DataFrame:
    """What lies before the segment, from ``skip`` on, and behind it."""
    end = F.col("at") + F.col("size")
    return rows.withColumns({"head": F.substring("t", skip + 1, F.col("at") - skip), "tail": F.substring("t", end + 1, F.length("t"))})


def _second_cut(rows: DataFrame) -> DataFrame:
    """Segments of head and tail together one more than edits, in proportion to their lengths."""
    head, tail, need = F.length("head"), F.length("tail"), F.col("edits") - F.col("cost") + 1
    in_head = F.least(head, F.greatest(need - tail, F.round(need * head / (head + tail)).cast("int")))
    rows = _rest(rows, F.col("skip")).withColumn("kh", in_head).withColumn("kt", need - F.col("kh"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), need - 1)))
    before = F.col("j") < F.col("kh")
    j, k, n = F.when(before, F.col("j")).otherwise(F.col("j") - F.col("kh")), F.when(before, F.col("kh")).otherwise(F.col("kt")), F.when(before, head).otherwise(tail)
    part = F.when(before, F.col("head")).otherwise(F.col("tail"))
    return rows.withColumns({"at2": _start(j, k, n), "size2": _size(j, k, n)}).withColumn("segment2", F.substring(part, F.col("at2") + 1, F.col("size2")))


def _second_probes(rows: DataFrame) -> DataFrame:
    """Places of the second segments in longer texts: they are shifted by no more than the edits. How a shorter text was cut
    follows from the lengths alone."""
    rest = F.col("short") - F.col("skip")
    short_head = _start(F.col("i"), F.col("k"), rest)
    rows = _rest(rows, F.lit(0)).withColumns({"sh": short_head, "st": rest - short_head - F.col("size")})
    need = F.col("edits") - F.col("cost") + 1
    in_head = F.least(F.col("sh"), F.greatest(need - F.col("st"), F.round(need * F.col("sh") / (F.col("sh") + F.col("st"))).cast("int")))
    rows = rows.withColumn("kh", in_head).withColumn("kt", need - F.col("kh")).withColumn("j", F.explode(F.sequence(F.lit(0), need - 1)))
    before = F.col("j") < F.col("kh")
    j, k, n = F.when(before, F.col("j")).otherwise(F.col("j") - F.col("kh")), F.when(before, F.col("kh")).otherwise(F.col("kt")), F.when(before, F.col("sh")).otherwise(F.col("st"))
    rows = rows.withColumns({"p2": F.when(before, F.col("skip")).otherwise(0) + _start(j, k, n), "size2": _size(j, k, n), "part": F.when(before, F.col("head")).otherwise(F.col("tail"))})
    rows = rows.withColumns({"low2": F.greatest(F.lit(0), F.col("p2") - F.col("edits")), "high2": F.least(F.length("part") - F.col("size2"), F.col("p2") + F.col("edits"))}).where("low2 <= high2")
    return rows.withColumn("at2", F.explode(F.sequence("low2", "high2"))).withColumn("segment2", F.substring("part", F.col("at2") + 1, F.col("size2")))


def _met(shorts: DataFrame, longs: DataFrame, group: Sequence[str], slices: DataFrame | None = None) -> DataFrame:
    """Rows of equal keys. With ``slices`` (key, slices), the shorter texts of a key are dealt out in so many."""
    on = [*group, "key"]
    if slices is not None:
        shorts = shorts.join(slices, "key", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("t"), F.col("slices")), F.lit(0)).cast("int"))
        longs = longs.join(slices, "key", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
        on.append("slice")
    # what is behind the common beginnings is less text than the whole, and few pairs are left to be compared in full
    rest = F.when(F.col("room") < F.col("edits"), F.substring(F.col("t"), F.col("begin") + 1, F.length("t")))
    a = shorts.select(*on, F.col("t").alias("x"), F.col("side").alias("x_side"), rest.alias("x_rest"), "room")
    b = longs.select(*on, F.col("t").alias("y"), F.col("side").alias("y_side"), "long", "edits", rest.alias("y_rest"))
    # few bytes make many pairs, so they are spread over as many tasks as shuffles have
    met = spread(a, *on).join(spread(b, *on), on)
    # of texts of one length either may be the shorter one, so only one order is looked at
    met = met.where("x_side <> y_side and (length(x) < `long` or x_side = 0) and (x_rest is null or levenshtein(x_rest, y_rest, room) >= 0)")
    return met.select(*group, "x", "y", "x_side", "y_side", "long", "edits")


def _hot(shorts: DataFrame, longs: DataFrame) -> DataFrame:
    """Keys by which more than ``HOT`` pairs meet, with the slices that the shorter texts need."""
    both = shorts.select("key", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(longs.select("key", F.lit(0).alias("a"), F.lit(1).alias("b")))
    pairs = both.groupBy("key").agg((F.sum("a").cast("double") * F.sum("b")).alias("n")).where(F.col("n") > HOT)
    return pairs.select("key", F.ceil(F.col("n") / HOT).cast("int").alias("slices"))


def _sizes(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups that both sides have, with the slices for all pairs of their different texts, the side that is dealt out, and whether they are ``few``."""
    a, b = (df.groupBy(*group).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_a"), (right, "_b")))
    both = a.join(b, list(group)) if group else a.crossJoin(b)
    pairs = F.col("_a").cast("double") * F.col("_b")
    sizes = both.where("_a > 0 and _b > 0").select(*group, F.ceil(pairs / DIRECT).cast("int").alias("_slices"), (F.col("_a") >= F.col("_b")).alias("_left"), (F.least("_a", "_b") <= FEW).alias("_few"))
    return written(sizes, "similar-sizes")


def _all_pairs(left: DataFrame, right: DataFrame, sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    """Pairs (group, x, y) of all texts ``t`` of the two sides in the groups of ``sizes``."""
    own, each = F.array(F.pmod(F.xxhash64("t"), F.col("_slices")).cast("int")), F.sequence(F.lit(0), F.col("_slices") - 1)

    def side(df: DataFrame, dealt: Column, name: str) -> DataFrame:
        met = df.join(sizes, list(group)) if group else df.crossJoin(F.broadcast(sizes))  # without a group it is one row
        return met.select(*group, F.col("t").alias(name), F.explode(F.when(dealt, own).otherwise(each)).alias("_slice"))

    on = [*group, "_slice"]
    return spread(side(left, F.col("_left"), "x"), *on).join(spread(side(right, ~F.col("_left"), "y"), *on), on).drop("_slice")


def _split(left: DataFrame, right: DataFrame, group: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """All pairs of groups with few texts on one side, and the texts of both sides in other groups; None where there are none."""
    sizes = _sizes(left, right, group)
    kinds = {r[0] for r in sizes.select("_few").distinct().collect()}
    pairs = _all_pairs(left, right, sizes.where("_few"), group) if True in kinds else None
    if False not in kinds:
        return pairs, None, None
    if True in kinds:
        left, right = (df.join(sizes.where("not _few").select(*group), list(group), "left_semi") for df in (left, right))
    return pairs, left, right


def similar_pairs(left: DataFrame, right: DataFrame, group: Sequence[str], least: float, text: str = "t") -> DataFrame:
    """Pairs (group, a, b) of different or equal texts of ``left`` and ``right`` that are ``least`` alike (over 0, up to 1). Both sides have the
    group's columns and ``text``."""
    group = list(group)
    side = lambda df, s: df.select(*group, F.col(text).alias("t")).where("t <> ''").distinct().withColumn("side", F.lit(s))
    # few bytes of names make much work, so they are spread over as many tasks as shuffles have
    spread = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = written(side(left, 0).unionByName(side(right, 1)).repartition(spread, F.xxhash64(*group, "t")), "similar-texts")
    direct, one, other = _split(both.where("side = 0"), both.where("side = 1"), group)
    if direct is not None:
        edits = F.floor((1 - least) * F.greatest(F.length("x"), F.length("y")) + EPSILON).cast("int")
        direct = direct.withColumn("edits", edits).where("levenshtein(x, y, edits) >= 0").select(*group, F.col("x").alias("a"), F.col("y").alias("b"))
    if one is None:
        return both.select(*group, F.col("t").alias("a"), F.col("t").alias("b")).limit(0) if direct is None else direct
    both = one.unionByName(other)
    lengths = both.select(*group, (1 - F.col("side")).alias("side"), F.length("t").alias("n")).distinct()
    # a key is a hash; what a collision brings together, the distance tells apart
    place = ("short", "long", "i", "segment")
    key, to = F.xxhash64("side", *group, *place), F.xxhash64(1 - F.col("side"), *group, *place)  # only texts of the other side meet
    frames = written(_frames(both, group), "similar-frames")
    shorts, places = _cut(both, least, lengths, frames, group).withColumn("key", key), _probes(both, least, lengths, frames, group)
    longs = _once(places).withColumn("key", to)
    hot = written(_hot(shorts, longs), "similar-hot")
    near = F.expr("levenshtein(x, y, edits) >= 0")
    if hot.isEmpty():
        pairs = _met(shorts, longs, group)
    else:
        # texts of a hot key that have enough characters left are refined by a second segment, others are sliced
        own = F.col("edits") - F.col("cost")
        can = (F.col("k") == own + 1) & (F.col("short") - F.col("skip") - F.col("size") > own)
        longs = _each(places).withColumn("key", to)
        shorts, longs = (df.join(hot.select("key", F.lit(True).alias("_hot")), "key", "left").withColumn("hot", F.col("_hot").isNotNull() & can) for df in (shorts, longs))
        key2 = F.xxhash64("key", "j", "segment2").alias("key")
        twice, again = _second_cut(shorts.where("hot")).withColumn("key", key2), _second_probes(longs.where("hot")).withColumn("key", key2)
        pairs = _met(shorts.where("not hot"), longs.where("not hot"), group, hot).unionByName(_met(twice, again, group, written(_hot(twice, again), "similar-hot")))
    of = lambda s: F.when(F.col("x_side") == s, F.col("x")).otherwise(F.col("y"))
    pairs = pairs.where(near).select(*group, of(0).alias("a"), of(1).alias("b")).distinct()
    return pairs if direct is None else pairs.unionByName(direct)


def holding_pairs(left: DataFrame, right: DataFrame, group: Sequence[str], shortest: int, share: float, text: str = "t") -> DataFrame:
    """Pairs (group, a, b) of texts of ``left`` and ``right`` of which one holds the other, which has ``shortest`` characters or more and ``share`` of
    the longer one's: the longer text meets shorter ones by its substrings."""
    group = list(group)
    side = lambda df: df.select(*group, F.col(text).alias("t")).where("t <> ''").distinct()

    def held(shorter: DataFrame, longer: DataFrame) -> DataFrame:
        n = F.length("t")
        low = F.greatest(F.lit(shortest), F.ceil(share * n - EPSILON).cast("int"))
        lengths = side(shorter).select(*group, n.alias("size")).distinct()
        parts = side(longer).where(n >= low).withColumn("size", F.explode(F.sequence(low, n))).join(lengths, [*group, "size"], "left_semi").withColumn("at", F.explode(F.sequence(F.lit(1), n - F.col("size") + 1)))
        parts = parts.select(*group, F.col("t").alias("y"), F.substring("t", F.col("at"), F.col("size")).alias("x")).distinct()
        return side(shorter).where(n >= shortest).withColumnRenamed("t", "x").join(parts, [*group, "x"])

    direct, one, other = _split(side(left), side(right), group)
    if direct is not None:
        x, y = F.length("x"), F.length("y")
        long_enough = (F.least(x, y) >= shortest) & (F.least(x, y) >= F.ceil(share * F.greatest(x, y) - EPSILON))
        direct = direct.where(long_enough & (F.col("x").contains(F.col("y")) | F.col("y").contains(F.col("x")))).select(*group, F.col("x").alias("a"), F.col("y").alias("b"))
    if one is None:
        return side(left).select(*group, F.col("t").alias("a"), F.col("t").alias("b")).limit(0) if direct is None else direct
    left, right = (df.withColumnRenamed("t", text) for df in (one, other))
    one = held(left, right).select(*group, F.col("x").alias("a"), F.col("y").alias("b"))
    found = one.unionByName(held(right, left).select(*group, F.col("y").alias("a"), F.col("x").alias("b"))).distinct()
    return found if direct is None else found.unionByName(direct)
