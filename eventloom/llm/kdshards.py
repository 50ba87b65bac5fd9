"""Sharding by a k-d tree of weighted medians.

The rows of a node are split along its widest metadata dimension at the weighted median
(weight: bytes of the row), again and again, until every leaf has its target of bytes. The
law that holds is ``bytes``: shards differ by about the size of one row for each level.

The median is exact and found without sorting or gathering rows: a row's order is a
62-bit key (31 bits of the scaled dimension, 31 of a hash that breaks ties), bytes are
summed by 16 bits of it for all nodes at once, and only the crossing bin is looked at further. Rows that
share the whole key, such as repeats of one row, are split by 16 bits of a hash of their number in the stored table.

A node is the run of shards that it still has to be split to, so the tree lives in the rows; the driver
sees a row for each node of a level while these are at most ``FEW_NODES``, and none of them beyond.

Groups of equal texts aren't kept whole: an id is one of the dimensions, so a group is cut wherever its ids are. That is
what keeps the law where one group holds a third of all rows; the README says how many groups it cuts.

Defined results: a null text has no bytes and so size 1 and crc 0; nulls in a dimension sort
first; rows that repeat an id and a text are split like others, and which of them goes where is open; fewer rows than
shards leave shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DIGIT_BITS = 16
SLOT_ROWS = 20_000
FEW_NODES = 10_000


def _text_place(name: str) -> Column:
    """A string's place in byte order, from its first six bytes."""
    first = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0")
    return F.conv(first, 16, 10).cast("double")


def metadata(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", numbers: tuple[str, ...] = ("doc_id",), strings: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, dimensions d0.. scaled to 31 bits, and the tie-breaking hash.
    The first dimension is the logarithm of the size; all texts are read once, here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *(F.col(c).cast("double").alias(f"n_{c}") for c in numbers), *(_text_place(c).alias(f"s_{c}") for c in strings),
    )
    rows = stored(rows.withColumn("log_size", F.log2("size")), "kd-rows")
    dims = ["log_size", *(f"n_{c}" for c in numbers), *(f"s_{c}" for c in strings)]
    bounds = rows.agg(*(f(F.coalesce(F.col(d), F.lit(0.0))).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).head()
    scaled = {}
    for i, d in enumerate(dims):
        lo, hi = bounds[f"lo_{d}"] or 0.0, bounds[f"hi_{d}"] or 0.0
        scaled[f"d{i}"] = F.least(F.floor((F.coalesce(F.col(d), F.lit(lo)) - lo) / ((hi - lo) or 1.0) * (2**31 - 1)), F.lit(2**31 - 1)).cast("long")
    tie = F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit(2**31 - 1))
    return rows.withColumns(scaled).select("row", "doc_id", "size", "text_crc32", *scaled, tie.alias("tie"))


def _small(table: DataFrame, n_rows: int, name: str) -> DataFrame:
    """A table of at most ``n_rows`` rows that is computed once: a local, broadcast one if it has few, a stored one else."""
    if n_rows > FEW_NODES:
        return stored(table, name)
    return F.broadcast(table.sparkSession.createDataFrame(table.collect(), table.schema))


def weighted_medians(rows: DataFrame, goals: DataFrame, n_nodes: int) -> DataFrame:
    """node, split, spread: the largest key of the left part, and the largest number hash that this key's rows
    may have in it. ``rows`` has node, key, row, size; ``goals`` node and goal, the bytes that the left part should hold."""
    digit_of = {shift: F.shiftright("key", shift).bitwiseAND(F.lit(2**DIGIT_BITS - 1)) for shift in (48, 32, 16, 0)} | {-1: spread_of()}
    found = goals.select("node", "goal", F.lit(0).cast("long").alias("prefix"), F.lit(2).cast("long").alias("n"), F.lit(2**DIGIT_BITS - 1).cast("long").alias("digit"))
    for shift, digit in digit_of.items():
        inside = rows.join(found.drop("digit"), "node")
        if 0 <= shift < 48:
            inside = inside.where(F.shiftright("key", shift + DIGIT_BITS) == F.col("prefix"))
        elif shift < 0:
            inside = inside.where((F.col("key") == F.col("prefix")) & (F.col("n") > 1))
        bins = inside.groupBy("node", digit.alias("digit"), "goal", "prefix").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        bins = bins.withColumn("upto", F.sum("bytes").over(Window.partitionBy("node").orderBy("digit")))
        # the bin that crosses the goal; the last one where rounding leaves the goal above all
        own = F.struct("digit", "upto", "bytes", "goal", "prefix", "n")
        at = bins.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("goal"), own)), F.max(own)).alias("at"))
        at = at.select("node", (F.col("at.goal") - F.col("at.upto") + F.col("at.bytes")).alias("goal"), *(F.col(f"at.{c}").cast("long").alias(c) for c in ("prefix", "n", "digit")))
        if shift >= 0:
            at = at.withColumn("prefix", F.shiftleft("prefix", DIGIT_BITS) + F.col("digit"))
            found = _small(at.withColumn("digit", F.lit(2**DIGIT_BITS - 1).cast("long")), n_nodes, "kd-found")
        else:  # keys of one row alone have no bins here
            last = at.select("node", F.col("digit").alias("spread"))
            return found.join(last, "node", "left").select("node", F.col("prefix").alias("split"), F.coalesce("spread", "digit").alias("spread"))


def spread_of() -> Column:
    return F.xxhash64(F.lit("spread"), "row").bitwiseAND(F.lit(2**DIGIT_BITS - 1))


def kd_leaves(meta: DataFrame, n_shards: int) -> DataFrame:
    """Adds ``shard``: the leaf of each row, from 0 to n_shards - 1 in tree order. A node is the number of its
    first shard; ``k`` is how many it has."""
    dims = [c for c in meta.columns if c.startswith("d") and c[1:].isdigit()]
    # written with its first node, so that no later join sees a constant in place of a key
    rows = stored(meta.withColumns({"node": F.lit(0).cast("long"), "k": F.lit(n_shards).cast("long")}), "kd-level0")
    for level in range(math.ceil(math.log2(n_shards)) if n_shards > 1 else 0):
        n_nodes = min(2**level, n_shards)
        ranges = F.array(*(F.max(d) - F.min(d) for d in dims))
        nodes = rows.where("k > 1").groupBy("node", "k").agg(F.sum("size").alias("bytes"), ranges.alias("ranges"))
        nodes = nodes.select("node", "k", F.array_position("ranges", F.array_max("ranges")).cast("int").alias("dim"), (F.col("bytes") * F.ceil(F.col("k") / 2) / F.col("k")).alias("goal"))
        nodes = _small(nodes, n_nodes, "kd-nodes")
        key = (F.shiftleft(F.element_at(F.array(*dims), F.col("dim")), 31) + F.col("tie")).alias("key")
        keyed = rows.join(nodes.select("node", "dim"), "node").select("node", key, "row", "size")
        splits = _small(weighted_medians(keyed, nodes.select("node", "goal"), n_nodes).join(nodes.select("node", "dim"), "node"), n_nodes, "kd-splits")
        left = F.col("split").isNull() | (key < F.col("split")) | ((key == F.col("split")) & (spread_of() <= F.col("spread")))
        half = F.ceil(F.col("k") / 2)
        moved = rows.join(splits, "node", "left").withColumn("left", left)
        moved = moved.select("row", "doc_id", "size", "text_crc32", *dims, "tie", F.when(F.col("left"), F.col("node")).otherwise(F.col("node") + half).alias("node"), F.when(F.col("left"), half).otherwise(F.col("k") - half).alias("k"))
        rows = stored(moved, f"kd-level{level + 1}")
    return rows.withColumn("shard", F.col("node").cast("int")).drop("node", "k")


def gapless_slots(rows: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: rows are numbered in hash buckets of
    about ``SLOT_ROWS`` rows, and the counts of earlier buckets are added."""
    buckets = max(1, math.ceil(n_rows / n_shards / SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "row")
    return rows.withColumn("_at", F.row_number().over(own)).join(counts, ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("_at") - 1).cast("long")).drop("_at", "before", "bucket")


def kd_shards(documents: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, **names) -> DataFrame:
    """Puts all rows to shards of equal bytes: ``n_shards`` of them, or as many as leave
    ``target_bytes`` to each."""
    meta = metadata(documents, **names)
    total = meta.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).head()
    if n_shards is None:
        n_shards = max(1, math.ceil((total["bytes"] or 0) / target_bytes))
    placed = gapless_slots(kd_leaves(meta, n_shards), total["n"], n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
