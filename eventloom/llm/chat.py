"""Cumulative-snapshot collapse of logged conversations, then chat rendering.

A chat log often holds the same conversation again after each turn. Every turn gets the hash
of the conversation up to and with it (an exclusive-or over position-keyed 128-bit turn hashes,
which is a running aggregate); a conversation whose full hash is that of a proper
prefix of another one is a snapshot and goes, by an anti-join. Of conversations that are equal
as a whole, that of the smallest id stays. Only DataFrame functions are used.

Defined results: turns are ordered by (turn, role, text) with nulls first; rows that repeat
all of conversation, turn, role and text are one turn; a null role renders as ``unknown`` and
a null text as an empty one, yet they differ from these strings when conversations are
compared; rows with a null conversation id form a conversation of their own, with a null
id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CHUNK_TURNS = 1024


def _turn_hash(seed: int) -> Column:
    """Hash of role and text; ``xxhash64`` skips nulls, so they are flagged."""
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def turn_table(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every different turn with its chunk of turn numbers, its place in the chunk and its content's hashes, written
    to the shared folder. Texts are shuffled once for this; prefixes are computed from the other columns."""
    turns = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(2**62))))
    # repeats go first and by their whole content, so very many of one turn are no single task's work
    turns = turns.dropDuplicates()
    place = F.row_number().over(Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text"))
    return stored(turns.withColumns({"place": place, "c1": _turn_hash(11), "c2": _turn_hash(29)}), "chat-turns")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv, chunk, place and, of :func:`turn_table`'s rows, the position from 1, the conversation's length and the hash (h1, h2) of
    the prefix that ends there. Windows run over chunks of turn numbers, whose totals
    are carried forward, so one huge conversation isn't one task."""
    turns = turns.select("conv", "chunk", "place", "c1", "c2")
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    keys = ("conv", "chunk")

    def same(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
        return left.join(right, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))).drop("_conv", "_chunk")

    counts = turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("length"))
    placed = same(turns, counts).withColumn("pos", F.col("place") + F.col("before"))
    placed = placed.withColumns({f"t{i}": F.xxhash64(F.lit(i), "pos", "c1", "c2") for i in (1, 2)})
    sums = placed.groupBy(*keys).agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    sums = sums.select(*keys, *(F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in (1, 2)))
    running = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = same(placed, sums)
    return stored(out.select("conv", "chunk", "place", "pos", "length", *(F.bit_xor(f"t{i}").over(running).bitwiseXOR(F.col(f"s{i}")).alias(f"h{i}") for i in (1, 2))), "chat-prefixes")


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """Ids of the conversations that prefix no longer one, one for each different content."""
    key = ["pos", "h1", "h2"]
    proper = prefixes.where("pos < length").groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    final = prefixes.where("pos = length").groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_equal"))
    return final.join(proper, key, "left_anti").select("conv", F.col("pos").alias("n_turns"), "n_equal")


def render_maximal(conversations: DataFrame, **names: str) -> DataFrame:
    """conv_id, n_turns, n_equal (conversations of the same content) and the rendered text
    of each maximal conversation: ``<|role|>`` line, text and ``<|end|>`` for every turn."""
    turns = turn_table(conversations, **names)
    prefixes = prefix_hashes(turns)
    kept = maximal_conversations(prefixes).withColumnRenamed("conv", "_conv")
    parts = turns.select("conv", "chunk", "place", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n")).alias("part"))
    own = parts.join(kept, F.col("conv").eqNullSafe(F.col("_conv")))
    packed = own.groupBy("conv", "n_turns", "n_equal").agg(F.sort_array(F.collect_list(F.struct("chunk", "place", "part"))).alias("parts"))
    return packed.select(F.col("conv").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), "n_equal", F.array_join(F.col("parts.part"), "").alias("text"))
