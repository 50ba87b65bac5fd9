"""The prefix trie of all conversations, built and rolled up level by level.

1.  Conversations are rebuilt: their first turns are those of their block's first conversation. A turn is the SHA-256 of its role and text and
    a number of code points, so no text is shuffled.
2.  Conversations that are equal as a whole are grouped first and go on as one row with a count, however many they are.
3.  Down: at each depth the live conversations are grouped by (parent node, next turn), and a group is a node named by its smallest
    member. Groups that hold a large share of all rows, of which there can be few, are looked up by broadcast, the rest by a join. A
    conversation that is alone in its node is not live any longer: its remaining nodes form a chain, read off its turns. So there are as many rounds as the deepest prefix
    that two different conversations share has turns.
4.  Up: from the deepest level, children are summed by parent and joined to the level above.

Every level is written to the shared folder. Long conversations are cut into blocks of ``BLOCK`` turns wherever rows meet
by conversation.

Defined results: turns are ordered by (turn, digest of role and text), null turns first; null roles and texts are empty; rows that
repeat all of another are turns of their own; rows with a null conversation id name no conversation and are left out;
an empty table gives no rows, not even a root; other columns are ignored. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

BLOCK = 4096
TURN_RANGE = 1024
HEAVY_SHARE, HEAVY_ROWS = 256, 4096
NOBODY = hashlib.sha256(b"").hexdigest()


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def rebuilt_turns(conversations: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv, n) of every conversation, and (conv, pos, digest, chars) of its turns after the first ``crc32(conv) % most`` are
    replaced by those of the first conversation of its ``block``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("turn") / TURN_RANGE), _long(-(2**62))))
    # conversations are numbered range by range, and the counts of earlier ranges are added
    counts = rows.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("own"))
    w = Window.partitionBy("conv")
    counts = counts.select("conv", "range", F.coalesce(F.sum("own").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), _long(0)).alias("before"), F.sum("own").over(w).alias("own_n"))
    heads = counts.select("conv", "own_n").distinct()
    bases = heads.where(F.col("conv") % block == 0).select(F.col("conv").alias("base"), F.col("own_n").alias("base_n"))
    taken = F.crc32(F.col("conv").cast("string")) % most
    told = counts.withColumns({"base": F.col("conv") - F.col("conv") % block, "h": taken}).join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", _long(0)))).drop("base_n")
    told = stored(told, "trie-counts")
    place = F.row_number().over(Window.partitionBy("conv", "range").orderBy("turn", "digest"))
    own = rows.withColumn("_at", place).join(told.drop("base"), ["conv", "range"])
    own = stored(own.select("conv", (F.col("_at") + F.col("before")).alias("own_pos"), "h", "taken", "digest", "chars"), "trie-turns")
    convs = told.select("conv", "base", "h", (F.col("taken") + F.greatest(F.col("own_n") - F.col("h"), _long(0))).alias("n")).distinct()
    firsts = own.where((F.col("own_pos") < most) & (F.col("conv") % block == 0)).select(F.col("conv").alias("base"), F.col("own_pos").alias("pos"), "digest", "chars")
    begun = convs.where("h > 0").select("conv", "base", "h").join(firsts, "base").where("pos <= h").select("conv", "pos", "digest", "chars")
    rest = own.where("own_pos > h").select("conv", (F.col("own_pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    return convs.select("conv", "n"), begun.unionByName(rest)


def _joined_digests(parts: DataFrame) -> DataFrame:
    """rep and the SHA-256 of its parts, comma-joined in their order: one stream for a rep, of which a part is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, sha = None, None
        for batch in batches:
            reps, out = [], []
            for own, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != rep:
                    if sha is not None:
                        reps.append(rep)
                        out.append(sha.hexdigest())
                    rep, sha = own, hashlib.sha256(part.encode())
                else:
                    sha.update(b"," + part.encode())
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(out)], names=["conv", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([sha.hexdigest()])], names=["conv", "ends_sha256"])

    return parts.repartition("conv").sortWithinPartitions("conv", "part").select("conv", "ids").mapInArrow(run, "conv long, ends_sha256 string")


def distinct_conversations(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv (the smallest of equal conversations), m (how many), n (turns) and the SHA-256 of their ids."""
    keys = ["n", "s1", "s2"]
    hashes = turns.select("conv", *(F.xxhash64(F.lit(i), "pos", "digest").alias(f"s{i}") for i in (1, 2))).unionByName(convs.select("conv", F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2")))
    whole = hashes.groupBy("conv").agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2")).join(convs, "conv")
    parts = whole.groupBy(*keys, F.floor(F.col("conv") / BLOCK).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"), F.count(F.lit(1)).alias("m"), F.min("conv").alias("conv"))
    parts = stored(parts, "trie-parts")
    groups = stored(parts.groupBy(*keys).agg(F.min("conv").alias("rep"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("k"), F.min("ids").alias("ids")), "trie-groups")
    few = groups.where("k = 1").select(F.col("rep").alias("conv"), "m", "n", F.sha2("ids", 256).alias("ends_sha256"))
    many = groups.where("k > 1")
    long = _joined_digests(parts.drop("m", "conv").join(many.select(*keys, F.col("rep").alias("conv")), keys).select("conv", "part", "ids"))
    return stored(few.unionByName(many.select(F.col("rep").alias("conv"), "m", "n").join(long, "conv")), "trie-distinct")


def _blocks(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))).alias("block")


def turn_table(distinct: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns of the distinct conversations in order of depth, with m, n and the code points from each turn to the end."""
    turns = turns.withColumn("block", F.floor(F.col("pos") / BLOCK))
    live = distinct.where("n > 0").select("conv", "m", "n", _blocks(_long(0), F.col("n")))
    sums = turns.groupBy("conv", "block").agg(F.sum("chars").alias("own"))
    later = F.coalesce(F.sum("own").over(Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), _long(0))
    sums = live.join(sums, ["conv", "block"]).withColumn("later", later).drop("own")
    after = F.sum("chars").over(Window.partitionBy("conv", "block").orderBy(F.desc("pos")))
    whole = turns.join(sums, ["conv", "block"]).withColumn("chars_from", F.col("later") + after).drop("later")
    return stored(whole.repartitionByRange("pos", "conv").sortWithinPartitions("pos"), "trie-table")


def _live(step: DataFrame, nodes: DataFrame, depth: int, n_rows: int) -> DataFrame:
    """Conversations that go on below a node of several, with that node."""
    shared = nodes.where((F.col("seqs") > 1) & (F.col("deepest") > depth)).select("node", "digest", F.col("conv_id").alias("child"), "seqs")
    limit = max(HEAVY_ROWS, n_rows // HEAVY_SHARE)  # no more than HEAVY_SHARE groups can be larger
    heavy = F.broadcast(shared.where(F.col("seqs") > limit).drop("seqs"))
    step = step.where(F.col("n") > depth).join(heavy, ["node", "digest"], "left")
    rest = step.where("child is null").drop("child").join(shared.where(F.col("seqs") <= limit).drop("seqs"), ["node", "digest"])
    columns = ["conv", F.col("child").alias("node"), "m", "n"]
    return step.where("child is not null").select(*columns).unionByName(rest.select(*columns))


def _rolled_up(level: DataFrame, below: DataFrame | None, depth: int) -> DataFrame:
    """Children, leaves and savings of a level from those of the level below."""
    own = (F.col("n_convs") - 1) * F.col("chars")
    chain = {"n_children": F.when((F.col("seqs") == 1) & (F.col("deepest") > depth), 1).otherwise(0).cast("long"), "n_leaves": _long(1), "saved_tokens": F.when(F.col("seqs") == 1, (F.col("n_convs") - 1) * F.col("chars_from")).otherwise(own)}
    if below is None:
        return level.withColumns(chain)
    kids = below.groupBy("node").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    joined = level.join(kids.withColumnRenamed("node", "conv_id"), "conv_id", "left").withColumns(chain)
    has = F.col("kids").isNotNull() & (F.col("seqs") > 1)
    return joined.withColumns({"n_children": F.when(has, F.col("kids")).otherwise(F.col("n_children")), "n_leaves": F.when(has, F.col("leaves")).otherwise(F.col("n_leaves")), "saved_tokens": F.when(has, own + F.col("saved")).otherwise(F.col("saved_tokens"))}).drop("kids", "leaves", "saved")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``convs`` (conv, n) and ``turns`` (conv, pos from 1, digest, chars)."""
    distinct = distinct_conversations(convs, turns)
    table = turn_table(distinct, turns)
    least, n_rows = distinct.agg(F.min("conv"), F.count(F.lit(1))).head()
    root = distinct.agg(F.min("conv").alias("conv_id"), F.sum("m").alias("n_convs"), F.count(F.lit(1)).alias("seqs"), F.max("n").alias("deepest"), F.min(F.when(F.col("n") == 0, F.col("conv"))).alias("ends")).where("seqs > 0")
    # a root above a single conversation has a child like any other, which the chain rule would give too
    root = root.withColumns({"node": F.lit(None).cast("long"), "chars": _long(0), "chars_from": _long(0), "depth": _long(0), "seqs": F.col("seqs") + 1})
    levels = [stored(root, "trie-level0")]
    live = distinct.where("n > 0").select("conv", F.lit(least).cast("long").alias("node"), "m", "n")
    depth = 0
    while not levels[-1].where((F.col("seqs") > 1) & (F.col("deepest") > depth)).isEmpty():
        depth += 1
        step = stored(live.join(table.where(F.col("pos") == depth).select("conv", "digest", "chars", "chars_from"), "conv"), "trie-step")
        grouped = step.groupBy("node", "digest").agg(F.min("conv").alias("conv_id"), F.sum("m").alias("n_convs"), F.count(F.lit(1)).alias("seqs"), F.max("n").alias("deepest"), F.min(F.when(F.col("n") == depth, F.col("conv"))).alias("ends"), F.max("chars").alias("chars"), F.max("chars_from").alias("chars_from"))
        levels.append(stored(grouped.withColumn("depth", _long(depth)), "trie-level"))
        live = _live(step, levels[-1], depth, n_rows)
    done, below = [], None
    for d in range(depth, -1, -1):
        below = stored(_rolled_up(levels[d].drop("digest"), below, d), "trie-up")
        done.append(below)
    nodes = done[0]
    for level in done[1:]:
        nodes = nodes.unionByName(level)
    ends = distinct.select(F.col("conv").alias("ends"), "ends_sha256")
    columns = ["conv_id", "depth", F.col("node").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    named = nodes.where("ends is not null").join(ends, "ends").unionByName(nodes.where("ends is null").withColumn("ends_sha256", F.lit(NOBODY)), allowMissingColumns=True).select(*columns)
    alone = nodes.where((F.col("seqs") == 1) & (F.col("deepest") > F.col("depth"))).select(F.col("conv_id").alias("conv"), "depth", "deepest")
    alone = alone.join(distinct.select("conv", "ends_sha256"), "conv").select("conv", "depth", "ends_sha256", _blocks(F.col("depth") + 1, F.col("deepest")))
    chain = table.join(alone, ["conv", "block"]).where("pos > depth")
    chain = chain.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.col("conv").alias("parent_conv_id"), F.col("m").alias("n_convs"), (F.col("pos") < F.col("n")).cast("long").alias("n_children"), _long(1).alias("n_leaves"), ((F.col("m") - 1) * F.col("chars_from")).alias("saved_tokens"), F.when(F.col("pos") == F.col("n"), F.col("ends_sha256")).otherwise(NOBODY).alias("ends_sha256"))
    return named.unionByName(chain)


def trie_query(conversations: DataFrame) -> DataFrame:
    bounded_batches(conversations.sparkSession)
    return prefix_trie(*rebuilt_turns(conversations))
