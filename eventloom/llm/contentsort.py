"""Exact duplicates by a sort of contents.

Texts are compared without the characters ``[\\x20\\x09-\\x0D]``; these normalised bytes are sorted as a whole:

1.  Copies that lie together in the input are packed before anything is shuffled: one row holds the bytes once and the ids
    and lengths of the rows that bear them. Packs are written to the shared folder, so a retried task sees the same packs.
2.  Spark samples splitters and range-partitions the packs by the first bytes, the SHA-256 and a hash of the pack's first id.
    Splitters are short whatever a text's length, texts with a common beginning are told apart by their digest, and a
    group with very many copies is cut by the ids into as many ranges as its share of the sample asks for.
3.  Each range is sorted externally, by the bytes behind the digest too. One pass compares every pack with its neighbour, byte for byte, and numbers the runs of equals.
4.  The last text of a range is compared with the first of the next one, so a run that goes on across ranges is one group.
    There is a row for each range in this step, and none for its documents.

Of equal texts, the row with the most code points before normalisation stays, then that of the smallest id.

Defined results: a null text counts as an empty one, and all rows without a character form a group; a null id comes
after all others and is kept only where all ids of its group are null; of rows that repeat id and text one is
kept; an empty table gives no rows; other columns are ignored, or handed on by :func:`without_copies`. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, stored

SPACES = b"\t\n\x0b\x0c\r "
HEAD_BYTES = 32
PACK_BYTES, PACK_ROWS = 8 << 20, 1 << 16
RANGE_BYTES = 128 << 20


def normalised(text: Column) -> Column:
    """The text that copies share; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES.decode(), "")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def packed_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (first bytes and SHA-256), tie, body (normalised bytes), ids and lens: one row for the equal texts among some
    thousand neighbouring rows, the row to stay first."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = pa.schema([("key", pa.binary()), ("tie", pa.int64()), ("body", pa.binary()), ("ids", pa.list_(_arrow(docs, "id"))), ("lens", pa.list_(pa.int64()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = rows = 0

        def flushed() -> pa.RecordBatch:
            out = []
            for body, own in held.items():
                own.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0) if not isinstance(r[1], str) else (-r[0], False, r[1]))
                ids, lens = [r[1] for r in own], [r[0] for r in own]
                key = body[:HEAD_BYTES].ljust(HEAD_BYTES, b"\0") + hashlib.sha256(body).digest()
                out.append({"key": key, "tie": zlib.crc32(repr(own[0]).encode()), "body": body, "ids": ids, "lens": lens})
            held.clear()
            return pa.RecordBatch.from_pylist(out, schema)

        for batch in batches:
            texts = batch.column(1).fill_null("")
            for doc_id, n, text in zip(batch.column(0).to_pylist(), pc.utf8_length(texts).to_pylist(), texts.cast(pa.binary()), strict=True):
                body = text.as_py().translate(None, SPACES)
                own = held.get(body)
                if own is None:
                    own = held[body] = []
                    size += len(body)
                own.append((n, doc_id))
                rows += 1
                if size > PACK_BYTES or rows > PACK_ROWS:
                    yield flushed()
                    size = rows = 0
        if held:
            yield flushed()

    return stored(docs.mapInArrow(pack, f"key binary, tie long, body binary, ids array<{kind}>, lens array<long>"), "copies-packed")


def sorted_runs(packs: DataFrame) -> DataFrame:
    """part (the range), run, pack (its place in the range), ids, lens and sha256 of every pack in the order of its content; one more row
    for each range, with a null pack, the number of runs and the first and last text."""
    spark = packs.sparkSession
    total = packs.agg(F.sum(F.octet_length("body"))).head()[0] or 0
    n = max(math.ceil(total / RANGE_BYTES), spark.sparkContext.defaultParallelism)
    kind = packs.schema["ids"].dataType.simpleString()
    schema = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("pack", pa.int64()), ("ids", _arrow(packs, "ids")), ("lens", pa.list_(pa.int64())), ("sha256", pa.string()), ("first", pa.binary()), ("last", pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run, pack, first, last = TaskContext.get().partitionId(), -1, 0, None, None
        for batch in batches:
            runs = []
            for body in batch.column(1):
                body = body.as_py()
                if body != last:
                    run += 1
                    first = body if first is None else first
                    last = body
                runs.append(run)
            k = batch.num_rows
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(runs, pa.int64()), pa.array(range(pack, pack + k), pa.int64()), batch.column(2), batch.column(3), pa.array([x[HEAD_BYTES:].hex() for x in keys]), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=schema)
            pack += k
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "run": run + 1, "first": first, "last": last}], schema)

    dealt = packs.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "body", "tie").select("key", "body", "ids", "lens")
    return stored(dealt.mapInArrow(compare, f"part int, run long, pack long, ids {kind}, lens array<long>, sha256 string, first binary, last binary"), "copies-sorted")


def runs_across_ranges(runs: DataFrame) -> DataFrame:
    """part, run and the (root_part, root_run) that they belong to, for runs that go on over a border of ranges; at most two rows a range."""
    edges = runs.where("pack is null").select("part", F.col("run").alias("n_runs"), "first", "last")
    order = Window.orderBy("part")  # one small row for each range
    line = edges.select("part", F.lag("part").over(order).alias("prev"), F.lag("n_runs").over(order).alias("prev_runs"))
    lasts = edges.select(F.col("part").alias("prev"), "last")
    tied = edges.select("part", "first").join(line, "part").join(lasts, "prev", "left")
    tied = tied.select("part", "prev", "prev_runs", F.coalesce(F.col("first") == F.col("last"), F.lit(False)).alias("goes_on"))
    anchor = F.when(~F.col("goes_on"), F.struct(F.col("part").alias("p"), F.lit(0).cast("long").alias("r"))).when(F.col("prev_runs") > 1, F.struct(F.col("prev").alias("p"), (F.col("prev_runs") - 1).alias("r")))
    rooted = tied.select("part", "goes_on", F.last(anchor, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("root")).where("goes_on")
    root = [F.col("root.p").alias("root_part"), F.col("root.r").alias("root_run")]
    members = rooted.select("part", F.lit(0).cast("long").alias("run"), *root)
    return members.unionByName(rooted.select(F.col("root.p").alias("part"), F.col("root.r").alias("run"), *root).distinct())


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_chars of every row."""
    runs = sorted_runs(packed_copies(documents, id_col, text_col))
    across = stored(runs_across_ranges(runs), "copies-across")
    # a pack's first row is its best: longest, then smallest id
    best = F.struct((-F.col("lens")[0]).alias("neg_len"), F.col("ids")[0].isNull().alias("no_id"), F.col("ids")[0].alias("id"), F.col("part").alias("at_part"), "pack")
    packs = runs.where("pack is not null").select("part", "run", "pack", "ids", "lens", "sha256", F.size("ids").cast("long").alias("n"), best.alias("best"))
    own = Window.partitionBy("part", "run")  # within one range, and ranges are of bounded bytes
    roots = packs.join(F.broadcast(across), ["part", "run"]).groupBy("root_part", "root_run").agg(F.sum("n").alias("all_n"), F.min("best").alias("all_best"))
    known = F.broadcast(across.join(roots, ["root_part", "root_run"]).drop("root_part", "root_run"))
    told = packs.withColumns({"n": F.sum("n").over(own), "best": F.min("best").over(own)}).join(known, ["part", "run"], "left")
    told = told.select("part", "pack", "ids", "lens", "sha256", F.coalesce("all_n", "n").alias("n"), F.coalesce("all_best", "best").alias("best"))
    rows = told.select("part", "pack", "sha256", "n", "best", F.posexplode(F.arrays_zip("ids", "lens")).alias("at", "row"))
    kept = (F.col("part") == F.col("best.at_part")) & (F.col("pack") == F.col("best.pack")) & (F.col("at") == 0)
    return rows.select(F.col("row.ids").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha256").alias("text_sha256"), F.col("row.lens").alias("n_chars"))


def without_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    digest, chars = free_name(documents.columns, "_digest"), free_name(documents.columns, "_chars")
    kept = exact_groups(documents, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_digest"), F.col("n_chars").alias("_kept_chars"))
    own = documents.withColumns({digest: F.sha2(normalised(F.col(text_col)), 256), chars: F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")})
    same = F.col(digest).eqNullSafe(F.col("_kept_digest")) & (F.col(chars) == F.col("_kept_chars")) & F.col(id_col).eqNullSafe(F.col("_kept_id"))
    return own.join(kept, same, "left_semi").dropDuplicates([id_col, digest, chars]).select(documents.columns)


def copies_query(documents: DataFrame) -> DataFrame:
    bounded_batches(documents.sparkSession)
    return exact_groups(documents).drop("n_chars")
