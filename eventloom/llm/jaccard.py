"""Exact Jaccard join of word-shingle sets in metric space, and its components.

Jaccard distance is a metric, so a pivot bounds the distance of any two documents whose
distances to it are known. For high-dimensional sets nearly all distances are 1, and pivots
drawn at random separate nothing. So pivots are taken where documents can be close at all:

1.  Shingles are ordered (frequent ones later, else by hash), and a document's first
    ``n - ceil(t n) + 1`` are its boundary: documents linked at similarity t share one of it.
    Of the documents that share a boundary shingle those stay that counts of shingles in 64 hash ranges let link with another of them:
    in large tables most share one by chance. All that stay meet at one pivot, that of them which meets most
    others. The documents that reach a pivot form its Voronoi region; documents at the border of several regions are in each.
2.  Distances to the pivot decide who links to it. Counts of shingles in 256 hash ranges
    are distances to 256 more pivots; where these alone exclude a link, the sets aren't fetched.
3.  What is left of a region are pairs of documents in different components, and of these only
    pairs that the triangle inequality allows, |d(x, p) - d(y, p)| <= 1 - t. A region of over ``LEAF`` of them
    is split: pivots are drawn from what is left, every document goes to the cell of its nearest pivot, and to the others that its
    window reaches, d(x, p) <= d(x, nearest) + 2 (1 - t), so that two linked documents meet in a cell. Cells are regions again, and
    steps 2 and 3 repeat on them as long as they shrink. What fits, or doesn't shrink any more, is joined
    block by block with exact counts.

No link between different texts is lost: every linked pair is in one region, and in it either
has a pivot, or is compared, or its documents are in one component already. Equal sets are one
node from the start. Which shingles are frequent is kept in bitmaps of bounded size; a
collision in one moves a shingle back in the order for all documents alike, which can't
change the result.

Shingles are hashed to 64 bits, sets to 63.

Defined results: a null or empty text has no shingles and is linked with nothing; a text of fewer
words than a shingle has one, its whole sequence; rows that repeat a doc_id are documents of their
own; a null doc_id never names a component unless all ids of it are null; an empty
table gives no rows; other columns are ignored. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, hashed_words, holding, rows_of, stored, windows
from .components import components

MAP_BITS = 23  # a bitmap has 2**23 bits, one MiB
MOST_MAP_BITS = 26  # of tables of more than MAP_ROWS documents, twice as many for each doubling
MAP_ROWS = 1 << 18
FREQUENT = (3, 16, 128)  # boundaries that hold a shingle, for each class of the order
SKETCH = 256
COARSE = 64
LEAF = 1024
NARROW = 8192
PIVOTS = 8  # of a region that is split
DEPTH = 6
SHRINKS = 0.8  # a split is worth another one if no cell has over this share of its region
GROUP_ROWS = 20_000
HOT_KEYS = 1024
BLOCK = 256
ONE = np.ones(1, bool)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of all runs of ``width`` words, or of the
    whole if it has fewer."""
    words, at = hashed_words(texts)
    runs, at = windows(words, width) if len(words) >= width else words[:0], at.tolist()
    out = []
    for a, b in zip(at, at[1:], strict=False):
        s = np.sort(runs[a : b - width + 1] if b - a >= width else windows(words[a:b], b - a) if b > a else words[:0])
        out.append(s[np.concatenate((ONE, s[1:] != s[:-1]))] if len(s) > 1 else s)
    return out


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big") >> 1


def boundary(shingles: np.ndarray, percent: int, frequent: list[np.ndarray], stretch: float = 1) -> np.ndarray:
    """The first ``n - ceil(percent n / 100) + 1`` shingles, frequent ones last."""
    n = len(shingles)
    size = n + 1 + (-percent * n) // 100
    if frequent:
        place = sum(_marked(bits, shingles).astype(np.int8) for bits in frequent)
        if place.any():
            shingles = shingles[np.argsort(place, kind="stable")]
    return shingles[: int(size * stretch)]


def map_bits(rows: int) -> int:
    return min(MOST_MAP_BITS, MAP_BITS + (max(0, rows - 1) // MAP_ROWS).bit_length())


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(62 - len(bits).bit_length())).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def sketch(shingles: np.ndarray) -> bytes:
    """Shingles in each of 256 hash ranges, 255 at most. The sum of differences of two sketches is
    at most the number of shingles in one set alone."""
    return np.minimum(np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def _counts(sketches, size: int = SKETCH) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, size).astype(np.int16)


def coarse(sketches: pd.Series) -> pd.Series:
    """Sketches of 64 hash ranges; they bound as those of 256 do, less closely."""
    return pd.Series([c.tobytes() for c in np.minimum(_counts(sketches).reshape(-1, COARSE, SKETCH // COARSE).sum(axis=2), 255).astype(np.uint8)], dtype=object)


def _sets(documents: DataFrame, width: int, emit, schema: str, ids=None) -> DataFrame:
    """``emit((doc_id, text_hash), node, shingles, seen)`` gives a row or None for each document. With ``ids``, a
    broadcast bitmap of hashed doc_ids, only documents in it are looked at."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("jaccard")
        seen = set()
        for batch in batches:
            if ids is not None:
                batch = batch.filter(pa.array(_marked(ids.value, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))))
            for a in range(0, batch.num_rows, 500):
                part, out = batch.slice(a, 500), []
                for doc_id, text_hash, shingles in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(part.column(1), width), strict=True):
                    if len(seen) > 200_000:
                        seen.clear()
                    if (row := emit((doc_id, text_hash), node_of(shingles) if len(shingles) else None, shingles, seen)) is not None:
                        out.append(row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], names=[f for f, _ in fields])

    hashed = [] if ids is None else [F.xxhash64("doc_id").alias("id_hash")]
    return documents.select("doc_id", "text", "text_hash", *hashed).mapInArrow(run, schema)


def _first_keys(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """key: shingles that may be in a boundary, of each different set that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("jaccard")
        seen = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                out = []
                for shingles in shingle_sets(batch.column(0).slice(a, 500), width):
                    if len(seen) > 200_000:
                        seen.clear()
                    if len(shingles) and (node := node_of(shingles)) not in seen:
                        seen.add(node)
                        out.append(boundary(shingles, percent, [], 1.3))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["key"])

    return documents.select("text").mapInArrow(run, "key long")


def _exploded(rows: DataFrame, wanted=None) -> DataFrame:
    """node, key for each boundary shingle in ``keys``; ``wanted``: a broadcast bitmap to look them up in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("jaccard")
        for nodes, keys in rows_of(batches, "node", "keys"):
            for a in range(0, len(nodes), 500):
                counts = np.array([len(k) // 8 for k in keys[a : a + 500]])
                flat = np.frombuffer(b"".join(keys[a : a + 500]), np.uint64)
                owner = np.repeat(np.array(nodes[a : a + 500], np.int64), counts)
                if wanted is not None:
                    own = _marked(wanted.value, flat)
                    flat, owner = flat[own], owner[own]
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(flat.view(np.int64))], names=["node", "key"])

    return rows.select("node", "keys").mapInArrow(run, "node long, key long")


def _bitmaps(keys: DataFrame, *conditions, size: int = MAP_BITS) -> list[np.ndarray]:
    """A bitmap of 2**size bits for each condition of the keys that meet it: at most eight MiB each to the driver."""
    bit = F.shiftrightunsigned("key", 64 - size)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - size}) & 31 as int))")
    words = keys.groupBy(F.shiftright(bit, 5).cast("int").alias("word")).agg(*(F.bit_or(F.when(c, mask).otherwise(F.lit(0))).alias(f"b{i}") for i, c in enumerate(conditions)))
    got, out = words.toArrow(), []
    for i in range(len(conditions)):
        bits = np.zeros(1 << (size - 5), "<u4")
        bits[got["word"].to_numpy()] = got[f"b{i}"].to_numpy().astype(np.uint32)
        out.append(bits.view(np.uint8))
    return out


def _keyed(rows: DataFrame, table: DataFrame, columns: list[str], groups: DataFrame) -> DataFrame:
    """``rows`` (node, key) with the columns that ``table`` has for their key, for keys it has. Keys of over one in ``HOT_KEYS`` of all rows are
    fewer than ``HOT_KEYS``: their part of the table is broadcast, and their rows are dealt by node."""
    total = groups.agg(F.sum("size")).head()[0] or 0
    hot = groups.where(F.col("size") * HOT_KEYS > total).select("key")
    few = table.join(F.broadcast(hot), "key", "left_semi").select("key", *(F.col(c).alias(f"_hot_{c}") for c in columns), F.lit(True).alias("_hot"))
    told = rows.join(F.broadcast(few), "key", "left").withColumn("_deal", F.when(F.col("_hot"), F.xxhash64("node").bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    found = told.join(table.select("key", *columns, F.lit(0).cast("long").alias("_deal")), ["key", "_deal"], "left")
    found = found.withColumns({c: F.coalesce(f"_hot_{c}", c) for c in columns}).where(F.col(columns[0]).isNotNull())
    return found.select("key", "node", *(c for c in rows.columns if c not in ("key", "node")), *columns)


def _of_nodes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sets whose node is in a bitmap of ``nodes``, so that few others are shuffled in a join with these."""
    keys = nodes.select(F.shiftleft(nodes.columns[0], 1).alias("key"))  # nodes have 63 bits, keys 64
    wanted = sets.sparkSession.sparkContext.broadcast(_bitmaps(keys, F.lit(True))[0])
    keep = F.pandas_udf(lambda n: pd.Series(_marked(wanted.value, n.to_numpy(np.int64).view(np.uint64) << np.uint64(1))), "boolean")
    return sets.where(keep("node"))


def _linked(inter: np.ndarray, a, b, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pivot, node, n, m (set sizes) and inter (common shingles) for pairs (pivot, node)."""
    sets = _of_nodes(sets, pairs.select("node").union(pairs.select("pivot")))
    right = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("theirs"))
    rows = pairs.join(sets.select("node", F.col("shingles").alias("own")), "node").join(right, "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("jaccard")
        for batch in batches:
            n = batch.num_rows
            own, theirs = batch.column(batch.schema.get_field_index("own")), batch.column(batch.schema.get_field_index("theirs"))
            a = np.empty((3, n), np.int64)
            for i in range(n):
                x, y = np.frombuffer(own[i].as_buffer(), np.uint64), np.frombuffer(theirs[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    at = np.searchsorted(x, y)
                    inter = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                else:
                    at = np.searchsorted(y, x)
                    inter = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                a[:, i] = len(x), len(y), inter
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("pivot")), batch.column(batch.schema.get_field_index("node")), *(pa.array(r) for r in a)], names=["pivot", "node", "n", "m", "inter"])

    return rows.select("pivot", "node", "own", "theirs").mapInArrow(run, "pivot long, node long, n long, m long, inter long")


def _block_links(percent: int):
    """Links between the members of two blocks of a region that are in different components,
    as a spanning forest. Common shingles are counted by products of 0/1 matrices."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "left"]).reset_index(drop=True)
        sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
        owner = owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        left, right = np.flatnonzero(pdf["left"]), np.flatnonzero(pdf["right"])
        inter = np.zeros((len(left), len(right)), np.int64)
        width = 4096
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            m = np.zeros((len(sets), width), np.float32)
            m[owner[lo:hi], column[lo:hi] - a] = 1
            inter += (m[left] @ m[right].T).astype(np.int64)
        comp, dist, node = pdf["component"].to_numpy(), pdf["dist"].to_numpy(float), pdf["node"].to_numpy()
        near = ~(np.abs(dist[left][:, None] - dist[right][None, :]) > 1 - percent / 100 + 1e-9)
        ok = _linked(inter, sizes[left][:, None], sizes[right][None, :], percent) & near & (comp[left][:, None] != comp[right][None, :])
        out, root = [], {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for i, j in zip(*np.nonzero(ok), strict=True):
            a, b = find(comp[left[i]]), find(comp[right[j]])
            if a != b:
                root[a] = b
                out.append((node[left[i]], node[right[j]]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _labelled(regions: DataFrame, links: DataFrame) -> DataFrame:
    """Regions with the component of each member and of the pivot."""
    comps = components(links)
    out = regions.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return out.join(comps.select(F.col("node").alias("pivot"), F.col("component").alias("home")), "pivot", "left").withColumn("home", F.coalesce("home", "pivot"))


def _left_over(regions: DataFrame, percent: int) -> DataFrame:
    """Members of regions whose documents aren't all in one component. Of the pivot's own
    component only those stay that can reach a document outside it by the triangle inequality."""
    t = 1 - percent / 100 + 1e-9
    outside = F.col("component") != F.col("home")
    # a distance that wasn't computed may be any
    bounds = regions.where(outside).groupBy("region").agg(F.min(F.coalesce("dist", F.lit(0.0))).alias("lo"), F.max(F.coalesce("dist", F.lit(1.0))).alias("hi"), F.count(F.lit(1)).alias("n_out"))
    inside = regions.where(~outside).join(bounds, "region").where(F.col("dist").isNull() | ((F.col("dist") >= F.col("lo") - t) & (F.col("dist") <= F.col("hi") + t)))
    n_in = inside.groupBy("region").agg(F.count(F.lit(1)).alias("n_in"))
    rest = regions.where(outside).join(bounds, "region").unionByName(inside)
    # a lone document outside was compared with the pivot already
    return rest.join(n_in, "region", "left").withColumn("n_in", F.coalesce("n_in", F.lit(0))).where("n_out + n_in > 1")


def _sketches_allow(percent: int):
    """Whether sketches leave a link possible: at similarity t at most (1 - t) / (1 + t) of
    both sizes' sum is in one set alone."""

    def allow(n: pd.Series, m: pd.Series, own: pd.Series, theirs: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=bool)
        a, b = _counts(own), _counts(theirs)
        return pd.Series((100 + percent) * np.abs(a - b).sum(axis=1) <= (100 - percent) * (n.to_numpy(np.int64) + m.to_numpy(np.int64)))

    return F.pandas_udf(allow, "boolean")


SMALL = 2048


def able(key: np.ndarray, size: np.ndarray, sketches: np.ndarray, percent: int) -> np.ndarray:
    """Which rows, sorted by key, may link with another one of their key by sizes and sketches. Rows are held against those one place
    further on, two, and so on, of all keys at once."""
    keep, at, step = np.zeros(len(key), bool), np.arange(len(key)), 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        a, b = size[at], size[at + step]
        near = at[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
        apart = np.concatenate([np.abs(sketches[c] - sketches[c + step]).sum(axis=1, dtype=np.int64) for c in np.array_split(near, len(near) // 100_000 + 1)])
        near = near[(100 + percent) * apart <= (100 - percent) * (size[near] + size[near + step])]
        keep[near] = keep[near + step] = True
    return keep


def _able_members(members: DataFrame, bounded: DataFrame, percent: int) -> DataFrame:
    """Members (key, node, size) without those that sizes and coarse sketches let link with no other one of their key, so that what
    shares a shingle by chance goes no further; a key without any is left out. Keys of more than ``SMALL`` members stay as they are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["key"].to_numpy(), kind="stable")
        pdf = pdf.iloc[order]
        return pdf.loc[able(pdf["key"].to_numpy(), pdf["n"].to_numpy(np.int64), _counts(pdf["coarse"], COARSE), percent), ["key", "node", "size"]]

    sketches = bounded.select("node", "n", F.pandas_udf(coarse, "binary")("sketch").alias("coarse")).dropDuplicates(["node"])
    few = members.where(F.col("size") <= SMALL).join(sketches, "node").select("key", "node", "size", "n", "coarse")
    looked = few.groupBy(_dealt("key", members)).applyInPandas(lambda _, pdf: run(pdf), "key long, node long, size long")
    return looked.union(members.where(F.col("size") > SMALL).select("key", "node", "size"))


def _dealt(column: str, rows: DataFrame):
    """Regions dealt to groups of about ``GROUP_ROWS`` rows of a stored table, for each group costs a call. Groups are more as rows are more."""
    least = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(column), F.lit(max(least, rows.count() // GROUP_ROWS))).alias("_g")


def _with_partners(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (pivot, node, possible) whose node may link with the pivot or with another node of the
    region. Regions of at most ``SMALL`` nodes are looked through by sketches; nodes of
    larger ones stay as they are."""

    def partners(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = pdf["possible"].to_numpy(bool).copy()
        pivot, size = pdf["pivot"].to_numpy(), pdf["n"].to_numpy(np.int64)
        counts = _counts(pdf["sketch"])
        order = np.argsort(pivot, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(pivot[order])) + 1):
            for k, i in enumerate(own[:-1]):
                rest = own[k + 1 :]
                rest = rest[100 * np.minimum(size[i], size[rest]) >= percent * np.maximum(size[i], size[rest])]
                rest = rest[(100 + percent) * np.abs(counts[rest] - counts[i]).sum(axis=1) <= (100 - percent) * (size[i] + size[rest])]
                if len(rest):
                    keep[i] = True
                    keep[rest] = True
        return pdf.loc[keep, ["pivot", "node", "possible"]]

    counted = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("nodes"), F.max("possible").alias("any")).where("nodes > 1 or any")
    told = stored(pairs.join(counted, "pivot"), "jaccard-told")
    small = told.where(F.col("nodes") <= SMALL).join(sketches, "node")
    looked = small.groupBy(_dealt("pivot", told)).applyInPandas(lambda _, pdf: partners(pdf), "pivot long, node long, possible boolean")
    return looked.union(told.where(F.col("nodes") > SMALL).select("pivot", "node", "possible"))


def link_sets(documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, text_hash, n, node) of all documents, and edges (u, v) between nodes whose components
    are those of all links at a similarity of ``percent`` hundredths."""
    spark = documents.sparkSession
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    size = map_bits(documents.count())
    counted = _first_keys(base, width, percent).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= FREQUENT[0])
    frequent = spark.sparkContext.broadcast(_bitmaps(counted, *(F.col("rows") >= n for n in FREQUENT), size=size))

    def second(row, node, shingles, seen):
        if node is None or node in seen:
            return *row, node, len(shingles), None, None
        seen.add(node)
        return *row, node, len(shingles), boundary(shingles, percent, frequent.value).tobytes(), sketch(shingles)

    rows = stored(_sets(base, width, second, "doc_id long, text_hash long, node long, n int, keys binary, sketch binary"), "jaccard-rows")
    bounded = rows.where("keys is not null")
    groups = stored(_exploded(bounded).groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b").select("key", "size"), "jaccard-groups")
    shared = spark.sparkContext.broadcast(_bitmaps(groups, F.lit(True), size=size)[0])
    members = stored(_keyed(_exploded(bounded, shared), groups, ["size"], groups), "jaccard-members")
    members = stored(_able_members(members, bounded, percent), "jaccard-able")
    # the pivot of a shingle's documents is the one that meets most others: the middle of a group of near copies
    # is in all their groups, so it is near to most of them and regions are few
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = stored(members.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot")), "jaccard-pivots")
    regions = stored(_keyed(members.drop("size"), pivots, ["pivot"], groups).where("node <> pivot").select("pivot", "node").distinct(), "jaccard-regions")

    # a sketch for each node that regions name
    sketches = bounded.select("node", "n", "sketch").dropDuplicates(["node"])
    pairs = regions.join(sketches, "node").join(sketches.select(F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("sketch").alias("other")), "pivot")
    sized = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & _sketches_allow(percent)("n", "m", "sketch", "other")
    pairs = stored(pairs.select("pivot", "node", sized.alias("possible")), "jaccard-pairs")
    pairs = stored(_with_partners(pairs, sketches, percent), "jaccard-partners")

    def whole(_, node, shingles, seen):
        if node is None or node in seen:
            return None
        seen.add(node)
        return node, shingles.tobytes()

    needed = pairs.select("node").union(pairs.select("pivot")).distinct()
    by_id = bounded.join(needed, "node", "left_semi").select(F.xxhash64("doc_id").alias("key"))
    ids = spark.sparkContext.broadcast(_bitmaps(by_id, F.lit(True))[0])
    # others of the same bit may come along
    sets = stored(_sets(base, width, whole, "node long, shingles binary", ids).join(needed, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "jaccard-sets")

    far = 1 - F.col("inter") / (F.col("n") + F.col("m") - F.col("inter"))
    is_link = 100 * F.col("inter") >= percent * (F.col("n") + F.col("m") - F.col("inter"))
    close = _distances(pairs.where("possible").select("pivot", "node"), sets).select("pivot", "node", far.alias("dist"), is_link.alias("linked"))
    measured = stored(pairs.select("pivot", "node").join(close, ["pivot", "node"], "left"), "jaccard-distances")
    links = measured.where("linked").select(F.col("pivot").alias("u"), F.col("node").alias("v"))

    def still_open(regions: DataFrame, links: DataFrame) -> DataFrame:
        return stored(_narrowed(stored(_left_over(_labelled(regions, links), percent), "jaccard-left"), sketches, percent), "jaccard-open")

    open_regions = still_open(measured.select(F.col("pivot").alias("region"), "pivot", "node", "dist"), links)
    done = None
    for depth in range(DEPTH):
        large = open_regions.where(F.col("n_out") > LEAF)
        if large.isEmpty():
            break
        cells, found = _cells(large, sets, percent, depth)
        links = stored(links.union(found), "jaccard-links")
        rest = open_regions.where(F.col("n_out") <= LEAF)
        done = rest if done is None else done.unionByName(rest)
        # cells that hardly shrink are left to the blocks
        sized = cells.join(cells.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region")
        stuck = F.col("n") > SHRINKS * F.col("parent")
        own = ["region", "pivot", "node", "dist"]
        done = done.unionByName(stored(_left_over(_labelled(sized.where(stuck).select(own), links), percent).select(done.columns), "jaccard-stuck"))
        open_regions = still_open(sized.where(~stuck).select(own), links).select(done.columns)
    if done is not None:
        again = done.unionByName(open_regions).select("region", "pivot", "node", "dist").distinct()
        open_regions = still_open(again, links)
    return rows, links.union(_leaf_links(open_regions, sets, percent))


def _cells(large: DataFrame, sets: DataFrame, percent: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Voronoi cells of large regions: rows (region, parent, pivot, node, dist), and the links to pivots. ``parent`` is the size of the region split."""
    drawn = large.where("component <> home").groupBy("region", F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(PIVOTS)).alias("_k")).agg(F.min("node").alias("pivot"))
    members = large.select("region", "node").distinct()
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("parent"))
    pairs = members.join(drawn.select("region", "pivot"), "region").where("node <> pivot")
    told = _distances(pairs.select("pivot", "node").distinct(), sets)
    far = 1 - F.col("inter") / (F.col("n") + F.col("m") - F.col("inter"))
    is_link = 100 * F.col("inter") >= percent * (F.col("n") + F.col("m") - F.col("inter"))
    measured = stored(pairs.join(told, ["pivot", "node"]).select("region", "pivot", "node", far.alias("dist"), is_link.alias("linked")), "jaccard-cells")
    nearest = measured.groupBy("region", "node").agg(F.min("dist").alias("nearest"))
    window = 2 * (1 - percent / 100) + 1e-9
    # a pivot has distance 0 to itself, so it is in the cells of those near to it
    nearest = nearest.join(drawn.select("region", F.col("pivot").alias("node"), F.lit(0.0).alias("own")), ["region", "node"], "left").withColumn("nearest", F.coalesce("own", "nearest")).drop("own")
    reached = measured.join(nearest, ["region", "node"]).where(F.col("dist") <= F.col("nearest") + window)
    cells = reached.join(sizes, "region").select(F.xxhash64("region", "pivot", F.lit(depth)).alias("region"), "parent", "pivot", "node", "dist")
    return stored(cells, "jaccard-voronoi"), measured.where("linked").select(F.col("pivot").alias("u"), F.col("node").alias("v"))


def _narrowed(regions: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of regions of at most ``NARROW`` documents those whose sketches leave a link to one of another
    component possible; larger regions as they are."""
    columns = ["region", "pivot", "node", "component", "home", "dist", "n_out", "n_in"]
    regions = regions.select(*columns)

    def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
        size, counts, parts = pdf["n"].to_numpy(np.int64), _counts(pdf["sketch"]), []
        component, dist, region = pdf["component"].to_numpy(), pdf["dist"].to_numpy(float), pdf["region"].to_numpy()
        order = np.argsort(region, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(region[order])) + 1):
            keep = np.zeros(len(own), bool)
            for k, i in enumerate(own[:-1]):
                at = k + 1 + np.flatnonzero((component[own[k + 1 :]] != component[i]) & ~(np.abs(dist[own[k + 1 :]] - dist[i]) > 1 - percent / 100 + 1e-9))
                rest = own[at]
                near = 100 * np.minimum(size[i], size[rest]) >= percent * np.maximum(size[i], size[rest])
                at, rest = at[near], rest[near]
                near = (100 + percent) * np.abs(counts[rest] - counts[i]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (size[i] + size[rest])
                if near.any():
                    keep[k] = True
                    keep[at[near]] = True
            kept = pdf.iloc[own[keep]]
            n_out = int((kept["component"] != kept["home"]).sum())
            parts.append(kept[columns].assign(n_out=n_out, n_in=len(kept) - n_out))
        return pd.concat(parts)

    small = F.col("n_out") + F.col("n_in") <= NARROW
    told = regions.where(small).join(sketches, "node")
    schema = ", ".join(f"{c} {regions.schema[c].dataType.simpleString()}" for c in columns)
    looked = told.groupBy(_dealt("region", regions)).applyInPandas(lambda _, pdf: narrow(pdf), schema)
    return looked.union(regions.where(~small))


def _leaf_links(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Joins what is left of the regions, ``BLOCK`` by ``BLOCK`` documents at a time: documents
    outside the pivot's component with each other, and with those inside it."""
    outside = F.col("component") != F.col("home")
    n_out, n_in = F.ceil(F.col("n_out") / BLOCK), F.ceil(F.col("n_in") / BLOCK)
    mine = F.pmod(F.xxhash64("node"), F.when(outside, n_out).otherwise(n_in))
    placed = regions.withColumns({"outside": outside, "mine": mine, "n_out": n_out, "n_in": n_in})
    # left and right block of each task; a block of the inside is on the right, after all of the outside
    as_left = F.expr("transform(sequence(mine, n_out + n_in - 1), j -> struct(mine as i, j as j, true as left, mine = j as right))")
    as_right = F.expr("transform(sequence(0, mine), i -> struct(i as i, mine as j, mine = i as left, true as right))")
    from_inside = F.expr("transform(sequence(0, n_out - 1), i -> struct(i as i, n_out + mine as j, false as left, true as right))")
    tasks = placed.withColumn("task", F.explode(F.when(F.col("outside"), F.array_distinct(F.concat(as_left, as_right))).otherwise(from_inside)))
    rows = tasks.select("region", "node", "component", "dist", "task.*").join(sets, "node")
    return rows.groupBy("region", "i", "j").applyInPandas(_block_links(percent), "u long, v long")


def _grouped(documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of all documents, and node, component (a node) of all nodes in a group of several rows."""
    rows, links = link_sets(documents, width, percent)
    comps = stored(components(stored(links, "jaccard-all-links")), "jaccard-components")
    # equal sets share a node; only groups of several rows get a component by join
    nodes = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    lone = nodes.join(comps, "node", "left_anti").where("rows > 1").select("node", F.col("node").alias("component"))
    return rows.select("doc_id", "text_hash", "n", "node"), comps.select("node", "component").union(lone)


def jaccard_components(documents: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents`` (doc_id, text)."""
    rows, groups = _grouped(documents, width, percent)
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(groups, "node")
    named = least.join(least.groupBy("component").agg(F.min("least").alias("id")), "component").select("node", "id")
    out = rows.join(named, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("id", "doc_id").alias("component_id"))


def one_of_each_group(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest (doc_id, hash of the text), null ids last. Rows
    without words are in no component and stay; rows that repeat both id and text are a group."""
    rows, groups = _grouped(documents, width, percent)
    told = rows.where("node is not null").groupBy("doc_id", "text_hash", "node").agg(F.count(F.lit(1)).alias("n_rows")).join(groups, "node")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = told.groupBy("component").agg(F.min(own).alias("first")).select(F.col("first.doc_id").alias("_first"), F.col("first.text_hash").alias("_first_hash"))
    # joined by id and text, as a component may hold very many rows
    is_first = F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("text_hash") == F.col("_first_hash"))
    told = told.join(first, is_first, "left").withColumn("stays", F.col("_first_hash").isNotNull())
    key, text_hash = free_name(documents.columns, "_text_hash"), F.xxhash64("text")
    marked = documents.withColumn(key, text_hash)

    def same(told: DataFrame, how: str) -> DataFrame:
        told = told.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        return marked.join(told, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col(key) == F.col("_hash")), how)

    # ids and hashes of rows to go, and of those that stay once though they are repeated: few against all,
    # so texts are shuffled only where these aren't small
    repeated = F.col("stays") & (F.col("n_rows") > 1)
    alone = same(told.where(~F.col("stays") | repeated), "left_anti")
    once = same(told.where(repeated), "left_semi").dropDuplicates(["doc_id", key])
    return alone.unionByName(once).drop(key)
