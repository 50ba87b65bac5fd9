"""Helpers shared by the corpus operators: shared storage, files, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the folder that driver and executors share. Only where
    neither it nor a checkpoint folder is set (local tests) is a temporary one made.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='eventloom-')}"
        sc.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Has the session's Python tasks get Arrow batches of at most ``BATCH_BYTES``, whatever a row's length."""
    spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here, and a lost
    executor costs a re-read rather than a recomputation. Python tasks of the write get Arrow
    batches of at most ``BATCH_BYTES``, so that rows of long texts or sets don't add up."""
    path, conf = shared_dir(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(BATCH_LIMIT, None)
    conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        conf.unset(BATCH_LIMIT) if before is None else conf.set(BATCH_LIMIT, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def given_back() -> None:
    """Gives the memory that this process has freed back to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


_HELD: dict[str, Callable[[], None]] = {}


def holding(name: str, forget: Callable[[], None] = lambda: None) -> None:
    """Says that the operator ``name`` fills caches of this Python worker, which ``forget`` empties. Spark hands workers on from
    stage to stage, so caches of other operators, which no task here reads any more, go first, and their memory to the system."""
    if name in _HELD:
        return
    if _HELD:
        for empty in _HELD.values():
            empty()
        _HELD.clear()
        given_back()
    _HELD[name] = forget


def free_name(columns: list[str], stem: str) -> str:
    """``stem``, with underscores added until no column bears the name in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased; none for null.
    ``bytes.split`` and ``bytes.lower`` know exactly these six separators and these letters."""
    return text.encode("utf-8").lower().split() if text else []


MUL = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: a 64-bit value for each byte, A-Z as a-z; hashes of words are polynomials of these in BASE
BYTE_VALUES = mixed((np.arange(256, dtype=np.uint64) + np.where((np.arange(256) > 64) & (np.arange(256) < 91), 32, 0).astype(np.uint64) + np.uint64(1)) * MUL)
BASE = 0xD6E8FEB86659FD93
HASH_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)), dtype=np.uint64)


POWERS, INVERSES = _powers(BASE, 2 * HASH_BLOCK), _powers(pow(BASE, -1, 1 << 64), 2 * HASH_BLOCK)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (as :func:`lower_words` cuts them) of a string array, one after the other,
    and where each text's words start, with the end. Nulls have no words.

    Whole arrays are hashed at once: sums of byte values times powers of a base run on over
    a block, and a word's own is a difference of two, brought back to power 0.
    """
    texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    inside = ~SEPARATOR[data]
    new = np.ones(len(data) + 1, bool)  # whether no word goes on from the byte before
    new[1:-1] = ~inside[:-1]
    new[edges] = True
    starts = np.flatnonzero(inside & new[:-1])
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    last[edges[1:][edges[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + HASH_BLOCK, "right")))
        at = starts[a]
        n = int(ends[b - 1] - at)
        powers, inverses = (POWERS, INVERSES) if n < len(POWERS) else (_powers(BASE, n + 1), _powers(pow(BASE, -1, 1 << 64), n + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[at : at + n]] * powers[:n], out=sums[1:])
        s, e = starts[a:b] - at, ends[a:b] - at
        out[a:b] = mixed((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64) * MUL)
        a = b
    return out, np.searchsorted(starts, edges)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(h) - width + 1
    out = h[:n].copy()
    for i in range(1, width):
        out = mixed(out * MUL + h[i : n + i])
    return out


def rows_of(batches: Iterator, *columns: str) -> Iterator[tuple[list, ...]]:
    """Arrow record batches as tuples of Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)
