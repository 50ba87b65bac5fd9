"""Token-id files as directly addressable codes.

An id is cut into chunks of 8 bits, least significant first. Level k holds chunk k of every
id that has one, a bitmap says which ids go on to level k + 1, and a rank directory (ones
before every 512th bit) turns a position on one level into that on the next. So any token is
read from one byte for each level, without decoding others.

A file is a run of segments of whole documents, then a footer::

    DACS | segment ... | doc ids, doc starts, segment table | footer bytes (uint64) | DACS

Texts are encoded as the library's plain call does, so the name of an added token in a text is that token.

Defined results: a null text is empty and so holds the end id alone; a null doc_id sorts
first and comes back null; repeated doc_ids are separate documents; an empty table gives no
file and no rows; columns other than the two named are ignored. A document may be of any
length; a segment closes at the first document end past ``SEGMENT_TOKENS``.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, rows_of, shared_dir

MAGIC = b"DACS"
SEGMENT_TOKENS = 1 << 20
RANK_BITS = 512
POPCOUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)
NULL_ID = -(2**63)


class DirectCodes:
    """One segment: chunk levels, continuation bitmaps and rank directories."""

    def __init__(self, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.bitmaps, self.ranks = levels, bitmaps, ranks

    @classmethod
    def encode(cls, ids: np.ndarray) -> DirectCodes:
        rest, levels, bitmaps, ranks = ids.astype(np.uint64), [], [], []
        while True:
            levels.append((rest & np.uint64(255)).astype(np.uint8))
            rest = rest >> np.uint64(8)
            more = rest > 0
            if not more.any():
                return cls(levels, bitmaps, ranks)
            bits = np.packbits(more)
            bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
            ones = POPCOUNT[bits].reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint64)
            bitmaps.append(bits)
            ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32))
            rest = rest[more]

    def __len__(self) -> int:
        return len(self.levels[0])

    def get(self, i: int) -> int:
        """The id at position ``i``, by one rank for each further level."""
        value, at = int(self.levels[0][i]), i
        for k, (bits, ranks) in enumerate(zip(self.bitmaps, self.ranks, strict=True)):
            byte, bit = divmod(at, 8)
            if not bits[byte] >> (7 - bit) & 1:
                break
            block = at // RANK_BITS
            at = int(ranks[block]) + int(POPCOUNT[bits[block * (RANK_BITS // 8) : byte]].sum()) + int(POPCOUNT[bits[byte] >> (8 - bit)] if bit else 0)
            value |= int(self.levels[k + 1][at]) << 8 * (k + 1)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range; each level is entered once, by the rank of its first bit."""
        out = self.levels[0][start:stop].astype(np.uint32)
        where, lo, hi = np.arange(len(out)), start, stop
        for k, bits in enumerate(self.bitmaps):
            if lo >= hi:
                break
            flags = np.unpackbits(bits[lo // 8 : -(-hi // 8)])[lo % 8 : lo % 8 + hi - lo].astype(bool)
            block = lo // RANK_BITS
            before = np.unpackbits(bits[block * (RANK_BITS // 8) : -(-lo // 8)])[: lo - block * RANK_BITS]
            lo = int(self.ranks[k][block]) + int(before.sum())
            where = where[flags]
            hi = lo + len(where)
            out[where] |= self.levels[k + 1][lo:hi].astype(np.uint32) << np.uint32(8 * (k + 1))
        return out

    def tobytes(self) -> bytes:
        out = io.BytesIO()
        sizes = [len(x) for x in self.levels] + [len(x) for x in self.bitmaps]
        out.write(np.array([len(self.levels), *sizes], "<u8").tobytes())
        for x in (*self.levels, *self.bitmaps):
            out.write(x.tobytes())
        for x in self.ranks:
            out.write(x.astype("<u4").tobytes())
        return out.getvalue()

    @classmethod
    def frombytes(cls, raw: bytes) -> DirectCodes:
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        sizes = np.frombuffer(raw, "<u8", 2 * n - 1, 8).astype(int).tolist()
        at, parts = 8 * 2 * n, []
        for size in sizes:
            parts.append(np.frombuffer(raw, np.uint8, size, at))
            at += size
        ranks = []
        for size in sizes[n:]:
            ranks.append(np.frombuffer(raw, "<u4", size * 8 // RANK_BITS, at))
            at += size // (RANK_BITS // 32)
        return cls(parts[:n], parts[n:], ranks)


class Writer:
    """Collects documents to segments of a file."""

    def __init__(self, sink):
        self.sink, self.at = sink, sink.write(MAGIC) or 4
        self.held, self.n_held, self.total = [], 0, 0
        self.doc_ids, self.starts, self.segments = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.starts.append(self.total)
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= SEGMENT_TOKENS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = DirectCodes.encode(np.concatenate(self.held)).tobytes()
            self.sink.write(raw)
            self.segments.append((self.total - self.n_held, self.at, len(raw)))
            self.at += len(raw)
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        foot = np.array([len(self.doc_ids), len(self.segments), self.total], "<u8").tobytes() + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.segments, "<u8").tobytes()
        self.sink.write(foot + np.array([len(foot)], "<u8").tobytes() + MAGIC)
        self.sink.close()


class Reader:
    """Random access to a file that :class:`Writer` made. ``source`` is seekable."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        if source.read(4) != MAGIC:
            raise ValueError("not a token file")
        source.seek(source.size() - 12)
        tail = source.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("a token file without its footer")
        size = int(np.frombuffer(tail, "<u8", 1)[0])
        source.seek(source.size() - 12 - size)
        foot = source.read(size)
        docs, segments, self.total = (int(x) for x in np.frombuffer(foot, "<u8", 3))
        self.doc_ids = np.frombuffer(foot, "<i8", docs, 24)
        self.starts = np.frombuffer(foot, "<u8", docs, 24 + 8 * docs).astype(np.int64)
        self.segments = np.frombuffer(foot, "<u8", 3 * segments, 24 + 16 * docs).reshape(-1, 3).astype(np.int64)
        self._open = (-1, None)

    def segment(self, k: int) -> DirectCodes:
        if self._open[0] != k:
            self.source.seek(int(self.segments[k, 1]))
            self._open = (k, DirectCodes.frombytes(self.source.read(int(self.segments[k, 2]))))
        return self._open[1]

    def token(self, i: int) -> int:
        k = int(np.searchsorted(self.segments[:, 0], i, "right")) - 1
        return self.segment(k).get(i - int(self.segments[k, 0]))

    def document(self, j: int) -> np.ndarray:
        """All ids of the j-th document; documents don't cross segments."""
        start, stop = int(self.starts[j]), int(self.starts[j + 1]) if j + 1 < len(self.starts) else self.total
        k = int(np.searchsorted(self.segments[:, 0], start, "right")) - 1
        base = int(self.segments[k, 0])
        return self.segment(k).slice(start - base, stop - base)


#: pre-tokens of the byte-level pattern, spelt out for characters whose classes never changed
PRE_TOKENS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\n+(?!\S)|\n+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be printed, else one of the next free ones."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


class BatchEncoder(dict):
    """Ids of whole texts by the tokenizers library; as a dict, piece -> its ids as bytes.

    Byte-level BPE never joins a character with a space after it. So where every space of a text
    stands before a character that isn't white space, the ids of the text are those of its
    pieces cut before each space, and repeated pieces need encoding once. A new piece of plain letters,
    digits, punctuation and line feeds is cut to pre-tokens, which go to the library's model; any
    other piece, and any other text, goes to the library as it is.
    """

    LIMIT = 300_000  # pieces, and pre-tokens, of one generation; two are kept
    ODD = re.compile(r" (?:[\s\x1c-\x1f\x85]|$)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        known = self.words.get(word) or self.older_words.get(word)
        if known is None:
            spelt = word.replace(" ", "\u0120") if word.isascii() and "\n" not in word else "".join(map(self.letters.__getitem__, word.encode("utf-8")))
            known = np.array([t.id for t in self.model.tokenize(spelt)], np.uint32).tobytes()
        self.words[word] = known
        return known

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            parts = PRE_TOKENS.findall(piece)
            found = b"".join(map(self._word, parts)) if sum(map(len, parts)) == len(piece) else self._plain(piece)
        self[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if "\0" in text or self.ODD.search(text) or self.added.search(text):
            return np.frombuffer(self._plain(text), np.uint32)
        if len(self) > self.LIMIT:
            self.older = dict(self)
            self.clear()
        if len(self.words) > self.LIMIT:
            self.older_words, self.words = self.words, {}
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0"))), np.uint32)


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder_for(path: str) -> BatchEncoder:
    """A Python worker's encoder, which keeps its pieces from one task to the next."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, BatchEncoder(path))


def encode_to_files(documents: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes the ids of all documents, in ascending order of doc_id over the files' numbers,
    and returns the manifest (part, file, docs, tokens, base) with the ids before each file."""
    spark = documents.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    schema = "part int, file string, docs long, tokens long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        part = TaskContext.get().partitionId()
        name, writer, encoder = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.dac", None, None
        for ids, texts in rows_of(batches, "doc_id", "text"):
            if writer is None:
                fs.create_dir(path, recursive=True)
                writer, encoder = Writer(fs.open_output_stream(name)), encoder_for(tokenizer_path)
            for doc_id, text in zip(ids, texts, strict=True):
                writer.add(doc_id, np.append(encoder.encode(text), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.doc_ids)], pa.int64()), pa.array([writer.total], pa.int64())], names=["part", "file", "docs", "tokens"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows that share an id, null ones among them, are dealt out by their texts' hashes
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    ordered.mapInArrow(write, schema).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(schema).parquet(f"{folder}/manifest")
    # one row for each file, not for each document
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), folder


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for files, bases in rows_of(batches, "file", "base"):
            for name, base in zip(files, bases, strict=True):
                with fs.open_input_file(name) as source:
                    reader = Reader(source)
                    lengths, crcs = [], []
                    for j in range(len(reader.doc_ids)):
                        ids = reader.document(j)
                        lengths.append(len(ids))
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    mask = reader.doc_ids == NULL_ID
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64(), mask=mask), pa.array(reader.starts + base, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "base").repartition(max(1, manifest.count())).mapInArrow(read, schema)


def encode_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 2, **names: str) -> DataFrame:
    """Writes all documents as directly addressable codes and digests what the files hold."""
    manifest, folder = encode_to_files(documents, tokenizer_path, end_id, **names)
    return read_digests(manifest, folder)
