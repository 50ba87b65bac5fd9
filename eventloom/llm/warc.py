"""WARC archives in Zstandard form: a dictionary in a leading skippable frame, then one
frame for each record.

Layout of a file::

    5D 2A 4D 18 | uint32 length | dictionary        skippable frame
    zstd frame                                      warcinfo record
    zstd frame                                      one response or revisit record each

Defined results: a null payload is an empty one; a null URL is ``about:blank``; control
characters in a URL are percent-encoded; rows with a null id come back with a null id; rows
that repeat an id are separate records. Of equal payloads of at least ``min_bytes`` bytes the
smallest id is the response (every row that carries that id is), null ids never lead a group
unless no row of it has an id, and then all of them are responses. An empty table gives
no file and no rows. Columns other than the three named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, rows_of, shared_dir

DICT_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
ID_URI = "urn:x-page:"
READ_BYTES = 1 << 17
SAMPLE_CHARS = 1 << 16


class WarcError(ValueError):
    """An archive that breaks the format."""


def train_dictionary(samples: list[bytes], size: int = 32768) -> bytes:
    """A Zstandard dictionary of at most ``size`` bytes; where the samples are too few to
    train one, their concatenation serves as raw content, and no sample gives none."""
    samples = [s for s in samples if s]
    if len(samples) >= 16 and sum(map(len, samples)) >= 16 * size:
        return zstd.train_dictionary(size, samples).as_bytes()
    return b"".join(samples)[:size]


def dictionary_of(raw: bytes) -> zstd.ZstdCompressionDict | None:
    return zstd.ZstdCompressionDict(raw) if raw else None


def _head(fields: list[tuple[str, str]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode("utf-8")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit keeps the HTTP header, whose Content-Length is that of the
    full payload, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{ID_URI}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "about:blank"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{ID_URI}{refers_to}>")]
    return _head([*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and block of one record, after checks of the version line, the mandatory
    headers, the block length and the closing blank lines."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"malformed header {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, {length} declared")
    return fields | {"block": rest[:length]}


def frames(source) -> Iterator[bytes]:
    """Decoded frames of an open archive, one at a time. The dictionary comes from the
    leading skippable frame; input is read in pieces, so memory holds one record."""
    lead = source.read(8)
    dictionary, pending = None, lead
    if lead[:4] == DICT_MAGIC:
        size = struct.unpack("<I", lead[4:])[0]
        raw = source.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary is cut short")
        dictionary, pending = dictionary_of(raw), b""
    context = zstd.ZstdDecompressor(dict_data=dictionary) if dictionary else zstd.ZstdDecompressor()
    while True:
        if not pending:
            pending = source.read(READ_BYTES)
            if not pending:
                return
        while len(pending) < 4 and (more := source.read(4 - len(pending))):
            pending += more
        if pending[:4] != FRAME_MAGIC:
            raise WarcError("not a Zstandard frame")
        decoder, parts = context.decompressobj(), []
        while True:
            parts.append(decoder.decompress(pending))
            if decoder.eof:
                pending = decoder.unused_data
                break
            pending = source.read(READ_BYTES)
            if not pending:
                raise WarcError("the last frame is cut short")
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, date: str, level: int = 3) -> DataFrame:
    """Writes one archive for each partition of ``pages`` (page_id, url, payload, digest,
    record_type, refers_to) and returns the manifest (file, records). Every attempt of a task
    writes a file of its own; only those of attempts that ended are in the manifest."""
    schema = "file string, records long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        name = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        trained = dictionary_of(dictionary)
        packer = zstd.ZstdCompressor(level=level, dict_data=trained, write_content_size=True) if trained else zstd.ZstdCompressor(level=level, write_content_size=True)
        sink, n = None, 0
        for rows in rows_of(batches, "page_id", "url", "payload", "digest", "record_type", "refers_to"):
            if sink is None:
                fs.create_dir(path, recursive=True)
                sink = fs.open_output_stream(name, compression=None)
                sink.write(DICT_MAGIC + struct.pack("<I", len(dictionary)) + dictionary)
                info = b"format: WARC File Format 1.1\r\n"
                sink.write(packer.compress(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n"))
            for page_id, url, payload, digest, kind, refers_to in zip(*rows, strict=True):
                sink.write(packer.compress(record(kind, page_id, url, payload.encode("utf-8"), digest, refers_to, date)))
                n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    manifest = f"{folder}/manifest"
    pages.mapInArrow(write, schema).write.parquet(manifest)
    return pages.sparkSession.read.schema(schema).parquet(manifest)


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads every archive of a manifest, validates each record and returns a row for each
    response and revisit. A wrong length, digest or record count fails the task."""

    def page(uri: str | None) -> int | None:
        digits = (uri or "").strip("<>").removeprefix(ID_URI)
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for files, counts in rows_of(batches, "file", "records"):
            for name, count in zip(files, counts, strict=True):
                out, seen = [], 0
                with fs.open_input_stream(name, compression=None) as source:
                    for raw in frames(source):
                        r = parse_record(raw)
                        if r["warc-type"] not in ("response", "revisit"):
                            continue
                        seen += 1
                        http, _, payload = r["block"].partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length:")[2])
                        digest = r["warc-payload-digest"].removeprefix("sha256:")
                        if r["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise WarcError(f"payload of {r['warc-record-id']} doesn't match its header")
                        out.append((page(r["warc-record-id"]), length, digest, r["warc-type"], page(r.get("warc-refers-to")), r.get("warc-target-uri")))
                        if len(out) >= 5000:
                            yield _batch(out)
                            out = []
                if seen != count:
                    raise WarcError(f"{name} has {seen} records, not {count}")
                if out:
                    yield _batch(out)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in READ_SCHEMA.split(", ")])


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, dictionary_pages: int = 256, date: str = "1970-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Writes all pages to archives and returns what reading them back gives.

    The dictionary is trained on at most ``dictionary_pages`` pages, those of the lowest
    hashed ids. Which page leads a group of equal payloads comes from a pre-aggregated minimum
    for each digest; only groups of several rows are joined back, by keys without payloads. Of a
    page the dictionary sees ``SAMPLE_CHARS`` characters at most, which bounds what the driver gets.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    chosen = [r[0] for r in base.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(dictionary_pages).collect()]
    sampled = base.where(F.col("page_id").isin(chosen)).select(F.substring("payload", 1, SAMPLE_CHARS)).limit(dictionary_pages)
    samples = [r[0].encode("utf-8") for r in sampled.collect()] if chosen else []
    keyed = base.withColumn("digest", F.sha2("payload", 256))
    ids = keyed.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    groups = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    revisits = ids.join(groups.select("digest", "refers_to"), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    # payloads meet the few revisits by page and digest, so a page that very many rows hold is no hot key
    labelled = keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    labelled = labelled.select("page_id", "url", "payload", "digest", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to")
    manifest = write_archives(labelled, folder, train_dictionary(samples), date)
    return read_archives(manifest, folder)
