"""The adapter contract as a Spark data source: landed pages in, one row an outcome out.

Pages land in batches, ``batch=<number>/organiser=<id>/*.parquet`` below a folder; a batch counts once its ``_SUCCESS`` is there.
One parse of a page gives its events, an error if it couldn't be read, and a ``page`` row with the structure hash and
diagnostics; :func:`results` parts them without parsing again.

The batch reader deals files out by bytes and takes filters on ``organiser`` (whole folders are left out) and on ``date`` (rows are left
out before they reach the JVM). The stream reader's offset is the last committed batch number, so a restart goes on behind it, and a
batch that was planned but not finished is read again as a whole.

Defined results: a null text is read as an empty one; an organiser may be any text; null columns of events stay null; a folder
without batches gives no rows; other columns of pages are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.hashing import outline_hash
from .feeds import FIELDS, html_rows, ical_events

PARTITION_BYTES = 1 << 20  # packed: pages of one template shrink much, and parsing is the work
FILE_PAGES = 1 << 14  # a file is read by one task
SCHEMA = "page_id long, organiser string, outcome string, " + ", ".join(f"{f} string" for f in FIELDS) + ", error string, structure_hash string, diagnostics string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([(c, pa.int64() if c == "page_id" else pa.string()) for c in COLUMNS])


def parser(options: dict[str, str]) -> tuple[Callable[[str], list[dict]], bool]:
    """The parser that ``options`` name, and whether pages have an outline: ``kind`` is ical, or html with ``row``, ``container`` and ``field.<name>`` selectors."""
    if options.get("kind", "ical") == "ical":
        return ical_events, False
    # option names arrive in lower case
    fields = {f: options[f"field.{f}"] for f in FIELDS if f"field.{f}" in options}
    return html_rows(options["row"], fields, options.get("container")), True


def outcomes(page_id: int, organiser: str, text: str | None, parse: Callable[[str], list[dict]], outlined: bool) -> list[dict]:
    """What one page gives: its events or an error, and always a page row."""
    text = text or ""
    own = {"page_id": page_id, "organiser": organiser}
    try:
        rows, error = [own | {"outcome": "event"} | {f: r.get(f) for f in FIELDS} for r in parse(text)], None
    except (ValueError, KeyError, IndexError) as e:
        rows, error = [], str(e) or type(e).__name__
        rows = [own | {"outcome": "error", "error": error}]
    told = {"bytes": len(text.encode("utf-8", "surrogatepass")), "events": 0 if error else len(rows), "undated": sum(r.get("date") is None for r in rows if r["outcome"] == "event"), "failed": error is not None}
    return [*rows, own | {"outcome": "page", "structure_hash": outline_hash(text) if outlined else None, "diagnostics": json.dumps(told, separators=(",", ":"))}]


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(files)
        self.files = files


def _committed(root: str) -> Iterator[tuple[int, str]]:
    """Numbers and folders of the batches that are whole."""
    fs, path = pafs.FileSystem.from_uri(root)
    for entry in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if entry.base_name.startswith("batch=") and fs.get_file_info(f"{entry.path}/_SUCCESS").type == pafs.FileType.File:
            yield int(entry.base_name.removeprefix("batch=")), entry.path


def _dealt(root: str, batches: list[str], organisers: set[str] | None) -> list[Files]:
    """Files of the batches, put together up to ``PARTITION_BYTES``."""
    fs, _ = pafs.FileSystem.from_uri(root)
    out, held, size = [], [], 0
    for batch in sorted(batches):
        for info in sorted(fs.get_file_info(pafs.FileSelector(batch, recursive=True)), key=lambda i: i.path):
            if info.type != pafs.FileType.File or not info.path.endswith(".parquet"):
                continue
            organiser = unquote(info.path.rsplit("/organiser=", 1)[1].split("/")[0])
            if organisers is not None and organiser not in organisers:
                continue
            if held and size + info.size > PARTITION_BYTES:
                out.append(Files(held))
                held, size = [], 0
            held.append((organiser, info.path))
            size += info.size
    return [*out, Files(held)] if held else out


def _read(root: str, options: dict[str, str], partition: Files, fits: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    fs, _ = pafs.FileSystem.from_uri(root)
    parse, outlined = parser(options)
    compare = {"=": str.__eq__, "<": str.__lt__, "<=": str.__le__, ">": str.__gt__, ">=": str.__ge__}
    for organiser, path in partition.files:
        with fs.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=512, columns=["page_id", "text"]):
                rows = [row for page_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in outcomes(page_id, organiser, text, parse, outlined)]
                rows = [r for r in rows if all(r.get("date") is not None and compare[op](r["date"], value) for op, value in fits)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)


class _Batch(DataSourceReader):
    OPERATORS = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}

    def __init__(self, options: dict[str, str]):
        self.options, self.root = options, options["path"]
        self.organisers: set[str] | None = None
        self.fits: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("organiser",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.organisers = own if self.organisers is None else self.organisers & own
            elif type(f) in self.OPERATORS and f.attribute == ("date",):
                self.fits.append((self.OPERATORS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        return _dealt(self.root, [path for _, path in _committed(self.root)], self.organisers) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.root, self.options, partition, self.fits)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.root = options, options["path"]

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max((n for n, _ in _committed(self.root)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt(self.root, [path for n, path in _committed(self.root) if start["batch"] < n <= end["batch"]], None)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.root, self.options, partition, [])


class LandedFeed(DataSource):
    """``spark.read.format("landed_feed").option("path", folder).option("kind", "ical")``, or ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedFeed)
    return spark


def land(pages: DataFrame, folder: str, batch: int) -> None:
    """Writes pages (page_id, organiser, text) as batch number ``batch``; numbers go up."""
    pages.select("page_id", F.col("organiser").cast("string").alias("organiser"), "text").write.mode("overwrite").option("maxRecordsPerFile", FILE_PAGES).partitionBy("organiser").parquet(f"{folder}/batch={batch}")


def read_landed(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    reader = register(spark).read.format("landed_feed").option("path", folder)
    return reader.options(**{k.replace("__", "."): v for k, v in options.items()}).load()


def stream_landed(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    reader = register(spark).readStream.format("landed_feed").option("path", folder)
    return reader.options(**{k.replace("__", "."): v for k, v in options.items()}).load()


def results(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, errors and pages (with structure hash and diagnostics) of outcome rows. Store ``rows`` first where more than one is used."""
    events = rows.where("outcome = 'event'").select("page_id", "organiser", *FIELDS)
    errors = rows.where("outcome = 'error'").select("page_id", "organiser", "error")
    return events, errors, rows.where("outcome = 'page'").select("page_id", "organiser", "structure_hash", "diagnostics")
