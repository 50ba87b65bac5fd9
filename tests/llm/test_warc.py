import hashlib

import pyarrow.fs as pafs
import pytest

from eventloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"  # digest: a clashing extra column


def archived(spark, rows):
    return {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_round_trip_with_revisits_nulls_and_long_payloads(spark):
    big, small = "é" * 300_000, "x" * 99
    rows = [(7, "http://a/\r\nb", big, "z"), (3, None, big, None), (1, "u", None, None), (2, "u", "", None), (4, "u", small, None), (5, "u", small, None), (9, "u", big, None), (None, "u", big, None)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert archived(spark, rows) == {
        (7, 600_000, sha(big), "revisit", 3), (3, 600_000, sha(big), "response", None), (9, 600_000, sha(big), "revisit", 3), (None, 600_000, sha(big), "revisit", 3),
        (1, 0, sha(""), "response", None), (2, 0, sha(""), "response", None), (4, 99, sha(small), "response", None), (5, 99, sha(small), "response", None),
    }


def test_empty_table(spark):
    assert archived(spark, []) == set()


def test_layout_and_damage(spark, tmp_path):
    digest = hashlib.sha256(b"hello" * 50).hexdigest()
    pages = spark.createDataFrame([(1, "u", "hello" * 50, digest, "response", None)], "page_id long, url string, payload string, digest string, record_type string, refers_to long").coalesce(1)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", b"hello hello", "1970-01-01T00:00:00Z")
    name = manifest.head().file
    with open(name, "rb") as f:
        raw = f.read()
    assert raw[:4] == warc.DICT_MAGIC and raw[8:19] == b"hello hello"
    fs = pafs.LocalFileSystem()
    with fs.open_input_stream(name, compression=None) as f:
        kinds = [warc.parse_record(x)["warc-type"] for x in warc.frames(f)]
    assert kinds == ["warcinfo", "response"]
    with open(name, "wb") as f:
        f.write(raw[:-3])
    with fs.open_input_stream(name, compression=None) as f, pytest.raises(warc.WarcError):
        list(warc.frames(f))
    good = warc.record("response", 1, "u", b"abc", "d", None, "t")
    with pytest.raises(warc.WarcError):
        warc.parse_record(good.replace(b"Content-Length: ", b"Content-Length: 1", 2))
    with pytest.raises(warc.WarcError):
        warc.parse_record(good.replace(b"WARC-Date", b"WARC-Data"))


def test_repeated_rows_and_equal_ids(spark):
    body = "<p>" + "same " * 40
    pages = spark.createDataFrame([(5, "u", body), (5, "u", body), (3, "v", body), (9, "w", "small"), (9, "w", "small"), (None, "x", None)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.archive_pages(pages).collect())
    assert got == [(0, "response", 0), (3, "response", 0), (5, "revisit", 3), (5, "revisit", 3), (9, "response", 0), (9, "response", 0)]
