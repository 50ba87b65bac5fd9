import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from eventloom.sources import adapter

CALENDAR = "BEGIN:VCALENDAR\r\n{}END:VCALENDAR\r\n"
EVENT = "BEGIN:VEVENT\r\nUID:{}\r\nSUMMARY:Run {}\r\nDTSTART:{}T190000\r\nEND:VEVENT\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(i, o, t, "x") for i, o, t in rows], "page_id long, organiser string, text string, date string")


@pytest.fixture
def folder(spark, tmp_path):
    path = f"file://{tmp_path}/landed"
    one = CALENDAR.format(EVENT.format("a", 1, "20260501") + EVENT.format("b", 2, "20260601"))
    adapter.land(pages(spark, [(1, "one", one), (2, "two & more/x", one.replace("UID:", "UID:t")), (3, "one", "broken"), (4, "one", None)]), path, 0)
    return path


def test_one_parse_gives_events_errors_and_pages(spark, folder):
    events, errors, told = adapter.results(adapter.read_landed(spark, folder, kind="ical"))
    assert sorted((r.page_id, r.organiser, r.uid, r.date) for r in events.collect()) == [(1, "one", "a", "2026-05-01"), (1, "one", "b", "2026-06-01"), (2, "two & more/x", "ta", "2026-05-01"), (2, "two & more/x", "tb", "2026-06-01")]
    assert sorted((r.page_id, r.error) for r in errors.collect()) == [(3, "no calendar"), (4, "no calendar")]
    diagnostics = {r.page_id: json.loads(r.diagnostics) for r in told.collect()}
    assert diagnostics[1]["events"] == 2 and diagnostics[3] == {"bytes": 6, "events": 0, "undated": 0, "failed": True} and set(diagnostics) == {1, 2, 3, 4}


def test_filters_are_the_readers(spark, folder):
    reader = adapter.LandedFeed({"path": folder, "kind": "ical"}).reader(None)
    kept = EqualTo(("title",), "Run 1")
    assert list(reader.pushFilters([In(("organiser",), ("one", "none")), GreaterThanOrEqual(("date",), "2026-05-15"), kept])) == [kept]
    assert {o for p in reader.partitions() for o, _ in p.files} == {"one"}
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["page_id"], r["uid"]) for r in rows] == [(1, "b")]
    found = adapter.read_landed(spark, folder, kind="ical").where("organiser = 'two & more/x' and date < '2026-06-01' and title like 'Run%'").collect()
    assert [(r.page_id, r.uid) for r in found] == [(2, "ta")]


def test_files_are_dealt_out_by_bytes(spark, folder, monkeypatch):
    monkeypatch.setattr(adapter, "PARTITION_BYTES", 1)
    reader = adapter.LandedFeed({"path": folder}).reader(None)
    assert all(len(p.files) == 1 for p in reader.partitions()) and len(reader.partitions()) >= 2


def test_batches_that_are_not_whole_and_empty_folders(spark, folder, tmp_path):
    adapter.land(pages(spark, [(9, "one", "broken")]), folder, 1)
    os.remove(f"{folder.removeprefix('file://')}/batch=1/_SUCCESS")
    assert adapter.read_landed(spark, folder, kind="ical").where("page_id = 9").isEmpty()
    assert adapter.read_landed(spark, f"file://{tmp_path}/nothing", kind="ical").isEmpty()


def test_a_restarted_stream_goes_on_behind_its_last_batch(spark, folder, tmp_path):
    def run():
        rows = adapter.stream_landed(spark, folder, kind="html", row="p", field__title="b")
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.page_id, r.title) for r in spark.read.parquet(f"{tmp_path}/rows").where(F.col("outcome") == "event").collect())

    adapter.land(pages(spark, [(10, "h", "<p><b>First</b></p>")]), folder, 1)
    assert run() == [(10, "First")]
    assert run() == [(10, "First")]
    adapter.land(pages(spark, [(11, "h", "<p><b>Second</b></p><p><b>Third</b></p>")]), folder, 2)
    assert run() == [(10, "First"), (11, "Second"), (11, "Third")]


def test_a_landed_file_holds_few_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapter, "FILE_PAGES", 2)
    pages = spark.range(5).selectExpr("id as page_id", "'one' as organiser", "'' as text").coalesce(1)
    adapter.land(pages, f"file://{tmp_path}/few", 0)
    assert len(list((tmp_path / "few").rglob("*.parquet"))) == 3
    assert adapter.PARTITION_BYTES <= 1 << 20
