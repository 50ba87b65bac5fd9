import random
from datetime import UTC, datetime, timedelta


from eventloom.streaming import timed
from eventloom.streaming.runs import drained, landed, latest

START = datetime(2026, 1, 1)
SCHEMA = "source_id long, type string, at timestamp, action string, ordinal long"


def run(spark, tmp_path, batches, snooze=3600, delay="2 hours", ttl=10**9):
    for rows in batches:
        spark.createDataFrame([(s, "t", START + timedelta(minutes=m), a, o) for o, (s, m, a) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = landed(spark, f"file://{tmp_path}/in", SCHEMA, 1)
    with timed.stores(spark):
        return drained(timed.timed_alerts(stream, snooze, delay, ttl), "timed", "update")


def last(rows):
    return {r.source_id: (r.status, r.opened, r.reopened) for r in latest(rows.drop("at", "type", "reason"), ["source_id"]).collect()}


def test_a_late_snooze_is_placed_by_time(spark, tmp_path):
    rows = run(spark, tmp_path, [[(1, 0, "raised"), (1, 40, "cleared")], [(1, 20, "snooze")]])
    # in order of time: raised, snoozed, and a clearance that a sleeping alert ignores
    assert last(rows)[1] == ("SNOOZED", 1, 0)


def test_a_snooze_ends_without_a_row_of_its_own(spark, tmp_path):
    rows = run(spark, tmp_path, [[(1, 0, "raised"), (1, 5, "snooze"), (2, 0, "raised")], [(2, 300, "ack")], [(2, 301, "ack")]])
    assert last(rows) == {1: ("OPEN", 1, 1), 2: ("ACKNOWLEDGED", 1, 0)}
    woken = rows.where("reason = 'timer'").collect()
    assert [(r.source_id, r.status, r["at"]) for r in woken] == [(1, "OPEN", START + timedelta(minutes=65))]


def test_what_is_resolved_is_forgotten(spark, tmp_path):
    batches = [[(1, 0, "raised"), (1, 5, "cleared"), (2, 0, "raised")], [(2, 600, "ack")], [(2, 601, "ack")], [(1, 700, "raised")]]
    assert last(run(spark, tmp_path / "a", batches))[1] == ("OPEN", 2, 0)
    assert last(run(spark, tmp_path / "b", batches, ttl=3600))[1] == ("OPEN", 1, 0)


def test_any_arrival_within_the_delay_gives_the_order_of_time(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, m, rng.choice(["raised", "ack", "snooze", "cleared", "other"])) for s in range(6) for m in sorted(rng.sample(range(600), 30))]
    rows.sort(key=lambda r: r[1] + rng.randint(0, 110))
    batches = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    got = last(run(spark, tmp_path, batches))
    top = max(m for b in batches for _, m, _ in b)
    for s in range(6):
        own = [((START + timedelta(minutes=m)).replace(tzinfo=UTC).timestamp() * 1e6, i, a) for i, (k, m, a) in enumerate(rows) if k == s]
        state = timed.folded(timed.NEW, own, 3_600_000_000)
        state = timed.woken(state, ((START + timedelta(minutes=top)).replace(tzinfo=UTC) - timedelta(hours=2)).timestamp() * 1e6)
        assert got[s] == state[:3]


def test_the_provider_is_set_back(spark):
    before = spark.conf.get(timed.PROVIDER)
    with timed.stores(spark):
        assert spark.conf.get(timed.PROVIDER) == timed.ROCKSDB
    assert spark.conf.get(timed.PROVIDER) == before


def test_newer_rows_are_few_values_of_the_store(monkeypatch):
    monkeypatch.setattr(timed, "PACK", 4)
    rows = [(i, -i, a) for i, a in enumerate(["raised", "ack", "snooze", "cleared", "other"] * 2)]
    values = timed.packed(rows)
    assert len(values) == 3 and timed.unpacked(values) == rows
    assert timed.unpacked(timed.packed([(1, 2, "what")])) == [(1, 2, "other")] and timed.packed([]) == []
