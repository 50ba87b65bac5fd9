import math
import zlib
from collections import Counter, defaultdict

from eventloom.llm import kdshards
from eventloom.llm.kdshards import kd_shards

SCHEMA = "doc_id long, text string, lang string, source string, shard string, row string"


def checked(spark, docs, **options):
    """Contract of the query: every row once, sizes and crcs of whole texts, gapless slots."""
    rows = spark.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA)
    got = kd_shards(rows, **options).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, load = defaultdict(list), Counter()
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, load


def test_equal_bytes(spark):
    docs = [(i, "w" * (i * 37 % 900), ("de", "en", None)[i % 3], f"s{i % 5}") for i in range(1500)]
    _, load = checked(spark, docs, n_shards=16)
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) <= 4 * 901
    _, load = checked(spark, docs, n_shards=5)
    assert set(load) == set(range(5)) and max(load.values()) - min(load.values()) <= 3 * 901
    total = sum(load.values())
    _, load = checked(spark, docs, target_bytes=100_000)
    assert set(load) == set(range(math.ceil(total / 100_000)))


def test_repeated_rows_are_split(spark):
    docs = [(7, "x" * 50, "en", "hot")] * 2000 + [(i, "y" * (i % 120), "en", "s") for i in range(1000)]
    _, load = checked(spark, docs, n_shards=16)
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) <= 5 * 121


def test_order_along_the_widest_dimension(spark):
    """One level against a brute-force weighted median of the widest dimension."""
    docs = [(i * i, "t" * 9, "en", "s") for i in range(101)]
    got, load = checked(spark, docs, n_shards=2)
    assert load == {0: 51 * 10, 1: 50 * 10}
    assert {r["doc_id"] for r in got if r["shard"] == 0} == {i * i for i in range(51)}


def test_many_nodes_are_stored(spark, monkeypatch):
    monkeypatch.setattr(kdshards, "FEW_NODES", 2)
    docs = [(i, "w" * (i * 37 % 300), "en", f"s{i % 5}") for i in range(300)]
    _, load = checked(spark, docs, n_shards=8)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 4 * 301


def test_edges(spark):
    checked(spark, [(None, None, None, None), (1, "", None, "a"), (1, "", None, "a"), (2, "\u00e9\U0001f600", "fr", None)], n_shards=16)
    checked(spark, [(3, "long " * 100_000, "en", "s"), (4, "b", "en", "s")], n_shards=3)
    assert kd_shards(spark.createDataFrame([], SCHEMA), n_shards=4).count() == 0
    assert kd_shards(spark.createDataFrame([], SCHEMA), target_bytes=10).count() == 0
