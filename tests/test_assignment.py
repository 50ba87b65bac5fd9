import random
import time

import pytest
from pyspark.sql import functions as F

from eventloom.operators import matching


def greedy(rows):
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    out, seen = [], set()
    for slot, o, e, rank in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, r[1], r[2])):
        if ("o", slot, o) not in seen and ("e", slot, e) not in seen:
            seen |= {("o", slot, o), ("e", slot, e)}
            out.append((slot, o, e, rank))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, "slot int, ordinal long, event_id long, rank int").repartition(3)
    return sorted((tuple(r) for r in matching.assign_one_to_one(df, ["slot"]).collect()), key=str)


@pytest.mark.parametrize("limit, gain", [(1 << 22, 0.05), (20, 0.0), (20, 0.9), (0, 0.0)])
def test_equals_the_sequential_choice(spark, monkeypatch, limit, gain):
    monkeypatch.setattr(matching, "STREAM_PAIRS", limit)
    monkeypatch.setattr(matching, "GAIN", gain)
    rng = random.Random(limit)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), rng.randint(0, 15), rng.randint(0, 15), rng.choice([0, 1, 1, 2, None])) for _ in range(300)]
    rows += rows[:40] + [(0, None, 1, 0), (0, 1, None, 0), (7, 1, 1, 1)]
    assert found(spark, rows) == greedy(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_one_slot_of_a_million_pairs(spark):
    pairs = spark.range(1_000_000).select(F.lit(1).alias("slot"), (F.col("id") % 1000).alias("ordinal"), F.floor(F.col("id") / 1000).alias("event_id"), (F.xxhash64("id") % 3).alias("rank"))
    began = time.time()
    got = sorted((tuple(r) for r in matching.assign_one_to_one(pairs, ["slot"]).collect()), key=str)
    assert time.time() - began < 60
    assert got == greedy([tuple(r) for r in pairs.collect()])
