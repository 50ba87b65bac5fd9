import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.streaming import keyed
from eventloom.streaming.keyed import KeyedSink

SCHEMA = "k long, part string, v long, bucket string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sink_at(spark, path, **options):
    return KeyedSink(spark, f"file://{path}/sink", frame(spark, []).schema, ["k", "part"], [F.asc("v")], **{"buckets": 4, "filter_bits": 1 << 12, **options})


def first_of(batches):
    out = {}
    for rows in batches:
        for k, p, v, b in sorted(rows, key=lambda r: r[2]):
            out.setdefault((k, p), (k, p, v, b))
    return Counter(out.values())


def held(sink):
    return Counter(tuple(r) for r in sink.rows().collect())


def random_batches(seed, n):
    rng = random.Random(seed)
    return [[(rng.choice([None, *range(40)]), rng.choice(["a", None]), i * 1000 + j, "x") for j in range(25)] for i in range(n)]


@pytest.mark.parametrize("bits", [1 << 12, 64])
def test_the_first_row_of_each_key_stays(spark, tmp_path, bits):
    sink, batches = sink_at(spark, tmp_path, filter_bits=bits), random_batches(1, 4)
    for i, rows in enumerate(batches):
        sink.append(frame(spark, rows), i)
    assert held(sink) == first_of(batches)
    assert held(sink.rebucketed(f"file://{tmp_path}/more", 16)) == first_of(batches)


def test_a_batch_that_failed_or_came_twice(spark, tmp_path):
    sink, batches = sink_at(spark, tmp_path), random_batches(2, 3)
    sink.append(frame(spark, batches[0]), 0)
    sink.append(frame(spark, batches[1]), 1)
    sink.append(frame(spark, batches[1]), 1)
    before = held(sink)
    # rows and filters of a batch without its manifest are as if they weren't there
    frame(spark, [(999, "z", 1, "left over")]).withColumn(sink.BUCKET, F.lit(0)).write.partitionBy(sink.BUCKET).parquet(f"{sink.folder}/rows/batch=2")
    assert held(sink) == before == first_of(batches[:2])
    sink.append(frame(spark, batches[2]), 2)
    assert held(sink) == first_of(batches)
    sink.append(frame(spark, []), 3)
    assert held(sink) == first_of(batches)


def test_new_keys_read_no_rows_however_many_batches(spark, tmp_path):
    sink = sink_at(spark, tmp_path, filter_bits=1 << 16)
    for i in range(6):
        sink.append(frame(spark, [(i * 100 + j, "a", j, "x") for j in range(30)]), i)
    assert sink.reads() == dict.fromkeys(range(6), 0)
    sink.append(frame(spark, [(5, "a", 0, "x"), (7000, "a", 0, "x")]), 6)
    assert sink.reads()[6] == 1 and sink.rows().count() == 181


def test_a_stream_over_restarts(spark, tmp_path):
    sink, batches = sink_at(spark, tmp_path), random_batches(3, 4)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        return Counter(tuple(r) for r in sink_at(spark, tmp_path).drain(stream, f"file://{tmp_path}/progress").collect())

    for i in (0, 1):
        frame(spark, batches[i]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert run() == run() == first_of(batches[:2])
    for i in (2, 3):
        frame(spark, batches[i]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert run() == first_of(batches) and held(sink) == first_of(batches)


def test_filters_never_deny_a_key():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, (2, 500))
    held_bits = keyed.filter_with(keyed.filter_with(None, *h[:, :200], 1 << 13), *h[:, 200:], 1 << 13)
    assert keyed.filter_holds(held_bits, *h, 1 << 13).all()
    other = rng.integers(-(2**63), 2**63 - 1, (2, 2000))
    assert keyed.filter_holds(held_bits, *other, 1 << 13).mean() < 0.02 and not keyed.filter_holds(None, *other, 1 << 13).any()
