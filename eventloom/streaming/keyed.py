"""A keyed sink: rows in hash buckets of their key, with a Bloom filter for each bucket and a manifest for each batch.

A batch's keys are tested against the filters of their buckets. Only buckets that may hold one of them are read, their key
columns alone; a batch of new keys reads filters and next to no rows, however many batches came before. New rows, the filters of the buckets they fall
into and then the manifest are written. The manifest is the commit: readers see batches that have one, and a batch that runs again
starts from the manifest before it and overwrites what it left.

A filter has ``filter_bits`` bits. Beyond about a tenth as many keys a bucket is tested in vain ever more often, which costs reads
and no rows; :meth:`KeyedSink.rebucketed` copies a sink to more buckets.

Defined results: of a batch's rows with one key the first by ``order`` counts; null key columns are values like others; an empty batch leaves an empty
commit; the key's hash only chooses buckets and filter bits, keys themselves are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.windows import pick_best
from ..storage import written

PROBES = 7


def _bits(h1: np.ndarray, h2: np.ndarray, n: int) -> np.ndarray:
    """The filter bits of keys, a row each."""
    with np.errstate(over="ignore"):
        steps = np.arange(PROBES, dtype=np.uint64)[:, None]
        return ((h1.astype(np.int64).view(np.uint64) + steps * (h2.astype(np.int64).view(np.uint64) | np.uint64(1))) % np.uint64(n)).T


def filter_holds(held: bytes | None, h1: np.ndarray, h2: np.ndarray, n: int) -> np.ndarray:
    """Whether a filter may hold each key; no for certain where it says so."""
    if not held:
        return np.zeros(len(h1), bool)
    at = _bits(h1, h2, n)
    return ((np.frombuffer(held, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def filter_with(held: bytes | None, h1: np.ndarray, h2: np.ndarray, n: int) -> bytes:
    """The filter with further keys."""
    own = np.frombuffer(held, np.uint8).copy() if held else np.zeros(n // 8, np.uint8)
    at = _bits(h1, h2, n).ravel()
    np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return own.tobytes()


class KeyedSink:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: Sequence[str], order: Sequence[Column], buckets: int = 16, filter_bits: int = 1 << 20):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.key, self.order, self.buckets, self.filter_bits = list(key), list(order), buckets, filter_bits

    # names that no column of the rows can clash with
    BUCKET, H1, H2, MAYBE = "sink_bucket__", "sink_h1__", "sink_h2__", "sink_maybe__"

    def _manifests(self, before: int | None = None) -> DataFrame | None:
        """Rows (batch, bucket, n, reads) of committed batches, of those before ``before``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        numbers = [int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        numbers = sorted(n for n in numbers if before is None or n < before)
        if not numbers:
            return None
        last = self.spark.read.schema("batch long, bucket int, n long, reads long, filter long").parquet(f"{self.folder}/manifest/batch={numbers[-1]}")
        return last

    def _commits(self, manifest: DataFrame | None) -> list[tuple]:
        """What each bucket holds: (bucket, batches with rows, batch with the newest filter); a row a bucket."""
        if manifest is None:
            return []
        held = manifest.where("n > 0").groupBy("bucket").agg(F.sort_array(F.collect_set("batch")).alias("batches"), F.max("filter").alias("filter"))
        return [tuple(r) for r in held.collect()]

    def _keyed(self, rows: DataFrame) -> DataFrame:
        flagged = [x for k in self.key for x in (F.col(k).isNull(), F.col(k))]  # a hash skips nulls
        return rows.withColumns({self.BUCKET: F.pmod(F.xxhash64(F.lit(0), *flagged), F.lit(self.buckets)).cast("int"), self.H1: F.xxhash64(F.lit(1), *flagged), self.H2: F.xxhash64(F.lit(2), *flagged)})

    def _same_key(self, a: DataFrame, b: DataFrame) -> Column:
        on = F.lit(True)
        for k in self.key:
            on = on & a[k].eqNullSafe(b[k])
        return on

    def append(self, batch: DataFrame, number: int) -> None:
        """Adds the rows of new keys as batch ``number``; numbers go up, and a number may be given again."""
        manifest = self._manifests(number)
        held = {bucket: (batches, filter_at) for bucket, batches, filter_at in self._commits(manifest)}
        rows = written(self._keyed(pick_best(batch, self.key, self.order)).select(*self.schema.names, self.BUCKET, self.H1, self.H2), "sink-batch")
        touched = [r[0] for r in rows.select(self.BUCKET).distinct().collect()]  # at most one for each bucket
        filters = [f"{self.folder}/filters/batch={held[b][1]}/bucket={b}" for b in touched if b in held]
        schema, n_bits = "bucket int, bits binary", self.filter_bits
        known = self.spark.read.schema(schema).option("basePath", f"{self.folder}/filters").parquet(*filters).select("bucket", "bits") if filters else self.spark.createDataFrame([], schema)
        fields = f"{self.BUCKET} int, {self.H1} long, {self.H2} long"
        tested = rows
        if filters:
            bucket, h1, h2, maybe = self.BUCKET, self.H1, self.H2, self.MAYBE

            def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                bits = right["bits"].iloc[0] if len(right) else None
                return left.assign(**{maybe: filter_holds(bits, left[h1].to_numpy(), left[h2].to_numpy(), n_bits)})[[bucket, h1, h2, maybe]]

            asked = rows.select(bucket, h1, h2).groupBy(bucket).cogroup(known.withColumnRenamed("bucket", bucket).groupBy(bucket))
            doubtful = written(asked.applyInPandas(test, f"{fields}, {maybe} boolean").where(maybe), "sink-doubtful")
            look = [r[0] for r in doubtful.select(bucket).distinct().collect()]
            paths = [f"{self.folder}/rows/batch={i}/{self.BUCKET}={b}" for b in look if b in held for i in held[b][0]]
            if paths:
                earlier = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths).select(*self.key)
                tested = rows.join(earlier, self._same_key(rows, earlier), "left_anti")
        else:
            look = []
        new = written(tested, "sink-new")
        counts = new.groupBy(F.col(self.BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        new.select(*self.schema.names, self.BUCKET).write.mode("overwrite").partitionBy(self.BUCKET).parquet(f"{self.folder}/rows/batch={number}")
        bucket, h1, h2 = self.BUCKET, self.H1, self.H2

        def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({"bucket": pd.Series([], dtype="int32"), "bits": pd.Series([], dtype=object)})
            bits = right["bits"].iloc[0] if len(right) else None
            return pd.DataFrame({"bucket": [int(left[bucket].iloc[0])], "bits": [filter_with(bits, left[h1].to_numpy(), left[h2].to_numpy(), n_bits)]})

        grown = new.select(bucket, h1, h2).groupBy(bucket).cogroup(known.withColumnRenamed("bucket", bucket).groupBy(bucket)).applyInPandas(add, schema)
        grown.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/filters/batch={number}")
        own = counts.select(F.lit(number).cast("long").alias("batch"), "bucket", "n", F.lit(len(look)).cast("long").alias("reads"), F.lit(number).cast("long").alias("filter"))
        done = self.spark.createDataFrame([(number, -1, 0, len(look), -1)], own.schema)  # tells of a batch without new rows
        both = own.unionByName(done)
        (both if manifest is None else both.unionByName(manifest)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={number}")

    def rows(self) -> DataFrame:
        """The rows of committed batches."""
        manifest = self._manifests()
        paths = [] if manifest is None else [f"{self.folder}/rows/batch={r[0]}" for r in manifest.where("n > 0").select("batch").distinct().collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths).select(*self.schema.names)

    def reads(self) -> dict[int, int]:
        """Buckets whose rows each batch had to read."""
        manifest = self._manifests()
        return {} if manifest is None else {r[0]: r[1] for r in manifest.where("bucket = -1").select("batch", "reads").collect()}

    def rebucketed(self, folder: str, buckets: int) -> KeyedSink:
        """A copy in another number of buckets."""
        out = KeyedSink(self.spark, folder, self.schema, self.key, self.order, buckets, self.filter_bits)
        out.append(self.rows(), 0)
        return out

    def drain(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Runs a stream into the sink to the end of what has landed, and gives the sink's rows."""
        stream.writeStream.foreachBatch(lambda batch, i: self.append(batch, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self.rows()
