"""Structured Streaming over landed runs: exactly-once inserts, maturity by watermark, recomputed buckets, alerts, recurrence
counters, sliding and session windows, missed bands, expiry.

Every pipeline takes a streaming DataFrame, so its source may be any. :func:`drained` runs one to the end of what has landed
(``availableNow``) and gives the result as a table; a long-running job starts the same plan with another trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import shared_folder


def landed(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a path. Timestamps without a zone become instants, as watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    rows = reader.parquet(path)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema.fields if f.dataType.typeName() == "timestamp_ntz"} or {rows.columns[0]: F.col(rows.columns[0])})


def drained(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that has landed. In update mode a key's last row counts, so each row carries its batch (``_batch``)."""
    spark = rows.sparkSession
    folder, checkpoint = shared_folder(spark, f"{name}-rows"), shared_folder(spark, f"{name}-progress")
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", folder).start()
    else:
        query = writer.foreachBatch(lambda batch, i: batch.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/batch={i}")).start()
    query.awaitTermination()
    found = spark.read.schema(rows.schema if mode == "append" else rows.schema.add("_batch", "long"))
    return found.option("recursiveFileLookup", True).parquet(folder) if mode != "append" else found.parquet(folder)


def latest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last state of each key of an update stream's rows."""
    others = [c for c in rows.columns if c not in (*key, "_batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "_batch").alias("s")).select(*key, "s.*")


def unique_within(rows: DataFrame, key: Sequence[str], at: str, delay: str) -> DataFrame:
    """The first row of each key; its state is kept for ``delay`` of event time."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key))


def insert_once(rows: DataFrame, key: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Appends rows whose key the sink doesn't have yet, exactly once over restarts; a batch reads filters and the buckets that may
    hold its keys (:class:`~.keyed.KeyedSink`), not what earlier batches left."""
    from .keyed import KeyedSink

    spark = rows.sparkSession
    sink = KeyedSink(spark, shared_folder(spark, f"{name}-sink"), rows.schema, key, order)
    return sink.drain(rows, shared_folder(spark, f"{name}-progress"))


def matured_days(rows: DataFrame, at: str, delay: str, *aggregates: Column) -> DataFrame:
    """Aggregates of days that are over for good: a day is given once, when the watermark has passed its end."""
    days = rows.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("w")).agg(*aggregates)
    return days.select(F.to_date("w.start").alias("day"), *[c for c in days.columns if c != "w"])


def sliding(rows: DataFrame, at: str, length: str, step: str, delay: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    wide = rows.withWatermark(at, delay).groupBy(F.window(at, length, step).alias("w"), *keys).agg(*aggregates)
    return wide.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in wide.columns if c != "w"])


def sessions(rows: DataFrame, at: str, gap: str, delay: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    wide = rows.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*aggregates)
    return wide.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in wide.columns if c != "w"])


def recomputed_buckets(rows: DataFrame, key: str, bucket: Column, name: str) -> DataFrame:
    """Rows by bucket of the last version of each key (``version`` tells which), where a later version may move a row to another bucket. A
    batch stores its keys' newest versions; counts are those of the newest of all, so a moved row leaves its old bucket."""
    spark = rows.sparkSession
    folder, checkpoint = shared_folder(spark, f"{name}-versions"), shared_folder(spark, f"{name}-progress")

    def keep(batch: DataFrame, i: int) -> None:
        own = batch.select(key, "version", bucket.alias("bucket"))
        own.groupBy(key).agg(F.max_by("bucket", "version").alias("bucket"), F.max("version").alias("version")).write.mode("overwrite").parquet(f"{folder}/batch={i}")

    rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.option("recursiveFileLookup", True).parquet(folder).groupBy(key).agg(F.max_by("bucket", "version").alias("bucket"))
    return newest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


ALERTS = "source_id long, type string, at timestamp, status string, opened long, reopened long"


def _alert_step(state: tuple, row, snooze_until: float | None) -> tuple:
    """One run's effect on an alert (status, opened, reopened, snoozed until in seconds, or -1)."""
    status, opened, reopened, until = state
    now = row.at.timestamp()
    if row.action == "ack" and status == "OPEN":
        return "ACKNOWLEDGED", opened, reopened, until
    if row.action == "snooze" and status in ("OPEN", "ACKNOWLEDGED"):
        return "SNOOZED", opened, reopened, snooze_until if snooze_until is not None else -1.0
    if row.action == "raised":
        if status in ("NONE", "RESOLVED"):
            return "OPEN", opened + 1, reopened, -1.0
        if status == "SNOOZED" and 0 <= until < now:
            return "OPEN", opened, reopened + 1, -1.0
    if row.action == "cleared" and status in ("OPEN", "ACKNOWLEDGED"):
        return "RESOLVED", opened, reopened, -1.0
    return state


def alerts(rows: DataFrame, snooze_seconds: int) -> DataFrame:
    """Life of each alert (source_id, type): raised opens it once, acknowledged stays open, snoozed sleeps for a time and opens again if it is
    raised after that, cleared (said only by runs that looked) resolves it unless it sleeps. Input: source_id, type, at, action, ordinal; output:
    a row for each key and batch with its status."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = state.get if state.exists else ("NONE", 0, 0, -1.0)
        last = None
        for row in pd.concat(list(frames)).sort_values(["at", "ordinal"]).itertuples():
            own = _alert_step(own, row, row.at.timestamp() + snooze_seconds)
            last = row.at
        state.update(own)
        yield pd.DataFrame({"source_id": [key[0]], "type": [key[1]], "at": [last], "status": [own[0]], "opened": [own[1]], "reopened": [own[2]]})

    grouped = rows.groupBy("source_id", "type")
    return grouped.applyInPandasWithState(run, ALERTS, "status string, opened long, reopened long, until double", "update", GroupStateTimeout.NoTimeout)


def recurrences(rows: DataFrame, least: int = 5) -> DataFrame:
    """Recurrences of each issue (issue_id) since it was opened last, and whether that escalated: once, when ``least`` is reached. Reopening
    starts anew. Input: issue_id, at, action, ordinal."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, escalations, armed = state.get if state.exists else (0, 0, True)
        for row in pd.concat(list(frames)).sort_values(["at", "ordinal"]).itertuples():
            if row.action == "reopened":
                count, armed = 0, True
            elif row.action == "seen":
                count += 1
                if armed and count >= least:
                    escalations, armed = escalations + 1, False
        state.update((count, escalations, armed))
        yield pd.DataFrame({"issue_id": [key[0]], "count": [count], "escalations": [escalations]})

    return rows.groupBy("issue_id").applyInPandasWithState(run, "issue_id long, count long, escalations long", "count long, escalations long, armed boolean", "update", GroupStateTimeout.NoTimeout)


def crossed_bands(runs: DataFrame, target: datetime, bands: Sequence[int] = (180, 90, 30), slack: int = 4) -> DataFrame:
    """Bands of days before ``target`` that a source's runs hit, or jumped over since its last run, which the state keeps: a missed run loses
    no band. Input: source_id, at; output: source_id, at, band."""
    aim = target.replace(tzinfo=UTC).date()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, out = (state.get[0] if state.exists else None), []
        for at in sorted(pd.concat(list(frames))["at"]):
            days = (aim - at.date()).days
            out += [(key[0], at, b) for b in bands if abs(days - b) <= slack or (before is not None and before > b + slack and days < b - slack)]
            before = days
        state.update((before,))
        yield pd.DataFrame(out, columns=["source_id", "at", "band"])

    return runs.groupBy("source_id").applyInPandasWithState(run, "source_id long, at timestamp, band long", "days long", "append", GroupStateTimeout.NoTimeout)


def expired(rows: DataFrame, key: str, at: str, hours: int, delay: str) -> DataFrame:
    """Keys whose last row is over ``hours`` old by the watermark: their state goes, and they are given once (runs that never ended, drafts)."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "last_seconds": [last]})
            return
        last = max(int(pd.concat(list(frames))[at].max().timestamp()), state.get[0] if state.exists else 0)
        state.update((last,))
        state.setTimeoutTimestamp(max(last * 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    grouped = rows.withWatermark(at, delay).groupBy(key)
    return grouped.applyInPandasWithState(run, f"{key} long, last_seconds long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def each_source(rows: DataFrame, source: str, merge: Callable[[DataFrame, int], None], name: str) -> None:
    """Hands every micro-batch, partitioned by source, to ``merge``."""
    checkpoint = shared_folder(rows.sparkSession, f"{name}-progress")
    rows.writeStream.foreachBatch(lambda batch, i: merge(batch.repartition(source), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
