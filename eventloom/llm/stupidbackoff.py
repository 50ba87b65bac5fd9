"""Stupid-backoff language-model scores of all documents from n-gram counts of all documents.

``S(w | h) = count(h w) / count(h)`` if the n-gram h w occurs at least ``min_count`` times in the corpus, else
``alpha * S(w | h without its first word)``; the last level is ``count(w) / N``. The scored documents are the
corpus, so every n-gram was seen: ``min_count`` of 2, the default, asks for one seen elsewhere too.

A document's score is that of backing off everywhere, plus for each n-gram of at least ``min_count`` what its own
estimate adds over the one below. All of it is tables:

*   words are counted; the ``TOP`` most frequent ones (a bound, so a broadcast) give their counts on the spot;
*   pairs of words are exploded, one row each, and partitioned by their hash, where each is counted and its
    documents' rows take the count. The key of a pair of top words is their two ranks, which gives back both counts;
    rarer words of a pair that counts are looked up in the word table by a join;
*   what rows add is summed per document.

Pairs of two of the ``HOT`` most frequent words don't meet in one
partition: their counts are pre-aggregated to at most ``HOT`` squared sums, which are broadcast.
From trigrams on, n-grams carry the hashes of their history and suffix, and those that count are joined to the table below.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, n-grams 64-bit hashes. Defined results: a null
or empty text has no words and a score of 0; rows that repeat a doc_id count and are scored one by
one; an empty table gives no rows; other columns are ignored. Whole texts, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_words, mixed, stored, windows

RANK_BITS = 21
TOP = 1 << RANK_BITS
HOT = 1024
DOCS = 500
BINS = 64  # of the word counts' logarithm to base 2


@dataclass
class Words:
    """The most frequent words: hashes in order, their ranks by frequency, and natural logs of counts by rank."""

    hashes: np.ndarray
    ranks: np.ndarray
    logs: np.ndarray
    n_words: int
    rarest: int  # no other word has a count of this or more
    pairs: np.ndarray | None = None  # counts of pairs of hot words

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Ranks of words, -1 for those that aren't here."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ranks[at].astype(np.int64), -1)  # two of them are packed to one number


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each word."""
    return mixed(windows(hashes, n) + np.uint64(n)) if len(hashes) >= n else hashes[:0]


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """A few documents at a time: their rows, all words' hashes, where each text's words start, and each word's place in its text."""
    for batch in batches:
        for a in range(0, batch.num_rows, DOCS):
            part = batch.slice(a, DOCS)
            hashes, at = hashed_words(part.column(column))
            yield part, hashes, at, np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, _, _ in _parts(batches, 0):
            words, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(words)), pa.array(n)], names=["word", "n"])

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bin() -> F.Column:
    return F.floor(F.log2("n") * BINS)


def top_words(counts: DataFrame) -> tuple[Words, float]:
    """At most ``TOP`` words, all those from some count on, and the bin of that count."""
    n_words = counts.agg(F.sum("n")).head()[0] or 0
    cut, room = math.inf, TOP
    for r in sorted(counts.groupBy(_bin().alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        room -= r["count"]
        if room < 0:
            break
        cut = r["bin"]
    own = _bin() >= F.lit(float(cut))
    got = counts.where(own).toArrow()  # two numbers for each of at most TOP words
    word, n = np.asarray(got["word"], np.int64).view(np.uint64), np.asarray(got["n"], np.int64)
    order = np.argsort(word)
    word, n = word[order], n[order]
    by_count = np.lexsort((word, -n))
    ranks = np.empty(len(n), np.int32)
    ranks[by_count] = np.arange(len(n), dtype=np.int32)
    rarest = (counts.where(~own).agg(F.max("n")).head()[0] or 0) + 1
    return Words(word, ranks, np.log(n[by_count]), n_words, rarest), cut


def hot_pairs(texts: DataFrame, words: Words) -> np.ndarray:
    """Counts of all pairs of hot words that follow each other in a text."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, _, place in _parts(batches, 0):
            rank = shared.value.rank(hashes)
            hot = (rank >= 0) & (rank < HOT)
            own = hot[:-1] & hot[1:] & (place[1:] > 0)
            pairs, n = np.unique(rank[:-1][own] * HOT + rank[1:][own], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    got = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(HOT * HOT, np.int64)
    out[np.asarray(got["pair"], np.int64)] = np.asarray(got["n"], np.int64)
    return out


ROWS = "kind byte, key long, row long, value double, first long, second long"
DOC, RARE, PAIR, RARE_PAIR = 0, 1, 2, 3


def exploded(documents: DataFrame, words: Words, order: int, alpha: float, min_count: int) -> DataFrame:
    """The rows of single words and pairs. By ``kind``: of each document its id (first), words (second) and the
    value that is known at once; of each rarer word its key; of each pair that may count its key and, where one is
    rarer, the value of the other's count and the words whose counts aren't in it."""
    shared, log_alpha = documents.sparkSession.sparkContext.broadcast(words), math.log(alpha)
    types = [pa.int8(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def rows(kind: int, key, row, value=None, first=None, second=None) -> pa.RecordBatch:
        arrays = [np.full(len(row), kind, np.int8), key, row, value, first, second]
        arrays = [pa.nulls(len(row), t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(arrays, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        log_n, few = math.log(max(1, w.n_words)), math.log(min_count) - 1e-9
        for part, hashes, at, place in _parts(batches, 2):
            row, lengths = part.column(0).to_numpy(), np.diff(at)
            owner, rank = np.repeat(np.arange(len(row)), lengths), w.rank(hashes)
            known = rank >= 0
            logs = np.where(known, w.logs[rank], 0.0) if len(w.logs) else np.zeros(len(hashes))
            # what the last level gives after backing off from all others; without a rarer word's own count
            base = logs - log_n + log_alpha * np.minimum(place, order - 1)
            t = np.flatnonzero(place[1:] > 0) + 1 if order > 1 else np.empty(0, np.int64)
            h = t - 1
            both = known[h] & known[t] & (rank[h] < HOT) & (rank[t] < HOT)
            n = w.pairs[rank[h[both]] * HOT + rank[t[both]]]
            gain = np.zeros(len(hashes))  # of the pair that ends at each word
            gain[t[both]] = np.where(n >= min_count, np.log(np.maximum(n, 1)) - logs[h[both]] - (logs[t[both]] - log_n + log_alpha), 0.0)
            sums = np.bincount(owner, base + gain, len(row))
            yield rows(DOC, _signed(mixed(row.astype(np.uint64) + np.uint64(0x51ED27))), row, sums, part.column(1), lengths)
            if w.rarest > 2 and (rare := np.flatnonzero(~known)).size:  # else such words occur once
                yield rows(RARE, _signed(hashes[rare]), row[owner[rare]], np.zeros(len(rare)))
            # a word of fewer than min_count is in no pair of as many
            own = ~both & ~(known[h] & (logs[h] < few)) & ~(known[t] & (logs[t] < few))
            top = own & known[h] & known[t]
            yield rows(PAIR, rank[h[top]] << RANK_BITS | rank[t[top]], row[owner[h[top]]])
            if w.rarest > min_count:
                h, t = h[own & ~top], t[own & ~top]
                first, second = (pa.array(_signed(hashes[x]), pa.int64(), mask=known[x]) for x in (h, t))
                key = _signed(mixed(mixed(hashes[h] * np.uint64(0x9E3779B97F4A7C15) + hashes[t]) + np.uint64(2)))
                yield rows(RARE_PAIR, key, row[owner[h]], -logs[h] - (logs[t] - log_n + log_alpha), first, second)

    return documents.select("row", "doc_id", "text").mapInArrow(run, ROWS)


def _known(rows: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the value that ``table`` (word, log_n) has for ``column``, 0 where that is null."""
    return rows.join(table.select(F.col("word").alias(column), F.col("log_n").alias(name)), column, "left").fillna(0.0, [name])


def pair_gains(rows: DataFrame, counts: DataFrame, words: Words, cut: float, alpha: float, min_count: int) -> DataFrame:
    """row, value, and of document rows first and second, for every exploded row that adds to a score."""
    shared, offset = rows.sparkSession.sparkContext.broadcast(words), math.log(max(1, words.n_words)) - math.log(alpha)
    # one shuffle serves both uses below: a condition on the kind alone would be moved below it and make it two
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "kind")))

    def value(key: pd.Series, n: pd.Series) -> pd.Series:
        k, logs = key.to_numpy(np.int64), shared.value.logs if len(shared.value.logs) else np.zeros(1)  # rows that are no pairs come with key 0
        return pd.Series(np.log(n.to_numpy(np.int64)) - logs[k >> RANK_BITS] - logs[k & ((1 << RANK_BITS) - 1)] + offset)

    pair = F.pandas_udf(value, "double")
    adds = F.expr(f"CASE WHEN n >= {min_count} THEN kind <> {RARE_PAIR} ELSE kind < {PAIR} END")
    is_pair, is_doc = F.col("kind") == PAIR, F.col("kind") == DOC
    done = counted.where(adds).withColumn("_pair", pair(F.when(is_pair, F.col("key")).otherwise(0), "n"))
    own = F.when(is_pair, F.col("_pair")).when(is_doc, F.col("value")).otherwise(F.col("value") + F.log("n"))
    done = done.select("row", own.alias("value"), *(F.when(is_doc, F.col(c)).alias(c) for c in ("first", "second")))
    if words.rarest <= min_count:
        return done
    # pairs of rarer words that count are few, and no such word is common
    rare = counts.where(_bin() < F.lit(float(cut))).select("word", F.log("n").alias("log_n"))
    left = counted.where(F.expr(f"CASE WHEN n >= {min_count} THEN kind = {RARE_PAIR} ELSE false END"))
    left = _known(_known(left, rare, "first", "a"), rare, "second", "b")
    missing = F.lit(None).cast("long")
    return done.union(left.select("row", F.col("value") + F.log("n") - F.col("a") - F.col("b"), missing, missing))


def higher_grams(documents: DataFrame, n: int) -> DataFrame:
    """key, row, history, suffix of every n-gram, n of at least 2; these two are hashes of (n - 1)-grams, or words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes, at, place in _parts(batches, 1):
            left = np.repeat(at[1:], np.diff(at)) - np.arange(len(hashes))
            own = np.flatnonzero(left >= n)
            grams, below = _grams(hashes, n), _grams(hashes, n - 1) if n > 2 else hashes
            row = part.column(0).to_numpy()[np.repeat(np.arange(part.num_rows), np.diff(at))]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(grams[own])), pa.array(row[own]), pa.array(_signed(below[own])), pa.array(_signed(below[own + 1]))], names=["key", "row", "history", "suffix"])

    return documents.select("row", "text").mapInArrow(run, "key long, row long, history long, suffix long")


def _estimates(grams: DataFrame, below: DataFrame, min_count: int) -> DataFrame:
    """key, n, score and suffix score of the n-grams that count, from the table below (key, n, score)."""
    counted = grams.groupBy("key", "history", "suffix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    out = counted.join(below.select(F.col("key").alias("history"), F.col("n").alias("before")), "history")
    out = out.join(below.select(F.col("key").alias("suffix"), F.col("score").alias("lower")), "suffix")
    return out.select("key", "n", (F.log("n") - F.log("before")).alias("score"), "lower")


def score_documents(documents: DataFrame, order: int = 2, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score (both natural logarithms)."""
    base = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = stored(word_counts(base.select("text")), "lm-words")
    words, cut = top_words(counts)
    words.pairs = hot_pairs(base.select("text"), words)
    gains = pair_gains(exploded(base, words, order, alpha, min_count), counts, words, cut, alpha, min_count)
    if order > 2:
        table = counts.select(F.col("word").alias("key"), "n", (F.log("n") - math.log(max(1, words.n_words))).alias("score"))
        table = stored(_estimates(higher_grams(base, 2), table, min_count), "lm-table2")
        for n in range(3, order + 1):
            grams = higher_grams(base, n)
            table = stored(_estimates(grams, table, min_count), f"lm-table{n}")
            missing = F.lit(None).cast("long")
            more = grams.select("key", "row").join(table, "key").select("row", (F.col("score") - F.col("lower") - math.log(alpha)).alias("value"), missing.alias("first"), missing.alias("second"))
            gains = gains.union(more)
    scored = gains.groupBy("row").agg(F.sum("value").alias("log_score"), F.max("first").alias("doc_id"), F.max("second").alias("n_words"))
    return scored.select("doc_id", "n_words", "log_score", F.coalesce(F.try_divide("log_score", "n_words"), F.lit(0.0)).alias("mean_log_score"))
