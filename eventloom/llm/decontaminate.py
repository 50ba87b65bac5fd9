"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

Every passage of every training document is a query: passages are windows of two strides
that start at each stride. Items are searched by classes of length: up to ``CLASS_WORDS`` words, up to twice as
many, and so on. A class's stride is its longest item's words, so every item, however long, lies whole in some
passage, and long items don't widen the passages of short ones. Impacts are divided by the item's score against
its own text, so one threshold holds for all items and all items that reach it are retrieved:

*   a passage is skipped whose terms' greatest impacts don't add up to the threshold, over
    all items or within any of ``COARSE`` coarse blocks (computed for all passages of a batch at once);
*   the rest run block-max WAND: lists advance to the pivot item, blocks whose greatest impacts
    stay below the threshold are skipped, and scores are exact.

A retrieved item is then verified on word runs: the share of the question's and of the answer's
runs that the passage holds. An item's answer is its last sentence, the question what is before it;
an item of one sentence is all question.

The index of one shard of a class (``SHARD_BYTES`` of text) is broadcast; larger benchmarks are
searched shard by shard, with term statistics of the whole.

Defined results: null or empty texts and items match nothing; items that repeat an id or a text
are reported one by one; rows that repeat a doc_id are searched one by one; empty tables give no
rows. Whole texts are searched, however long.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

K1, B = 1.2, 0.75
BLOCK_ITEMS = 16
COARSE = 64
CLASS_WORDS = 256  # words of items in the first class of length
SHARD_BYTES = 16 << 20
EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_"
LEAK = "array<struct<item_id: bigint, bm25: double, question_overlap: double, answer_overlap: double>>"


def terms_of(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    return [t for w in (text.encode("utf-8").lower().split() if text else []) if (t := w.strip(EDGES))]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Terms before and in the last sentence; all are the question if there is but one."""
    cuts = [m.end() for m in re.finditer(r"[.?!]\s+", text.rstrip())]
    question, answer = (terms_of(text[: cuts[-1]]), terms_of(text[cuts[-1] :])) if cuts else (terms_of(text), [])
    return (question, answer) if question and answer else (question + answer, [])


def runs(terms: list[bytes], width: int) -> set[tuple]:
    k = min(width, len(terms))
    return {tuple(terms[i : i + k]) for i in range(len(terms) - k + 1)} if terms else set()


def overlap(own: set[tuple], passage: list[bytes], width: int) -> float:
    """Share of ``own`` runs in a passage; an empty side is met."""
    if not own:
        return 1.0
    k = len(next(iter(own)))
    return len(own & runs(passage, k) if len(passage) >= k else set()) / len(own)


class _TermIds(dict):
    """Raw word -> term number, -1 for words of no item. Emptied when large."""

    LIMIT = 100_000

    def __init__(self, terms: dict[bytes, int]):
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        core = word.strip(EDGES)
        value = self[word] = self.terms.get(core, -1) if core else -2
        return value


@dataclass
class Index:
    ids: list[int]
    questions: list[set]
    answers: list[set]
    terms: dict[bytes, int]
    starts: np.ndarray  # of each term's postings
    items: np.ndarray
    impacts: np.ndarray
    greatest: np.ndarray  # impact of each term
    stride: int
    width: int

    @classmethod
    def build(cls, rows: list[tuple[int, str]], n_items: int, mean_length: float, frequencies: dict[bytes, int], width: int, stride: int) -> Index:
        split = [question_and_answer(t) for _, t in rows]
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for j, (q, a) in enumerate(split):
            counts: dict[bytes, int] = {}
            for t in q + a:
                counts[t] = counts.get(t, 0) + 1
            norm = K1 * (1 - B + B * len(q + a) / mean_length)
            impact = {t: math.log(1 + (n_items - frequencies[t] + 0.5) / (frequencies[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in counts.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                postings.setdefault(t, []).append((j, x / own))
        terms = {t: i for i, t in enumerate(sorted(postings))}
        lists = [postings[t] for t in terms]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat = [p for x in lists for p in x]
        return cls([i for i, _ in rows], [runs(q, width) for q, _ in split], [runs(a, width) for _, a in split], terms, starts, np.array([j for j, _ in flat], np.int64), np.array([x for _, x in flat]), np.array([max(x for _, x in p) for p in lists]), stride, width)

    def blocks(self) -> list[dict[int, float]]:
        """Per term: block of items -> greatest impact in it."""
        out = []
        for a, b in zip(self.starts, self.starts[1:], strict=False):
            best: dict[int, float] = {}
            for j, x in zip(self.items[a:b] // BLOCK_ITEMS, self.impacts[a:b], strict=True):
                best[int(j)] = max(best.get(int(j), 0.0), float(x))
            out.append(best)
        return out


class Searcher:
    """Block-max WAND over one index, for the passages of many texts."""

    def __init__(self, index: Index, threshold: float, min_question: float, min_answer: float):
        self.index, self.threshold, self.min_question, self.min_answer = index, threshold, min_question, min_answer
        self.term_ids = _TermIds(index.terms)
        self.block_best = index.blocks()
        coarse = max(1, -(-len(index.ids) // COARSE))
        self.coarse = np.zeros((len(index.terms), -(-len(index.ids) // coarse)), np.float32)
        np.maximum.at(self.coarse, (np.repeat(np.arange(len(index.terms)), np.diff(index.starts)), index.items // coarse), index.impacts)
        self.lists = [(index.items[a:b].tolist(), index.impacts[a:b].tolist()) for a, b in zip(index.starts, index.starts[1:], strict=False)]

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score against the distinct terms reaches the threshold."""
        theta, found = self.threshold - 1e-9, []
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # item, place, term
        greatest = self.index.greatest
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += greatest[t]
                if bound >= theta:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(self.block_best[t].get(block, 0.0) for _, _, t in cursors[: pivot + 1]) < theta:
                # nothing in this block before the next list's item can reach it
                target = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                self._advance(cursors, pivot + 1, max(target, item + 1))
            elif cursors[0][0] == item:
                score = sum(self.lists[t][1][p] for i, p, t in cursors[: pivot + 1])
                if score >= theta:
                    found.append((item, score))
                self._advance(cursors, pivot + 1, item + 1)
            else:
                self._advance(cursors, pivot, item)
        return found

    def _advance(self, cursors: list[list[int]], n: int, target: int) -> None:
        for c in cursors[:n]:
            own = self.lists[c[2]][0]
            c[1] = bisect_left(own, target, c[1])
            c[0] = own[c[1]] if c[1] < len(own) else -1
        cursors[:] = [c for c in cursors if c[0] >= 0]

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """Verified leaks of each text: the best passage for each item."""
        stride = self.index.stride
        out: list[dict[int, dict]] = [{} for _ in texts]
        words = [t.encode("utf-8").lower().split() if t else [] for t in texts]
        ids = [np.fromiter(map(self.term_ids.__getitem__, w), np.int64, len(w)) for w in words]
        ids = [x[x > -2] for x in ids]  # words of punctuation alone have no place
        lengths = np.array([len(x) for x in ids], np.int64)
        windows = np.maximum(1, -(-lengths // stride))
        first = np.concatenate([[0], np.cumsum(windows)])
        if not lengths.sum() or not len(self.index.terms):
            return [[] for _ in texts]
        flat = np.concatenate(ids)
        doc = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        own = flat >= 0
        flat, doc, at = flat[own], doc[own], at[own]
        # the last place of the same term in the same text: a term counts once in a passage
        key = doc * len(self.index.terms) + flat
        order = np.argsort(key, kind="stable")
        before = np.full(len(key), -1, np.int64)
        same = key[order[1:]] == key[order[:-1]]
        before[order[1:][same]] = at[order[:-1][same]]
        window, best = at // stride, self.index.greatest[flat]
        place = first[doc] + window
        here, earlier = before < window * stride, (window > 0) & (before < (window - 1) * stride)
        place, flat, best = (np.concatenate([x[here], x[earlier] - k]) for x, k in ((place, 1), (flat, 0), (best, 0)))
        bound = np.bincount(place, best, first[-1])
        theta = self.threshold - 1e-6
        some = bound[place] >= theta
        place, flat = place[some], flat[some]
        order = np.argsort(place, kind="stable")
        place, flat = place[order], flat[order]
        heads = np.flatnonzero(np.diff(place, prepend=-1))
        for a in range(0, len(heads), 4096):
            lo, hi = heads[a], heads[a + 4096] if a + 4096 < len(heads) else len(flat)
            sums = np.add.reduceat(self.coarse[flat[lo:hi]], heads[a : a + 4096] - lo, axis=0)
            for k in np.flatnonzero(sums.max(axis=1) >= theta).tolist():
                self._verify(int(place[heads[a + k]]), first, ids, words, out)
        return [[x[j] for j in sorted(x)] for x in out]

    def _verify(self, passage: int, first: np.ndarray, ids: list[np.ndarray], words: list[list[bytes]], out: list[dict[int, dict]]) -> None:
        d = int(np.searchsorted(first, passage, "right")) - 1
        stride = self.index.stride
        start = (passage - int(first[d])) * stride
        part = ids[d][start : start + 2 * stride]
        hits = self.retrieve(np.unique(part[part >= 0]).tolist())
        if hits:
            terms = [t for w in words[d] if (t := w.strip(EDGES))][start : start + 2 * stride]
            for j, score in hits:
                q, a = overlap(self.index.questions[j], terms, self.index.width), overlap(self.index.answers[j], terms, self.index.width)
                if q >= self.min_question and a >= self.min_answer and score > out[d].get(j, {"bm25": -1.0})["bm25"]:
                    out[d][j] = {"item_id": self.index.ids[j], "bm25": score, "question_overlap": q, "answer_overlap": a}


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 4) -> Iterator[Index]:
    """An index for each shard of each class of items. A shard holds ``SHARD_BYTES`` of text, whatever the
    benchmark's size, and so has a bounded broadcast."""
    items = benchmark.where(F.length(F.col(text_col)) > 0).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows_of(batches, "text"):
            rows = [(t, len(own)) for own in map(terms_of, texts) if own for t in (*set(own), b"")]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["term", "n"])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "item_id", "text"):
            rows = [(i, t, n, ((n - 1) // CLASS_WORDS).bit_length()) for i, t in zip(ids, texts, strict=True) if (n := len(terms_of(t)))]
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int32()), strict=True)], names=["item_id", "text", "n", "class"])

    counted = items.mapInArrow(terms, "term binary, n long").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))
    whole = counted.where(F.length("term") == 0).head()
    if whole is None:
        return
    classed = items.mapInArrow(classes, "item_id long, text string, n long, class int")
    for c in classed.groupBy("class").agg(F.max("n").alias("longest"), F.sum(F.octet_length("text")).alias("size")).orderBy("class").collect():
        shards = math.ceil(c["size"] / SHARD_BYTES)
        for k in range(shards):
            own = classed.where((F.col("class") == c["class"]) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)).select("item_id", "text")
            rows = sorted(tuple(r) for r in own.collect())
            names = own.mapInArrow(terms, "term binary, n long").select("term").distinct()
            frequencies = {bytes(r["term"]): r["df"] for r in counted.join(names, "term", "left_semi").select("term", "df").collect()}
            if rows:
                yield Index.build(rows, whole["df"], max(1.0, whole["n"] / whole["df"]), frequencies, width, max(16, c["longest"]))


def _search_udf(shared, threshold: float, min_question: float, min_answer: float):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(shared.value, threshold, min_question, min_answer)
        for texts in batches:
            found = []
            for a in range(0, len(texts), 500):
                found += searcher.search(texts.iloc[a : a + 500].tolist())
            yield pd.Series(found)

    search.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(search, LEAK)


def leak_columns(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_question: float = 0.6, min_answer: float = 0.5, text_col: str = "text", name: str = "leaks") -> DataFrame:
    """``documents`` with an array of verified leaks (item_id, bm25, question_overlap, answer_overlap)."""
    spark, parts = documents.sparkSession, []
    for index in build_indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)
        parts.append(_search_udf(shared, threshold, min_question, min_answer)(F.col(text_col)))
    return documents.withColumn(name, F.concat(*parts) if parts else F.from_json(F.lit("[]"), LEAK))


def leaks(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id and item of every verified leak."""
    found = leak_columns(documents.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", F.inline("leaks"))
