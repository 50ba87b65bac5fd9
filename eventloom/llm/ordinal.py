"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (poor), 1 (fair) or 2 (good). One weight vector over hashed text
features is shared by all grades, and ordered thresholds cut its margin:
``P(grade >= k) = sigmoid(w . x - theta_k)`` with ``theta_1 < theta_2``. The expected grade is the sum of
the two tail probabilities; a document is kept if ``P(grade >= 2)`` reaches ``min_tail``.

Ratings become grades: quality 0 is poor, quality 1 with a toxic mark is fair, quality 1 without
one is good. Training reads at most ``max_train_rows`` rated documents, those of the lowest hashed ids
(the documented bound); every document is scored. Every feature of ``MIN_ROWS`` documents gets a weight. Its value
is 1 if its documents' mean grade is off by ``SURE`` standard errors or more, and falls with the square
of that below, so the penalty on weights holds chance features down and rare telling words still count.

Defined results: a null or empty text has no features and gets the grades' base rates; ratings with a
null quality are ignored, a null toxic mark counts as none; of several ratings of one document the worst
counts; without ratings of two grades all weights are 0; rows that repeat a doc_id are
scored one by one; an empty table gives no rows; columns of the documents pass through
unless they bear a result's name. Whole texts are read, however long.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, given_back, holding, stored

FEATURE_BITS = 20
MAX_TRAIN_BYTES = 256 << 20  # of features of rated documents
MIN_ROWS = 10  # training documents that a feature needs for a weight
SURE = 8.0  # standard errors from which a feature counts in full
SLICE = 1 << 18  # (document, feature) pairs in a step of the gradient, which bounds the driver's memory
FIT_ROWS = 256  # documents whose features are counted at once
RESULTS = ("expected_grade", "p_ge_1", "p_ge_2", "kept")
CORE = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"(.)\1+")


def _bucket(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value}") >> (64 - FEATURE_BITS)


class CharacterShapes(dict):
    """Code point -> what stands for it in a shape."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        value = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if point < 65536:
            self[point] = value
        return value


_CHARACTERS = CharacterShapes()


def shape_of(word: str) -> str:
    """Letter cases, digits and other characters of a word, runs collapsed."""
    return RUN.sub(r"\1", word.translate(_CHARACTERS))


class Words(dict):
    """Word -> feature ids of its letters, and of their first four and five; its shape."""

    LIMIT, LONGEST = 100_000, 64

    def __missing__(self, word: str) -> tuple[tuple[int, ...], str]:
        lower = word.lower()
        core = lower if lower.isalpha() else "".join(CORE.findall(lower))
        ids = (_bucket("w", core), *(_bucket("p", core[:k]) for k in (4, 5) if len(core) > k)) if core else ()
        value = ids, _SHAPES[word.translate(_CHARACTERS)]
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value


class Shapes(dict):
    """Shape with its runs -> the first characters of the shape without."""

    LIMIT, LONGEST = 100_000, 64

    def __missing__(self, shape: str) -> str:
        value = RUN.sub(r"\1", shape)[:8]
        if len(shape) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[shape] = value
        return value


_WORDS, _SHAPES = Words(), Shapes()


def _release() -> None:
    _WORDS.clear()
    _SHAPES.clear()


def features(text: str | None) -> np.ndarray:
    """Sorted ids of the features that a text has: its words and prefixes, the share (by powers of
    two, to 1/16) of each word shape, and the share of words that repeat the one before."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int32)
    found: set[int] = set()
    shares = {"repeat": sum(map(operator.eq, words, words[1:]))}
    for word, n in Counter(words).items():
        ids, shape = _WORDS[word]
        found.update(ids)
        shares[shape] = shares.get(shape, 0) + n
    for shape, n in shares.items():
        level, at = 0, n
        while at < len(words) and level < 5:
            at, level = at * 2, level + 1
        if n and level < 5:
            found.update(_bucket("s", f"{shape}:{k}") for k in range(level, 5))
    return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass
class OrdinalModel:
    ids: np.ndarray  # features with a weight, sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def margin(self, x: np.ndarray) -> float:
        if not len(self.ids) or not len(x):
            return 0.0
        at = np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1)
        return float(self.weights[at[self.ids[at] == x]].sum())

    def tails(self, margins: np.ndarray) -> np.ndarray:
        return _sigmoid(margins[:, None] - self.thresholds[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 150, rate: float = 0.1, l2: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood by Adam with full gradients; deterministic."""
    n = len(rows)
    shares = [(np.sum(grades >= k) + 0.5) / (n + 1) for k in (1, 2)]
    start = np.array([-np.log(p / (1 - p)) for p in shares])
    start[1] = max(start[1], start[0] + 1e-3)
    if n == 0 or len(set(grades.tolist())) < 2:
        return OrdinalModel(np.empty(0, np.int32), np.empty(0), start)
    counts, totals = np.zeros(1 << FEATURE_BITS, np.int64), np.zeros(1 << FEATURE_BITS)
    for a in range(0, n, FIT_ROWS):
        part = np.concatenate(rows[a : a + FIT_ROWS])
        counts += np.bincount(part, minlength=len(counts))
        totals += np.bincount(part, np.repeat(grades[a : a + FIT_ROWS], [len(r) for r in rows[a : a + FIT_ROWS]]), len(counts))
    ids = np.flatnonzero((counts >= MIN_ROWS) & (counts < n)).astype(np.int32)
    off = np.abs(totals[ids] - counts[ids] * grades.mean()) / (np.sqrt(counts[ids]) * grades.std())
    value, place = np.minimum(1.0, off / SURE) ** 2, np.full(len(counts), -1, np.int32)
    place[ids] = np.arange(len(ids))
    owner, at = np.empty(counts[ids].sum(), np.int32), np.empty(counts[ids].sum(), np.int32)
    filled = 0
    for i, row in enumerate(rows):
        found = place[row]
        found = found[found >= 0]
        owner[filled : filled + len(found)], at[filled : filled + len(found)] = i, found
        filled += len(found)
    del counts, totals, place
    slices = [(owner[a : a + SLICE], at[a : a + SLICE]) for a in range(0, len(at), SLICE)]
    # theta_2 = theta_1 + exp(gap): the order of the thresholds can't break
    p = np.concatenate([np.zeros(len(ids)), [start[0], np.log(start[1] - start[0])]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t1, gap = p[:-2], p[-2], p[-1]
        scaled = w * value
        z = sum((np.bincount(o, scaled[c], n) for o, c in slices), np.zeros(n))
        upper = np.column_stack([np.ones(n), _sigmoid(z - t1), _sigmoid(z - t1 - np.exp(gap)), np.zeros(n)])
        slope = upper * (1 - upper)
        pick = np.arange(n)
        likely = np.maximum(upper[pick, grades] - upper[pick, grades + 1], 1e-12)
        lo, hi = slope[pick, grades] / likely, slope[pick, grades + 1] / likely
        dz = (lo - hi) / n
        g2 = (np.where(grades == 2, lo, 0) - np.where(grades == 1, hi, 0)) / n
        dw = sum((np.bincount(c, dz[o], len(ids)) for o, c in slices), np.zeros(len(ids)))
        g = np.concatenate([l2 * w - value * dw, [dz.sum(), g2.sum() * np.exp(gap)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(ids, p[:-2] * value, np.array([p[-2], p[-2] + np.exp(p[-1])]))


def grades_of(labels: DataFrame) -> DataFrame:
    worst = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    return worst.select("doc_id", F.when(F.col("q") < 1, 0).when(F.col("x") > 0, 1).otherwise(2).alias("grade"))


def train(documents: DataFrame, labels: DataFrame, max_train_rows: int = 12_000, text_col: str = "text", max_train_bytes: int = MAX_TRAIN_BYTES) -> OrdinalModel:
    """Fits on the features of at most ``max_train_rows`` rated documents, in the order of their hashed ids as far as ``max_train_bytes`` of
    features go; features are extracted on the executors, and the driver holds ids of features only."""
    # a limit of max_train_rows rows of two numbers: the broadcast is bounded
    rated = F.broadcast(grades_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows))

    def extracted(texts: pd.Series) -> pd.Series:
        holding("ordinal", _release)
        return pd.Series([features(t).tobytes() for t in texts])

    extract = F.pandas_udf(extracted, "binary")
    chosen = documents.select("doc_id", F.col(text_col).alias("text")).join(rated, "doc_id")
    told = stored(chosen.select("doc_id", "grade", extract("text").alias("x")).groupBy("doc_id", "grade").agg(F.min("x").alias("x")), "ordinal-features")
    # the sample is bounded in bytes as well: a window over its bounded rows
    upto = F.sum(F.octet_length("x").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    got = told.withColumn("upto", upto).where(F.col("upto") <= max_train_bytes).select("doc_id", "grade", "x").toArrow()
    order = np.argsort(got["doc_id"].to_numpy()).tolist()
    rows, grades = [np.frombuffer(got["x"][i].as_buffer(), np.int32) for i in order], got["grade"].to_numpy().astype(np.int64)[order]
    model = fit(rows, grades)
    del got, rows
    given_back()  # the driver lives on: later operators would run beside the memory of this fit
    return model


def score(documents: DataFrame, model: OrdinalModel, min_tail: float = 0.7, text_col: str = "text") -> DataFrame:
    """``documents`` with expected_grade, p_ge_1, p_ge_2 and kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a weight for each feature of the bounded sample

    def tails(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        holding("ordinal", _release)
        for texts in batches:
            p = shared.value.tails(np.array([shared.value.margin(features(t)) for t in texts]))
            yield pd.DataFrame({"p1": p[:, 0], "p2": p[:, 1]})

    tails.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    own = free_name([*documents.columns, *RESULTS], "_p")
    p1, p2 = F.col(f"{own}.p1"), F.col(f"{own}.p2")
    scored = documents.drop(*RESULTS).withColumn(own, F.pandas_udf(tails, "p1 double, p2 double")(F.col(text_col)))
    return scored.withColumns({"expected_grade": p1 + p2, "p_ge_1": p1, "p_ge_2": p2, "kept": p2 >= min_tail}).drop(own)


def classify(documents: DataFrame, labels: DataFrame, min_tail: float = 0.7, max_train_rows: int = 12_000, text_col: str = "text") -> DataFrame:
    return score(documents, train(documents, labels, max_train_rows, text_col), min_tail, text_col)
