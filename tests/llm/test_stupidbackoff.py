import math
import random
import re
from collections import Counter

import pytest

from eventloom.llm import stupidbackoff as sb


def brute(texts, order, alpha, min_count):
    words = [[w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))

    def s(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= min_count else alpha * s(gram[1:])

    return [(len(w), sum(math.log(s(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))) for w in words]


@pytest.mark.parametrize(("order", "min_count", "top"), [(1, 2, 16), (2, 2, 1 << 21), (2, 2, 16), (2, 1, 0), (3, 1, 16), (4, 2, 16)])
def test_scores_equal_brute_force(spark, monkeypatch, order, min_count, top):
    monkeypatch.setattr(sb, "TOP", top)
    monkeypatch.setattr(sb, "HOT", 6)
    monkeypatch.setattr(sb, "DOCS", 7)
    rng = random.Random(order)
    vocabulary = ["the", "The", "a", "É", "é", "x\x0by", *(f"w{i}" for i in range(60))]
    texts = [None, "", " \n", "one", "Zwei", "the " * 5000, *(" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(150))]
    rows = [*((i, t, "clash") for i, t in enumerate(texts)), (None, "the a", "c"), (7, texts[7], "c")]
    want = sorted((repr(i), n, s) for (i, _, _), (n, s) in zip(rows, brute([t for _, t, _ in rows], order, 0.4, min_count), strict=True))
    found = sb.score_documents(spark.createDataFrame(rows, "doc_id long, text string, batch string"), order=order, min_count=min_count).collect()
    got = sorted((repr(r.doc_id), r.n_words, r.log_score) for r in found)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)


def test_large_vocabulary(spark, monkeypatch):
    """Ranks far beyond those of hot words, as pairs pack two of them to one key."""
    monkeypatch.setattr(sb, "HOT", 8)
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 30_000}" for _ in range(400)) for _ in range(60)]
    rows = list(enumerate(texts))
    got = sorted((r.doc_id, r.log_score) for r in sb.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [s for _, s in got] == pytest.approx([s for _, s in brute(texts, 2, 0.4, 2)], abs=1e-6)


def test_empty_table(spark):
    assert sb.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_trigram_query(spark, tmp_path):
    from eventloom.llm.queries import QUERIES

    rng = random.Random(7)
    texts = [None, *(" ".join(rng.choices(["the", "a", "b", "c"], k=rng.randint(0, 40))) for _ in range(40))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_words, r.log_score) for r in QUERIES["op5_stupid_backoff_order3"](spark, str(tmp_path)).collect())
    want = brute(texts, 3, 0.4, 2)
    assert [x[:2] for x in got] == [(i, n) for i, (n, _) in enumerate(want)]
    assert [x[2] for x in got] == pytest.approx([s for _, s in want], abs=1e-4)
