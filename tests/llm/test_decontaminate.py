import random

import numpy as np

from eventloom.llm import decontaminate as d


def index_of(rows, width=4):
    split = [d.terms_of(t) for _, t in rows]
    df = {}
    for own in split:
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    return d.Index.build(rows, len(rows), sum(map(len, split)) / len(rows), df, width, max(16, max(map(len, split))))


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)] + ["the", "of", "and"] * 20
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) + ". " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    texts = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if k % 3 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(items)[1].upper().split()
        texts.append(" ".join(text))
    return items, [None, "", "!! ??", *texts]


def test_wand_retrieves_all_above_the_threshold():
    items, texts = corpus()
    index = index_of(items)
    for theta in (0.2, 0.35, 0.6):
        searcher = d.Searcher(index, theta, 0, 0)
        for text in texts:
            terms = sorted({index.terms[t] for t in d.terms_of(text) if t in index.terms})
            scores = np.zeros(len(items))
            for t in terms:
                a, b = index.starts[t], index.starts[t + 1]
                scores[index.items[a:b]] += index.impacts[a:b]
            got = dict(searcher.retrieve(terms))
            assert sorted(got) == np.flatnonzero(scores >= theta - 1e-9).tolist()
            assert all(abs(got[j] - scores[j]) < 1e-9 for j in got)


def test_search_equals_brute_force_over_passages():
    items, texts = corpus()
    index = index_of(items)
    searcher = d.Searcher(index, 0.4, 0.5, 0.5)
    for text, found in zip(texts, searcher.search(texts), strict=True):
        terms, want = d.terms_of(text), set()
        for s in range(0, len(terms), index.stride):
            part = terms[s : s + 2 * index.stride]
            for j in range(len(items)):
                score = sum(x for t in set(part) if t in index.terms for i, x in zip(*(v[index.starts[index.terms[t]] : index.starts[index.terms[t] + 1]] for v in (index.items, index.impacts)), strict=True) if i == j)
                if score >= 0.4 - 1e-9 and d.overlap(index.questions[j], part, 4) >= 0.5 and d.overlap(index.answers[j], part, 4) >= 0.5:
                    want.add(items[j][0])
        assert {x["item_id"] for x in found} == want


def test_query_finds_planted_items_alone(spark, monkeypatch):
    items, texts = corpus()
    documents = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, items[3][1], "x")], "doc_id long, text string, bm25 string")
    benchmark = spark.createDataFrame([*items, (None, None), (500, "")], "item_id long, text string")
    planted = {(i, j) for i, t in enumerate(texts) for j, x in items if t and x.upper() in t}
    once = {(r.doc_id, r.item_id) for r in d.leaks(documents, benchmark).collect()}
    assert planted <= once and (None, 3) in once and len(once) <= len(planted) + 3
    monkeypatch.setattr(d, "SHARD_BYTES", 2000)
    assert {(r.doc_id, r.item_id) for r in d.leaks(documents, benchmark).collect()} == once
    assert d.leaks(documents, benchmark.limit(0)).count() == d.leaks(documents.limit(0), benchmark).count() == 0


def test_query_finds_long_items_at_every_offset(spark):
    items, texts = corpus()
    rng = random.Random(3)
    long = {900 + n: " ".join(f"q{rng.randrange(5000)}" for _ in range(n - 10)) + ". " + " ".join(f"a{i}" for i in range(10)) for n in (257, 600, 1000)}
    copies = [(i, "filler " * at + text + " filler" * 50) for i, text in long.items() for at in (0, 1, 100, 255, 300, 511, 700, 999, 2003)]
    documents = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(copies)] + [(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in d.leaks(documents, spark.createDataFrame([*items, *long.items()], "item_id long, text string")).collect()}
    assert {(k, i) for k, (i, _) in enumerate(copies)} == {x for x in found if x[0] < 1000}
    assert {(1000 + k, j) for k, t in enumerate(texts) for j, x in items if t and x.upper() in t} <= found


def test_repeated_items_and_documents(spark):
    items, _ = corpus()
    text = items[3][1]
    bench = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "before " + text), (7, "before " + text), (8, None), (9, "nothing of it")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect())
    assert got == sorted((doc, item) for doc in (7, 7) for item in (1, 1, 2))
