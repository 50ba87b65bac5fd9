import random
import tracemalloc

import numpy as np

from eventloom.llm import ordinal as o


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2])
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if grade == 0:
            text = [w + "!!" for w in text]
        if grade == 1:
            text[rng.randrange(len(text))] = rng.choice(["nasty", "vile,"])
        yield i, " ".join(text), grade


def test_held_out_accuracy_and_ordered_tails():
    rows = list(corpus(1500, 1))
    model = o.fit([o.features(t) for _, t, _ in rows], np.array([g for _, _, g in rows]))
    assert model.thresholds[0] < model.thresholds[1]
    held = list(corpus(600, 2))
    tails = model.tails(np.array([model.margin(o.features(t)) for _, t, _ in held]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    kept, good = tails[:, 1] >= 0.7, np.array([g == 2 for _, _, g in held])
    assert (kept == good).mean() > 0.97


def test_gradient_against_differences():
    """Full gradients make the likelihood rise to a point that small moves don't improve."""
    rows = list(corpus(300, 4))
    x, g = [o.features(t) for _, t, _ in rows], np.array([k for _, _, k in rows])

    def loss(m):
        t = m.tails(np.array([m.margin(r) for r in x]))
        p = np.column_stack([1 - t[:, 0], t[:, 0] - t[:, 1], t[:, 1]])[np.arange(len(g)), g]
        return -np.log(np.maximum(p, 1e-12)).mean() + 5e-5 * (m.weights**2).sum()

    model = o.fit(x, g, steps=1500, rate=0.02)
    best = loss(model)
    for k in range(2):
        for d in (-0.05, 0.05):
            moved = model.thresholds.copy()
            moved[k] += d
            assert loss(o.OrdinalModel(model.ids, model.weights, moved)) > best - 1e-4


def test_query_cases(spark):
    rows = [*((i, t) for i, t, _ in corpus(300, 5)), (None, None), (900, ""), (901, "w1 " * 50_000), (901, "w1 " * 50_000)]
    documents = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, min(g, 1), int(g == 1)) for i, _, g in corpus(300, 5)] + [(900, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = o.classify(documents, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.p_ge_2 <= r.p_ge_1 <= 1 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 for r in got)
    assert len({r.p_ge_2 for r in got if r.doc_id == 901}) == 1
    assert o.classify(documents, labels.limit(0)).where("kept is null").count() == 0
    assert o.classify(documents.limit(0), labels).count() == 0


def test_toxic_words_count_with_a_few_hundred_ratings():
    def rated(n, seed):
        rng = random.Random(seed)
        words = [x + y for x in "bcdfghklmn" for y in ("ado", "ebi", "iru", "osa", "uta")]
        for _ in range(n):
            grade = rng.choice([0, 1, *[2] * 8])
            text = [rng.choice(words) + "!" * (grade == 0) for _ in range(rng.randint(20, 120))]
            if grade == 1:
                text[rng.randrange(len(text))] = rng.choice(["nasty", "vile"])
            yield o.features(" ".join(text)), grade

    rows, held = list(rated(400, 1)), list(rated(2000, 2))
    model = o.fit([x for x, _ in rows], np.array([g for _, g in rows]))
    kept = model.tails(np.array([model.margin(x) for x, _ in held]))[:, 1] >= 0.7
    grades = np.array([g for _, g in held])
    assert kept[grades == 1].mean() < 0.2 and kept[grades == 2].mean() > 0.9


def test_query_equals_brute_force(spark):
    """The distributed query against a model fitted and applied document by document with dictionaries and sums."""
    import math

    rows = [*((i, t) for i, t, _ in corpus(400, 8)), (None, "w1 w2"), (401, None), (7, "another text of a rated id")]
    labels = [(i, min(g, 1), int(g == 1)) for i, _, g in corpus(400, 8) if i % 2 == 0]
    documents = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, _p string, kept string").repartition(3)
    got = o.classify(documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r._p == "a" for r in got)
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, []).append(t)
    rated = {i: 0 if q < 1 else 1 if x > 0 else 2 for i, q, x in labels}
    order = sorted(i for i in rated if i in texts)
    model = o.fit([np.frombuffer(min(o.features(t).tobytes() for t in texts[i]), np.int32) for i in order], np.array([rated[i] for i in order]))
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))

    def tail(text, k):
        z = sum(weight.get(f, 0.0) for f in o.features(text).tolist()) - model.thresholds[k]
        return 1 / (1 + math.exp(-z))

    want = sorted((str(i), round(tail(t, 0), 9), round(tail(t, 1), 9), tail(t, 1) >= 0.7) for i, t in rows)
    assert sorted((str(r.doc_id), round(r.p_ge_1, 9), round(r.p_ge_2, 9), r.kept) for r in got) == want


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j}" for j in range(50)) + (" bad" if i % 2 else " good")) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    whole, few = o.train(docs, labels), o.train(docs, labels, max_train_bytes=700)
    assert len(whole.ids) and few.thresholds.tolist() != whole.thresholds.tolist()
    assert not len(o.train(docs, labels, max_train_bytes=0).ids)


def test_fit_holds_little_more_than_its_rows():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 50_000, 1000)).astype(np.int32) for _ in range(4000)]
    grades = rng.integers(0, 3, len(rows))
    tracemalloc.start()
    o.fit(rows, grades, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * sum(r.nbytes for r in rows) + (32 << 20)


def test_new_words_of_known_shapes_cost_no_search(monkeypatch):
    """A corpus brings ever new words: neither their letters nor their shapes may be searched word by word."""
    calls = []

    class Counting:
        def __init__(self, pattern):
            self.pattern = pattern

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.pattern, name)

    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcdefgé", k=rng.randint(3, 9))) for _ in range(3000)})
    want = o.features(" ".join(words)).tolist()
    o._release()
    monkeypatch.setattr(o, "CORE", Counting(o.CORE))
    monkeypatch.setattr(o, "RUN", Counting(o.RUN))
    assert o.features(" ".join(words)).tolist() == want and len(words) > 2000
    assert len(calls) < 20


def test_features_of_odd_words_by_hand():
    import re

    def by_hand(text):
        found, shares, words = set(), {}, text.split()
        for w in words:
            core = "".join(re.findall(r"[^\W\d_]+", w.lower()))
            found |= {o._bucket("w", core), *(o._bucket("p", core[:k]) for k in (4, 5) if len(core) > k)} if core else set()
            shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w))[:8]
            shares[shape] = shares.get(shape, 0) + 1
        shares["repeat"] = shares.get("repeat", 0) * 0 + sum(x == y for x, y in zip(words, words[1:], strict=False))
        for shape, n in shares.items():
            found |= {o._bucket("s", f"{shape}:{k}") for k in range(5) if n * 2**k >= len(words)}
        return sorted(found)

    rng = random.Random(3)
    odd = ["İstanbul", "ǅ", "x²", "Ⅷ", "a_b", "٣٤", "字字", "😀😀", "ßẞ", "it's", "--", "0", "AAA", "ée", "z" * 200, "Q" * 70 + "!", "\x00", "𝒳𝒳y", "#" * 90]
    for _ in range(60):
        text = " ".join(rng.choices(odd, k=rng.randint(1, 30)))
        assert o.features(text).tolist() == by_hand(text), text


def test_the_driver_gives_back_the_memory_of_the_fit(spark, monkeypatch):
    called = []
    monkeypatch.setattr(o, "given_back", lambda: called.append(1), raising=False)
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(40, 5)], "doc_id long, text string")
    o.train(docs, spark.createDataFrame([(i, min(g, 1), int(g == 1)) for i, _, g in corpus(40, 5)], "doc_id long, quality int, toxic int"))
    assert called
