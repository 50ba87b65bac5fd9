import random

import numpy as np
import pytest

from eventloom.llm import jaccard
from eventloom.llm.common import lower_words
from eventloom.llm.components import components


def shingles(text, width):
    words = lower_words(text)
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min((v for v in (least.get(find(k)), i) if v is not None), default=None)
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for _ in range(90):  # one large group of near copies of many distances
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append(" ".join(own))
    for _ in range(60):  # unlike documents that share a passage
        rows.append(" ".join(base[:40] + [rng.choice(words) for _ in range(rng.randint(1, 60))]))
    for _ in range(25):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        rows += [text, text.upper(), f"{text} {rng.choice(words)}"]
    rows += [None, "", " \n", "one", "One", "one two", "one two", "w1 " * 20_000, "\x0bw1\x0c" * 20_000]
    rng.shuffle(rows)
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    out = list(zip(ids, rows, strict=True))
    return [*out, (out[0][0], out[0][1]), (out[1][0], "another text of an id that repeats")]


@pytest.mark.parametrize(("width", "percent", "leaf", "block"), [(3, 90, 1024, 256), (5, 80, 6, 4)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, leaf, block):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "NARROW", 2 * leaf)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT_KEYS", 64 if leaf < 100 else 1024)
    rows = corpus(width)
    documents = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(documents, width, percent).collect()), key=repr)
    assert got == brute(rows, width, percent)


def test_cells_keep_every_link(spark, monkeypatch):
    """Voronoi cells of one region: two linked documents meet in a cell, or one of them is its pivot and linked there."""
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rng = random.Random(9)
    base = [rng.randrange(2**62) for _ in range(60)]
    sets = {}
    for node in range(1, 60):
        own = set(base[: rng.randint(30, 60)]) | {rng.randrange(2**62) for _ in range(rng.randint(0, 8))}
        sets[node] = sorted(own)
    packed = spark.createDataFrame([(n, bytearray(np.array(s, np.uint64).tobytes())) for n, s in sets.items()], "node long, shingles binary")
    large = spark.createDataFrame([(5, n, n, 0) for n in sets], "region long, node long, component long, home long")
    cells, links = jaccard._cells(large, packed, 80, 0)
    linked = {frozenset((r.u, r.v)) for r in links.collect()}
    members = {}
    for r in cells.collect():
        members.setdefault(r.region, {r.pivot}).add(r.node)
    for a in sets:
        for b in sets:
            if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b])):
                assert frozenset((a, b)) in linked or any({a, b} <= m for m in members.values())


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "x y z"), (None, "x y z")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, None), (None, 2, None), (4, 1, 4), (None, 1, 4)], key=repr)


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}


def test_what_shares_a_shingle_by_chance_is_in_no_region(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    # each document has twelve passages of three words that one other document has too, in otherwise unlike texts; one is a near copy
    passages = [" ".join(words(3)) for _ in range(1200)]
    own = [[] for _ in range(200)]
    for k, passage in enumerate(passages):
        own[k % 200].append(passage)
        own[(k * 7 + k // 200 + 1) % 200].append(passage)
    texts = [" x ".join([" ".join(words(30)), *o, " ".join(words(30))]) for o in own]
    texts.append(texts[0] + " more")
    seen = {}
    kept = jaccard.stored

    def stored(df, name):
        out = kept(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    out = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in out} == {**{i: i for i in range(200)}, 200: 0}
    assert seen["jaccard-members"] > 100 and seen["jaccard-regions"] <= 2


def test_able_rows_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 60, 400))
    size = rng.integers(40, 60, 400)
    sketches = rng.poisson(1.0, (400, 64)).astype(np.int16)
    sketches[1::2] = sketches[::2]
    want = np.zeros(400, bool)
    for i in range(400):
        for j in range(400):
            if i != j and key[i] == key[j] and 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j]) and 180 * np.abs(sketches[i] - sketches[j]).sum() <= 20 * (size[i] + size[j]):
                want[i] = True
    assert want.any() and not want.all() and (jaccard.able(key, size, sketches, 80) == want).all()
