import datetime
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import linking, matching, similarity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike(a, b, least):
    n = max(len(a), len(b))
    return bool(a) and bool(b) and n - distance(a, b) >= least * n - 1e-9


def names(seed, n, most, letters="abc"):
    rng = random.Random(seed)
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n)]
    for name in out[: n // 2]:  # near copies
        edited = list(name)
        for _ in range(rng.randint(1, max(1, len(name) // 3))):
            at = rng.randint(0, len(edited))
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        out.append("".join(edited))
    return out


def pairs(spark, left, right, least, group=()):
    frame = lambda rows: spark.createDataFrame(rows, "g int, t string").repartition(3)
    found = similarity.similar_pairs(frame(left), frame(right), ["g"], least).collect()
    assert len(found) == len(set(found))
    return {(r.g, r.a, r.b) for r in found}


@pytest.mark.parametrize("least", [0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
@pytest.mark.parametrize("hot", [1 << 22, 3])
def test_equals_all_pairs(spark, monkeypatch, least, hot):
    monkeypatch.setattr(similarity, "HOT", hot)
    left = [(i % 2, t) for i, t in enumerate(names(1, 40, 8) + names(2, 16, 60, "abcdefgh"))] + [(0, None), (0, ""), (1, "é")]
    right = [(i % 2, t) for i, t in enumerate(names(1, 40, 8) + names(2, 16, 60, "abcdefgh")[::-1] + names(3, 20, 3))] + [(0, None), (1, ""), (1, "é")]
    expected = {(g, a, b) for g, a in left for h, b in right if g == h and a and b and alike(a, b, least)}
    assert pairs(spark, left, right, least) == expected


def test_common_segments(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", 8)
    left, right = [(0, f"Hash House Member {i:04}") for i in range(0, 300, 7)], [(0, f"Hash Hause Member {i:04}!") for i in range(0, 300, 11)]
    assert pairs(spark, left, right, 0.85) == {(0, a, b) for _, a in left for _, b in right if alike(a, b, 0.85)}


def test_holding(spark):
    left, right = ["harbour", "big harbour hash", "short", "x" * 30, None, ""], ["harbour hash", "harbour", "shorts", "x" * 90, "x" * 7, None, ""]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "t string")
    found = {(r.a, r.b) for r in similarity.holding_pairs(frame(left), frame(right), [], 6, 0.3).collect()}
    assert found == {(a, b) for a in left for b in right if a and b and (a in b or b in a) and min(len(a), len(b)) >= 6 and min(len(a), len(b)) >= 0.3 * max(len(a), len(b)) - 1e-9}


def test_short_names_at_low_thresholds(spark):
    frame = lambda rows, c: spark.createDataFrame([(0, r) for r in rows], f"g int, {c} string")
    found = linking.near_names(frame(["abc", "abcde", "ab", " ABC "], "name"), frame(["axc", "axcye", "acb", "abx"], "other"), "name", "other", ["g"], 0.6)
    got = {(r._n, r._m) for r in found.collect()}
    assert got == {(a, b) for a in ("abc", "abcde", "ab") for b in ("axc", "axcye", "acb", "abx") if alike(a, b, 0.6)}


def test_discovery_equals_all_pairs(spark):
    known = [(i, n) for i, n in enumerate(names(4, 60, 14, "hasorun ") + ["Brooklyn", "north brooklyn runners"])]
    found = [(i, n[::-1] if i % 5 == 0 else n, m) for i, (n, m) in enumerate(zip(names(4, 20, 14, "hasorun "), names(6, 20, 14, "hasorun "), strict=True))] + [(90, "brooklynn", "Brooklynn"), (91, None, "")]
    f = spark.createDataFrame([(i, s, n, 1, None, None) for i, s, n in found], "found_id int, slug string, name string, country int, lat double, lng double")
    k = spark.createDataFrame([(i, n, i % 2, None, None) for i, n in known], "kennel_id int, name string, country int, lat double, lng double")

    def score(q, n):
        q, n = q.lower().strip(" "), n.lower().strip(" ")
        if not q or not n:
            return 0
        held = min(len(q), len(n)) >= 6 and (q in n or n in q)
        return min(1, 1 - distance(q, n) / max(len(q), len(n)) + (0.3 if held else 0))

    expected = {}
    for i, *queries in found:
        best = {}
        for q in queries:
            for v, j in sorted(((score(q or "", n), j) for j, n in known), key=lambda x: (-x[0], x[1]))[:5]:
                best[j] = max(best.get(j, 0), v)
        ranked = sorted(((int((v - (0.3 if j % 2 != 1 else 0)) * 1000 + 0.5 + 1e-9), j) for j, v in best.items()), key=lambda x: (-x[0], x[1]))
        ranked = [r for r in ranked if r[0] >= 600]
        ranked = ranked[:1] if ranked and ranked[0][0] >= 950 else ranked[:3]
        expected |= {(i, j): v for v, j in ranked}
    got = {(r.found_id, r.kennel_id): r.score for r in linking.discovery_matches(f, k).collect()}
    assert got == expected and (90, 90) in got


@pytest.mark.parametrize("few", [0, 5, 1024])
def test_groups_with_few_texts_on_one_side_are_compared_directly(spark, monkeypatch, few):
    monkeypatch.setattr(similarity, "FEW", few)
    cuts, plain = [], similarity._cut
    monkeypatch.setattr(similarity, "_cut", lambda *a: cuts.append(1) or plain(*a))
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(4, 9)))
    left = {(g, text()) for g, n in ((0, 4), (1, 40), (2, 40)) for _ in range(n)}
    right = {(g, text()) for g, n in ((0, 40), (1, 40), (3, 9)) for _ in range(n)}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "g int, t string")
    limit = lambda a, b: int(0.4 * max(len(a), len(b)) + 1e-9)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = sorted((g, a, b) for g, a in left for h, b in right if g == h and distance(a, b) <= limit(a, b))
    got = sorted(tuple(r) for r in similarity.similar_pairs(frame(left), frame(right), ["g"], 0.6).select("g", "a", "b").collect())
    assert got == want and len(cuts) == (few < 1024)
    hold = sorted((g, a, b) for g, a in left for h, b in right if g == h and (a in b or b in a) and 5 <= min(len(a), len(b)))
    assert sorted(tuple(r) for r in similarity.holding_pairs(frame(left), frame(right), ["g"], 5, 0.3).select("g", "a", "b").collect()) == hold


@pytest.mark.parametrize("hot", [1 << 22, 3])
@pytest.mark.parametrize("least", [0.6, 0.7, 0.8, 0.87])
def test_common_beginnings_leave_the_rest_exact(spark, monkeypatch, least, hot):
    monkeypatch.setattr(similarity, "FEW", 0)
    monkeypatch.setattr(similarity, "HOT", hot)
    rng = random.Random(12)
    rest = lambda: "".join(rng.choice("01a") for _ in range(rng.randint(0, 7)))
    begins = [("member ", "membre "), ("member", "emberm"), ("abcdefgh", "h"), ("ab", "abab"), ("same ", "same "), ("", "xx"), ("aaa", "a01"), ("éé1", "é1")]
    side = lambda s: [(g, b[s] + rest()) for g, b in enumerate(begins) for _ in range(22)]
    left, right = side(0), side(1)
    assert pairs(spark, left, right, least) == {(g, a, b) for g, a in left for h, b in right if g == h and a and b and alike(a, b, least)}


def test_common_beginnings_bring_nothing_together(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FEW", 0)
    met, plain = [], similarity._met
    monkeypatch.setattr(similarity, "_met", lambda *a: met.append(plain(*a)) or met[-1])
    rng = random.Random(2)
    left, right = ([(0, f"{word} 000{i:06}") for i in rng.sample(range(1000000), 250)] for word in ("member", "membre"))
    assert pairs(spark, left, right, 0.7) == {(0, a, b) for _, a in left for _, b in right if alike(a, b, 0.7)}
    assert sum(df.count() for df in met) < len(left) * len(right) / 8


@pytest.mark.parametrize("first, most", [(8, 1 << 26), (1, 1 << 26), (8, 0)])
def test_fuzzy_window_finds_the_first_that_fits(spark, monkeypatch, first, most):
    monkeypatch.setattr(matching, "FIRST", first)
    monkeypatch.setattr(matching, "TITLE_PAIRS", most)
    rng = random.Random(4)
    day = datetime.date(2024, 1, 1)
    title = lambda: rng.choice(["Red run", "red  run ", "Blue moon trail", "blue moon", "abc", None])
    row = lambda i: (i, rng.randrange(2), day + datetime.timedelta(rng.randrange(6)), rng.choice([1, 2, None]), title(), rng.choice([1, 2, None]), rng.choice(["10:00", "13:30", "x", None]), rng.choice(["park", "harbour side house", None]))
    a, b = [row(i % 50) for i in range(60)], [(*row(i), rng.choice([1, 2, None])) for i in range(60)]
    minute = lambda t: None if t == "x" else int(t[:2]) * 60 + int(t[3:])

    def fits(x, y):
        gap = abs((x[2] - y[2]).days)
        time = x[6] is None or y[6] is None or ("x" not in (x[6], y[6]) and abs(minute(x[6]) - minute(y[6])) <= 120)
        place = x[7] is None or y[7] is None or distance(x[7], y[7]) <= 8
        return x[1] == y[1] and 1 <= gap <= 2 and x[4] and y[4] and len(x[4].strip()) >= 4 and distance(x[4].strip().lower(), y[4].strip().lower()) <= 4 and None not in (x[3], y[3]) and x[3] != y[3] and (x[5] is None or y[5] is None or x[5] == y[5]) and time and place

    want = {}
    for x in a:
        for y in b:
            if fits(x, y):
                key = (y[8] is None, -(y[8] or 0), abs((x[2] - y[2]).days), y[0])
                want[x[0]] = min(want.get(x[0], key), key)
    schema = "kennel_id int, date date, source_id int, title string, run_number int, start_time string, location string"
    out = matching.fuzzy_window_duplicates(spark.createDataFrame(a, f"ordinal int, {schema}"), spark.createDataFrame(b, f"event_id int, {schema}, trust int"))
    assert len(want) > 5 and {r.ordinal: r.event_id for r in out.collect()} == {o: k[3] for o, k in want.items()}


def test_same_day_rows_that_ask_alike_have_one_answer_each(spark):
    schema = "kennel_id int, date string, source_url string, run_number int, start_time string, title string"
    incoming = spark.createDataFrame([(1, 1, "d", None, 5, None, None), (2, 1, "d", None, 5, None, None), (3, 1, "d", None, 6, None, None), (4, None, "d", None, 5, None, None), (4, 1, "d", None, 5, None, None)], f"ordinal int, {schema}")
    existing = spark.createDataFrame([(9, 1, "d", "u", 5, "10:00", "t")], f"event_id int, {schema}")
    out = matching.same_day_match(incoming, existing)
    assert {tuple(r) for r in out.collect()} == {(1, 9, "run"), (2, 9, "run"), (3, None, "new"), (4, 9, "run")}
