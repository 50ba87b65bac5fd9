import random
import re
from collections import Counter
from math import log

from eventloom.llm import qualityrules as q


def base(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "cat", "é", "##", "a|b", "Dog", "x", " y", "ñandú"]
    texts = [None, "", " \t\x0b\x0c\r ", "one two", "a b c a b c", "a a a", "a a", "\n\nx\nx\n y\n", "w " * 30_000, " ".join(f"w{i}" for i in range(20_000))]
    texts += ["".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", " \n"]) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "clash"), (3, "one two", "clash")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(4, 1, 0), (9, 1, None), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.quality_columns(documents, labels, threshold=-0.5).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(r.text)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.llr >= -0.5)


def test_ratio_is_the_two_multinomials(spark, monkeypatch):
    texts = {1: "good calm words", 2: "bad !! bad !!", 3: "calm words again", 4: None}
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (2, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    tokens = {k: re.findall(r"\w+|[^\w\s]+", (v or "").lower()) for k, v in texts.items()}
    grams = {k: [(t,) for t in v] + list(zip(v, v[1:], strict=False)) for k, v in tokens.items()}
    raw, target = Counter(g for v in grams.values() for g in v), Counter(g for k in (1, 3) for g in grams[k])
    floor = q.SMOOTHING * q.BUCKETS

    def llr(gs):
        return sum(log((target[g] + q.SMOOTHING) / (target.total() + floor)) - log((raw[g] + q.SMOOTHING) / (raw.total() + floor)) for g in gs) / len(gs) if gs else 0.0

    for r in q.quality_columns(documents, labels).collect():
        assert abs(r.llr - llr(grams[r.doc_id])) < 1e-5


def test_no_labels_and_empty_table(spark):
    documents = spark.createDataFrame([(1, "x y " * 40)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.llr for r in q.quality_columns(documents, none).collect()] == [0.0]
    assert q.quality_columns(documents.limit(0), none).count() == 0
