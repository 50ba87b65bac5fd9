import random
import re

import pytest

from eventloom.operators import rules as R

ROWS = "row_id int, source_id int, text string, tags string, ordinal int"
RULES = "source_id int, ordinal int, pattern string, many boolean, tags array<string>"


def brute(rows, rules):
    out = {}
    for row, source, text in rows:
        fits = [r for r in sorted(rules, key=lambda r: (r[1] is None, r[1] or 0, r[2])) if text is not None and r[0] in (None, source) and re.search(r[2], text, re.IGNORECASE)]
        many = [t for r in fits if r[3] for t in r[4]]
        out[row] = list(dict.fromkeys(many)) if any(r[3] for r in fits) else next((r[4] for r in fits), [])
    return out


def found(spark, rows, rules):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], ROWS).repartition(2)
    return {r.row_id: r.tags for r in R.routed(df, spark.createDataFrame(rules, RULES)).collect()}


@pytest.mark.parametrize("slice_bytes", [4 << 20, 40])
def test_equals_all_pairs(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(R, "SLICE_BYTES", slice_bytes)
    rng = random.Random(1)
    words = ["moon", "full moon", "MOONLIGHT", "run", "trail run", "a(b", "ünder", "x1", "pub crawl"]
    patterns = ["moon", r"full\s+moon", "(?:trail )?run", r"\bpub\b", "mo+n", "(moon|run)", ".", r"x\d", r"[ab]c", r"a\(b", "ÜNDER", "cra(w)l$", "^full", "(trail run){1,2}", "zz?moon", "li(?=ght)"]
    rows = [(i, rng.randint(0, 2), rng.choice([None, "", " ".join(rng.sample(words, 2))])) for i in range(80)]
    rules = [(rng.choice([None, 0, 1, 2]), rng.randint(0, 9), p, rng.random() < 0.3, [f"t{rng.randint(0, 5)}", f"u{i}"][: rng.randint(1, 2)]) for i, p in enumerate(patterns * 2)]
    assert found(spark, rows, rules) == brute(rows, rules)


def test_ten_thousand_rules(spark):
    rules = [(None, i, rf"\bevent {i}\b", False, [f"t{i}"]) for i in range(10_000)]
    rows = [(i, 0, f"the event {i * 7} tonight") for i in range(2000)]
    assert found(spark, rows, rules) == {i: [f"t{i * 7}"] if i * 7 < 10_000 else [] for i in range(2000)}
    matcher = R.Matcher(rules)
    assert len(matcher.candidates(0, "the event 4321 tonight")) <= 4  # those of 4, 43, 432 and 4321


@pytest.mark.parametrize("pattern, text", [("moon", "moon"), ("Full Moon", "full moon"), ("a?bc", "bc"), ("(ab|cd)", ""), ("x*", ""), (r"(run)\s+(home)", "home"), ("(?:ab){2}c", "ab"), ("a(b)c", "abc"), (".", ""), ("^ab$", "ab"), ("a(?!b)c", "a")])
def test_required_texts(pattern, text):
    assert R.required_text(pattern) == text


def test_no_pattern_and_no_rules(spark):
    with pytest.raises(ValueError):
        found(spark, [(1, 1, "a")], [(1, 1, "(", False, ["t"])])
    assert found(spark, [(1, 1, "a")], []) == {1: []}


def test_no_task_or_driver_holds_all_rules(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rules with a required text are held together")

    monkeypatch.setattr(R, "Matcher", refuse)
    rules = [(None, i, rf"\bevent {i}$", False, [f"t{i}"]) for i in range(3000)]
    rows = [(i, 0, f"the event {i * 7}") for i in range(300)] + [(300, None, "The EVENT 5"), (301, 0, None)]
    assert found(spark, rows, rules) == brute(rows, rules)


def test_letters_of_one_case_fold_and_rules_without_ordinal(spark):
    rows = [(1, 0, "R\u0130SE"), (2, 0, "ri\u017fe"), (3, 0, "r\u0131se"), (4, None, "rise \u00fc"), (5, 0, "")]
    rules = [(None, None, "rise", False, ["last"]), (None, 3, "ri", False, ["first"]), (0, 1, "zz|e$", True, [])]
    assert found(spark, rows, rules) == brute(rows, rules)
