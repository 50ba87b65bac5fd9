import random
from collections import Counter

import pytest

from eventloom.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, pos string, length string, chunk string"


def brute(rows):
    """Maximal conversations by comparing all pairs of turn lists."""
    turns = {}
    for conv, turn, role, text in set(rows):
        turns.setdefault(conv, []).append((turn, role, text))
    lists = {c: [x[1:] for x in sorted(t, key=lambda x: tuple((v is not None, v if v is not None else 0) for v in x))] for c, t in turns.items()}
    out = []
    for c, own in lists.items():
        equal = [d for d, other in lists.items() if other == own]
        if min(equal, key=lambda d: (d is None, d or 0)) == c and not any(len(o) > len(own) and o[: len(own)] == own for o in lists.values()):
            out.append((c, len(own), len(equal), "".join(f"<|{r if r is not None else 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in own)))
    return Counter(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    return Counter((r.conv_id, r.n_turns, r.n_equal, r.text) for r in chat.render_maximal(df).collect())


@pytest.mark.parametrize("chunk", [2, 1024])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK_TURNS", chunk)
    rng = random.Random(chunk)
    rows = []
    for conv in range(60):
        n, first = rng.randint(1, 7), rng.choice([0, 0, 3])
        rows += [(conv, first + i, rng.choice(["user", "user", "user", None]) if i == 5 else ("user", "bot")[i % 2], f"t{rng.randint(0, 1 if i < 3 else 3)}") for i in range(n)]
    rows += [(100, 0, "user", None), (101, 0, "user", ""), (102, 0, None, "a"), (103, 0, "unknown", "a"), (104, None, "user", "n"), (104, 1, "bot", "m"), (105, 1, "b", "x"), (105, 1, "a", "y")]
    rows += rows[:20] + [(None, 1, "user", "lost"), (None, 2, "bot", "found")] + [(200, i, "user", f"long {i}") for i in range(50)] + [(201, i, "user", f"long {i}") for i in range(49)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert not found(spark, [])


def test_long_texts_and_many_repeats(spark):
    rows = [(1, 0, "user", "x" * 300_000), (2, 0, "user", "x" * 300_000), (2, 1, "bot", "y")] + [(3, 0, "user", "again")] * 500
    assert found(spark, rows) == brute(rows)
