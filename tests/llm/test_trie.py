import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from eventloom.llm import trie


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [r[3:] for r in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[k] for k in kids[seq]) or 1
        saved[seq] = (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0) + sum(saved[k] for k in kids[seq])
    out = Counter()
    for seq, own_members in members.items():
        ends = ",".join(map(str, sorted(c for c in own_members if len(rebuilt[c]) == len(seq))))
        parent = min(members[seq[:-1]]) if seq else None
        out[min(own_members), len(seq), parent, len(own_members), len(kids[seq]), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, node string, n string").repartition(3)
    return Counter(tuple(r) for r in trie.trie_query(df).select(*COLUMNS).collect())


def table(seed, convs):
    rng = random.Random(seed)
    rows = []
    for conv in convs:
        n = rng.choice([1, 1, 2, 3, 5, 8, 9])
        kind = rng.randint(0, 3)
        rows += [(conv, i if rng.random() < 0.9 else None, ("user", "assistant", None)[i % 3], f"é{kind if i > 2 else 0}" if rng.random() < 0.8 else None) for i in range(n)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # blocks of turns, ranges of turns, groups looked up by broadcast
        for name, value in {"BLOCK": 3, "TURN_RANGE": 2, "HEAVY_ROWS": 4, "HEAVY_SHARE": 8}.items():
            monkeypatch.setattr(trie, name, value)
    rows = table(5, [*range(0, 130), *range(205, 230), 100_000])
    rows += [(300 + c, i, "user", f"deep {i}") for c in range(4) for i in range(12 + c)]  # snapshots of one conversation
    rows += [(400 + c, i, "user", "copy") for c in range(40) for i in range(7)] + rows[:5] + [(None, 1, "user", "nobody's")]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(0, None, None, None)], [(7, 1, "user", "a")], [(c, i, "u", "x" * 50_000) for c in (0, 1) for i in range(3)]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == brute(rows)
