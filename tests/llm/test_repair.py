import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from eventloom.llm import repair

FITS = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, letters, repaired) of rows (role, text, fault) by trying all edits, insertions up to two in a row."""
    prefixes = re.compile(r"(s?(ua)*u?)?")

    @cache
    def best(i, shape, added):
        # shape: the initials so far, with pairs of turns cut out
        shape = re.sub(r"(ua)+", "ua", shape)
        found = []
        if i == len(rows) and FITS.fullmatch(shape):
            found.append((0, "", ()))

        def go(cost, letter, row, role, j, added):
            new = shape if row is None else shape + role[:1]
            if not prefixes.fullmatch(new) or (row is not None and role[:1] not in ("s", "u", "a")):
                return
            rest = best(j, new, added)
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1], (() if row is None else (row,)) + rest[2]))

        if added < 2:
            for role in ("user", "assistant"):
                go(3, "I", f"{role}:", role, i, added + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(4, "D", None, "", i + 1, 0)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                go(more, "K", f"{role}:{text}", role, i + 1, 0)
                for other in ("user", "assistant"):
                    go(3 + more, "R", f"{other}:{text}", other, i + 1, 0)
        return min(found, key=lambda f: f[:2]) if found else None

    return best(0, "", 0)


def brute(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        own = convs[conv]
        spaced = lambda v: " " if v is None else v
        code = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = Counter()
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        rows, seen, n = [], set(), Counter()
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            n[fault] += 1
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, text = cheapest(tuple(rows))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()] += 1
    return out


def table(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for i in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["A.", "B!", "C? ", "open", "", " \n", None, "D.", "more, and", "é."])
            rows.append((conv, rng.choice([i, i, i, i + 2, None]), role, text))
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, range string, edit string").repartition(3)
    return Counter(tuple(r) for r in repair.repair_query(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())


EXTRA = [(None, 1, "user", "lost."), (None, 2, "assistant", "found."), (5000, 1, "user", "twice."), (5000, 1, "user", "twice."), (5001, 1, "user", "x" * 100_000 + "."), (5001, 2, "assistant", "y" * 100_000)]


def test_equals_all_edits_tried(spark):
    rows = table(1, 150, 8) + EXTRA
    assert found(spark, rows) == brute(rows)


def test_long_conversations_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(repair, "LONG_ROWS", 6)
    monkeypatch.setattr(repair, "RANGE_TURNS", 3)
    monkeypatch.setattr(repair, "BLOCK_ROWS", 5)
    rows = table(2, 60, 20) + EXTRA
    assert found(spark, rows) == brute(rows)


def test_repaired_roles_fit(spark):
    rows = spark.createDataFrame([(c, t or 0, r or "none", x or "") for c, t, r, x in table(3, 80, 9)], "conv_id long, turn long, role string, text string")
    shapes = repair.repaired_turns(rows).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "seq", "role"))), lambda r: F.left(r["role"], F.lit(1))), "").alias("shape"))
    assert all(FITS.fullmatch(r["shape"]) for r in shapes.collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)]])
def test_empty_and_null(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_conversations_of_which_nothing_is_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = next(iter(found(spark, [(conv, 0, "user", "gone.")])))
    assert row == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
