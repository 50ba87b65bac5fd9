import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from eventloom.llm import contentsort


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = Counter()
    for body, own in groups.items():
        own.sort(key=lambda r: r[:3])
        digest = hashlib.sha256(body.encode()).hexdigest()
        out.update((r[3], own[0][3], len(own), at == 0, digest) for at, r in enumerate(own))
    return out


def found(spark, rows, slices=4):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, part string, kept string").repartition(slices)
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in contentsort.exact_groups(df).collect())


@pytest.mark.parametrize("pack_rows, pack_bytes", [(1, 1 << 20), (7, 40), (1 << 16, 8 << 20)])
def test_equals_brute_force(spark, monkeypatch, pack_rows, pack_bytes):
    monkeypatch.setattr(contentsort, "PACK_ROWS", pack_rows)
    monkeypatch.setattr(contentsort, "PACK_BYTES", pack_bytes)
    rng = random.Random(pack_rows)
    rows = [(i, "".join(rng.choice("ab \té\n") for _ in range(rng.randint(0, 5)))) for i in range(400)]
    rows += [(1000 + i, "hot text" + " " * (i % 3)) for i in range(500)]  # a group over several ranges
    rows += [(2000, None), (2001, ""), (None, "hot text  "), (None, "lost"), (None, "lo st"), (5, "same"), (5, "same"), (6, " a"), (7, "x" * 200_000), (8, "x" * 200_000 + " ")]
    assert found(spark, rows) == brute(rows)


def test_common_beginnings_are_told_apart(spark):
    rows = [(i, "licence " * 20 + str(i // 2)) for i in range(200)]
    assert found(spark, rows) == brute(rows)


def test_kept_documents_have_their_columns(spark):
    df = spark.createDataFrame([(1, "a b", "p"), (2, "a  b", "q"), (2, "a  b", "q"), (3, None, "r"), (None, "c", "s")], "doc_id long, text string, _digest string")
    assert sorted((r.doc_id or 0, r._digest) for r in contentsort.without_copies(df).collect()) == [(0, "s"), (2, "q"), (3, "r")]


def test_ids_may_be_strings(spark):
    df = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t")], "doc_id string, text string")
    assert {r.keep_id for r in contentsort.exact_groups(df).collect()} == {"a"}


def test_empty_table(spark):
    assert not found(spark, [])
