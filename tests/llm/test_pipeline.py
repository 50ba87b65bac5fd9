import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _leaks string, _p string, _q string"
RATED = "doc_id long, quality int, toxic int"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c") for i, t in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, RATED).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, prose(rng, 120, words)) for i in range(60)]
    clean = dict(docs)
    item = prose(rng, 30, [f"q{i}" for i in range(50)]) + " " + prose(rng, 12, [f"a{i}" for i in range(50)])
    docs += [(60, clean[1]), (61, clean[2].replace(clean[2].split()[3], "changed", 1)), (None, clean[3]), (62, f"{clean[4][:200]} {item} {prose(rng, 60, words)}"), (63, None), (64, ""), (65, "too short"), (66, "same words again " * 60)]
    docs += [(5, clean[5]), (7, clean[8])]
    tables(spark, tmp_path, docs, [(i, 1, 0) for i in range(63)], [(1, item), (2, None)])
    stages, kept = dict(corpus_pipeline.STAGES), {}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in stages.items():
        frame = corpus_pipeline.stored(stage(spark, frame, str(tmp_path)), name)
        kept[name] = frame.collect()
    ids = {n: sorted((r.doc_id is None, r.doc_id) for r in rows) for n, rows in kept.items()}
    ids = {n: [i for _, i in x] for n, x in ids.items()}
    # base rules: no text, short and repetitive ones go, all others stay
    assert ids["quality_rules"] == sorted([i for i, _ in docs if i is not None and i not in (63, 64, 65, 66)]) + [None]
    assert kept["quality_rules"][0]._leaks == "a" and kept["quality_rules"][0]._p == "b" and kept["quality_rules"][0]._q == "c"
    # near duplicates against all pairs: one row of each group
    before, after = kept["quality_classifier"], kept["near_duplicates"]
    assert all(jaccard(a.text, b.text) < 0.8 for k, a in enumerate(after) for b in after[:k])
    assert all(any(jaccard(a.text, b.text) >= 0.8 for b in after) for a in before)
    assert {r.text for r in after} >= {r.text for r in before if r.doc_id in range(9)} - {clean[8]} | {clean[8]}
    assert [r.doc_id for r in after if r.text == clean[8]] == [7] and [r.doc_id for r in after if r.text == clean[7]] == [7]
    assert 62 in ids["near_duplicates"] and set(ids["near_duplicates"]) - set(ids["decontamination"]) == {62}
    assert all(r.lossless and r.n_ids == len(r.ids) > 0 for r in kept["sentencepiece_ids"])
    assert ids["sentencepiece_ids"] == ids["decontamination"]


def test_nothing_stays(spark, tmp_path):
    tables(spark, tmp_path, [(1, "short"), (2, None)], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
