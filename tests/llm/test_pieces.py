import random

import numpy as np
import pytest

from eventloom.llm import pieces as p

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return p.Model(PATH)


def texts(n, seed):
    rng = random.Random(seed)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "字", "😀", "▁", "\t", "ing", "Über", "0", "...", "", "x" * 30, "   ", "\0"]
    return [None, "", " ", "▁", "word " * 3000, "z" * 4000, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(n))]


def test_without_dropout_equals_the_library(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = texts(1500, 1)
    for t, ids in zip(own, p.Encoder(model, 0, 1, 8).encode(list(range(len(own))), own), strict=True):
        assert model.decode(ids) == (t or "")
        if t and "▁" not in t:
            assert ids.tolist() == library.encode(t), repr(t)


def test_dropout_equals_the_agenda_and_decodes(model):
    encoder = p.Encoder(model, 0.3, 5, 4)
    own = [t for t in texts(400, 2) if t]
    segments = sorted({s for t in own for s in p.SEGMENTS.findall(p.MARK + t.replace(p.MARK, p.ESCAPED).replace(" ", p.MARK))})
    hashes = np.arange(len(segments), dtype=np.uint64) * p.MUL
    variant = np.arange(len(segments)) % 4
    flat, starts = encoder.encode_segments(segments, hashes, variant)
    keys = encoder.segment_keys(hashes, variant)
    for i, s in enumerate(segments):
        assert flat[starts[i] : starts[i + 1]].tolist() == model.finish(p.agenda_merge(model, model.symbol_ids(s), int(keys[i]), 0.3)), repr(s)


def test_varied_seeded_and_lossless(spark, model):
    own = texts(60, 3)
    rows = [(i, t, "clash") for i, t in enumerate(own)]
    documents = spark.createDataFrame([*rows, (None, "some words vary", "c"), (3, own[3], "c")], "doc_id long, text string, ids string").repartition(3)
    got = p.with_ids(documents, PATH, rate=0.2, seed=9).collect()
    assert len(got) == len(own) + 2 and all(r.lossless for r in got)
    assert all(model.decode(np.array(r.ids, np.int64)) == (r.text or "") for r in got)
    word = next(r for r in got if r.text == "word " * 3000)
    cuts = {tuple(x.split()) for x in " ".join(map(str, word.ids)).split(str(model.symbols["▁word"]))}
    assert len(cuts) > 1  # the same word is cut in several ways
    key = lambda rows: sorted((repr(r.doc_id), r.ids_crc32) for r in rows)
    once = p.id_digests(documents, PATH, rate=0.2, seed=9).collect()
    assert key(once) == key(p.id_digests(documents.repartition(1), PATH, rate=0.2, seed=9).collect())
    assert key(once) != key(p.id_digests(documents, PATH, rate=0.2, seed=10).collect())
    assert p.id_digests(documents.limit(0), PATH).count() == 0


def test_each_occurrence_is_cut_by_itself(model):
    encoder = p.Encoder(model, 0.1, 17)
    letters = [c for c in "abcdeimopst" if p.MARK + c in model.symbols]
    for c, ids in zip(letters, encoder.encode(list(range(len(letters))), [f"{c} " * 4000 for c in letters]), strict=True):
        assert abs(np.count_nonzero(ids == model.symbols[p.MARK + c]) / 4000 - 0.9) < 0.03


def test_kept_encodings_equal_the_agenda(model):
    encoder, rng = p.Encoder(model, 0.2, 5), random.Random(6)
    own = [" ".join(rng.choices(["the", "walking", "Übergang", "字", "x" * 70, "unbelievable"], k=60)) + f" rare{i}" for i in range(20)]
    for _ in range(2):
        for i, ids in enumerate(encoder.encode(list(range(20)), own)):
            want, key = [], p.xxhash.xxh64_intdigest(repr(i), 5)
            for place, s in enumerate(p.SEGMENTS.findall(p.MARK + own[i].replace(" ", p.MARK))):
                variant = p.mixed(np.array([key], np.uint64) + np.array([place], np.uint64) * p.MUL)
                one = encoder.segment_keys(np.array([p.xxhash.xxh64_intdigest(s)], np.uint64), variant)
                want += model.finish(p.agenda_merge(model, model.symbol_ids(s), int(one[0]), 0.2))
            assert ids.tolist() == want


@pytest.mark.parametrize("limit, kept", [(40, 10_000), (10_000, 30), (25, 20), (4, 4)])
def test_forgetting_changes_nothing(model, limit, kept):
    own = texts(300, 6) * 2
    ids = list(range(len(own)))
    whole, small = p.Encoder(model, 0.3, 5), p.Encoder(model, 0.3, 5)
    small.LIMIT, small.KEPT = limit, kept
    for i in range(0, len(own), 20):
        a, b = (list(e.encode(ids[i : i + 20], own[i : i + 20])) for e in (whole, small))
        assert all(x.tolist() == y.tolist() for x, y in zip(a, b, strict=True))


def test_another_operator_in_the_worker_empties_the_encoder():
    from eventloom.llm import common

    common.holding("other")
    text = "some words of some text"
    ids = next(iter(p.encoder_for(PATH, 0.1, 17, None).encode([1], [text]))).tolist()
    assert p.encoder_for(PATH, 0.1, 17, None) is p.encoder_for(PATH, 0.1, 17, None)
    assert p._MODELS and p._ENCODERS
    common.holding("other")
    assert not p._MODELS and not p._ENCODERS
    assert next(iter(p.encoder_for(PATH, 0.1, 17, None).encode([1], [text]))).tolist() == ids
