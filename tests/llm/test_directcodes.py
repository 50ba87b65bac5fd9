import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import directcodes as dc

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("top", [1, 256, 70_000, 2**32 - 1])
def test_codes_give_any_token(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 5000, endpoint=True).astype(np.uint32)
    codes = dc.DirectCodes.frombytes(dc.DirectCodes.encode(ids).tobytes())
    for i in [0, 1, 511, 512, 513, 4999, *rng.integers(0, 5000, 200)]:
        assert codes.get(int(i)) == ids[i]
    for a, b in [(0, 5000), (17, 17), (511, 1025), (4990, 5000), (3, 900)]:
        assert (codes.slice(a, b) == ids[a:b]).all()


def test_file_random_access(monkeypatch):
    monkeypatch.setattr(dc, "SEGMENT_TOKENS", 100)
    docs = [np.arange(n, dtype=np.uint32) * 37 % 60_000 for n in (1, 250, 3, 99, 40, 80)]
    sink = pa.BufferOutputStream()
    closed = type("S", (), {"write": lambda self, b: sink.write(b), "close": lambda self: None})()
    w = dc.Writer(closed)
    for k, d in enumerate(docs):
        w.add(k if k else None, d)
    w.close()
    r = dc.Reader(pa.BufferReader(sink.getvalue()))
    assert len(r.segments) > 2 and r.doc_ids[0] == dc.NULL_ID
    whole = np.concatenate(docs)
    assert [r.token(i) for i in range(len(whole))] == whole.tolist()
    assert all((r.document(k) == d).all() for k, d in enumerate(docs))


def test_pieces_equal_whole_text():
    rng = random.Random(5)
    alphabet = ["a", "The", " ", " ", "\n", "é", "1", "'s", "!!", "\t", " ", "<|endoftext|>", "字", "\0", "  "]
    encoder, plain = dc.BatchEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ("a\n b", "a\n\n b", "a\n\nb", "x's 't ''s ('s 'S", "a<|endoftext|> b", "fa\u00e7on \u0153uvre \u00d7\u00f7 12ab a_b", "a\x1cb \x85c", "\u65e5\u672c \u8a9e"):
        assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.encode("<|endoftext|>").tolist() == [50256]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents(spark):
    texts = {5: "Hello there,  world\n", 1: None, 9: "", 2: "x" * 200_000, 3: "a b c", 7: "end <|endoftext|> of it"}
    plain = Tokenizer.from_file(PATH)
    rows = [(k, v, "clash") for k, v in texts.items()]
    got = sorted(tuple(r) for r in dc.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, start string"), PATH).collect())
    want, start = [], 0
    for k in sorted(texts):
        ids = np.array([*plain.encode(texts[k] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert dc.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    again = dc.encode_documents(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), PATH)
    assert [(r.doc_id, r.start) for r in again.orderBy("start").collect()] == [(None, 0), (1, 2), (1, 4)]


def test_generations_keep_the_ids(monkeypatch):
    monkeypatch.setattr(dc.BatchEncoder, "LIMIT", 5)
    encoder, plain, rng = dc.BatchEncoder(PATH), Tokenizer.from_file(PATH), random.Random(3)
    for _ in range(300):
        text = " ".join(rng.choice(["re", "anning.", "the", "over\nIt", "x1", "(a)", "fa\u00e7ade", "of,"]) for _ in range(4))
        assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
