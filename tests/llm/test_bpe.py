import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pressroom.llm import bpe as B
from tests.llm.helpers import docs


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(public_tokenizers.path(B.VOCABULARY))
    t.no_truncation()
    t.no_padding()
    return t


def want(lib, text):
    return lib.encode(text, add_special_tokens=False).ids


def test_every_character(lib):
    for c in [*range(0x3000), *range(0xAC00, 0xAC80), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800, 7),
              *range(0x1F300, 0x1F700, 5)]:
        t = f"a{chr(c)}B"
        assert B.encode(t) == want(lib, t), hex(c)


def test_random_texts_in_pieces(lib, monkeypatch):
    rng = random.Random(4)
    bits = ["a", "the", "ing", "'", "'s", "'re", "r", "e", " ", "\n", "  ", "é", "é", "́", "Σ", "1", "42", "!!",
            "<|endoftext|>", "<|start", "oftext|>", "中", "文", "가", "ᅡ", "ß", "İ", ".", "…", "X"]
    v = B.vocabulary()
    for k in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        assert B.encode(t) == want(lib, t), t
        e, out, at = B.Encoder(v), [], 0
        while at < len(t):
            n = rng.randrange(1, 9)
            out += e.feed(t[at:at + n])
            at += n
        assert out + e.finish() == want(lib, t), t


def test_long_words_in_constant_memory(lib, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 64)
    rng = random.Random(9)
    v = B.vocabulary()
    for alphabet in ("ab", "in", "the ring a", "etaoinshr", "é中a", "!?.", "ha"):
        t = "".join(rng.choice(alphabet.replace(" ", "")) for _ in range(4000))
        e, out, most = B.Encoder(v), [], 0
        for lo in range(0, len(t), 50):
            out += e.feed(t[lo:lo + 50])
            most = max(most, len(e.symbols) + len(e.raw) + len(e.text))
        assert out + e.finish() == want(lib, t)
        assert most < v.lookahead + 1000
    assert B.encode("x" * 3000 + " y") == want(lib, "x" * 3000 + " y")


def test_decoding(lib):
    rng = random.Random(6)
    v = B.vocabulary()
    for _ in range(300):
        ids = [rng.randrange(49408) for _ in range(rng.randrange(30))]
        assert B.decode(ids) == lib.decode(ids, skip_special_tokens=False)
        d, text = B.Decoder(v, shown=False), ""
        for i in ids:
            text += d.feed([i])
        assert text + d.finish() == B.decode(ids, shown=False)
    assert B.decode(B.encode("Größe 中文 it's"), shown=False) == "größe 中文 it 's "


def test_frames(spark, lib):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "a" * 200_000), (-3, "a" * 200_000), (None, "null id")]
    got = sorted(map(tuple, B.round_trip(docs(spark, rows).withColumnRenamed("lang", "ids")).collect()), key=str)
    exp = []
    for i, t in rows:
        ids = want(lib, t or "")
        exp.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(exp, key=str)
    assert B.round_trip(docs(spark, [])).count() == 0
    one = B.encode_documents(docs(spark, [(7, "it's")]), end_id=2).first()
    assert one.ids == want(lib, "it's") + [2]
