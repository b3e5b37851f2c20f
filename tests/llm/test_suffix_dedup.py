import hashlib
import random

import numpy as np
import pytest

from pressroom.llm import suffix_dedup as S
from tests.llm.helpers import docs, table_rows


def slow(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p:p + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if least[b[p:p + 50]] < i:
                    gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(rng, n=60):
    passage = ["".join(rng.choice("ab cd") for _ in range(rng.randrange(30, 200))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            parts.append("".join(rng.choice("xyz é") for _ in range(rng.randrange(80))))
            p = rng.choice(passage)
            lo = rng.randrange(40)
            parts.append(p[lo:lo + rng.choice([20, 49, 50, 51, 60, 300])])
        rows.append((rng.randrange(-50, 10**6), "".join(parts)))
    rows += [(7, "a" * 300), (9, "a" * 120), (11, "ab" * 90), (3, "ab" * 40), (5, None), (6, "")]
    rows += [(100 + i, rows[0][1] + "tail") for i in range(5)] + [(None, rows[0][1]), (9, "a" * 200), (9, "a" * 200)]
    return rows


def test_made_texts(spark, monkeypatch):
    rows = made(random.Random(8))
    got = sorted(map(tuple, S.dedup_substrings(docs(spark, rows).withColumnRenamed("lang", "doc")).collect()), key=str)
    assert got == slow(rows)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 3)
    monkeypatch.setattr(S, "GROUP", 2)
    rows = made(random.Random(9), 30)
    got = sorted(map(tuple, S.dedup_substrings(docs(spark, rows)).collect()), key=str)
    assert got == slow(rows)


def test_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table_rows(spark, "/root/testdata/sf0.001")]
    got = sorted(map(tuple, S.dedup_substrings(docs(spark, rows), keep_text=True).drop("kept").collect()), key=str)
    assert got == slow(rows)


def test_pieces_of_long_texts(monkeypatch):
    text = np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8).tobytes()
    whole = S.suffixes(text)
    lo = (whole[:, 1] & np.uint64(0xFFFFFF)).tolist()
    assert lo[0] == 0 and lo == sorted(lo)
    ends = lo[1:] + [len(text) - 49]
    assert [a + int(x >> np.uint64(8) & np.uint64(63)) + 1 for a, x in zip(lo, whole[:, 2])] == ends
    monkeypatch.setattr(S, "_PIECE", 700)
    cut = S.suffixes(text)
    # pieces only split extents at their borders; leads, grams and sides of the rest are the same
    assert set(map(tuple, whole[:, :2].tolist())) <= set(map(tuple, cut[:, :2].tolist()))
    assert len(cut) <= len(whole) + 8


def test_multikey_order():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order = S.multikey_order(keys)
    rows = list(zip(*[k[order].tolist() for k in keys]))
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(500))


def test_empty(spark):
    assert S.dedup_substrings(docs(spark, [])).count() == 0
    assert S.dedup_substrings(docs(spark, [(None, None)])).first().n_bytes == 0
