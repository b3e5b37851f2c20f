"""Cross-tokenizer alignment against loops over bytes, with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pressroom.llm import alignment as A
from tests.llm.helpers import docs, table_rows


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(P.path(A.MODEL_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path(A.MODEL_B))


def test_products_equal_dense_ones():
    rng = np.random.default_rng(5)
    for _ in range(30):
        shape = rng.integers(1, 9, 3)
        x, y = (rng.random((shape[i], shape[i + 1])) < 0.4 for i in (0, 1))
        csr = lambda m: A.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])
        got = A.row_product(csr(x), csr(y))
        dense = np.zeros((shape[0], shape[2]), int)
        dense[got.row_of(), got.cols] = got.data
        assert (dense == x.astype(int) @ y.astype(int)).all()
        assert (A.row_sizes(csr(x), csr(y)) == (x.astype(int) @ y.astype(int)).sum(1)).all()
        t = A.transpose(csr(x))
        back = np.zeros((shape[1], shape[0]), bool)
        back[t.row_of(), t.cols] = True
        assert (back == x.T).all()


def by_bytes(libraries, rows):
    """The contract, byte by byte."""
    ta, tb = libraries
    pieces_a = A.TokenizerA(A.MODEL_A).pieces
    out, counts, per_doc = [], Counter(), []
    for doc_id, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        bytes_b = []
        for i in b:
            p = tb.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode())
        raw = (" " + text).encode() if text else b""
        if b"".join(pieces_a[i] for i in a) != raw or b"".join(bytes_b) != raw:
            a, b, bytes_b = [], [], []
        owner_a = [k for k, i in enumerate(a) for _ in pieces_a[i]]
        owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(owner_a, owner_b)))
        ends = {n for n in range(len(owner_a)) if (n + 1 == len(owner_a) or (
            owner_a[n] != owner_a[n + 1] and owner_b[n] != owner_b[n + 1]))}
        groups, now = [], ([], [])
        for n in range(len(owner_a)):
            for side, owner, ids in ((0, owner_a, a), (1, owner_b, b)):
                if n == 0 or owner[n] != owner[n - 1]:
                    now[side].append(ids[owner[n]])
            if n in ends:
                groups.append(now)
                now = ([], [])
        pairs = Counter((a[i], b[j]) for i, j in links)
        counts.update(pairs)
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        per_doc.append((doc_id, len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), pairs,
                        hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    for d, na, nb, ng, nl, shared, pairs, sha in per_doc:
        out.append((d, na, nb, ng, nl, shared, sum(n for p, n in pairs.items() if counts[p] == most[p[1]]),
                    sum(n * counts[p] for p, n in pairs.items()), sha))
    return sorted(out, key=str)


def strange():
    rng = random.Random(1)
    rows = [(None, "no id"), (1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> <s> </s> <unk> <0x41>"),
            (6, "same words"), (6, "same words"), (7, "\x00\t\r\n  two  \n\n"), (8, "é é ﬁ 漢字 🙂🏽  　"),
            (9, "x" * 3000), (10, "word " * 30_000), (11, "🙂" * 2000)]
    for i in range(60):
        rows.append((100 + i, "".join(rng.choice("ab é漢🙂\n\t.,'s1 2 ­Ω") for _ in range(rng.randrange(1, 80)))))
    return rows


@pytest.mark.parametrize("head_rows", [1 << 20, 20, 0])
def test_equal_to_loops_over_bytes(spark, libraries, head_rows, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_CHARS", 5000)
    rows = strange()
    got = A.alignment(docs(spark, rows), head_rows=head_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_bytes(libraries, rows)


def test_whole_table(spark, libraries):
    from tests.conftest import SF_SMALL
    rows = [(r.doc_id, r.text) for r in table_rows(spark, SF_SMALL)]
    got = A.alignment(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_bytes(libraries, rows)


def test_words_by_ranks_equal_the_library(libraries):
    rng = random.Random(2)
    t = A.TokenizerA(A.MODEL_A)
    points = [*range(32, 0x250), *range(0x370, 0x400), *range(0x4E00, 0x4F00), *range(0x1F600, 0x1F640), 9, 10, 13, 0x2028]
    for _ in range(500):
        x = "".join(chr(rng.choice(points)) for _ in range(rng.randrange(40)))
        assert t.encode(x) == libraries[0].encode(x, add_special_tokens=False).ids


def test_group_links_are_all_pairs_of_a_group():
    ta, tb = A.tokenizers(A.MODEL_A, A.MODEL_B)
    lens = [np.array([len(p) for p in t.pieces]) for t in (ta, tb)]
    al = A.align([A.encode_exact(t, ta, tb) for t in ("Größe überall", "", "naïve 漢字 text")], *lens)
    m = al.group_links()
    assert set(zip(m.row_of().tolist(), m.cols.tolist())) == {
        (i, j) for i, g in enumerate(al.a_group) for j, h in enumerate(al.b_group) if g == h}
    assert (al.links.data > 0).all() and al.links.data.sum() == lens[0][al.a].sum()


def test_empty_table(spark):
    assert A.alignment(docs(spark, [(1, "x")]).limit(0)).count() == 0
