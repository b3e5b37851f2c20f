"""Cross-tokenizer alignment: which token occurrences of two tokenizers cover the same bytes, by sparse row products.

Each text is encoded by a byte-level BPE (A) and by a piece model (B).  Over the bytes of many texts laid end to end, a
token-byte incidence matrix has a row a token and ones at its bytes.  ``A . B^T``, a Gustavson row product over hand-built
CSR arrays, gives the overlap links (token of A, token of B, shared bytes).  Offsets where tokens of both end cut the
bytes into groups; the product of the two group-incidence matrices gives the links between tokens that share a group.

Corpus counts: a stage writes each document's distinct (A id, B id) pairs with their numbers, packed, once; encoding
isn't repeated.  Pair counts are summed with map-side combine.  Counts come back to the documents by a join in which the
frequent pairs are broadcast (their size is counted first, at most ``HEAD_BYTES``) and the rest, rare by choice, are
shuffled: no frequent pair is ever a hot key.

A's words are merged by ranks read from the vocabulary file; where that file's merges are not its ids in order, its own
library encodes.  Texts that are NULL, empty, or that a tokenizer does not give back byte for byte have no tokens: zeros
and an empty digest.  Repeated rows are documents of their own, a NULL doc_id stays NULL, an empty table gives no rows,
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import checkpointed
from pressroom.session import scratch_path

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters laid end to end for one product (one longer text is a product of its own).
BLOCK_CHARS = 1 << 20
#: The frequent pairs may take this many bytes when broadcast, at PAIR_BYTES each.
HEAD_BYTES, PAIR_BYTES = 64 << 20, 64


# ---------------------------------------------------------------------------------------------- sparse products

class Csr(NamedTuple):
    """A sparse matrix by rows: row i holds ``cols[starts[i]:starts[i + 1]]`` with ``data`` (None: all ones)."""
    starts: np.ndarray
    cols: np.ndarray
    width: int
    data: np.ndarray | None = None

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def row_of(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(self.height), np.diff(self.starts))


def interval_incidence(lengths: np.ndarray) -> Csr:
    """Token-byte incidence of tokens laid end to end: row i has ones at the bytes of token i."""
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return Csr(starts, np.arange(starts[-1]), int(starts[-1]))


def group_incidence(group: np.ndarray, n_groups: int) -> Csr:
    """Token-group incidence: row i has a one at the group of token i."""
    return Csr(np.arange(len(group) + 1), group, n_groups)


def transpose(m: Csr) -> Csr:
    """Columns become rows, by a counting sort."""
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.cols, minlength=m.width), dtype=np.int64)])
    rows = m.row_of()
    ordered = len(m.cols) < 2 or bool((m.cols[1:] >= m.cols[:-1]).all())
    return Csr(starts, rows if ordered else rows[np.argsort(m.cols, kind="stable")], m.height)


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Terms of each row of ``a . b`` before they are summed (the symbolic half of the product)."""
    per = np.diff(b.starts)[a.cols]
    sums = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])
    return sums[a.starts[1:]] - sums[a.starts[:-1]]


def row_product(a: Csr, b: Csr) -> Csr:
    """``a . b`` by Gustavson's rows: each entry (i, k) of ``a`` adds row k of ``b`` to row i; equal columns of a row
    are summed."""
    counts = np.diff(b.starts)[a.cols]
    rows = np.repeat(a.row_of(), counts)
    ends = np.cumsum(counts, dtype=np.int64)
    at = np.arange(len(rows)) + np.repeat(b.starts[:-1][a.cols] - (ends - counts), counts)
    key = rows * np.int64(b.width) + b.cols[at]
    if len(key) > 1 and not (key[1:] >= key[:-1]).all():
        key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    data = np.diff(np.concatenate([new, [len(key)]]))
    key = key[new]
    starts = np.searchsorted(key, np.arange(a.height + 1) * np.int64(b.width))
    return Csr(starts, key % b.width if b.width else key, b.width, data)


# ---------------------------------------------------------------------------------------------- tokenizers

def byte_table() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def _path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class TokenizerA:
    """A byte-level BPE file: ``encode`` gives ids, ``pieces[id]`` the bytes of a token."""

    def __init__(self, name: str):
        with open(_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        vocab, table = spec["model"]["vocab"], byte_table()
        ranks = {bytes(table[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.pieces[i] = t
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        in_order = spec.get("normalizer") is None and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        if in_order:
            import public_tokenizers
            import tiktoken
            words = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = words.encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            t = Tokenizer.from_file(_path(name))
            t.encode_special_tokens = True
            self.encode = lambda text: t.encode(text, add_special_tokens=False).ids


class TokenizerB:
    """A piece model that puts a space before the text: U+2581 is a space, ``<0xHH>`` a byte."""

    def __init__(self, name: str):
        import sentencepiece
        p = sentencepiece.SentencePieceProcessor(model_file=_path(name))
        self.pieces = []
        for i in range(p.vocab_size()):
            piece = p.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if p.is_byte(i)
                               else b"" if p.is_control(i) else piece.replace("▁", " ").encode())
        self.encode = lambda text: p.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def tokenizers(name_a: str, name_b: str):
    return TokenizerA(name_a), TokenizerB(name_b)


# ---------------------------------------------------------------------------------------------- a block of texts

class Aligned(NamedTuple):
    """Texts laid end to end: ids, links and groups; ``a_at``/``b_at`` are the first token of every text."""
    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    links: Csr            # A tokens x B tokens, data = shared bytes
    a_group: np.ndarray
    b_group: np.ndarray
    n_groups: int

    def group_links(self) -> Csr:
        """Pairs of tokens that share a group."""
        return row_product(group_incidence(self.a_group, self.n_groups),
                           transpose(group_incidence(self.b_group, self.n_groups)))


def encode_exact(text: str | None, ta, tb) -> tuple[list[int], list[int]]:
    """The ids of both tokenizers, or none where one of them does not give the bytes back."""
    if not text:
        return [], []
    raw = (" " + text).encode()
    a = ta.encode(" " + text)
    if b"".join(map(ta.pieces.__getitem__, a)) != raw:
        return [], []
    b = tb.encode(text)
    return (a, b) if b"".join(map(tb.pieces.__getitem__, b)) == raw else ([], [])


def align(pairs: list[tuple[list[int], list[int]]], len_a: np.ndarray, len_b: np.ndarray) -> Aligned:
    """Links and groups of texts whose tokens cover the same bytes; text ends are ends of both, so no group or link
    crosses texts."""
    a = np.fromiter((i for p, _ in pairs for i in p), np.int64)
    b = np.fromiter((i for _, p in pairs for i in p), np.int64)
    a_at = np.concatenate([[0], np.cumsum([len(p) for p, _ in pairs], dtype=np.int64)])
    b_at = np.concatenate([[0], np.cumsum([len(p) for _, p in pairs], dtype=np.int64)])
    in_a, in_b = interval_incidence(len_a[a]), interval_incidence(len_b[b])
    links = row_product(in_a, transpose(in_b))
    ends_a, ends_b = in_a.starts[1:], in_b.starts[1:]
    cuts = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
    return Aligned(a, b, a_at, b_at, links, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts))


class Texts(NamedTuple):
    """Written forms of ids: followed by a comma, or by the mark that ends the group's part."""
    comma: np.ndarray
    last: np.ndarray


def _texts(n: int, mark: str) -> Texts:
    return Texts(np.array([f"{i}," for i in range(n)], dtype=object), np.array([f"{i}{mark}" for i in range(n)], dtype=object))


def written(al: Aligned, ta: Texts, tb: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Every token written as in ``a1,a2|b1;a3|b2,b3;`` in the order of that text, and the first place of every text."""
    out = np.empty(len(al.a) + len(al.b), dtype=object)
    a_n = np.concatenate([[0], np.cumsum(np.bincount(al.a_group, minlength=al.n_groups), dtype=np.int64)])
    b_n = np.concatenate([[0], np.cumsum(np.bincount(al.b_group, minlength=al.n_groups), dtype=np.int64)])
    a_last = np.zeros(len(al.a), bool)
    b_last = np.zeros(len(al.b), bool)
    a_last[a_n[1:] - 1] = True
    b_last[b_n[1:] - 1] = True
    out[np.arange(len(al.a)) + b_n[al.a_group]] = np.where(a_last, ta.last[al.a], ta.comma[al.a])
    out[np.arange(len(al.b)) + a_n[al.b_group + 1]] = np.where(b_last, tb.last[al.b], tb.comma[al.b])
    return out, al.a_at + al.b_at


def blocks(texts: list, limit: int):
    """Slices of ``texts`` of about ``limit`` characters; a longer text is alone."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        k = len(t) if t else 0
        if n and n + k > limit:
            yield start, i
            start, n = i, 0
        n += k
    if start < len(texts):
        yield start, len(texts)


DDL = ("doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, "
       "pairs array<long>, times array<long>")


def _align_batches(schema: pa.Schema, name_a: str, name_b: str):
    def run(batches):
        ta, tb = tokenizers(name_a, name_b)
        len_a, len_b = (np.array([len(p) for p in t.pieces], np.int64) for t in (ta, tb))
        wa, wb = _texts(len(len_a), "|"), _texts(len(len_b), ";")
        span = np.int64(len(len_a)) * len(len_b)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in blocks(texts, BLOCK_CHARS):
                yield _block(ids.slice(lo, hi - lo), texts[lo:hi], ta, tb, len_a, len_b, wa, wb, span, schema)
    return run


def _block(ids, texts, ta, tb, len_a, len_b, wa, wb, span, schema):
    al = align([encode_exact(t, ta, tb) for t in texts], len_a, len_b)
    n = len(texts)
    a_at, b_at = al.a_at, al.b_at
    link_at = al.links.starts[a_at]
    cut_at = np.concatenate([al.a_group, [al.n_groups]])[a_at]
    shared = row_sizes(group_incidence(al.a_group, al.n_groups),
                       transpose(group_incidence(al.b_group, al.n_groups)))
    shared_at = np.concatenate([[0], np.cumsum(shared, dtype=np.int64)])[a_at]
    parts, place = written(al, wa, wb)
    digest = []
    for i in range(n):
        if place[i] == place[i + 1]:
            digest.append("")
        else:
            digest.append(hashlib.sha256("".join(parts[place[i]:place[i + 1]])[:-1].encode()).hexdigest())
    # distinct (document, A id, B id) with their numbers
    doc = np.repeat(np.arange(n), np.diff(link_at))
    key = doc * span + al.a[al.links.row_of()] * len(len_b) + al.b[al.links.cols]
    key, times = np.unique(key, return_counts=True)
    pair_at = np.searchsorted(key, np.arange(n + 1) * span)
    offsets = pa.array(pair_at.astype(np.int32))
    cols = [ids, np.diff(a_at), np.diff(b_at), np.diff(cut_at), np.diff(link_at), np.diff(shared_at), digest,
            pa.ListArray.from_arrays(offsets, pa.array(key % span)),
            pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))]
    cols = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types)]
    return pa.record_batch(cols, schema=schema)


# ---------------------------------------------------------------------------------------------- Spark side

def aligned(docs: DataFrame, name_a: str = MODEL_A, name_b: str = MODEL_B) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256 and the distinct id pairs
    (``A id * size of B + B id``) with their numbers.  A narrow stage."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    st = T.StructType.fromDDL(DDL.format(id=docs.schema["doc_id"].dataType.simpleString()))
    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .mapInArrow(_align_batches(to_arrow_schema(st), name_a, name_b), st))


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """pair, count over the corpus, best (1 where no pair of the same B id has more)."""
    counts = checkpointed(links.groupBy("pair").agg(F.sum("times").alias("count")))
    b = (F.col("pair") % size_b).alias("b")
    top = counts.groupBy(b).agg(F.max("count").alias("most"))  # at most the ids of B
    return counts.withColumn("b", b).join(top, "b").select("pair", "count",
                                                           (F.col("count") == F.col("most")).cast("long").alias("best"))


def split_head(counts: DataFrame, head_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent pairs, at most ``head_rows``, and the others (None if there are none): cut at the lowest power
    of two at which few enough are left."""
    power = F.floor(F.log2("count")).cast("int")
    levels = {r.p: r.n for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()}
    cut, left = 64, head_rows
    while cut > 0 and levels.get(cut - 1, 0) <= left:
        left -= levels.get(cut - 1, 0)
        cut -= 1
    if cut == 0:
        return counts, None
    return counts.where(power >= cut), counts.where(power < cut)


def alignment(docs: DataFrame, name_a: str = MODEL_A, name_b: str = MODEL_B,
              head_rows: int = HEAD_BYTES // PAIR_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, n_best (links whose id pair
    is as frequent as any of its B id) and count_sum (the corpus counts of all its links)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "alignment")
    (aligned(docs, name_a, name_b).withColumn("row", F.monotonically_increasing_id())
     .write.option("compression", "zstd").parquet(path))
    done = spark.read.parquet(path)
    links = done.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", "l.pairs", "l.times")
    links = links.withColumnRenamed("pairs", "pair")
    counts = checkpointed(pair_counts(links, len(tokenizers(name_a, name_b)[1].pieces)))
    head, tail = split_head(counts, head_rows)
    found = links.join(F.broadcast(head), "pair", "left" if tail is not None else "inner")
    if tail is not None:
        rare = found.where(F.col("count").isNull()).select("pair", "row", "times").join(tail, "pair")
        found = found.where(F.col("count").isNotNull()).unionByName(rare)
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"),
                                    F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return done.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", zero("n_best"), zero("count_sum"),
        "groups_sha256")
