"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

``Vocabulary`` reads a tokenizer file (merges with word ends over the byte alphabet) and computes the merge list's
sufficient lookahead: a boundary after a token can only be undone by a merge that takes up symbols right of it, whose
own parts were decided by earlier merges further right, and so on down strictly decreasing ranks.  The longest such
chain, found in one pass over the merges, bounds how far a decision can depend on what follows.  ``Encoder`` is fed a
text in pieces; it normalises, cuts words and merges, and emits tokens once the lookahead behind them is known, so
that its memory depends on the piece size and the lookahead, not on the text or on a single word in it.  ``Decoder``
is fed ids in pieces and keeps only the bytes of an unfinished character.

Words met before are looked up in a bounded table of the worker.  Rows are independent: one narrow Arrow stage that
yields small batches, no shuffle.

Defined results: NULL is an empty text (0 tokens); empty texts encode to nothing; the strings of special tokens in a
text are those tokens, as in the file; repeated rows give repeated results; other columns are not read; an empty
table gives an empty table; texts of any length are encoded whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

VOCABULARY = "word_bpe_49k.json"
#: Characters of a text given to the encoder at a time, and output rows in an Arrow batch.
PIECE = 1 << 16
ROWS = 256
#: Entries in each of the two generations of a worker's table of words met.
CACHE = 1 << 18
END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


class Vocabulary:
    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.joined = spec.get("decoder") is None  # without a decoder, tokens are shown joined by spaces
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(pairs)}
        self.ranks = {p: r for p, (r, _) in self.merges.items()}
        self.merged = [new for _, new in self.merges.values()]
        self.inner = [self.ids[c] for c in self.alphabet]
        self.last = [self.ids[c + END] for c in self.alphabet]
        self.lookahead = sufficient_lookahead(pairs)
        self.find_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
                                          or r"(?!)")
        self.special_hold = max(map(len, self.special), default=1) - 1


def _symbols(token: str) -> int:
    return len(token.removesuffix(END)) if token != END else 1


def sufficient_lookahead(pairs: list) -> int:
    """Symbols behind a token's end after which the boundary there can't change any more.

    reach[x]: the furthest that a merge so far with left part x depends on, counted from the end of x.  A merge
    (a, b) depends on b and on whatever could take up a token that ends where a + b ends: an earlier merge whose left
    part is a suffix of it."""
    reach: dict[str, int] = {}
    for a, b in pairs:
        whole = a + b
        size = len(whole) - (len(END) if whole.endswith(END) else 0)
        after = 0
        if not whole.endswith(END):  # nothing follows a word's end
            after = max((reach.get(whole[i:], 0) for i in range(1, size)), default=0)
        reach[a] = max(reach.get(a, 0), _symbols(b) + after)
    return max(reach.values(), default=0)


@lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a file: a path, or a name that the module of public tokenizers resolves on each worker."""
    if not os.path.isabs(name):
        import public_tokenizers
        name = public_tokenizers.path(name)
    with open(name, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def merge(v: Vocabulary, ids: list[int]) -> list[int]:
    """Merge symbols: always the pair of the lowest rank, leftmost first."""
    merges = v.merges
    if len(ids) < 64:
        ids, rank = list(ids), v.ranks.get
        ranks = [rank(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            ids[i:i + 2] = [v.merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NEVER)
        return ids
    ids, n = list(ids), len(ids)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(m[0], i, m[1]) for i, p in enumerate(zip(ids, ids[1:])) if (m := merges.get(p))]
    heapq.heapify(heap)
    while heap:
        rank, i, new = heapq.heappop(heap)
        j = after[i] if ids[i] is not None else n
        if j >= n or (m := merges.get((ids[i], ids[j]))) is None or m[0] != rank:
            continue  # one of the two was taken up meanwhile
        ids[i], ids[j] = new, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if m := merges.get((new, ids[after[j]])):
                heapq.heappush(heap, (m[0], i, m[1]))
        if before[i] >= 0 and (m := merges.get((ids[before[i]], new))):
            heapq.heappush(heap, (m[0], before[i], m[1]))
    return [x for x in ids if x is not None]


_NEVER = sys.maxsize

#: Fixed value: the file's word pattern.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_HOLD = 4  # the longest contraction, and the character behind it


@lru_cache(maxsize=1)
def _newer() -> tuple[re.Pattern, dict[str, list[str]], dict[str, str]]:
    """What the character tables of unicodedata lack and the regex module has: a pattern that finds such letters and
    digits; by class, those that the file's library lacks too; small forms of capitals that it has."""
    unknown = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    every, lacks = set(), {}
    for kind in (r"\p{L}", r"\p{N}"):
        found = regex.findall(kind, unknown)
        split = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
        known = {c for c, _ in split.pre_tokenize_str("".join(found))} if found else set()
        every.update(found)
        lacks[kind] = [c for c in found if c not in known]
    small = normalizers.Lowercase().normalize_str
    return re.compile(_class(every)), lacks, {c: low for c in every if (low := small(c)) != c}


def _class(chars) -> str:
    """A character class of ranges."""
    codes, parts = sorted(map(ord, chars)), []
    for c in codes:
        if parts and parts[-1][1] == c - 1:
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts) + "]" if parts else r"(?!)"


@lru_cache(maxsize=2)
def _patterns(usual: bool) -> tuple[regex.Pattern, regex.Pattern, regex.Pattern]:
    """The word pattern, and its parts that can go on without bound.  Letters and digits are those of the character
    tables of the file's library; only for texts with newer characters (not ``usual``) these differ from the regex
    module's."""
    letter, number = r"\p{L}", r"\p{N}"
    if not usual:
        letter, number = (f"[{k}--{_class(new)}]" if new else k for k, new in _newer()[1].items())
    word = _WORD.replace(r"\p{L}", letter).replace(r"\p{N}", number)
    return tuple(regex.compile(p, regex.V1) for p in (word, f"{letter}+", rf"[^\s{letter}{number}]+"))


def _usual(text: str) -> bool:
    if text.isascii():
        return True
    try:  # all of Latin-1 is old, and this is the fastest way to know it
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _newer()[0].search(text)


def normalise(text: str) -> str:
    """NFC and lower case (each character on its own, so a sigma has one form).  The file also makes white space one
    space; as no word holds any, that changes nothing here."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    text = text.replace("Σ", "σ").lower()
    return text if _usual(text) else "".join([_newer()[2].get(c, c) for c in text])


@lru_cache(maxsize=1)
def _composing() -> frozenset[str]:
    """Characters that can combine with one before them."""
    out = {chr(c) for r in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)) for c in r}
    for c in range(sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(c)).split()
        if len(d) > 1 and d[0][0] != "<":
            out.update(chr(int(x, 16)) for x in d[1:])
    return frozenset(out)


def _cut(raw: str, limit: int) -> int:
    """The last place up to ``limit`` where a text can be cut without changing its normal form or runs of white
    space; 0 if there is none."""
    for i in range(min(limit, len(raw)), 0, -1):
        c = raw[i] if i < len(raw) else ""
        if c.isascii() and c and not c.isspace():
            return i
        if c and not c.isspace() and unicodedata.combining(c) == 0 and c not in _composing():
            return i
    return 0


class Words:
    """Words met and their ids, in two generations: when the young one is full it becomes the old one, and words
    of the old one that are met again move to the young one.  ``merges``: ids of a word's bytes, own merges if None."""

    def __init__(self, v: Vocabulary, merges=None):
        self.v, self.merges = v, merges
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def add(self, w: str) -> tuple[int, ...]:
        ids = self.old.get(w)
        if ids is None:
            b, v = w.encode(), self.v
            if self.merges is not None:
                ids = self.merges("".join([v.alphabet[x] for x in b]))
            else:
                ids = tuple(merge(v, [*map(v.inner.__getitem__, b[:-1]), v.last[b[-1]]]))
        if len(self.young) >= CACHE:
            self.old = dict(self.young)
            self.young.clear()
        self.young[w] = ids
        return ids


class Encoder:
    """``feed`` text pieces, then ``finish``; both give the ids that are certain by then."""

    def __init__(self, v: Vocabulary, words: Words | None = None):
        self.v = v
        self.words = words or Words(v)
        self.raw = ""      # not yet normalised
        self.text = ""     # normalised, not yet cut into words
        self.run = None    # the kind ("letters", "others") of an unfinished word that outgrew a piece
        self.symbols: list[int] = []  # of that word

    def feed(self, piece: str) -> list[int]:
        out: list[int] = []
        self.raw += piece
        while m := self.v.find_special.search(self.raw):
            self._normal(self.raw[:m.start()], out, True)
            out.append(self.v.special[m.group()])
            self.raw = self.raw[m.end():]
        cut = _cut(self.raw, len(self.raw) - self.v.special_hold - 1)
        if cut > 0:
            piece, self.raw = self.raw[:cut], self.raw[cut:]
            self._normal(piece, out, False)
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.v.find_special.finditer(self.raw):
            self._normal(self.raw[at:m.start()], out, True)
            out.append(self.v.special[m.group()])
            at = m.end()
        self._normal(self.raw[at:], out, True)
        self.raw = ""
        return out

    def _normal(self, piece: str, out: list[int], end: bool) -> None:
        text = self.text + normalise(piece)
        pattern, letters, others = _patterns(_usual(text))
        at = 0
        if self.run:
            m = (letters if self.run == "letters" else others).match(text)
            at = m.end() if m else 0
            self._symbols(text[:at], out)
            if at == len(text) and not end:
                self.text = ""
                return
            self._end_run(out)
        if end:
            get = self.words.young.get
            for w in pattern.findall(text, at):
                out += get(w) or self._word(w, out)
            self.text = ""
            return
        done, sure = at, len(text) - _HOLD
        for m in pattern.finditer(text, at):
            if m.start() >= sure or m.end() == len(text):
                break
            out += self.words.young.get(m.group()) or self._word(m.group(), out)
            done = m.end()
        rest = text[done:].lstrip()
        if len(rest) > PIECE:  # one word, still open: its letters go on to the merges
            run, m = ("letters", letters.match(rest)) if letters.match(rest) else ("others", others.match(rest))
            if m and m.end() == len(rest):
                self.run = run
                self._symbols(rest, out)
                rest = ""
        self.text = rest

    def _word(self, w: str, out: list[int]) -> tuple[int, ...]:
        if len(w) > PIECE // 4:  # not kept, and in pieces
            self._symbols(w, out)
            self._end_run(out)
            return ()
        return self.words.add(w)

    def _symbols(self, part: str, out: list[int]) -> None:
        """Symbols of an open word: emit the tokens that have the lookahead behind them.  The last symbol is kept,
        as only the end of the word tells its form."""
        for lo in range(0, len(part), PIECE):
            self.symbols += map(self.v.inner.__getitem__, part[lo:lo + PIECE].encode())
            if len(self.symbols) > self.v.lookahead + PIECE:
                self._stable(out)

    def _stable(self, out: list[int]) -> None:
        known = len(self.symbols) - 1
        sure, used = known - self.v.lookahead, 0
        sizes, tokens = _symbols, self.v.tokens
        for t in merge(self.v, self.symbols[:known]):
            n = sizes(tokens[t])
            if used + n > sure:
                break
            out.append(t)
            used += n
        del self.symbols[:used]

    def _end_run(self, out: list[int]) -> None:
        if self.symbols:
            last = self.v.alphabet.index(self.v.tokens[self.symbols[-1]])
            out += merge(self.v, [*self.symbols[:-1], self.v.last[last]])
        self.run, self.symbols = None, []


class Decoder:
    """``feed`` ids, then ``finish``; both give the text that is certain by then.  ``shown``: as the file's own
    decoder shows it (tokens joined by spaces where it has none), else the plain text, word ends as spaces."""

    def __init__(self, v: Vocabulary, shown: bool = True):
        self.v, self.joined, self.first = v, shown and v.joined, True
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")
        self.of = {c: b for b, c in enumerate(v.alphabet)}

    def feed(self, ids) -> str:
        tokens = self.v.tokens
        if self.joined:
            parts = [tokens[i] for i in ids if i in tokens]
            text = ("" if self.first or not parts else " ") + " ".join(parts)
            self.first = self.first and not parts
            return text
        raw = bytearray()
        for i in ids:
            t = tokens.get(i, "")
            body = t if i in self.v.special.values() else t.removesuffix(END)
            raw += t.encode() if i in self.v.special.values() else bytes(self.of[c] for c in body)
            if body != t:
                raw += b" "
        return self.bytes.decode(bytes(raw))

    def finish(self) -> str:
        return "" if self.joined else self.bytes.decode(b"", True)


def encode_pieces(v: Vocabulary, text: str | None, words: Words | None = None) -> Iterator[list[int]]:
    """The ids of a text, piece by piece."""
    e, text = Encoder(v, words), text or ""
    for lo in range(0, len(text) - PIECE, PIECE):
        yield e.feed(text[lo:lo + PIECE])
    e.raw += text[(max(len(text) - 1, 0) // PIECE) * PIECE:] if len(text) > PIECE else text
    yield e.finish()


def encode(text: str | None, name: str = VOCABULARY, words: Words | None = None) -> list[int]:
    return [i for part in encode_pieces(vocabulary(name), text, words) for i in part]


def decode(ids, name: str = VOCABULARY, shown: bool = True) -> str:
    d = Decoder(vocabulary(name), shown)
    return "".join([d.feed(ids[lo:lo + PIECE]) for lo in range(0, len(ids), PIECE)]) + d.finish()


@lru_cache(maxsize=2)
def worker_words(name: str) -> Words:
    """The table of words of this worker."""
    return Words(vocabulary(name))


@lru_cache(maxsize=2)
def library_words(name: str) -> Words:
    """The same with the library's own merges."""
    from tokenizers import Tokenizer
    if not os.path.isabs(name):
        import public_tokenizers
        path = public_tokenizers.path(name)
    model = Tokenizer.from_file(path if not os.path.isabs(name) else name).model
    return Words(vocabulary(name), lambda w: tuple([t.id for t in model.tokenize(w)]))


def _little_endian(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def round_trip(docs: DataFrame, name: str = VOCABULARY, keep_ids: bool = False, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; with ``keep_ids`` also ``ids``, the little-endian
    unsigned 32-bit ids.  Digests are taken piece by piece, so nothing grows with a text but the kept ids."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * keep_ids
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches):
        v, words = vocabulary(name), worker_words(name)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                n, ids_sha, text_sha, kept = [], [], [], []
                for text in part.column(1):
                    a, b, d, count, raw = hashlib.sha256(), hashlib.sha256(), Decoder(v), 0, []
                    for ids in encode_pieces(v, text.as_py(), words):
                        data = _little_endian(ids)
                        a.update(data)
                        b.update(d.feed(ids).encode())
                        count += len(ids)
                        if keep_ids:
                            raw.append(data)
                    b.update(d.finish().encode())
                    n.append(count)
                    ids_sha.append(a.hexdigest())
                    text_sha.append(b.hexdigest())
                    kept.append(b"".join(raw))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_ids, [f for f, _ in fields])
    return read.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, kind)


def encode_documents(docs: DataFrame, name: str = VOCABULARY, end_id: int | None = None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, ``end_id`` appended where given."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        words = worker_words(name)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = [encode(t.as_py(), name, words) + ([] if end_id is None else [end_id]) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                                 ["doc_id", "ids"])
    return read.mapInArrow(run, "doc_id long, ids array<int>")
