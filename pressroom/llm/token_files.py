"""Token ids in binary shard files: a shared zstandard dictionary, each document compressed on its own.

A folder holds shard files, in ascending id order from shard to shard and inside each.  A shard:

    magic "TOKS1\\n", id width (2 or 4), SHA-256 of the dictionary
    one zstandard frame per document: its ids, little-endian, of that width
    index: per document 1 byte (id present), doc_id (8), offset (8), size (8), tokens (8)
    start of the index (8), documents (8), the magic again

so a reader finds a document by bisection in the index and decompresses that one frame alone.  The dictionary is
trained on the serialized ids of a bounded sample of short documents (``SAMPLE_ROWS``, ``SAMPLE_CHARS``): it is what
short documents lack, long ones compress as well without; it changes sizes, never ids.  It is stored beside the
shards under its hash.

Plan: one range shuffle of the texts by id (Spark's sampled splitters), then one Arrow stage per partition encodes,
compresses and writes its shard as it goes, holding one document and the index.  A task writes under a name of its
own and reports it in its row; the checkpointed rows are the manifest, so that files of lost or repeated attempts are
never read.  The files are opened through Arrow's file systems by the folder's URI (shared storage).

Defined results: NULL is an empty text (the end id alone); rows with a NULL id come first, rows that repeat an id
follow each other (by text hash), each a document of its own; an empty table gives no shard; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import uuid
import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.llm.bpe import CACHE, PIECE, VOCABULARY, _patterns, _usual, encode_pieces, library_words, normalise, vocabulary
from pressroom.llm.common import checkpointed, small_side
from pressroom.session import scratch_path

MAGIC = b"TOKS1\n"
DICTIONARY_BYTES = 64 << 10
#: Bounds of the sample that the dictionary is trained on.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
LEVEL = 3
_ENTRY = struct.Struct("<Bqqqq")
_TAIL = struct.Struct("<qq")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def _width(name: str) -> int:
    return 2 if max(vocabulary(name).tokens) < 1 << 16 else 4


def _pack(ids, width: int) -> bytes:
    a = array("H" if width == 2 else "I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


#: The word pattern for the standard library, on lower case text of ASCII and of Latin-1 (letters, digits and white space
#: of that range spelled out); such texts are in normal form.
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_LATIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|"
                         r"[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PackedWords:
    """Words met and their ids as packed bytes, in two generations like :class:`bpe.Words`; a text's ids are its words'
    bytes joined."""

    def __init__(self, name: str):
        self.name, self.v, self.width = name, vocabulary(name), _width(name)
        self.merges = library_words(name).merges
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _slow(self, text: str) -> bytes:
        words = library_words(self.name)
        return b"".join([_pack(part, self.width) for part in encode_pieces(self.v, text, words)])

    def _add(self, w: str) -> bytes:
        if len(w) > PIECE // 4:  # not kept, and merged in pieces
            return self._slow(w)
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        raw = self.young.get(w) or self.old.get(w)
        if raw is None:
            # printable ASCII stands for itself in the alphabet of bytes
            shown = w if w.isascii() and w.isalnum() else "".join([self.v.alphabet[x] for x in w.encode()])
            raw = _pack(self.merges(shown), self.width)
        self.young[w] = raw
        return raw

    def encode(self, text: str | None) -> bytes:
        """The packed ids of a text; texts of more than a piece and those with special tokens go the streaming way."""
        if not text:
            return b""
        if len(text) > PIECE or self.v.find_special.search(text):
            return self._slow(text)
        if text.isascii():
            words = _ASCII_WORD.findall(text.lower())
        elif _latin(text):
            words = _LATIN_WORD.findall(text.lower())
        else:
            text = normalise(text)
            words = _patterns(_usual(text))[0].findall(text)
        parts = list(map(self.young.get, words))
        if None in parts:
            parts = [p or self._add(w) for p, w in zip(parts, words)]
        return b"".join(parts)


def train_dictionary(docs: DataFrame, name: str = VOCABULARY, end_id: int = 2) -> bytes:
    """A dictionary from the ids of a sample of short documents; empty when there is too little to train on.  The rows are
    counted without their texts, so these are read once, and only about as many as wanted leave their task."""
    share = min(1.0, 2 * SAMPLE_ROWS / max(docs.count(), 1))
    texts = [r.text for r in docs.select("text").sample(fraction=share, seed=11).limit(2 * SAMPLE_ROWS)
             .filter(F.length("text").between(1, SAMPLE_CHARS)).limit(SAMPLE_ROWS).collect()]
    words = PackedWords(name)
    end = _pack([end_id], words.width)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [words.encode(t) + end for t in texts]).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


class ShardWriter:
    def __init__(self, out, dictionary: bytes, width: int):
        self.out, self.width, self.index, self.at = out, width, [], 0
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
        self._put(MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest())

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def add(self, doc_id: int | None, raw: bytes) -> int:
        """Write one document from its packed ids; the number of ids."""
        n = len(raw) // self.width
        frame = self.zstd.compress(raw)
        self.index.append((doc_id is not None, doc_id or 0, self.at, len(frame), n))
        self._put(frame)
        return n

    def close(self) -> None:
        at = self.at
        for e in self.index:
            self._put(_ENTRY.pack(*e))
        self._put(_TAIL.pack(at, len(self.index)) + MAGIC)
        self.out.close()


class ShardReader:
    def __init__(self, uri: str, dictionary: bytes):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if head[:len(MAGIC)] != MAGIC or head[len(MAGIC) + 1:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a shard of this dictionary")
        self.width = head[len(MAGIC)]
        tail = _TAIL.size + len(MAGIC)
        size = self.file.size()
        at, n = _TAIL.unpack(self.file.read_at(tail, size - tail)[:_TAIL.size])
        raw = self.file.read_at(n * _ENTRY.size, at)
        self.index = list(_ENTRY.iter_unpack(raw))
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdDecompressor(dict_data=data)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the shard."""
        _, _, at, size, n = self.index[k]
        raw = self.zstd.decompressobj().decompress(self.file.read_at(size, at))
        out = np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")
        if len(out) != n:
            raise ValueError("a document is damaged")
        return out

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document with this id, reading only its frame."""
        k = bisect_left(self.index, (1, doc_id, -1, -1, -1))
        return self.ids(k) if k < len(self.index) and self.index[k][:2] == (1, doc_id) else None


def write_token_files(docs: DataFrame, folder: str, name: str = VOCABULARY, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text") -> tuple[DataFrame, str]:
    """Write the shards; (manifest, URI of the dictionary).  Manifest: (shard, file, docs, tokens, start)."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(read, name, end_id)
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    dict_uri = f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dict"
    with fs.open_output_stream(open_fs(dict_uri)[1]) as f:
        f.write(dictionary)

    def write(batches):
        from pyspark import TaskContext
        words, writer = PackedWords(name), None
        end = _pack([end_id], words.width)
        tokens = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if writer is None:
                    shard = TaskContext.get().partitionId()
                    uri = f"{folder}/shard-{shard:08d}-{uuid.uuid4().hex}.toks"
                    to, at = open_fs(uri)
                    own_fs, own_path = open_fs(dict_uri)
                    with own_fs.open_input_file(own_path) as d:
                        writer = ShardWriter(to.open_output_stream(at), d.read(), _width(name))
                tokens += writer.add(doc_id.as_py(), words.encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([uri]), pa.array([len(writer.index)]), pa.array([tokens])],
                ["shard", "file", "docs", "tokens"])
    dealt = read.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = checkpointed(dealt.mapInArrow(write, "shard long, file string, docs long, tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row per shard
    return checkpointed(shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))), dict_uri


def read_token_files(manifest: DataFrame, dict_uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards."""
    def read(batches):
        own_fs, own_path = open_fs(dict_uri)
        with own_fs.open_input_file(own_path) as d:
            dictionary = d.read()
        for batch in batches:
            for shard, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r, at = ShardReader(uri, dictionary), 0
                out = ([], [], [], [], [])
                for k, (present, doc_id, _, _, n) in enumerate(r.index):
                    crc = zlib.crc32(r.ids(k).astype("<u4").tobytes())
                    for col, x in zip(out, (shard, doc_id if present else None, at, n, crc)):
                        col.append(x)
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                                 ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])
                r.file.close()
    # a shard a row and a task: they are the work (a number given is not coalesced)
    spread = manifest.select("shard", "file").repartitionByRange(max(1, manifest.count()), "shard")
    found = spread.mapInArrow(read, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return (found.join(small_side(manifest.select("shard", "start"), 16), "shard")
            .select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def token_files_round_trip(spark: SparkSession, docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the shards (to a fresh folder of the shared one by default) and read them back."""
    manifest, dict_uri = write_token_files(docs, folder or scratch_path(spark, "token-files"), **options)
    return read_token_files(manifest, dict_uri)
