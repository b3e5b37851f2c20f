import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pressroom.llm import bpe
from pressroom.llm import token_files as F
from tests.llm.helpers import docs, table_rows


def test_round_trip(spark, tmp_path):
    lib = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    rows = [(r.doc_id, r.text) for r in table_rows(spark, "/root/testdata/sf0.001")][::-1]
    rows += [(10**12, None), (-5, ""), (-5, "twice"), (None, "no id"), (7, "long " * 60_000)]
    uri = f"file://{tmp_path}/tokens"
    manifest, dictionary = F.write_token_files(docs(spark, rows).withColumnRenamed("lang", "at"), uri)
    got = sorted((tuple(r) for r in F.read_token_files(manifest, dictionary).collect()), key=lambda r: r[1])
    ids = {i: [] for i, _ in rows}
    for i, t in rows:
        a = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        ids[i].append((len(a), zlib.crc32(a.tobytes())))
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for doc_id, start, n, crc in got:
        assert start == at and (n, crc) in ids[doc_id]
        ids[doc_id].remove((n, crc))
        at += n
    assert not any(ids.values())
    # short documents are read alone
    raw = open(dictionary.removeprefix("file://"), "rb").read()
    for r in manifest.collect():
        reader = F.ShardReader(r.file, raw)
        for present, doc_id, *_ in reader.index:
            if present and doc_id not in (-5, 7):
                want = lib.encode(dict(rows)[doc_id] or "", add_special_tokens=False).ids + [2]
                assert reader.find(doc_id).tolist() == want
        assert reader.find(3_333_333) is None
    with pytest.raises(ValueError):
        F.ShardReader(manifest.first().file, b"another dictionary")


def test_empty(spark, tmp_path):
    assert F.token_files_round_trip(spark, docs(spark, []), f"file://{tmp_path}/none").count() == 0


def test_packed_words_equal_the_library():
    lib = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    words, rng = F.PackedWords(bpe.VOCABULARY), random.Random(6)
    ascii_all, latin_all = ("".join(map(chr, range(n))) for n in (128, 256))
    texts = [ascii_all, latin_all, latin_all[::-1], "a".join(latin_all), "1".join(latin_all), "-".join(latin_all), ascii_all * 3, "It's DON'T we'll I'd 'tis", "x" * 40_000, "a b " * 9000, "<|startoftext|>x<|endoftext|>",
             "é É ÉTÉ Σίσυφος ς ½² 漢字 🙂🏽", ""]
    for i in range(400):
        pool = (ascii_all, latin_all, ascii_all + "éÉßΣσς漢字🙂½²\u0301\u2028")[i % 3]
        texts.append("".join(rng.choice(pool) for _ in range(rng.randrange(60))))
    for _ in range(2):  # met anew, then known
        for t in texts:
            want = lib.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(words.encode(t), "<u2").tolist() == want, t[:80]


def test_shards_are_read_a_task_each(spark, tmp_path):
    rows = [(i, f"text {i} " * 40) for i in range(200)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    manifest, dictionary = F.write_token_files(docs(spark, rows).repartition(4), f"file://{tmp_path}/t")
    spark.conf.set(key, "true")
    assert manifest.count() > 1
    back = F.read_token_files(manifest, dictionary)
    assert back.rdd.getNumPartitions() == manifest.count()
    assert sorted(r.doc_id for r in back.collect()) == list(range(200))
