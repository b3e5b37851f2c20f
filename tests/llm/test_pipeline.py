"""The pipeline against a slow version of every stage, each built from the definitions alone."""

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from pressroom.llm import bpe, pii
from tests.llm.helpers import docs
from tests.llm.test_quality_and_contamination import slow_contaminated, slow_kept
from tests.llm.test_simhash import slow_components, slow_fingerprint


def test_pipeline_equals_slow_version(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, rows[5][1]), (10_003, rows[0][1] + " " + items[0][1])]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, str(tmp_path)).collect())
    left = [(i, t) for i, t in rows if slow_kept(t)]
    comp = slow_components([i for i, _ in left], [slow_fingerprint(t) for _, t in left], 4)
    left = [(i, t) for (i, t), c in zip(left, comp) if i == c]
    left = [(i, t) for i, t in left if not slow_contaminated(t, items)[3]]
    lib = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    want = []
    for i, t in left:
        ids = lib.encode(pii.mask(t), add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want) and 20 < len(got) < len(rows)


def test_stages_keep_the_columns(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(12)] + [None, ""]
    d = docs(spark, list(enumerate(texts)))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert out.columns == d.columns, name
        empty = stage(spark, d.filter("doc_id < 0"), "/root/testdata/sf0.001")
        assert empty.count() == 0, name
