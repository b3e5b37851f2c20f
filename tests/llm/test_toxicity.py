import random
import zlib

from pressroom.llm import toxicity as X
from tests.llm.helpers import docs


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = X.train(d, labels, rows=2000)
    own = labels.join(d.select("doc_id", "text"), "doc_id")
    rows = X.score_documents(own, model).join(labels, "doc_id").join(d.select("doc_id", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    hit = [r for r in held if r.predicted]
    precise = sum(r.toxic for r in hit) / len(hit)
    # a twentieth of the labels are wrong at random; of the others the model finds nearly all
    found = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    assert precise > 0.95 and found > 0.5
    named = [r.text[s.start:s.end] for r in hit for s in r.spans]
    assert len(named) >= len(hit) * 0.8


def test_spans_and_edges(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    make = lambda bad: ". ".join(" ".join(rng.choice(words) for _ in range(6)) for _ in range(4)) + (
        ". You total scoundrel there" if bad else "") + "."
    texts = [make(i % 3 == 0) for i in range(300)]
    model = X.fit(texts, [int(i % 3 == 0) for i in range(300)])
    assert model.score(texts[0]) > 0.9 and model.score(texts[1]) < 0.1
    a, b = model.spans(texts[0])[0]
    assert "scoundrel" in texts[0][a:b] and len(model.spans(texts[0])) == 1
    assert 0 <= model.score(None) == model.score("") <= model.score("scoundrel") <= 1
    rows = [(1, None), (2, ""), (3, texts[0]), (3, texts[0]), (None, texts[1]), (4, "scoundrel " * 200_000)]
    got = X.score_documents(docs(spark, rows).withColumnsRenamed({"lang": "score", "source": "toxic"}), model)
    assert sorted(((r.doc_id or 0), r.predicted) for r in got.collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1),
                                                                             (4, 1)]
    assert X.score_documents(docs(spark, []), model).count() == 0


def test_training_without_both_classes(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.train(docs(spark, [(1, "x")]), none).score("x") == 0
    one = spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert X.train(docs(spark, [(1, "x"), (2, "y"), (3, None)]), one).score("y") == 0
