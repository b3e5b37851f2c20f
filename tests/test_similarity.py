"""Nearest rows against all pairs: exact where every list is looked into, recall at 10 otherwise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom.functions.vectors import units
from pressroom.operators import similarity as S

from conftest import SF_MID


def truth(ids, rows, asks, k):
    u = units(np.array(rows, float))
    out = {}
    for i in asks:
        cos = [(-float((u[i] * u[j]).sum()), ids[j]) for j in range(len(ids)) if j != i]
        out[ids[i]] = [o for _, o in sorted(cos)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.other)
    return out


def test_recall_at_10_over_the_table(spark):
    df = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    got = found(S.nearest_rows(df, F.col("vec_id") % 50 == 0))
    want = truth([r.vec_id for r in rows], [r.embedding for r in rows], [i for i, r in enumerate(rows) if r.vec_id % 50 == 0], 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    recall = sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))
    assert recall >= 0.9


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_when_every_list_is_looked_into(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "fit", lambda *a, _fit=S.fit: _fit(*a)._replace(probes=10 ** 6))
    rng = np.random.default_rng(block)
    rows = rng.normal(size=(150, 5)).tolist()
    rows += [rows[0], (np.array(rows[0]) * 3).tolist(), None, [], [0.0] * 5, [1.0] * 4, [float("nan")] * 5]
    ids = list(range(len(rows)))
    df = spark.createDataFrame([(i, r, 1) for i, r in zip(ids, rows)], "vec_id long, embedding array<double>, list int")
    got = found(S.nearest_rows(df.repartition(3), F.col("vec_id") % 10 == 0, k=3))
    assert got == {i: w for i, w in truth(ids[:152], rows[:152], range(0, 152, 10), 3).items()}


def test_only_some_lists_are_looked_into(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    x = units(np.concatenate([c + rng.normal(size=(50, 16)) * 0.4 for c in centres]))
    books = S.fit(x[rng.permutation(len(x))], len(x))
    assert books.probes < len(books.centres) / 4
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got, want = found(S.nearest_rows(df, F.col("vec_id") % 50 == 0)), truth(range(len(x)), x, range(0, len(x), 50), 10)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * 10 * len(want)


def test_nothing_usable(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    assert S.nearest_rows(df, F.lit(True)).count() == 0
    assert S.nearest_rows(df.limit(0), F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert S.nearest_rows(one, F.lit(True)).count() == 0
