"""Frequent phrases against a counter, with summaries far too small; association against the formula."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pressroom.operators import phrases as P


def texts(seed=1, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [" ".join(rng.choices(vocab, weights, k=rng.randrange(0, 40))) for _ in range(n)]
    return rows + [None, "", "one", "Red, RED fox!", rows[0], rows[0], "new york " * 200]


def frame(spark, rows):
    return spark.createDataFrame([(t, 1, "x") for t in rows], "text string, n int, phrase string").repartition(5)


def by_hand(rows, n):
    c = Counter()
    for t in rows:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        c.update(" ".join(w[i:i + n]) for i in range(len(w) - n + 1))
    return c


@pytest.mark.parametrize("n, top, capacity", [(2, 20, 40), (3, 5, 10), (1, 30, 100_000), (2, 10**5, 16)])
def test_top_is_exact(spark, n, top, capacity):
    rows = texts()
    want = sorted(by_hand(rows, n).items(), key=lambda x: (-x[1], x[0]))[:top]
    got = P.top_ngrams(frame(spark, rows), n, top, capacity=capacity).collect()
    assert [(r.phrase, r["count"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, len(want) + 1)) and {r["n"] for r in got} == {n}


def test_summaries_stay_small_and_within_their_error():
    rng = np.random.default_rng(3)
    true, merged, total = Counter(), P.Summary(50), 0
    for _ in range(4):  # four tasks, merged
        s = P.Summary(50)
        for _ in range(6):
            keys = rng.zipf(1.3, 2000) % 5000
            true.update(keys.tolist())
            total += len(keys)
            s.add(keys)
            assert len(s.keys) <= 50
        merged.add(s.keys, s.counts, s.error)
    low = dict(zip(merged.keys.tolist(), merged.counts.tolist()))
    assert len(low) <= 50 and 0 < merged.error <= total / 50
    assert all(low.get(k, 0) <= c <= low.get(k, 0) + merged.error for k, c in true.items())


def test_a_shared_hash_does_not_hide_a_phrase(spark, monkeypatch):
    real = P._candidates

    def raised(*a):
        summed, error, least = real(*a)
        return summed, error, least + 500  # as if two n-grams of one hash had been added up
    monkeypatch.setattr(P, "_candidates", raised)
    rows = texts()
    got = P.top_ngrams(frame(spark, rows), 2, 12).collect()
    want = sorted(by_hand(rows, 2).items(), key=lambda x: (-x[1], x[0]))[:12]
    assert [(r.phrase, r["count"]) for r in sorted(got, key=lambda r: r["rank"])] == want


def test_association(spark):
    rows = texts(5) + ["a b"]
    d = frame(spark, rows)
    grams = by_hand(rows, 2)
    total = sum(grams.values())
    first, second = Counter(), Counter()
    for g, k in grams.items():
        a, b = g.split()
        first[a] += k
        second[b] += k
    got = P.associations(d, P.top_ngrams(d, 2, 40)).collect()
    assert len(got) == 40
    for r in got:
        a, b = r.phrase.split()
        k, na, nb = grams[r.phrase], first[a], second[b]
        cells = [(k, na, nb), (na - k, na, total - nb), (nb - k, total - na, nb), (total - na - nb + k, total - na, total - nb)]
        want = 2 * sum(c * math.log(c * total / (x * y)) for c, x, y in cells if c)
        assert (r["count"], r.n_first, r.n_second) == (k, na, nb) and math.isclose(r.score, want, rel_tol=1e-9)
    assert max(got, key=lambda r: r.score).phrase in ("new york", "york new")


def test_empty(spark):
    d = frame(spark, ["x"]).where("text IS NULL")
    top = P.top_ngrams(d, 2, 5)
    assert top.count() == 0 and P.associations(d, top).count() == 0


def test_summaries_are_one_stage_after_native_words(spark):
    d = frame(spark, texts())
    plan = P.summaries(d.selectExpr("array(xxhash64(text)) AS h"), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PartitionEvalPython" not in plan


def test_joined_hashes_agree(spark):
    rows = ["a b c d", "", "a a a", "b", "c d"]
    d = spark.createDataFrame([(t,) for t in rows], "text string").coalesce(1)
    hashes = dict(spark.sql("SELECT w, xxhash64(w) FROM VALUES 'a', 'b', 'c', 'd' t(w)").collect())
    flat = np.array([hashes[w] for t in rows for w in t.split()], np.int64)
    for n in (1, 2, 3, 4, 5):
        got = sorted(r.h for r in P.runs(d, n).collect())
        assert got == sorted(P.joined_runs(flat, np.array([len(t.split()) for t in rows]), n).tolist())
        assert len(got) == sum(max(0, len(t.split()) - n + 1) for t in rows)


def test_runs_are_cut_in_slices_without_loss(monkeypatch):
    """a batch of many words is joined to runs slice by slice; texts over and across slices lose and gain none."""
    import numpy as np
    from pressroom.operators import phrases as P
    monkeypatch.setattr(P, "SLICE", 7)
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            lengths = rng.integers(0, 30, 12)
            hashes = rng.integers(-2**62, 2**62, int(lengths.sum()))
            got = list(P.sliced_runs(hashes, lengths, n))
            assert max(map(len, got), default=0) <= 7
            assert np.concatenate(got).tolist() == P.joined_runs(hashes, lengths, n).tolist()
