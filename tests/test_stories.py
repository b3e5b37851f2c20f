"""Stories against all pairs, in one run and in batches of any order."""

import datetime as dt
import hashlib
import random
import re

import pytest

from pressroom.operators import stories as S
from pressroom.session import scratch_path

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "id long, title string, source string, scraped_at timestamp_ntz, digest string"


def sig(title):
    w = re.sub(r"[^\w\s]", "", (title or "").lower().strip()).split()
    runs = {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return set(sorted(hashlib.md5(r.encode()).hexdigest() for r in runs)[:8])


def brute(rows, hours):
    told = [(i, sig(t), at) for i, t, _, at, *_ in rows if i is not None]
    parent = {i: i for i, _, _ in told}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, sa, ta in told:
        for b, sb, tb in told:
            if sa & sb and ta is not None and tb is not None and abs((ta - tb).total_seconds()) <= hours * 3600:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in parent}


def articles(seed, n=120):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv".split()) for _ in range(rng.choice([3, 6, 14])))
            for _ in range(n // 6)]
    rows = []
    for i in range(n):
        t = rng.choice(base)
        if rng.random() < 0.3:
            t = rng.choice(["Live: ", "", "New! "]) + t + " " + rng.choice(base)
        rows.append((i, t, f"s{rng.randrange(4)}", T0 + dt.timedelta(minutes=rng.randrange(0, 6000)), "x"))
    return rows + [(n, None, "s0", T0, "x"), (n + 1, "", "s0", T0, "x"), (n + 2, base[0], "s1", None, "x"),
                   (None, base[0], "s1", T0, "x"), (3, base[1], "s9", T0 + dt.timedelta(days=2), "x")]


def stories(spark, rows, batches, hours, order):
    path = scratch_path(spark, "stories")
    parts = [rows[i::batches] for i in range(batches)]
    for n, k in enumerate(order):
        S.update_stories(spark.createDataFrame(parts[k], SCHEMA).repartition(2), path, n, hours)
    return path, {r.id: r.story for r in S.read_stories(spark, path).collect()}


@pytest.mark.parametrize("seed,hours", [(1, 6), (2, 1)])
def test_one_run_and_batches_equal_all_pairs(spark, seed, hours):
    rows = articles(seed)
    want = brute(rows, hours)
    assert len(set(want.values())) not in (1, len(want))
    assert stories(spark, rows, 1, hours, [0])[1] == want
    assert stories(spark, rows, 3, hours, [2, 0, 1])[1] == want


def test_replayed_and_uncommitted_batches(spark):
    rows = articles(5, 40)
    path, _ = stories(spark, rows, 2, 4, [0, 1])
    S.update_stories(spark.createDataFrame(rows[1::2], SCHEMA), path, 1, 4)  # the same batch once more
    assert {r.id: r.story for r in S.read_stories(spark, path).collect()} == brute(rows, 4)
    # a batch without its commit row is not seen
    spark.createDataFrame([(99, 99)], "id long, story long").write.parquet(f"{path}/labels/batch=7")
    assert S.read_stories(spark, path).where("id = 99").count() == 0


def test_empty_batch(spark):
    path = scratch_path(spark, "stories")
    S.update_stories(spark.createDataFrame([], SCHEMA), path, 0)
    assert S.read_stories(spark, path).count() == 0


def test_coverage(spark):
    df = spark.createDataFrame([(i, "t", s, T0 + dt.timedelta(hours=h), "") for i, s, h in
                                [(1, "a", 5), (2, "b", 2), (3, "a", 1), (4, "c", 9), (5, "b", 0)]], SCHEMA)
    told = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)], "id long, story long")
    got = [(r.story, r.source, r.n_articles, r.place, r.lag_seconds, r.after_source)
           for r in S.story_coverage(told, df).orderBy("story", "place").collect()]
    assert got == [(1, "a", 2, 1, 0, None), (1, "b", 1, 2, 3600, "a"), (1, "c", 1, 3, 8 * 3600, "b"), (5, "b", 1, 1, 0, None)]


def test_signature_sorts_natively(spark):
    """The digests are sorted without a comparator lambda, into the same order."""
    from pyspark.sql import functions as F
    from pressroom.operators.stories import signature
    df = spark.createDataFrame([(" ".join(f"w{i * 7 % 50}" for i in range(60)),), ("a b",), ("",), (None,)], "t string")
    df = df.select("t", signature(F.col("t")).alias("sig"))
    assert "array_sort" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = [r.sig for r in df.collect()]
    assert len(rows[0]) == 8 and rows[0] == sorted(set(rows[0])) and len(rows[1]) == 1
