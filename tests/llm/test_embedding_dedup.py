"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest

from pressroom.functions.vectors import units
from pressroom.llm import embedding_dedup as D


def brute(ids, rows, threshold=0.9):
    """{row number: (n_links, component_id, kept)} from all pairs."""
    n = len(rows)
    good = [r is not None and len(r) > 0 and all(c is not None and np.isfinite(c) for c in r) and any(r) for r in rows]
    parent, links = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    u = [units(np.array([r], float))[0] if g else None for r, g in zip(rows, good)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(u[i]) == len(u[j]) and float((u[i] * u[j]).sum()) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    comp = {}
    for i in range(n):
        if ids[i] is not None:
            comp[find(i)] = min(comp.get(find(i), ids[i]), ids[i])
    return sorted(((ids[i], links[i], comp.get(find(i)), ids[i] == comp.get(find(i))) for i in range(n)), key=str)


def near(rng, x, cosine):
    g = rng.normal(size=x.shape)
    g -= (g @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + (1 - cosine ** 2) ** 0.5 * g / np.linalg.norm(g)


def frame(spark, ids, rows, kind="double"):
    return spark.createDataFrame([(i, r, "x") for i, r in zip(ids, rows)],
                                 f"vec_id long, embedding array<{kind}>, cell string").repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("cell,block", [(200, 2048), (3, 4)])
def test_equal_to_all_pairs(spark, monkeypatch, cell, block):
    """With every cell visited the result is exact, however small cells and blocks are."""
    monkeypatch.setattr(D, "CELL", cell)
    monkeypatch.setattr(D, "BLOCK", block)
    rng = np.random.default_rng(cell)
    base = rng.normal(size=(40, 12))
    rows = [r.tolist() for r in base]
    for i in range(120):  # chains, groups around the threshold, scaled and exact copies
        r = np.array(rows[rng.integers(len(rows))])
        rows.append((near(rng, r, rng.choice([0.88, 0.899, 0.901, 0.93, 0.99])) * rng.choice([1, 7])).tolist())
    rows += [rows[3]] * 30 + [(2 * np.array(rows[3])).tolist()] * 3
    rows += [None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] + [1.0] * 11,
             [1.0], [2.0], [-1.0], rows[0][:7], rows[0][:7], [1e200] * 12, [1e-200] * 12]
    ids = list(range(len(rows)))
    ids[5], ids[6], ids[-1] = 4, None, -9
    df = frame(spark, ids, rows)
    monkeypatch.setattr(D, "fit", lambda *a, _fit=D.fit: _fit(*a)._replace(slack=1e9))
    assert got(D.embedding_links(df)) == brute(ids, rows)


def test_recall_on_random_vectors(spark, monkeypatch):
    """Pairs at 0.9 to 0.95 among random vectors, the hardest there are: at least the share asked for is found, and
    nothing else."""
    monkeypatch.setattr(D, "CELL", 8)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    y = np.stack([near(rng, r, c) for r, c in zip(x, rng.uniform(0.9, 0.95, len(x)))])
    rows = np.concatenate([x, y]).astype(np.float32)
    u = units(rows)
    cos = u @ u.T
    np.fill_diagonal(cos, 0)
    want = (cos >= 0.9).sum(1)
    out = sorted(map(tuple, D.embedding_links(frame(spark, range(3000), rows.tolist(), "float")).collect()))
    links = np.array([r[1] for r in out])
    assert (links <= want).all()
    assert links.sum() >= 0.95 * want.sum()
    for i, n, component, kept in out:
        assert component == (i % 1500 if n else i) or not want[i] == 1
        assert kept == (component == i)


def test_whole_table_against_all_pairs(spark):
    from tests.conftest import SF_SMALL
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    u = units(np.array([r.embedding for r in rows]))
    planted = [(10_000 + i, near(np.random.default_rng(i), u[i], 0.96).tolist()) for i in range(0, len(u), 5)]
    more = spark.createDataFrame(planted, "vec_id long, embedding array<float>")
    both = df.select("vec_id", "embedding").unionByName(more)
    all_rows = both.collect()
    v = units(np.array([r.embedding for r in all_rows]))
    cos = v @ v.T
    np.fill_diagonal(cos, 0)
    want = {r.vec_id: n for r, n in zip(all_rows, (cos >= 0.9).sum(1))}
    found = {r.vec_id: r.n_links for r in D.embedding_links(both).collect()}
    assert found.keys() == want.keys() and all(found[k] <= want[k] for k in want)
    assert sum(found.values()) >= 0.95 * sum(want.values())


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    cells = list(D.multi_sequence(a, b, 0.8))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums)
    assert sorted(cells) == sorted((i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= a.min() + b.min() + 0.8)


def test_bounds_hold_and_are_tight():
    rng = np.random.default_rng(1)
    x = units(rng.normal(size=(300, 48)))
    y = units(0.95 * x + 0.06 * rng.normal(size=x.shape))
    sure, unsure = D.decide(D.encode(x), D.encode(y), 0.9)
    cos = x @ y.T
    assert (cos[sure] >= 0.9).all() and (cos[~sure & ~unsure] < 0.9).all()
    assert (np.abs(cos[unsure] - 0.9) < 0.05).all()


def test_forest_spans():
    rng = np.random.default_rng(2)
    for _ in range(50):
        m = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.25
        edges = [(int(i), int(j)) for a, b in D.forest(m) for i, j in zip(a, b)]
        assert all(m[e] for e in edges) and len(set(edges)) == len(edges)

        def parts(pairs):
            p = {}

            def find(k):
                while p.setdefault(k, k) != k:
                    k = p[k]
                return k
            for i, j in pairs:
                p[find(("r", i))] = find(("c", j))
            return {frozenset(k for k in p if find(k) == find(q)) for q in list(p)}
        assert parts(edges) == parts(np.argwhere(m).tolist())


def test_empty_and_unusable(spark):
    df = frame(spark, [1, 1, None], [None, [0.0, 0.0], [float("nan")]])
    assert got(D.embedding_links(df)) == sorted([(1, 0, 1, True), (1, 0, 1, True), (None, 0, None, True)], key=str)
    assert D.embedding_links(df.limit(0)).count() == 0
