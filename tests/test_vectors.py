"""Vector helpers against plain definitions."""

import numpy as np

from pressroom.functions import vectors as V


def test_usable(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [-0.0, 1e-300]),
            (7, [0.0, -2.0])]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    assert [r.i for r in df.where(V.usable("v")).orderBy("i").collect()] == [6, 7]


def test_units_do_not_overflow():
    x = V.units(np.array([[1e200, 1e200], [3e-200, 4e-200], [3.0, 4.0]]))
    assert np.allclose(x, [[2 ** -0.5] * 2, [0.6, 0.8], [0.6, 0.8]])


def test_kmeans_finds_separate_groups_and_copes_with_few_points():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.01, (50, 3)) for c in range(4)])
    c = V.kmeans(points[rng.permutation(200)], 4)
    assert sorted(np.round(c[:, 0]).tolist()) == [0, 1, 2, 3]
    assert len(V.kmeans(np.ones((5, 2)), 3)) == 1
    d = V.distances(points, c)
    assert np.allclose(d, ((points[:, None] - c[None]) ** 2).sum(-1), atol=1e-9)
