"""Drake's bounds against plain Lloyd rounds over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from paperloom.llm import clusters


def plain(vectors, k, rounds, seed="2"):
    """(cluster and distance of each (id, integers), final centroids)."""
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), i) for i, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in vectors]
        for i in range(len(c)):
            mine = [v for (_, v), a in zip(vectors, of) if a == i]
            if mine:
                c[i] = [sum(x) // len(mine) for x in zip(*mine)]
    return [near(v) for _, v in vectors], c


def table(n, spread, dimensions=8):
    rnd = random.Random(n)
    centers = [[rnd.uniform(-1, 1) for _ in range(dimensions)] for _ in range(6)]
    out = []
    for i in range(n):
        m = centers[0] if i % 3 == 0 else rnd.choice(centers)
        out.append((i, [x + rnd.choice([0.0, spread, -spread]) for x in m]))  # many ties
    return out


@pytest.mark.parametrize("n, k, spread", [(400, 12, 0.5), (300, 40, 0.01), (50, 1, 0.2), (30, 40, 0.2), (200, 2, 0.0), (500, 17, 3.0)])
def test_against_plain(spark, n, k, spread):
    rows = table(n, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    log = []
    got, centroids = clusters.clustered(df, "vec_id", "embedding", k=k, dimensions=8, log=log)
    want, final = plain([(i, [math.floor(256 * x) for x in v]) for i, v in rows], k, 5)
    assert centroids.tolist() == final
    assert {r.vec_id: (r.distance, r.cluster) for r in got.collect()} == {i: w for (i, _), w in zip(rows, want)}
    assert log[0]["scanned"] == n * min(n, k)
    if (n, k) == (400, 12):  # bounds save work, and fall to what is needed
        assert sum(x["scanned"] for x in log[1:]) < 2 * n * k and log[-1]["b"] < 11


def test_bounds_stay_bounds():
    """After random moves no bound is beyond the true distance."""
    rng = np.random.default_rng(4)
    v, c = rng.integers(-300, 300, (500, 6)), rng.integers(-300, 300, (15, 6))
    state = clusters.Bounds(v, c, 5)
    state.scan(np.arange(500))
    for b in (5, 3, 7, 2, 14):
        new = c + rng.integers(-25, 25, c.shape)
        moved = clusters._high(clusters.squared(new, c))
        c = new
        then = clusters.Bounds(v, c, b)
        then.restore(state.cluster, state.upper, state.near, state.lower, state.rest, moved)
        d = np.stack([clusters.squared(v, x) for x in c], axis=1)
        true = np.sqrt(d)
        assert (then.upper >= true[np.arange(500), then.cluster] - 1e-9).all()
        then.update()
        assert (then.cluster == d.argmin(axis=1)).all()
        for j in range(then.b):
            has = then.near[:, j] >= 0
            assert (then.lower[has, j] <= true[has, then.near[has, j]] + 1e-9).all()
        others = np.ones(d.shape, bool)
        others[np.arange(500), then.cluster] = False
        for j in range(then.b):
            has = np.flatnonzero(then.near[:, j] >= 0)
            others[has, then.near[has, j]] = False
        assert (then.rest <= np.where(others, true, np.inf).min(axis=1) + 1e-9).all()
        state = then


def test_odd_rows(spark):
    good = [float(i) for i in range(64)]
    odd = [(1, good, 5, "mine"), (1, good, 5, "mine"), (None, good[::-1], 5, None), (3, None, 5, "x"), (4, [], 5, "x"), (5, good[:63], 5, "x"), (6, [*good[:63], None], 5, "x"), (7, [*good[:63], float("nan")], 5, "x"), (8, [*good[:63], float("inf")], 5, "x"), (9, [-0.001] * 64, 5, "x")]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<float>, cluster int, v string")
    got, centroids = clusters.clustered(df, "vec_id", "embedding")
    assert sorted((str(r.vec_id), r.distance) for r in got.collect()) == [("1", 0), ("1", 0), ("9", 0), ("None", 0)]
    assert len(centroids) == 4 and [-1] * 64 in centroids.tolist()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert clusters.query(spark, str(tmp_path)).count() == 0
