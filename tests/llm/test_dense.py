"""Fingerprint links where one key holds very many fingerprints."""

import numpy as np
import pandas as pd
import pytest

from paperloom.llm import simhash
from paperloom.llm.graph import components


def brute_roots(fps):
    """The least fingerprint that each one reaches over pairs at most four bits apart, by comparing all pairs."""
    label = np.arange(len(fps))
    edges = []
    for k in range(0, len(fps), 500):
        i, j = np.nonzero(np.bitwise_count(fps[k : k + 500, None] ^ fps[None, k:]) <= 4)
        edges.append(np.column_stack([i + k, j + k])[i < j])
    edges = np.concatenate(edges)
    while True:
        new = label.copy()
        np.minimum.at(new, edges[:, 0], label[edges[:, 1]])
        np.minimum.at(new, edges[:, 1], label[edges[:, 0]])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def roots(spark, fps):
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    met = simhash.candidates(nodes)
    got = components(simhash.linked(nodes)).toPandas()
    root = dict(zip(got.node, got.root, strict=True))
    return [root.get(x, x) for x in fps.view(np.int64).tolist()], met.count()


def same_partition(a, b):
    pairs = set(zip(a, b, strict=True))
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


@pytest.mark.parametrize("kind", ["one key", "one ball"])
def test_a_key_of_very_many_fingerprints(spark, kind):
    rnd = np.random.default_rng(5)
    n = 50_000 if kind == "one key" else 12_000
    if kind == "one key":  # 22 bits agree in all of them, the others are random; some are copies with a few bits changed
        fps = rnd.integers(0, 1 << 42, n, dtype=np.uint64)
        copies = fps[:3000].copy()
        for _ in range(3):
            copies ^= np.uint64(1) << rnd.integers(0, 42, len(copies), dtype=np.uint64)
        fps = np.concatenate([fps, copies])
    else:  # up to nine bits from one centre
        fps = np.full(n, 0x123456789ABCDEF0, dtype=np.uint64)
        for _ in range(9):
            fps ^= (np.uint64(1) << rnd.integers(0, 64, n, dtype=np.uint64)) * rnd.integers(0, 2, n, dtype=np.uint64)
    fps = np.unique(fps)
    got, rows = roots(spark, fps)
    assert same_partition(got, brute_roots(fps).tolist())
    assert rows < 400 * len(fps)
