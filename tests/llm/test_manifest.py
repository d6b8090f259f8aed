"""The Merkle manifest against plain recomputation."""

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, path int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(nodes):
    """(root, the siblings of each node as [(before, after)])."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % 3
            paths[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + 3])))
            at[i] = p // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 260), st.integers(1, 4))
def test_traversal(n, subtree):
    leaves = [H(str(i)) for i in range(n)]
    walk = manifest.Traversal(leaves, manifest.height(n), subtree)
    root, want = plain(leaves)
    assert walk.root == root
    held = 0
    for got, expected in zip(walk, want, strict=True):
        assert got == expected
        held = max(held, sum(len(x) for t in (*walk.existing, *walk.desired) for x in t.nodes))
    assert held <= 2 * len(walk.stacks) * (3 ** (subtree + 1)) / 2


def test_block_of_an_unfinished_tree():
    """A last block with one leaf is hashed as many levels as the others."""
    walk = manifest.Traversal(["x"], 2)
    assert walk.root == H(H("x")) and list(walk) == [[("", ""), ("", "")]]


def rows():
    rnd = random.Random(3)
    out = [(i, rnd.choice(["a", "b", "é"]) if i % 3 else "hot", rnd.choice([None, "en"]), rnd.choice([None, i]), rnd.choice([None, "", "x\ny", "日本\n", "z" * 20000])) for i in range(200)]
    out += [(None, None, None, None, None), (7, None, "en", 1, "t"), (7, None, "en", 1, "t"), (900, "lone", None, None, "one"), (None, "a", None, None, "q")]
    return [(*r, "mine", 4) for r in out]


@pytest.mark.parametrize("levels, subtree", [(9, 3), (2, 1), (3, 2)])
def test_manifest(spark, levels, subtree):
    given_rows = rows()
    docs = spark.createDataFrame(given_rows, SCHEMA).repartition(3)
    leaves = docs.select("*", manifest.leaf([F.col(c) for c in manifest.FIELDS]).alias("leaf"))
    got = manifest.manifest(leaves, "source", "doc_id", levels=levels, subtree=subtree)
    folded = got.select("doc_id", "source", "leaf", "path", "subroot", "root", manifest.fold(F.col("leaf"), F.col("path")).alias("again"), manifest.proof_digest(F.col("path")).alias("proof")).collect()
    by = defaultdict(list)
    for i, s, lang, n, t, *_ in given_rows:
        f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        by[s].append((i is None, i or 0, H(*map(f, (i, s, lang, n, t)))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain([x[2] for x in sorted(by[s])]) for s in order}
    root, tops = plain([trees[s][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for (_, _, leaf), path in zip(sorted(by[s]), trees[s][1], strict=True):
            want.append((s, leaf, trees[s][0], root, H(*[b + a for b, a in path + tops[k]])))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.source, r.leaf, r.subroot, r.root, r.proof) for r in folded], key=key) == sorted(want, key=key)
    assert {r.again for r in folded} == {root}


def test_a_changed_leaf_doesn_t_fold_to_the_root(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).select("*", manifest.leaf([F.col(c) for c in manifest.FIELDS]).alias("leaf"))
    got = manifest.manifest(docs, "source", "doc_id")
    assert got.where(manifest.fold(F.sha2(F.col("leaf"), 256), F.col("path")) == F.col("root")).count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert manifest.manifest(docs, "source", "doc_id").count() == 0
