"""The pipeline's near-duplicate stage against exact similarities of distinct five-word shingles."""

import random

from paperloom.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def changed(rnd, words, n):
    out = list(words)
    for k, at in enumerate(rnd.sample(range(len(out)), n)):
        out[at] = f"new{k}x{rnd.randrange(10**6)}"
    return out


def pairs(n, low, high, seed):
    """n pairs of texts with a similarity in [low, high)."""
    rnd, out = random.Random(seed), []
    while len(out) < n:
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 400))]
        text, other = " ".join(base), " ".join(changed(rnd, base, max(1, round(len(base) * rnd.uniform(0.015, 0.06)))))
        if low <= alike(text, other) < high:
            out.append((text, other))
    return out


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.keep_one(df).collect()}


def test_no_pair_at_the_limit_is_lost(spark):
    made = pairs(300, 0.8, 0.83, 1)
    assert kept(spark, [t for p in made for t in p]) == set(range(0, 600, 2))


def test_no_text_below_the_limit_goes(spark):
    made = pairs(300, 0.74, 0.8, 2)
    assert kept(spark, [t for p in made for t in p]) == set(range(600))


def test_chains_match_exact_classes(spark):
    """Clusters with similarities on both sides of the limit, in which many share their keys."""
    rnd, texts = random.Random(3), []
    for size in (40, 12, 5, 3):
        base = [f"w{rnd.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(changed(rnd, base, rnd.randrange(0, 7))) for _ in range(size)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert kept(spark, texts) == set(root)


def test_repeats_do_not_part_near_copies(spark):
    rnd, texts = random.Random(4), []
    for k in range(40):
        base, line = ([f"w{rnd.randrange(5000)}" for _ in range(n)] for n in (200, 10))
        texts += [" ".join(base + line), " ".join(base + line * (5, 10, 30)[k % 3])]
        assert alike(*texts[-2:]) > 0.9
    assert kept(spark, texts) == set(range(0, 80, 2))
