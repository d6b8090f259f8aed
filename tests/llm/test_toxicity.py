"""The factorization machine's score against the sum over all pairs of features, and on held-out documents."""

import random
import zlib

import numpy as np
import pyarrow as pa

from paperloom.llm import toxicity


def made(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 40))] + ["insultword"] * a + ["groupword"] * b
        rnd.shuffle(words)
        out.append((i, " ".join(words), int(a and b)))
    return out


def machine(rows):
    owner, bucket = toxicity.features(pa.array([t for _, t, _ in rows]))
    return toxicity.fit_machine(bucket, np.bincount(owner, minlength=len(rows)), np.array([y for _, _, y in rows]))


def test_score_is_the_sum_over_all_pairs():
    rows = made(400, 1)
    m = machine(rows)
    texts = [t for _, t, _ in made(30, 2)] + ["", None, "x " * 5000, "INSULTWORD groupword"]
    got = m.score_texts(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        bucket = toxicity.features(pa.array([text or ""]))[1]
        assert len(set(bucket.tolist())) == len(bucket)
        v, z = m.factors[bucket].astype(np.float64), m.bias + float(m.linear[bucket].astype(np.float64).sum())
        for i in range(len(bucket)):
            for j in range(i):
                z += float(v[i] @ v[j])
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-6
    assert abs(got[-4] - 1 / (1 + np.exp(-m.bias))) < 1e-9


def test_same_input_same_machine():
    a, b = machine(made(300, 3)), machine(made(300, 3))
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_one_class_gives_its_smoothed_share():
    rows = [(i, "some text", 0) for i in range(8)]
    assert abs(machine(rows).score_texts(pa.array(["anything"]))[0] - 0.1) < 1e-9


def test_the_sample_is_bounded_by_documents_and_buckets(spark):
    rows = made(400, 5)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    seen = []
    real = toxicity.fit_machine
    toxicity.fit_machine = lambda bucket, size, y: seen.append((len(y), len(bucket))) or real(bucket, size, y)
    try:
        for limit in ({}, {"rows": 50}, {"most": 1000}, {"most": 0}):
            toxicity.fit(docs, labels, **limit)
    finally:
        toxicity.fit_machine = real
    assert seen[0][0] > 300 and seen[1][0] == 50 and 0 < seen[2][1] <= 1000 and seen[3] == (0, 0)


def test_repeated_ids_do_not_crowd_out_others(spark):
    rows = made(600, 4)
    hot = [(1, f"filler {k}") for k in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows] + hot, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(5), labels)
    assert (a.linear == b.linear).all()
    got = {r.doc_id: r.predicted for r in toxicity.score(docs.where("doc_id <> 1"), a).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] != 1]
    assert sum(got[r[0]] == r[2] for r in held) / len(held) > 0.95
