"""Overlap matching moves a box about once: retries and votes against plain code, and their exchanges."""

import random

from pyspark.sql import functions as F

from paperloom.operators import ensemble

TOKEN = "upload_id long, page int, token_ix int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def boxes(n, seed, wide):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.uniform(-wide, wide), rnd.uniform(-wide, wide)
        out.append((1, 1 + i % 2, i, f"t{i}", rnd.choice([0.2, 0.5, 0.8]), x, y, x + rnd.choice([2, 7, 9, 30, 130]), y + rnd.choice([2, 7, 9, 30, 130])))
    return out


def moved(rows, seed, name):
    rnd = random.Random(seed)
    return [(u, p, i, name + t, rnd.choice([0.1, 0.6, 0.9]), x0 + rnd.uniform(-1, 1), y0 + rnd.uniform(-1, 1), x1 + rnd.uniform(-1, 1), y1 + rnd.uniform(-1, 1)) for u, p, i, t, _, x0, y0, x1, y1 in rows if rnd.random() < 0.8]


def best(r, others):
    def iou(s):
        w, h = min(r[7], s[7]) - max(r[5], s[5]), min(r[8], s[8]) - max(r[6], s[6])
        inner = w * h if w > 0 and h > 0 else 0.0
        return inner / ((r[7] - r[5]) * (r[8] - r[6]) + (s[7] - s[5]) * (s[8] - s[6]) - inner)

    near = [(-iou(s), s[2], s) for s in others if s[1] == r[1] and s[7] > s[5] and s[8] > s[6] and iou(s) > 0.5]
    return min(near)[2] if near else None


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_retries_by_one_matching(spark):
    own = boxes(300, 1, 250)
    engines = [moved(own, 2, "a"), moved(own, 3, "b")]
    got = ensemble.retry(spark.createDataFrame(own, TOKEN), [spark.createDataFrame(e, TOKEN) for e in engines])
    assert exchanges(got) <= 4  # weak tokens, engines, and the join back
    want, used = {}, set()
    for r in own:
        k, s = next(((k, s) for k, e in enumerate(engines, 1) if r[4] < 0.6 and (s := best(r, e)) and s[4] > r[4]), (0, r))
        want[r[1], r[2]] = (s[3:], k)
        used.add(k)
    assert used == {0, 1, 2}
    assert {(r.page, r.token_ix): (tuple(r)[3:9], r.engine_used) for r in got.collect()} == want


def test_votes_stay_where_they_are_matched(spark):
    own = boxes(200, 4, 200)
    tokens = [own, moved(own, 5, ""), moved(own, 6, "")]
    every = None
    for k, rows in enumerate(tokens):
        one = spark.createDataFrame(rows, TOKEN).withColumn("engine_ix", F.lit(k))
        every = one if every is None else every.unionByName(one)
    got = ensemble.vote(spark.createDataFrame(own, TOKEN), every)
    assert exchanges(got) == 2
    want = {}
    for r in own:
        said = [(k, s[3]) for k, rows in enumerate(tokens) if (s := best(r, rows))]
        counts = {t: (-sum(t == u for _, u in said), min(k for k, u in said if u == t)) for _, t in said}
        text = min(counts, key=counts.get)
        want[r[1], r[2]] = (text, -counts[text][0], 100.0 * -counts[text][0] / len(said))
    assert {(r.page, r.token_ix): (r.text, r.vote_count, r.vote_agreement) for r in got.collect()} == want


def test_a_box_goes_to_few_tiles(spark):
    """The rows that are brought together: one for a target, fewer than five for a candidate on average."""
    rows = spark.createDataFrame(boxes(4000, 7, 2000), TOKEN)
    plan = ensemble.best_matches(rows, rows)
    assert exchanges(plan) == 2
    c = ensemble._tiled(rows, 0.5)
    assert rows.count() <= c.count() < 5 * rows.count()
