"""Layout operators against plain code, on dense pages, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import ensemble, spatial, tokens

TOKEN = "upload_id long, page int, token_ix int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def boxes(n, seed=1, wide=400, sizes=(1, 3, 10, 60, 300)):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rnd.uniform(-20, wide), rnd.uniform(-20, wide), rnd.choice(sizes) * rnd.uniform(0.5, 1), rnd.choice(sizes) * rnd.uniform(0.5, 1)
        if i % 50 == 0:
            w = 0.0
        out.append((1, 1 + i % 2, i, f"t{i}", 0.5, x, y, x + w, y + h))
    return out


def plain_lines(rows, tolerance):
    lines, out = [], {}
    for r in sorted(rows, key=lambda r: (r[6], r[5], r[2])):
        middle = (r[6] + r[8]) / 2
        k = next((i for i, (a, z) in enumerate(lines) if abs((a + z) / 2 - middle) <= tolerance), len(lines))
        if k == len(lines):
            lines.append((r[6], r[8]))
        lines[k] = min(lines[k][0], r[6]), max(lines[k][1], r[8])
        out[r[2]] = k
    return out


@pytest.mark.parametrize("tolerance", [0.5, 8.0, 60.0])
def test_lines(spark, tolerance):
    rows = boxes(1500, 3)
    rows += [(1, 3, 5000 + i, "up", 0.1, float(i), 50.0 + i % 3, float(i), 20.0 - i) for i in range(40)]  # boxes that end above their beginning
    got = {(r.page, r.token_ix): r for r in tokens.cluster_lines(spark.createDataFrame(rows, TOKEN), tolerance).collect()}
    for page in (1, 2, 3):
        mine = [r for r in rows if r[1] == page]
        assert {ix: got[page, ix].line for ix in (r[2] for r in mine)} == plain_lines(mine, tolerance)
    assert all(tuple(got[r[1], r[2]])[:-1] == r for r in rows)


def test_lines_run_in_the_jvm(spark):
    plan = tokens.cluster_lines(spark.createDataFrame(boxes(5), TOKEN))._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan


@pytest.mark.parametrize("least", [0.5, 0.1, 0.9])
def test_overlaps(spark, least):
    a, b = boxes(300, 4), [(u, p, i, t, c, x0 + 0.4, y0 - 0.3, x1 + 0.4, y1 + 0.5) for u, p, i, t, c, x0, y0, x1, y1 in boxes(300, 4)] + [(1, p, 1000 + i, t, c, x0, y0, x1, y1) for u, p, i, t, c, x0, y0, x1, y1 in boxes(300, 5)]
    got = ensemble.best_matches(spark.createDataFrame(a, TOKEN), spark.createDataFrame(b, TOKEN), least).collect()

    def iou(r, s):
        w, h = min(r[7], s[7]) - max(r[5], s[5]), min(r[8], s[8]) - max(r[6], s[6])
        inner = w * h if w > 0 and h > 0 else 0.0
        union = (r[7] - r[5]) * (r[8] - r[6]) + (s[7] - s[5]) * (s[8] - s[6]) - inner
        return inner / union if union > 0 else 0.0

    want = {}
    for r in a:
        best = min(((-iou(r, s), s[2]) for s in b if s[1] == r[1]), default=None)
        if best and -best[0] > least:
            want[r[1], r[2]] = best[1]
    assert {(r.page, r.t_token_ix): r.c_token_ix for r in got} == want and len(want) > 50


def test_a_page_of_many_tokens_meets_its_neighbours_only(spark):
    """200,000 tokens of one page, matched with themselves: rows per token, not their square."""
    side = 450
    rows = spark.range(200_000).selectExpr("1L as upload_id", "1 as page", "cast(id as int) as token_ix", "'t' as text", "0.5D as confidence", f"(id % {side}) * 10.0D as x0", f"(id div {side}) * 10.0D as y0", f"(id % {side}) * 10.0D + 8 as x1", f"(id div {side}) * 10.0D + 8 as y1")
    t, c = ensemble._in_cells(ensemble._named(rows, "t_"), "t_", 0), ensemble._in_cells(ensemble._named(rows, "c_"), "c_", 1)
    assert t.join(c, ["upload_id", "page", "k", "x", "y"]).count() < 60 * 200_000
    m = ensemble.best_matches(rows, rows)
    assert m.count() == 200_000 and m.where("t_token_ix <> c_token_ix").isEmpty()


def test_bands_hold_all_neighbours(spark):
    rows = boxes(400, 6, wide=200)
    df = spark.createDataFrame(rows, TOKEN)
    labels = df.where("token_ix % 7 = 0")
    for side in ("right", "below"):
        got = {(r.page, r.l_token_ix): r.token_ix for r in spatial.nearest_block(df, labels, side).collect()}
        want = {}
        for r in rows:
            if r[2] % 7 == 0:
                if side == "right":
                    near = [(s[5] - r[7], s[2]) for s in rows if s[1] == r[1] and s[2] != r[2] and abs(s[6] - r[6]) < 10 and s[5] > r[7] + 5]
                else:
                    near = [(s[6] - r[8], s[2]) for s in rows if s[1] == r[1] and s[2] != r[2] and s[6] > r[8] and abs(s[5] - r[5]) < 50]
                if near:
                    want[r[1], r[2]] = min(near)[1]
        assert got == want


def test_consume_nine_fields_by_one_exchange(spark):
    rnd = random.Random(2)
    fields = tuple(f"f{i}" for i in range(9))
    rows = [(u, 1, f, t, rnd.choice([0.1, 0.5, 0.9])) for u in range(20) for f in (*fields, "unasked") for t in range(6) if rnd.random() < 0.6]
    df = spark.createDataFrame(rows, "upload_id long, page int, field string, token_ix int, score double")
    got = spatial.consume(df, fields)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = set()
    for u in range(20):
        taken = set()
        for f in fields:
            left = [(-s, t) for v, _, g, t, s in rows if v == u and g == f and t not in taken]
            if left:
                s, t = min(left)
                taken.add(t)
                want.add((u, 1, f, t, -s))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_records_of_tokens_by_one_exchange(spark):
    said = [("Account Number", 10, 10), ("No 123", 150, 10), ("Opening Balance", 10, 50), ("77.00", 10, 80), ("total", 10, 120), ("5", 150, 120)]
    rows = [(u, 1, i, t, 0.9, float(x), float(y), x + 100.0, y + 20.0) for u in range(3) for i, (t, x, y) in enumerate(said)] + [(9, 1, 0, "nothing", 0.9, 0.0, 0.0, 1.0, 1.0)]
    r = spatial.bank_record(spark.createDataFrame(rows, TOKEN))
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {x.upload_id: x for x in r.collect()}
    assert got[1].account_number == "123" and got[1].opening_balance == "77.00" and got[1].total_debit is None
    assert got[9].account_number is None and got[9].opening_balance == "0.00"


def test_relative_tolerance(spark):
    assert tokens.relative_tolerance(2.5) == 25.0 and tokens.relative_tolerance(1.0, 200.0) == 2.0
    lined = tokens.cluster_lines(spark.createDataFrame(boxes(60, 9), TOKEN), tokens.relative_tolerance(1.0, 400.0))
    assert lined.select(F.countDistinct("line")).first()[0] > 1
