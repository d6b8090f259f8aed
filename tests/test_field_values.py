"""Values near labels by one exchange."""

from paperloom.operators import spatial

TOKEN = "upload_id long, page int, token_ix int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, line int"


def test_one_exchange(spark):
    said = [(1, 0, "Total", 0, 0), (1, 1, "5.00", 20, 0), (1, 2, "6.00", 0, 20), (2, 0, "Total", 0, 0), (2, 1, "7.00", 0, 20), (3, 0, "9.00", 0, 0), (4, 0, "Total", 0, 0)]
    rows = [(u, 1, i, t, 0.9, float(x), float(y), x + 10.0, y + 8.0, y // 8) for u, i, t, x, y in said]
    got = spatial.field_values(spark.createDataFrame(rows, TOKEN), ("total",))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.upload_id, r.label, r.value) for r in got.collect()} == {(1, "Total", "5.00"), (2, "Total", "7.00")}
