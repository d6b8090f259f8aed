"""Positioned tokens: normalising, merging runs, lines and reading order.

Tokens are rows (upload_id, page, token_ix, text, confidence, x0, y0, x1, y1); token_ix is the
order in which the recogniser gave them and decides every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import rules
from paperloom.functions.text import let

PAGE = ("upload_id", "page")
NUMERIC_RUN = r"^[\d,.\s\-]+$"


def corners(polygon: Column) -> Column:
    """struct(x0, y0, x1, y1) of a polygon of points; zeros where it has no four points."""
    x = F.transform(polygon, lambda p: F.try_element_at(p, F.lit(1)))
    y = F.transform(polygon, lambda p: F.try_element_at(p, F.lit(2)))
    whole = F.coalesce(F.size(polygon) == 4, F.lit(False))
    side = lambda c: F.when(whole, c).otherwise(0.0)
    return F.struct(side(F.array_min(x)).alias("x0"), side(F.array_min(y)).alias("y0"), side(F.array_max(x)).alias("x1"), side(F.array_max(y)).alias("y1"))


def from_recognised(items: DataFrame) -> DataFrame:
    """Recogniser output (upload_id, page, token_ix, text, confidence in percent, polygon) as tokens; blank ones go."""
    rows = items.where(F.trim("text") != "").withColumn("__b", corners(F.col("polygon")))
    return rows.select("upload_id", "page", "token_ix", "text", (F.col("confidence") / 100.0).alias("confidence"), "__b.*")


def low_confidence(least: float = rules.LOW_CONFIDENCE) -> Column:
    return F.coalesce(F.col("confidence"), F.lit(1.0)) < least


def center_y() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def merge_runs(tokens: DataFrame, gap: float = rules.RUN_GAP, tolerance: float = rules.RUN_TOLERANCE) -> DataFrame:
    """Neighbouring numeric tokens on a line become one: texts joined, boxes united, confidences averaged."""
    w = Window.partitionBy(*PAGE).orderBy("token_ix")
    goes_on = (
        F.col("text").rlike(NUMERIC_RUN)
        & F.lag("text").over(w).rlike(NUMERIC_RUN)
        & (F.col("x0") - F.lag("x1").over(w) <= gap)
        & (F.abs(center_y() - F.lag(center_y()).over(w)) <= tolerance)
    )
    marked = tokens.withColumn("__new", F.when(goes_on, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("token_ix", "text"))), lambda t: t["text"])
    return runs.groupBy(*PAGE, "run").agg(
        F.min("token_ix").alias("token_ix"),
        F.array_join(in_order, "").alias("text"),
        F.avg("confidence").alias("confidence"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count("*").alias("merged_from"),
    ).drop("run")


def page_text(tokens: DataFrame, step: float = rules.LINE_STEP) -> DataFrame:
    """(upload_id, page, text): tokens by (y0, x0); a new line where y0 is ``step`` or more from the token before."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "token_ix")
    breaks = F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(w)) >= step, F.lit(True)).cast("int")
    lines = tokens.withColumn("__new", breaks).withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    words = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "token_ix", "text"))), lambda t: t["text"])
    by_line = lines.groupBy(*PAGE, "line").agg(F.array_join(words, " ").alias("text"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda t: t["text"])
    return by_line.groupBy(*PAGE).agg(F.array_join(joined, "\n").alias("text"))


#: Tokens whose lines are kept in one array while a page is folded; longer pages have an array of arrays.
_CHUNK = 512


def cluster_lines(tokens: DataFrame, tolerance: float = rules.LINE_TOLERANCE) -> DataFrame:
    """``tokens`` with line: tokens by (y0, x0) join the first line whose current centre is within ``tolerance``.

    A line's box, and so its centre, grows with each token, which no window frame can express, so a page
    is one ordered array that is folded over.  The state holds the lines that later tokens can still
    join (they start no higher than this one), and the lines given out so far.
    """
    own = tokens.columns
    by = [c for c in own if c in PAGE]
    rest = [c for c in own if c not in PAGE]
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "token_ix", F.struct(*rest).alias("own"))))
    page = tokens.groupBy(*by).agg(ordered.alias("t"), F.greatest(F.max((F.col("y0") - F.col("y1")) / 2), F.lit(0.0)).alias("inverted"))
    box = lambda line, low, high: F.struct(line.alias("line"), low.alias("low"), high.alias("high"))
    state = F.struct(
        F.lit(0).alias("n"), F.expr("cast(array() as array<struct<line:int,low:double,high:double>>)").alias("open"),
        F.expr("cast(array() as array<int>)").alias("chunk"), F.expr("cast(array() as array<array<int>>)").alias("done"),
    )

    def step(acc: Column, t: Column) -> Column:
        low, high = t["own"]["y0"].cast("double"), t["own"]["y1"].cast("double")
        middle = (low + high) / 2
        near = F.filter(acc["open"], lambda o: F.abs((o["low"] + o["high"]) / 2 - middle) <= tolerance)
        full = F.size(acc["chunk"]) >= _CHUNK

        def joined(k: Column) -> Column:
            grown = F.transform(acc["open"], lambda o: F.when(o["line"] == k, box(k, F.least(o["low"], low), F.greatest(o["high"], high))).otherwise(o))
            lines = F.when(k == acc["n"], F.concat(acc["open"], F.array(box(k, low, high)))).otherwise(grown)
            return F.struct(
                (acc["n"] + (k == acc["n"]).cast("int")).alias("n"),
                F.filter(lines, lambda o: (o["low"] + o["high"]) / 2 >= low - F.lit(tolerance) - F.col("inverted")).alias("open"),
                F.when(full, F.array(k)).otherwise(F.concat(acc["chunk"], F.array(k))).alias("chunk"),
                F.when(full, F.concat(acc["done"], F.array(acc["chunk"]))).otherwise(acc["done"]).alias("done"),
            )

        return let(F.coalesce(F.get(near, F.lit(0))["line"], acc["n"]), joined)

    lines = F.aggregate("t", state, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["chunk"]))))
    each = page.select(*by, "t", lines.alias("line")).select(*by, F.inline(F.arrays_zip("t", "line")))
    return each.select(*[F.col(c) if c in PAGE else F.col(f"t.own.{c}").alias(c) for c in own], "line")


def reading_order(lined: DataFrame) -> DataFrame:
    """``lined`` tokens with place, their order by (top of line, line, x0)."""
    top = F.min("y0").over(Window.partitionBy(*PAGE, "line"))
    return lined.withColumn("__top", top).withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("__top", "line", "x0", "token_ix"))).drop("__top")


def relative_tolerance(percent: float, page_height: float = 1000.0) -> float:
    return percent / 100.0 * page_height
