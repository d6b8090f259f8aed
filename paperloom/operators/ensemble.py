"""Reconciling several recognisers' tokens: overlap matching, retries and votes.

Tokens are brought together once, by page and tile, and matched there; each recogniser's tokens are read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import rules
from paperloom.operators.tokens import PAGE, low_confidence


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes over their union; a and b are column name prefixes; 0 for empty unions."""
    c = lambda p, k: F.col(f"{p}{k}")
    w = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    h = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    inner = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    area = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "y1") - c(p, "y0"))
    union = area(a) + area(b) - inner
    return F.when(union > 0, inner / union).otherwise(0.0)


def _named(tokens: DataFrame, prefix: str) -> DataFrame:
    return tokens.select(*PAGE, *[F.col(c).alias(f"{prefix}{c}") for c in tokens.columns if c not in PAGE])


def _size_class(p: str) -> Column:
    """The least k such that a box is at most 2**k wide and high."""
    return F.ceil(F.log2(F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0")))).cast("int")


def _cells(p: str, reach: int) -> Column:
    """The grid cells (k, x, y), of size 2**k, that a box touches; k is within ``reach`` of the box's class."""
    cells = lambda k, a, z: F.sequence(F.floor(F.col(f"{p}{a}") / F.pow(F.lit(2.0), k)), F.floor(F.col(f"{p}{z}") / F.pow(F.lit(2.0), k)))
    of = lambda k: F.flatten(F.transform(cells(k, "x0", "x1"), lambda x: F.transform(cells(k, "y0", "y1"), lambda y: F.struct(k.alias("k"), x.alias("x"), y.alias("y")))))
    own = _size_class(p)
    return F.flatten(F.transform(F.sequence(own - reach, own + reach), of))


def _solid(boxes: DataFrame, p: str) -> DataFrame:
    return boxes.where((F.col(f"{p}x1") > F.col(f"{p}x0")) & (F.col(f"{p}y1") > F.col(f"{p}y0")))


def _in_cells(boxes: DataFrame, p: str, reach: int) -> DataFrame:
    """``boxes`` once for each of their ``_cells``: at most four of the box's own class, and nine of the one below."""
    return _solid(boxes, p).select("*", F.inline(_cells(p, reach)))


#: A tile is where a target's upper left corner lies: its group of three size classes, and a square of the page
#: whose side is four to sixteen times that of its boxes.
_TILE = ("tg", "tx", "ty")


def _group(k: Column) -> Column:
    return (F.floor(k / 3) * 3).cast("int")


def _tile_at(group: Column, c: Column) -> Column:
    """The tile's number along one side; tiles are centred on 0, so that pages don't begin on a border."""
    return F.floor(c / F.pow(F.lit(2.0), group + 4) + 0.5)


def _reached(g: Column, a: str, least: float) -> Column:
    """The tiles along one side that a match's corner can lie in: from (1 / least - 1) sides before the box's own to (1 - least) after it."""
    low = F.col(f"c_{a}0")
    side = F.col(f"c_{a}1") - low
    return F.sequence(_tile_at(g, low - side * (1 / least - 0.999)), _tile_at(g, low + side * (1.001 - least)))


def _tiled(candidates: DataFrame, least: float) -> DataFrame:
    """Candidates (c_*), once for each tile that a match's corner can lie in."""
    reach = max(math.ceil(-math.log2(least)), 0)
    groups = F.array_distinct(F.transform(F.sequence(_size_class("c_") - reach, _size_class("c_") + reach), _group))
    tiles = lambda g: F.flatten(F.transform(_reached(g, "x", least), lambda x: F.transform(_reached(g, "y", least), lambda y: F.struct(g.alias("tg"), x.alias("tx"), y.alias("ty")))))
    return _solid(_named(candidates, "c_"), "c_").select("*", F.inline(F.flatten(F.transform(groups, tiles))))


def _best_in_tiles(targets: DataFrame, candidates: DataFrame, least: float, by: tuple[str, ...], parts: int | None) -> DataFrame:
    """``best_matches`` with the target's tile; rows of a page and tile are in one partition, so what is grouped by these stays there."""
    if least <= 0:
        raise ValueError("least is over 0")
    t = _solid(_named(targets, "t_"), "t_").withColumn("tg", _group(_size_class("t_")))
    t = t.withColumns({f"t{a}": _tile_at(F.col("tg"), F.col(f"t_{a}0")) for a in ("x", "y")})
    c = _tiled(candidates, least)
    tile = [*PAGE, *_TILE]
    if parts is not None:
        t, c = t.repartition(parts, *tile), c.repartition(parts, *tile)
    pairs = t.join(c, tile).withColumn("iou", iou("t_", "c_")).where(F.col("iou") > least)
    pick = F.row_number().over(Window.partitionBy(*tile, "t_token_ix", *by).orderBy(F.desc("iou"), "c_token_ix"))
    return pairs.withColumn("__n", pick).where("__n = 1").drop("__n")


def best_matches(targets: DataFrame, candidates: DataFrame, least: float = rules.MATCH_IOU, by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Each target (t_*) with its best-overlapping candidate (c_*) above ``least`` (over 0); the first of equals; per ``by`` columns.

    Boxes that overlap by more than ``least`` of their union have sizes within that factor and corners near each
    other: a target goes to the tile of its corner, a candidate to the tiles that a match's corner can lie in, mostly
    one.  All of a target's candidates are then in one place, in ``parts`` partitions (by default the session's
    number), and a page's pairs are those of a tile, not its square.
    """
    return _best_in_tiles(targets, candidates, least, by, parts).drop(*_TILE)


def retry(primary: DataFrame, engines: list[DataFrame], least: float = rules.LOW_CONFIDENCE, parts: int | None = None) -> DataFrame:
    """Low-confidence tokens take a better match, engine by engine; a replaced token is not tried again.

    Returns ``primary`` with engine_used, the number of the engine that replaced it (0: none).  A token keeps its
    box until it is replaced, so all engines are matched at once and the first that is better counts.
    """
    new = ("text", "confidence", "x0", "y0", "x1", "y1")
    if not engines:
        return primary.withColumn("engine_used", F.lit(0))
    every = None
    for k, engine in enumerate(engines, 1):
        one = engine.select(*PAGE, "token_ix", *new, F.lit(k).alias("engine_ix"))
        every = one if every is None else every.unionByName(one)
    weak = primary.where(low_confidence(least)).select(*PAGE, "token_ix", "confidence", "x0", "y0", "x1", "y1")
    m = _best_in_tiles(weak, every, rules.MATCH_IOU, ("c_engine_ix",), parts).where(F.coalesce("c_confidence", F.lit(0.0)) > F.coalesce("t_confidence", F.lit(1.0)))
    first = F.min_by(F.struct(*[F.col(f"c_{c}").alias(c) for c in new], F.col("c_engine_ix").alias("engine_ix")), "c_engine_ix")
    m = m.groupBy(*PAGE, *_TILE, "t_token_ix").agg(first.alias("__m")).select(*PAGE, F.col("t_token_ix").alias("token_ix"), "__m")
    met, hit = primary.join(m, [*PAGE, "token_ix"], "left"), F.col("__m").isNotNull()
    out = met.withColumns({c: F.when(hit, F.col(f"__m.{c}")).otherwise(F.col(c)) for c in new} | {"engine_used": F.when(hit, F.col("__m.engine_ix")).otherwise(F.lit(0))})
    return out.select(*primary.columns, "engine_used")


def vote(primary: DataFrame, engines: DataFrame, parts: int | None = None) -> DataFrame:
    """Majority text of all engines' best matches for each primary token.

    ``engines`` has engine_ix, 0 being the primary.  Most votes win, then the text met first in
    engine order; confidence is the mean over all matches (0.8 where missing).  Returns
    (upload_id, page, token_ix, text, confidence, vote_count, vote_agreement).
    """
    primary = primary.select(*PAGE, "token_ix", "x0", "y0", "x1", "y1")
    engines = engines.select(*PAGE, "engine_ix", "token_ix", "text", "confidence", "x0", "y0", "x1", "y1")
    m = _best_in_tiles(primary, engines, rules.MATCH_IOU, ("c_engine_ix",), parts).withColumn("vote", F.trim("c_text"))
    key = [*PAGE, *_TILE, "t_token_ix"]
    votes = m.groupBy(*key, "vote").agg(
        F.count("*").alias("n"), F.min("c_engine_ix").alias("first"), F.sum(F.coalesce("c_confidence", F.lit(0.8))).alias("s")
    )
    w = Window.partitionBy(*key)
    pick = F.row_number().over(w.orderBy(F.desc("n"), "first"))
    best = votes.withColumns({"__k": pick, "total": F.sum("n").over(w), "mean": F.sum("s").over(w) / F.sum("n").over(w)}).where("__k = 1")
    return best.select(
        *PAGE, F.col("t_token_ix").alias("token_ix"), F.col("vote").alias("text"), F.col("mean").alias("confidence"),
        F.col("n").alias("vote_count"), (100.0 * F.col("n") / F.col("total")).alias("vote_agreement"),
    )
