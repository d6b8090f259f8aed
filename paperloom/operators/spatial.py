"""Searching a page's layout: labels, and the values to their right or below them.

Searches join tokens with labels on (upload_id, page), so candidates are the tokens of one page;
every choice has token_ix as its last tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import rules
from paperloom.functions.numbers import clean_currency, parse_number
from paperloom.functions.text import contains_any
from paperloom.operators.tokens import NUMERIC_RUN, PAGE, cluster_lines, merge_runs

_PERCENT = r"(?i)%|peratus|percentage|pct|percent"


def percentage_context(text: Column, label: Column) -> Column:
    return text.rlike(_PERCENT) | label.rlike(_PERCENT)


def is_numeric(text: Column) -> Column:
    return parse_number(text).isNotNull()


def candidate_score(confidence: Column, gap: Column, relation: str) -> Column:
    """Recognition, being numeric, nearness and relation, weighted."""
    w = rules.SCORE_WEIGHTS
    near = F.greatest(F.lit(0.0), 1.0 - gap / F.lit(rules.SCORE_REACH))
    return w[0] * confidence + w[1] * F.lit(1.0) + w[2] * near + w[3] * F.lit(rules.RELATION[relation])


def find_labels(tokens: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Per page the first token that contains a word, else the first that contains a word's first part."""
    low = F.lower("text")
    whole = contains_any(low, [w.lower() for w in words])
    part = contains_any(low, [w.lower().split()[0] for w in words if " " in w])
    found = tokens.where(whole | part).withColumn("__pass", F.when(whole, 1).otherwise(2))
    pick = F.row_number().over(Window.partitionBy(*PAGE).orderBy("__pass", "token_ix"))
    return found.withColumn("__n", pick).where("__n = 1").drop("__n", "__pass")


def _pairs(tokens: DataFrame, labels: DataFrame, *keys: str, band: tuple[str, str, float, tuple[int, ...]] | None = None) -> DataFrame:
    """Tokens beside the labels (l_*) of their page that agree in ``keys``.

    ``band`` = (token's column, label's column, width, steps) keeps to tokens whose column is in one of the
    bands of that width at ``steps`` from the label's own, so a page's pairs are not its square.
    """
    named = labels.select(*PAGE, *[F.col(c).alias(f"l_{c}") for c in ("token_ix", "text", "x0", "y0", "x1", "y1", *(["line"] if "line" in labels.columns else []))])
    on = [*PAGE]
    for k in keys:
        named, on = named.withColumn(k, F.col(f"l_{k}")), [*on, k]
    if band is not None:
        column, other, width, steps = band
        tokens = tokens.withColumn("__band", F.floor(F.col(column) / width))
        named = named.withColumn("__band", F.explode(F.array(*[F.floor(F.col(f"l_{other}") / width) + s for s in steps])))
        on.append("__band")
    return tokens.join(named, on).where(F.col("token_ix") != F.col("l_token_ix")).drop("__band")


def _best(found: DataFrame, *order: Column) -> DataFrame:
    pick = F.row_number().over(Window.partitionBy(*PAGE, "l_token_ix").orderBy(*order, F.col("token_ix")))
    return found.withColumn("__n", pick).where("__n = 1").drop("__n")


def _unwanted(exclude: tuple[str, ...]) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", "l_text", "text")), exclude) | percentage_context(F.col("text"), F.col("l_text"))


def right_values(tokens: DataFrame, labels: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Per label the best-scored number to its right on its line (line must be in both tables)."""
    p = _pairs(tokens, labels, "line").where((F.col("x0") > F.col("l_x1")) & is_numeric(F.col("text")) & ~_unwanted(exclude))
    p = p.withColumn("gap", F.col("x0") - F.col("l_x1"))
    p = _best(p.withColumn("score", candidate_score(F.col("confidence"), F.col("gap"), "right")), F.desc("score"))
    return p.where(F.col("score") >= rules.SCORE_LEAST)


def below_values(tokens: DataFrame, labels: DataFrame, exclude: tuple[str, ...] = (), reach: float = rules.BELOW_REACH) -> DataFrame:
    """Per label the best-scored number below it on the page, within ``reach``."""
    p = _pairs(tokens, labels, band=("y0", "y1", reach, (0, 1))).withColumn("gap", F.col("y0") - F.col("l_y1"))
    p = p.where((F.col("gap") > 0) & (F.col("gap") <= reach) & is_numeric(F.col("text")) & ~_unwanted(exclude))
    p = _best(p.withColumn("score", candidate_score(F.col("confidence"), F.col("gap"), "below")), F.desc("score"))
    return p.where(F.col("score") >= rules.SCORE_LEAST)


def right_texts(tokens: DataFrame, labels: DataFrame, need_digit: bool = False) -> DataFrame:
    """Per label the nearest token to its right on its line that is no number."""
    p = _pairs(tokens, labels, "line").where((F.col("x0") > F.col("l_x1")) & ~F.col("text").rlike(NUMERIC_RUN))
    p = p.where(F.col("text").rlike(r"\d")) if need_digit else p
    return _best(p.withColumn("gap", F.col("x0") - F.col("l_x1")), F.col("gap"))


def field_values(tokens: DataFrame, words: tuple[str, ...], numeric: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(upload_id, page, label, value): to the label's right, else (numbers only) below it.

    The label is found by a window over its page and the values by one grouping of it, so tokens are brought
    together once.
    """
    low = F.lower("text")
    rank = F.when(contains_any(low, [w.lower() for w in words]), 1).when(contains_any(low, [w.lower().split()[0] for w in words if " " in w]), 2)
    label = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "token_ix", "text", "line", "x1", "y1"))).over(Window.partitionBy(*PAGE))
    met = tokens.withColumn("__l", label).where(F.col("__l").isNotNull() & F.col("upload_id").isNotNull() & F.col("page").isNotNull())
    met = met.select("*", *[F.col(f"__l.{c}").alias(f"l_{c}") for c in ("token_ix", "text", "line", "x1", "y1")])
    other, across, down = F.col("token_ix") != F.col("l_token_ix"), F.col("x0") - F.col("l_x1"), F.col("y0") - F.col("l_y1")
    right = other & (F.col("line") == F.col("l_line")) & (F.col("x0") > F.col("l_x1"))

    def scored(where: Column, gap: Column, relation: str) -> Column:
        score = candidate_score(F.col("confidence"), gap, relation)
        good = where & is_numeric(F.col("text")) & ~_unwanted(exclude) & (score >= rules.SCORE_LEAST)
        return F.max(F.when(good, F.struct(score.alias("score"), (-F.col("token_ix")).alias("order"), "text")))["text"]

    if numeric:
        value = F.coalesce(scored(right, across, "right"), scored(other & (down > 0) & (down <= rules.BELOW_REACH), down, "below"))
    else:
        value = F.min(F.when(right & ~F.col("text").rlike(NUMERIC_RUN), F.struct(across.alias("gap"), "token_ix", "text")))["text"]
    return met.groupBy(*PAGE).agg(F.first("l_text").alias("label"), value.alias("value")).where(F.col("value").isNotNull())


def consume(candidates: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Candidates (upload_id, page, field, token_ix, score): each token serves one field, in the order of ``fields``.

    A field takes its best token among those that earlier ones left: a fold over a page's candidates by
    (field, score), which knows the tokens that are taken and the field that is served.
    """
    own = candidates.columns
    order = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    rows = candidates.where(F.col("field").isin(*fields)).select(*PAGE, F.struct(order.alias("order"), (-F.col("score")).alias("score"), "token_ix", F.struct(*own).alias("own")).alias("c"))
    page = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list("c")).alias("c"))
    token = candidates.schema["token_ix"].dataType.simpleString()
    state = F.struct(F.lit(0).cast("long").alias("served"), F.expr(f"cast(array() as array<{token}>)").alias("taken"), F.slice("c", F.lit(1), F.lit(0)).alias("chosen"))

    def step(acc: Column, c: Column) -> Column:
        take = F.struct(c["order"].cast("long").alias("served"), F.concat(acc["taken"], F.array(c["token_ix"])).alias("taken"), F.concat(acc["chosen"], F.array(c)).alias("chosen"))
        return F.when((c["order"] == acc["served"]) | F.array_contains(acc["taken"], c["token_ix"]), acc).otherwise(take)

    chosen = F.aggregate("c", state, step, lambda acc: F.transform(acc["chosen"], lambda c: c["own"]))
    return page.select(F.inline(chosen)).select(*own)


def nearest_block(blocks: DataFrame, labels: DataFrame, side: str, tolerance_y: float = 10.0, tolerance_x: float = 5.0, reach_x: float = 50.0) -> DataFrame:
    """Per label the nearest text block right of it (tops within tolerance) or below it (lefts within reach)."""
    if side == "right":
        p = _pairs(blocks, labels, band=("y0", "y0", tolerance_y, (-1, 0, 1)))
        p = p.where((F.abs(F.col("y0") - F.col("l_y0")) < tolerance_y) & (F.col("x0") > F.col("l_x1") + tolerance_x)).withColumn("gap", F.col("x0") - F.col("l_x1"))
    else:
        p = _pairs(blocks, labels, band=("x0", "x0", reach_x, (-1, 0, 1)))
        p = p.where((F.col("y0") > F.col("l_y1")) & (F.abs(F.col("x0") - F.col("l_x0")) < reach_x)).withColumn("gap", F.col("y0") - F.col("l_y1"))
    value = F.trim(F.regexp_replace(F.trim("text"), r"^:+", ""))
    return _best(p, F.col("gap")).withColumn("text", value)


#: Fields of a bank record that are numbers, and those of money.
NUMERIC_FIELDS = ("opening_balance", "closing_balance")
MONEY_FIELDS = ("opening_balance", "closing_balance", "total_debit", "total_credit")


def bank_record(tokens: DataFrame, fields: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = rules.LAYOUT_FIELDS) -> DataFrame:
    """(upload_id, page, one column per field): each field's value near its label, null where there is none.

    ``fields`` has the words of a field's label and those that must not stand near.  Opening and
    closing balance are numbers right of their label or below it, other fields texts to its right.
    Lines are told once and all fields' labels found by one window, so a page's tokens are brought
    together once and everything after stays in place.
    """
    lined = cluster_lines(merge_runs(tokens).select(*PAGE, "token_ix", "text", "confidence", "x0", "y0", "x1", "y1"))
    low, page = F.lower("text"), Window.partitionBy(*PAGE)
    labels = []
    for name, (words, _) in fields.items():
        rank = F.when(contains_any(low, [w.lower() for w in words]), 1).when(contains_any(low, [w.lower().split()[0] for w in words if " " in w]), 2)
        first = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "token_ix", "text", "line", "x1", "y1"))).over(page)
        labels.append(F.struct(F.lit(name).alias("field"), first.alias("l")))
    met = lined.withColumn("__l", F.array(*labels)).withColumn("__l", F.explode_outer(F.filter("__l", lambda x: x["l"].isNotNull())))
    met = met.select("*", F.col("__l.field").alias("field"), *[F.col(f"__l.l.{c}").alias(f"l_{c}") for c in ("token_ix", "text", "line", "x1", "y1")])

    near = F.lower(F.concat_ws(" ", "l_text", "text"))
    unwanted = percentage_context(F.col("text"), F.col("l_text"))
    for name, (_, exclude) in fields.items():
        unwanted = unwanted | ((F.col("field") == name) & contains_any(near, exclude))
    number = F.col("field").isin(*NUMERIC_FIELDS) & is_numeric(F.col("text")) & ~unwanted
    other = F.col("token_ix") != F.col("l_token_ix")
    right = other & (F.col("line") == F.col("l_line")) & (F.col("x0") > F.col("l_x1"))
    across, down = F.col("x0") - F.col("l_x1"), F.col("y0") - F.col("l_y1")

    def best(where: Column, order: Column) -> Column:
        return F.min(F.when(where, F.struct(order.alias("order"), "token_ix", "text")))["text"]

    def scored(where: Column, gap: Column, relation: str) -> Column:
        score = candidate_score(F.col("confidence"), gap, relation)
        return best(where & number & (score >= rules.SCORE_LEAST), -score)

    text = best(right & ~F.col("field").isin(*NUMERIC_FIELDS) & ~F.col("text").rlike(NUMERIC_RUN), across)
    below = scored(other & (down > 0) & (down <= rules.BELOW_REACH), down, "below")
    found = met.groupBy(*PAGE, "field").agg(F.coalesce(scored(right, across, "right"), below, text).alias("value"))
    out = found.groupBy(*PAGE).agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in fields])
    money = {n: clean_currency(F.col(n)) if n in NUMERIC_FIELDS else F.when(F.col(n).isNotNull(), clean_currency(F.col(n))) for n in MONEY_FIELDS if n in fields}
    return out.withColumns(money | {"account_number": F.trim(F.regexp_replace("account_number", r"^(NO|No|no)\s+", ""))})
