"""Mixing sources to target weights, in DataFrame operations only.

Words are summed by source; a water-filling over the short table of sources gives each source's
target and repetition rate; each document is emitted floor(rate) times, plus one Bernoulli copy
with the fraction as its probability, drawn from a hash of seed, document id and text.

Water-filling: a source's target is min(cap * size, level * weight).  With sources sorted by
cap * size / weight, those at their cap come first, so one running sum finds the level at which
the targets add up to the whole; this equals resharing the excess until none is above its cap.

Defined results: a null text counts as no words; null sources form one source, the last; a null
id hashes as an empty one; repeated rows (same id and text) draw alike; a source without words
has target and rate 0; an empty table gives an empty table.  Columns of the input that are named
like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import join_small

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Fixed pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """One row per source: (source, source_size, target, rate).

    The windows run over the table of sources, one row each, not over documents.
    """
    by = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"),
    )
    by = by.withColumn("ordinal", F.row_number().over(named)).withColumn("weight", weight)
    by = by.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), "ordinal")
    by = (
        by.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    below = F.col("most") * F.col("weights") > F.col("left") * F.col("weight")
    by = by.withColumn("level", F.min(F.when(below, F.struct("rank", "left", "weights"))).over(whole))
    target = F.when(
        F.col("level").isNull() | (F.col("rank") < F.col("level.rank")), F.col("most")
    ).otherwise(F.col("level.left") * F.col("weight") / F.col("level.weights"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return by.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_counts(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """``docs`` with size, source_size, target and copies, the times the mix takes each document."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    sized = docs.select(*own, n_words(F.col("text")).alias("size"))
    targets = source_targets(sized.select("source", "size"), "source", "size", weights, share, cap)
    targets = targets.withColumnRenamed("source", "__of").withColumnRenamed("rate", "__rate")
    out = join_small(sized, targets, F.col("source").eqNullSafe(F.col("__of")))
    fraction = F.col("__rate") - F.floor("__rate")
    copies = F.floor("__rate") + F.when(draw(seed, F.col("doc_id"), F.col("text")) < fraction, 1).otherwise(0)
    return out.select(*own, "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as ``mix_counts`` says, numbered by copy from 1."""
    own = [c for c in docs.columns if c != "copy"]
    counted = mix_counts(docs.select(*own), **options).where("copies > 0")
    kept = [c for c in own if c in counted.columns]
    return counted.select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix_counts(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS ordinal FROM s
), w AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(ordinal - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM o
), r AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, ordinal) AS rank,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS "left",
    sum(weight) OVER (ORDER BY most / weight, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w
), k AS (SELECT rank, "left", weights FROM r WHERE most * weights > "left" * weight ORDER BY rank LIMIT 1
), t AS (
  SELECT r.source, r.source_size,
    CASE WHEN k.rank IS NULL OR r.rank < k.rank THEN r.most ELSE k."left" * r.weight / k.weights END AS target
  FROM r LEFT JOIN k ON true
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t
)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (d.size * (floor(rate) + CASE WHEN
    (('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(d.text, '')), 1, 13))::BIGINT)::DOUBLE
      / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
