"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage
returns as Parquet to the shared folder and reads it again as the next stage's docs.  All but the
last stage return the columns of documents.  Null ids, texts and sources are handled as the
operators define it; an empty table passes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import mixing, pieces, simhash, substring, toxicity
from paperloom.llm.shared import delete, fresh_dir, join_small, saved, workspace


def _through(docs: DataFrame, new: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` over ``docs``, whose own columns that are named like one of ``new`` stand aside meanwhile."""
    aside = {c: f"__own_{c}" if c in new else c for c in docs.columns}
    out = stage(docs.select(*[F.col(c).alias(a) for c, a in aside.items()]))
    return out.select(*[F.col(a).alias(c) for c, a in aside.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labels, doesn't score as toxic.

    Rows are judged each by their text alone: repeated rows stay or go together, a score of exactly 0.5 goes.
    """
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _through(docs, ("score", "predicted"), lambda d: toxicity.score(d, machine).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near duplicates; of equal ids the least text's hash, of repeated rows one."""
    return simhash.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeat an earlier passage; those that have no other words go.

    Texts that lose words are the words left, joined by single spaces; other texts stay as they are.
    """

    def stage(rows: DataFrame) -> DataFrame:
        tagged = rows.withColumns({"__t": F.xxhash64("text"), "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
        short = [c for c in tagged.columns if c not in ("text", "n_chars")]
        out = substring.remove_repeats(tagged, keep=tuple(short)).where("n_removed > 0")
        changed = saved(out.select(*short, F.col("kept").alias("text")), "repeats")
        same = join_small(tagged, changed.select("__id", "__t").distinct(), ["__id", "__t"], "left_anti")
        fresh = changed.where("text <> ''").withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType))
        return same.select(*rows.columns).unionByName(fresh.select(*rows.columns))

    return _through(docs, ("n_words", "n_removed", "words_sha256", "kept"), stage)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _through(docs, ("size", "source_size", "target", "copies", "copy"), mixing.mix)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids), with merge-dropout that cuts a document's copies apart.

    Rows of one id and text are copies, numbered in the order of their other columns; rows that are equal in
    all of them are interchangeable, so a rerun gives the same rows.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source")
    numbered = docs.select("doc_id", "lang", "source", "text").withColumn("copy", F.row_number().over(copies) - 1)
    out = pieces.encode(numbered, model, keep=("doc_id", "lang", "source"), copy="copy")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeats),
    ("mix_sources", mix_sources),
    ("pieces", encode_pieces),
]

#: Learned scores, fingerprints and tokens can't be expressed in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote is deleted once the next has read it, what it needed meanwhile at its end."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        with workspace(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
