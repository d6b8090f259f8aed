"""Sinks and their readers: results as nested JSON, raw uploads, page texts and tokens.

Rows are kept in a fixed number of folders by a hash of the upload's id, so the number of files
doesn't grow with that of uploads, and looking one up reads one folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256


def _bucket(upload_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(upload_id.cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int, kind: str) -> None:
    df = rows.withColumn("bucket", _bucket(F.col("upload_id"), buckets))
    df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").format(kind).save(path)


def write_results(results: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """One JSON object per upload; a rerun replaces them."""
    _write(results, path, buckets, "json")


def read_result(spark: SparkSession, path: str, upload_id, schema: StructType | str, buckets: int = BUCKETS) -> DataFrame:
    """The result of one upload; ``schema`` is that of the table that was written."""
    schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    rows = spark.read.schema(StructType([*schema, *spark.createDataFrame([], "bucket int").schema])).json(path)
    return rows.where((F.col("bucket") == _bucket(F.lit(upload_id), buckets)) & (F.col("upload_id") == F.lit(upload_id))).drop("bucket")


def read_results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All results."""
    return spark.read.schema(schema).json(path).select(*schema.names)


def keep_uploads(uploads: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Raw bytes of accepted uploads (upload_id, content), named ``<id>.pdf``."""
    kept = uploads.where("accepted").select("upload_id", F.concat(F.col("upload_id"), F.lit(".pdf")).alias("name"), "content")
    _write(kept, path, buckets, "parquet")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(upload_id, name, content) of the uploads that were kept."""
    return spark.read.schema("upload_id string, name string, content binary").parquet(path).select("upload_id", "name", "content")


def keep_page_texts(pages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Page texts (upload_id, document_number, text), named as pages are: ``extracted_text_page_<n>.txt``."""
    name = F.concat(F.lit("extracted_text_page_"), F.col("document_number").cast("string"), F.lit(".txt"))
    _write(pages.select("upload_id", name.alias("name"), "text"), path, buckets, "json")


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(upload_id, name, text) of the page texts that were kept."""
    return spark.read.schema("upload_id string, name string, text string").json(path).select("upload_id", "name", "text")


def keep_tokens(tokens: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Positioned tokens, one JSON object each."""
    _write(tokens, path, buckets, "json")


def read_tokens(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The tokens that were kept; ``schema`` is theirs."""
    return spark.read.schema(schema).json(path).select(*schema.names)
