"""Landing folders of uploads and of page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import file_extension

UPLOADS = "path string, modificationTime timestamp, length long, content binary"
TEXTS = "upload_id string, document_number int, text string"


def uploads(spark: SparkSession, folder: str, extension: str = ".pdf", most_bytes: int = 10 << 20) -> DataFrame:
    """Uploaded files with their id (the file name) and whether they are accepted by extension and size."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    fine = (file_extension(F.col("path")) == extension) & (F.col("length") <= most_bytes)
    return files.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("upload_id"), "path", "length", fine.alias("accepted"), "content")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("upload_id").agg(F.count("*").alias("pages"))


def whole_texts(pages: DataFrame) -> DataFrame:
    """(upload_id, text): the texts of an upload's pages (page from 0), empty ones skipped, joined by blank lines."""
    parts = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("page", "text"))))
    return pages.groupBy("upload_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def split_pages(uploads: DataFrame, texts: str = "texts") -> DataFrame:
    """(upload_id, document_number, text): an upload's list of page texts as pages, numbered from 1; empty lists give none."""
    return uploads.select("upload_id", F.posexplode(texts).alias("__n", "text")).select("upload_id", (F.col("__n") + 1).alias("document_number"), "text")
