"""The whole path from page text to result records, their summary, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import classify, rules
from paperloom.functions.text import clean_text
from paperloom.operators import bank, pages, payslip, validate
from paperloom.plans.scratch import checkpointed, fresh

BANK_FIELDS = (*bank.FIELDS, "available_balance")


_TYPED = (
    "upload_id {id}, document_number int, text string, classification_confidence double, bank_detection_confidence double, document_type string, detected_bank string"
)


def typed_pages(page_texts: DataFrame) -> DataFrame:
    """Cleaned pages with type and bank, written in folders by both, so that each kind is read alone."""
    spark = page_texts.sparkSession
    df = page_texts.select("upload_id", F.col("document_number").cast("int").alias("document_number"), clean_text(F.col("text")).alias("text"))
    df = df.withColumns({"__t": classify.document_type(F.col("text")), "__b": classify.issuing_bank(F.col("text"))})
    df = df.select(
        "upload_id", "document_number", "text", F.col("__t.confidence").alias("classification_confidence"), F.col("__b.confidence").alias("bank_detection_confidence"),
        F.col("__t.document_type").alias("document_type"), F.col("__b.bank").alias("detected_bank"),
    )
    path = fresh(spark, "pages")
    df.write.partitionBy("document_type", "detected_bank").parquet(path)
    return spark.read.schema(_TYPED.format(id=df.schema["upload_id"].dataType.simpleString())).parquet(path)


def extract_documents(page_texts: DataFrame) -> DataFrame:
    """(upload_id, document_number, text) -> one row per page with its type, fields, score and verdict.

    Nothing is shuffled.  Each bank's pages meet that bank's patterns in a table of rules (see
    ``ruletable``).  Pages of unknown type have an empty record and the score 0.
    """
    df = typed_pages(page_texts)
    ours = bank.by_bank_record(df.where("document_type = 'bank_statement'"))
    ours = ours.withColumns({"raw_confidence": bank.bank_completeness(ours), "__v": validate.bank_verdict(by_bank=True)})
    theirs = payslip.payslip_record(df.where("document_type = 'payslip'").drop("detected_bank", "bank_detection_confidence"))
    theirs = theirs.withColumns({"raw_confidence": payslip.payslip_completeness(), "__v": validate.payslip_verdict(), "validation_errors": validate.range_errors()})
    rest = df.where("document_type = 'unknown'").drop("detected_bank", "bank_detection_confidence").withColumn("raw_confidence", F.lit(0.0))
    out = ours.unionByName(theirs, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)
    return out.withColumns(
        {
            "confidence_score": F.bround("raw_confidence", 2),
            "text_length": F.length("text"),
            "is_valid": F.col("__v.is_valid"),
            "validation_message": F.col("__v.validation_message"),
        }
    ).drop("__v", "text")


def summarise(documents: DataFrame) -> DataFrame:
    """One row per upload: counts by type, mean confidence over pages, and their whole length."""
    kind = F.col("document_type")
    return documents.groupBy("upload_id").agg(
        F.count("*").alias("total_documents"),
        F.count_if(kind == "payslip").alias("payslips"),
        F.count_if(kind == "bank_statement").alias("bank_statements"),
        F.count_if(~kind.isin("payslip", "bank_statement")).alias("other"),
        F.coalesce(F.avg("raw_confidence"), F.lit(0.0)).alias("raw_average_confidence"),
        F.bround(F.coalesce(F.avg("confidence_score"), F.lit(0.0)), 2).alias("average_confidence"),
        F.sum("text_length").alias("total_text_length"),
    )


def record(names: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def result_records(page_texts: DataFrame) -> DataFrame:
    """One nested result per upload; pages of one account are merged, the summary is over pages before that."""
    documents = checkpointed(extract_documents(page_texts))  # read twice below
    merged = pages.merged_documents(pages.carry_forward(documents))
    names = [c for c in (*BANK_FIELDS, "detected_bank", *payslip.FIELDS, "validation_errors") if c in merged.columns]
    one = F.struct(
        F.col("document_number"), F.coalesce("document_type", F.lit("bank_statement")).alias("document_type"), record(tuple(names)).alias("extracted_data"),
        F.col("confidence_score"), F.col("text_length"), F.coalesce("is_merged", F.lit(False)).alias("is_merged"), F.coalesce("page_count", F.lit(1)).alias("merged_from_pages"),
    )
    lists = merged.groupBy("upload_id").agg(F.array_sort(F.collect_list(one)).alias("documents"))
    return lists.join(summarise(documents), "upload_id").withColumn(
        "summary", F.struct("payslips", "bank_statements", "other", "average_confidence")
    ).select("upload_id", "total_documents", "documents", "summary", "total_text_length", F.current_timestamp().alias("processing_completed_at"))


def lookup(status: DataFrame, wanted: DataFrame) -> DataFrame:
    """Asked-for uploads with the outcome of the lookup: 200, 202 while processing, 400 if failed, 404 if unknown."""
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") == "processing", 202).when(F.col("status") == "failed", 400).otherwise(200)
    return wanted.join(status, "upload_id", "left").withColumn("outcome", code)


def values_text(columns: tuple[str, ...]) -> Column:
    """A record's known values joined by spaces, the text on which language is told."""
    return F.array_join(F.filter(F.array(*[F.col(c).cast("string") for c in columns]), lambda v: v.isNotNull() & (v != "")), " ")
