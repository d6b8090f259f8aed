"""Document type, issuing bank and language of a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import rules
from paperloom.functions.text import contains_any, hits


def document_type(text: Column, tie: str = "bank_statement", bank=rules.BANK_WORDS, payslip=rules.PAYSLIP_WORDS) -> Column:
    """struct(document_type, confidence, raw_confidence, bank_hits, payslip_hits).

    confidence is rounded half to even; raw_confidence is the ratio itself.  ``tie`` names the
    type at equal hits: bank_statement (current rule) or unknown (older rule).
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    b, p = hits(low, bank), hits(low, payslip)
    kind = F.when(b + p == 0, "unknown").when(b > p, "bank_statement").when(p > b, "payslip").otherwise(tie)
    raw = F.when(b + p == 0, 0.0).when(b == p, 0.5).otherwise(F.greatest(b, p) / F.nullif(b + p, F.lit(0)))
    return F.struct(kind.alias("document_type"), F.bround(raw, 2).alias("confidence"), raw.alias("raw_confidence"), b.alias("bank_hits"), p.alias("payslip_hits"))


def old_document_type(text: Column) -> Column:
    """``document_type`` by the older lists, where a tie is unknown."""
    return document_type(text, "unknown", rules.OLD_BANK_WORDS, rules.OLD_PAYSLIP_WORDS)


def only_bank_statements() -> Column:
    """The constant of the bank-only service."""
    return F.struct(F.lit("bank_statement").alias("document_type"), F.lit(1.0).alias("confidence"))


def is_type(kind: Column, name: str, least: float = 0.5, strict: bool = True) -> Column:
    c = kind["confidence"]
    return (kind["document_type"] == name) & ((c > least) if strict else (c >= least))


def issuing_bank(text: Column) -> Column:
    """struct(bank, confidence): bank by bank, sure words give 1.0 and likely ones 0.8; none is generic, 0.3."""
    up = F.upper(F.coalesce(text, F.lit("")))
    bank = confidence = None
    for name, (sure, likely) in rules.BANK_MARKS.items():
        for words, value in ((sure, 1.0), (likely, 0.8)):
            hit = contains_any(up, words)
            bank = F.when(hit, name) if bank is None else bank.when(hit, name)
            confidence = F.when(hit, value) if confidence is None else confidence.when(hit, value)
    return F.struct(bank.otherwise("generic").alias("bank"), confidence.otherwise(0.3).alias("confidence"))


def bank_of_first_page(pages: DataFrame) -> DataFrame:
    """(upload_id, bank, confidence) from each upload's first page."""
    first = pages.groupBy("upload_id").agg(F.min_by("text", "document_number").alias("text"))
    return first.select("upload_id", issuing_bank(F.col("text")).alias("b")).select("upload_id", "b.*")


def language(text: Column, payslip_words: bool = True) -> Column:
    """struct(language, confidence, raw_confidence, en, ms, ar): most hits wins, the first of equals; too short or no hit is en, 0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = {k: hits(low, [w for i, g in enumerate(groups) if i != 1 or payslip_words for w in g]) for k, groups in rules.LANGUAGE_WORDS.items()}
    en, ms, ar = count["en"], count["ms"], count["ar"]
    total = en + ms + ar
    none = (F.length(F.trim(low)) < 10) | (total == 0)
    best = F.when(none | (en >= F.greatest(ms, ar)), "en").when(ms >= ar, "ms").otherwise("ar")
    raw = F.when(none, 0.0).otherwise(F.greatest(en, ms, ar) / F.nullif(total, F.lit(0)))
    return F.struct(best.alias("language"), F.bround(raw, 2).alias("confidence"), raw.alias("raw_confidence"), en.alias("en"), ms.alias("ms"), ar.alias("ar"))


def digital_uploads(pages: DataFrame, least: int = rules.TEXT_LAYER_CHARS, first: int = 3) -> DataFrame:
    """(upload_id, is_digital, text_chars): whether the first pages (numbered from 0) have more than ``least`` characters."""
    early = pages.where(F.col("page") < first).groupBy("upload_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("text_chars"))
    return early.select("upload_id", (F.col("text_chars") > least).alias("is_digital"), "text_chars")
