"""Pages of an upload: values carried forward, runs of one account, and their merge.

All three need an upload's pages together and in order; one hash partitioning on upload_id serves
them all.  An upload is one file, so its pages are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import numbers
from paperloom.operators.bank import derived_closing


def _pages() -> Window:
    return Window.partitionBy("upload_id").orderBy("document_number")


def carry_forward(pages: DataFrame) -> DataFrame:
    """Fills opening, debit and credit of one bank's pages from earlier pages of the same upload.

    A page with an opening balance above zero renews all three remembered values; a later page
    with "0.00" takes the remembered opening; any debit or credit found renews its own.  The
    closing balance is then derived where all three are known.
    """
    so_far = _pages().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.coalesce(F.col("opening_balance").try_cast(numbers.MONEY), F.lit(0)) > 0

    def remembered(c: str) -> Column:
        # the last value found since, and at, the last page with an opening balance
        return F.last(F.when(opened | F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(so_far)["v"]

    opening = F.last(F.when(opened, F.col("opening_balance")), ignorenulls=True).over(so_far)
    ours = F.col("detected_bank") == "bank_islam"
    out = pages.withColumns({"__o": opening, "__d": remembered("total_debit"), "__c": remembered("total_credit")})
    out = out.withColumn("opening_balance", F.when(ours & ~opened, F.coalesce("__o", "opening_balance")).otherwise(F.col("opening_balance")))
    derived = derived_closing(F.when(F.col("opening_balance") != "0.00", F.col("opening_balance")), F.coalesce("total_debit", "__d"), F.coalesce("total_credit", "__c"))
    out = out.withColumn("closing_balance", F.when(ours, F.coalesce(derived, "closing_balance")).otherwise(F.col("closing_balance")))
    return out.drop("__o", "__d", "__c")


def islands(pages: DataFrame, account: str = "account_number") -> DataFrame:
    """``pages`` with island: neighbouring bank pages of one known account share a number; others stand alone.

    Pages of other types get a null island.
    """
    bank = F.coalesce(F.col("document_type") == "bank_statement", F.lit(False))
    w = Window.partitionBy("upload_id", "__bank").orderBy("document_number")
    same = (F.coalesce(F.col(account), F.lit("")) != "") & F.col(account).eqNullSafe(F.lag(account).over(w))
    out = pages.withColumn("__bank", bank).withColumn("__new", F.when(same, 0).otherwise(1))
    number = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("island", F.when(F.col("__bank"), number)).drop("__bank", "__new")


def merge_islands(pages: DataFrame) -> DataFrame:
    """One row per island of bank pages, in order of its first page.

    Holder, account, date and opening are the first page's; closing is the last that is known and
    not "0.00", else "0.00"; debit, credit and period start are the first known; period end and
    available balance the last known; confidence is the mean, rounded half to even; lengths add up.
    """
    page = F.col("document_number")

    def first(c: str) -> Column:
        return F.min_by(c, page)

    def known(c: str, pick=F.min_by, unlike: str = "") -> Column:
        good = (F.coalesce(F.col(c), F.lit("")) != "") & (F.coalesce(F.col(c), F.lit("")) != unlike)
        return pick(c, F.when(good, page))

    mean = F.avg("confidence_score")
    merged = (
        pages.where(F.col("island").isNotNull())
        .groupBy("upload_id", "island")
        .agg(
            F.min(page).alias("document_number"),
            first("account_holder_name").alias("account_holder_name"),
            first("account_number").alias("account_number"),
            first("statement_date").alias("statement_date"),
            first("opening_balance").alias("opening_balance"),
            F.when(F.count("*") == 1, first("closing_balance")).otherwise(F.coalesce(known("closing_balance", F.max_by, "0.00"), F.lit("0.00"))).alias("closing_balance"),
            known("total_debit").alias("total_debit"),
            known("total_credit").alias("total_credit"),
            known("available_balance", F.max_by).alias("available_balance"),
            known("statement_period_from").alias("statement_period_from"),
            known("statement_period_to", F.max_by).alias("statement_period_to"),
            F.first("detected_bank", ignorenulls=True).alias("detected_bank"),
            F.count("*").alias("page_count"),
            F.when(F.count("*") == 1, F.min("confidence_score")).otherwise(F.bround(mean, 2)).alias("confidence_score"),
            mean.alias("raw_confidence"),
            F.sum("text_length").alias("text_length"),
        )
    )
    return merged.withColumn("is_merged", F.col("page_count") > 1)


def merged_documents(pages: DataFrame) -> DataFrame:
    """Merged islands together with the pages of other types, as they are."""
    marked = islands(pages)
    return merge_islands(marked).unionByName(marked.where(F.col("island").isNull()), allowMissingColumns=True)


def type_of_first_page(pages: DataFrame) -> DataFrame:
    """``pages`` with every page's document_type set to that of its upload's first page."""
    whole = _pages().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pages.withColumn("document_type", F.first("document_type").over(whole))
