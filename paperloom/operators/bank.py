"""Bank statement records: each field is an ordered choice of captures from one-line text, by a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import dates, numbers, rules
from paperloom.functions.classify import issuing_bank
from paperloom.functions.text import captured, let
from paperloom.operators import ruletable

FIELDS = (
    "account_number", "account_holder_name", "statement_date", "opening_balance", "closing_balance", "total_debit", "total_credit",
    "statement_period_from", "statement_period_to",
)

#: Fields by their patterns alone, and those that may be made from them.
_PLAIN = ("account_number", "account_holder_name", "statement_date", "opening_balance", "total_debit", "total_credit", "available_balance")
_MADE = ("closing_balance", "statement_period_from", "statement_period_to")


def _first(*choices: Column) -> Column:
    return F.coalesce(*choices) if choices else F.lit(None).cast("string")


def derived_closing(opening: Column, debit: Column, credit: Column) -> Column:
    """opening + credit - debit where all three are known."""
    m = lambda c: c.try_cast(numbers.MONEY)
    return F.when(opening.isNotNull() & debit.isNotNull() & credit.isNotNull(), numbers.money_text(m(opening) + m(credit) - m(debit)))


def bank_record(df: DataFrame, text: str = "text", bank: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """``df`` with the bank fields, detected_bank and bank_detection_confidence.

    The bank is detected in the text unless a column is named.
    """
    t = F.col(text)
    if bank is None:
        df = df.withColumn("__bank", issuing_bank(t))
        df = df.withColumns({"detected_bank": F.col("__bank.bank"), "bank_detection_confidence": F.col("__bank.confidence")}).drop("__bank")
    else:
        df = df.withColumns({"detected_bank": F.col(bank), "bank_detection_confidence": F.lit(None).cast("double")})
    return by_bank_record(df, text, table)


def by_bank_record(df: DataFrame, text: str = "text", table: DataFrame | None = None) -> DataFrame:
    """The bank fields of rows whose detected_bank is there already, by the rows of a rule table.

    ``table`` has the rules of all banks (``ruletable.SCHEMA``), by default those of ``rules.BANKS``.
    Banks without rules are generic.  ``df`` is read once, and no text is shuffled.
    """
    names, own, zero = (*FIELDS, "available_balance"), df.columns, F.lit("0.00")
    met = ruletable.with_rules(df, "detected_bank", table, {"__plain": _PLAIN, "__made": _MADE})
    t = F.col(text)
    met = met.withColumn("__plain", ruletable.values(t, F.col("__plain")))
    met = met.withColumns({f: F.get("__plain", F.lit(i)) for i, f in enumerate(_PLAIN)})
    made = {
        "derived": derived_closing(F.col("opening_balance"), F.col("total_debit"), F.col("total_credit")),
        "first_transaction": dates.first_transaction_date(t, F.col("statement_date")),
        "last_transaction": dates.last_transaction_date(t, F.col("statement_date")),
    }
    met = met.withColumn("__made", ruletable.values(t, F.col("__made"), made))
    met = met.withColumns({f: F.get("__made", F.lit(i)) for i, f in enumerate(_MADE)})
    return met.withColumns({f: F.coalesce(f, zero) for f in ("opening_balance", "closing_balance")}).select(*[c for c in own if c not in names], *names)


def with_typed(df: DataFrame) -> DataFrame:
    """Typed companions: *_amt DECIMAL(18,2) and *_dt DATE."""
    money = {f"{c}_amt": F.col(c).try_cast(numbers.MONEY) for c in ("opening_balance", "closing_balance", "total_debit", "total_credit")}
    days = {f"{c}_dt": dates.as_date(F.col(c)) for c in ("statement_date", "statement_period_from", "statement_period_to")}
    return df.withColumns(money | days)


def generic_field(text: Column, pattern: str | None, words: tuple[str, ...]) -> Column:
    """The older rule: a pattern anywhere first, then what follows a word."""
    tried = [captured(text, f"(?i)({pattern})")] if pattern else []
    for w in words:
        got = captured(text, rf"(?i){w}[:\s]+([^\n]+?)(?=\n|$|[A-Z][a-z])")
        got = F.trim(F.regexp_replace(F.regexp_replace(F.trim(got), r"\s+", " "), r"[^\w\s\-./,RM]", ""))
        tried.append(let(got, lambda g: F.when(F.length(g) > 1, g)))
    return _first(*tried)


def completeness(columns: list[Column], truthy: bool = False) -> Column:
    """Share of columns that are not null (truthy: nor empty nor "0.00")."""
    known = [(c.isNotNull() & (c != "") & (c != "0.00") if truthy else c.isNotNull()).cast("int") for c in columns]
    return sum(known[1:], known[0]) / F.lit(len(known))


def bank_completeness(df: DataFrame) -> Column:
    """Over the nine fields and the two of detection; one more for the bank that shows an available balance."""
    n = [F.coalesce(F.col(c).isNotNull(), F.lit(False)).cast("int") for c in (*FIELDS, "detected_bank", "bank_detection_confidence")]
    more = ((F.col("detected_bank") == "bsn") & F.col("available_balance").isNotNull() & (F.col("available_balance") != "0.00")).cast("int")
    return (sum(n[1:], n[0]) + F.coalesce(more, F.lit(0))) / (F.lit(len(n)) + F.coalesce(more, F.lit(0)))


def weighted_confidence(recognition: Column, pattern_ok: Column, nearness: Column, source: Column) -> Column:
    """A field's confidence from recognition, pattern, nearness and source, within [0, 1]."""
    w = rules.CONFIDENCE_WEIGHTS
    raw = (
        w[0] * F.coalesce(recognition, F.lit(rules.CONFIDENCE_DEFAULT))
        + w[1] * F.when(pattern_ok, 1.0).otherwise(0.0)
        + w[2] * nearness
        + w[3] * F.when(source == "pdf", rules.CONFIDENCE_PDF).otherwise(0.0)
    )
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
