"""Money and numbers in text, as column expressions; money is DECIMAL(18,2) inside, a string outside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import let

MONEY = "decimal(18,2)"


def as_money(text: Column) -> Column:
    """A plain decimal number as money; null for anything else."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text.try_cast("decimal(38,10)").try_cast(MONEY))


def money_text(value: Column) -> Column:
    return value.cast(MONEY).cast("string")


def last_dot_decimal(text: Column) -> Column:
    """Drops all dots but the last."""
    head, tail = F.regexp_extract(text, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(text, r"^(.*)\.([^.]*)$", 2)
    return F.when(F.contains(text, F.lit(".")), F.concat(F.regexp_replace(head, r"\.", ""), F.lit("."), tail)).otherwise(text)


def clean_currency(text: Column) -> Column:
    """Text to "0.00"-style money.

    Without a dot, exactly five digits after the last comma mean that its last two are cents;
    other commas are dropped.  Signs and letters are dropped; of several dots the last counts.
    """
    return let(text, _clean_currency)


def _clean_currency(text: Column) -> Column:
    bare = F.regexp_replace(text, r"[, ]", "")
    after = F.regexp_extract(text, r",([^,]*)$", 1)
    cents = F.regexp_replace(F.concat(F.regexp_extract(bare, r"^(.*)(..)$", 1), F.lit("."), F.regexp_extract(bare, r"^(.*)(..)$", 2)), r" ", "")
    dotted = F.when(~F.contains(text, F.lit(".")) & F.contains(text, F.lit(",")) & after.rlike(r"^\s*\d{5}\s*$"), cents).otherwise(bare)
    digits = let(F.regexp_replace(dotted, r"[^\d.]", ""), last_dot_decimal)
    return F.coalesce(let(digits, lambda d: money_text(as_money(d))), F.lit("0.00"))


def parse_number(text: Column) -> Column:
    """A signed number with . or , as its decimal mark; null where it is none."""
    x = F.regexp_replace(text, r"[^\d.,\-]", "")
    dot, comma = F.contains(x, F.lit(".")), F.contains(x, F.lit(","))
    x = (
        F.when(dot, F.regexp_replace(x, ",", ""))
        .when(comma & x.rlike(r",\d{1,2}$"), F.regexp_replace(x, ",", "."))
        .otherwise(F.regexp_replace(x, ",", ""))
    )
    return F.when(x.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), x.try_cast("double"))


def normalize_number(text: Column, bank: Column | str) -> Column:
    """An extracted amount as money; 0 where it is none.  One bank writes thousands with dots."""
    bank = F.lit(bank) if isinstance(bank, str) else bank
    many = F.length(F.regexp_replace(text, r"[^.]", "")) > 1
    plain = F.regexp_replace(F.trim(text), ",", "")
    value = F.when((bank == "bsn") & many, as_money(last_dot_decimal(plain))).otherwise(as_money(plain))
    return F.coalesce(value, F.lit(0).cast(MONEY))


def amount(text: Column, bank: Column | str) -> Column:
    """``normalize_number`` as text, null for zero: a zero amount counts as missing."""
    return let(text, lambda t: let(normalize_number(t, bank), lambda v: F.when(t.isNotNull() & (v != 0), money_text(v))))


def payslip_number(text: Column) -> Column:
    """Spaces, commas and RM go, - is a decimal mark."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\s,]", ""), "RM", ""), "-", ".")
    return as_money(x)


def payslip_currency(text: Column) -> Column:
    return F.coalesce(money_text(payslip_number(text)), F.lit("0.00"))


def label_value(text: Column) -> Column:
    """A number with two decimals, else a whole number with .00 added."""
    x = F.regexp_replace(text, r"[\s,]", "")
    return F.coalesce(F.regexp_substr(x, F.lit(r"\d+\.\d{2}")), F.concat(F.regexp_substr(x, F.lit(r"\d+")), F.lit(".00")))


def first_number(text: Column) -> Column:
    return F.regexp_substr(text, F.lit(r"[\d,\.]+\.?\d{0,2}"))


def keep_amount_chars(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\d,.]", "")
