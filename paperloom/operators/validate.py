"""Verdicts on records: the first rule that fails, and lists of range errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import rules

#: Patterns of well-formed values (here) and the messages of verdicts (below).
ID = r"^\d{6}-\d{2}-\d{4}$"
ACCOUNT = r"^\d{2}-\d{7}-\d$"
MONEY = r"^\d+\.\d{2}$"
#: Account shapes by bank, for the verdict that knows banks.
ACCOUNT_BY_BANK = {"bsn": r"^\d{16}$", "public_islamic": r"^\d{10}$", "bank_islam": r"^\d{14}$", "cimb": ACCOUNT, "generic": r"^\d{10,}$"}


def _missing(names: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(n)) for n in names]), lambda x: x.isNotNull())


def _shape(name: str, pattern: str, money: bool = False) -> Column:
    c = F.regexp_replace(F.col(name), ",", "") if money else F.col(name)
    return F.trim(c).rlike(pattern)


def _in_range(name: str, pattern: str, group: int, low: int, high: int) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(F.col(name)), pattern, group).try_cast("int").between(low, high), F.lit(False))


def _verdict(missing: Column, checks: list[tuple[Column, str]], good: str) -> Column:
    message = F.when(F.size(missing) > 0, F.concat(F.lit("Missing fields: "), F.array_join(missing, ", ")))
    for ok, text in checks:
        message = message.when(~F.coalesce(ok, F.lit(False)), F.lit(text))
    message = message.otherwise(F.lit(good))
    return F.struct((message == good).alias("is_valid"), message.alias("validation_message"))


def payslip_verdict(table: dict | None = None) -> Column:
    """struct(is_valid, validation_message) over the payslip columns; ``table`` overrides patterns and ranges."""
    rules_, span = table or {}, (table or {}).get("date_range", {})
    required = ("name", "id_number", "gross_income", "net_income", "total_deduction", "month_year")
    money, period = rules_.get("currency_pattern", MONEY), rules_.get("month_year_pattern", r"^\d{2}/\d{4}$")
    month = _in_range("month_year", r"^(\d+)/", 1, span.get("min_month", 1), span.get("max_month", 12))
    checks = [
        (_shape("id_number", rules_.get("id_number_pattern", ID)), "Invalid ID number format"),
        (_shape("gross_income", money, True), "Invalid gross income format"),
        (_shape("net_income", money, True), "Invalid net income format"),
        (_shape("total_deduction", money, True), "Invalid total deduction format"),
        (_shape("month_year", period) & month, "Invalid month/year format"),
    ]
    return _verdict(_missing(required), checks, "Valid payslip data")


def bank_verdict(by_bank: bool = False, years: tuple[int, int] = (1900, 2100), table: dict | None = None) -> Column:
    """struct(is_valid, validation_message) over the bank columns.

    by_bank: account shapes of each bank, else one shape for all; ``table`` overrides patterns and
    ranges: account_number_pattern, date_pattern, currency_pattern, and date_range with min_day,
    max_day, min_month, max_month, min_year and max_year.
    """
    rules_, span = table or {}, (table or {}).get("date_range", {})
    required = ("account_holder_name", "account_number", "statement_date", "opening_balance", "closing_balance")
    money, date = rules_.get("currency_pattern", MONEY), rules_.get("date_pattern", r"^\d{2}/\d{2}/\d{4}$")
    account = _shape("account_number", rules_.get("account_number_pattern", ACCOUNT))
    if by_bank:
        for bank, pattern in ACCOUNT_BY_BANK.items():
            account = F.when(F.col("detected_bank") == bank, _shape("account_number", pattern)).otherwise(account)
    good_date = _shape("statement_date", date)
    for group, (unit, low, high) in enumerate((("day", 1, 31), ("month", 1, 12), ("year", *years)), 1):
        good_date &= _in_range("statement_date", r"^(\d+)/(\d+)/(\d+)$", group, span.get(f"min_{unit}", low), span.get(f"max_{unit}", high))
    checks = [
        (account, "Invalid account number format"),
        (good_date, "Invalid statement date format"),
        (_shape("opening_balance", money, True), "Invalid opening balance format"),
        (_shape("closing_balance", money, True), "Invalid closing balance format"),
    ]
    return _verdict(_missing(required), checks, "Valid bank statement data")


def range_errors() -> Column:
    """array<string> of a payslip's values that are out of range, in a fixed order."""
    out = []
    for name, said in (("gross_income", "Gross income"), ("net_income", "Net income"), ("total_deduction", "Total deduction")):
        v = F.col(name).try_cast("decimal(28,2)")
        out += [F.when(v < 0, f"{said} cannot be negative"), F.when(v > rules.MOST_MONEY, f"{said} exceeds maximum ({rules.MOST_MONEY})")]
    two = r"^([^/]*)/([^/]*)$"
    month, year = (F.trim(F.regexp_extract("month_year", two, i)) for i in (1, 2))
    m, y = month.try_cast("int"), year.try_cast("int")
    both = m.isNotNull() & y.isNotNull()
    out += [
        F.when(both & ~m.between(1, 12), F.concat(F.lit("Invalid month: "), month)),
        F.when(both & ~y.between(2000, 2099), F.concat(F.lit("Invalid year: "), year)),
    ]
    return F.filter(F.array(*out), lambda e: e.isNotNull())


def sums_agree(tolerance: float = 1.0) -> Column:
    """Whether gross - deduction is net within ``tolerance``; null unless all three are above zero."""
    g, n, d = (F.col(c).try_cast("decimal(18,2)") for c in ("gross_income", "net_income", "total_deduction"))
    return F.when((g > 0) & (n > 0) & (d > 0), F.abs(g - d - n) <= tolerance)


def same_major(version: Column, expected: Column) -> Column:
    """Whether two versions agree in their first number."""
    return F.substring_index(version, ".", 1) == F.substring_index(expected, ".", 1)
