"""Identifiers, dates and periods in text, as column expressions; dates stay text in their source's form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import rules
from paperloom.functions.text import all_captured, captured, let


def twelve_digits(text: Column) -> Column:
    """6-2-4 digits, or null unless there are twelve."""
    d = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(d) == 12, F.concat_ws("-", F.substring(d, 1, 6), F.substring(d, 7, 2), F.substring(d, 9, 4)))


def clean_id_number(text: Column) -> Column:
    return F.coalesce(twelve_digits(text), F.trim(text))


def normalize_id_number(text: Column) -> Column:
    """6-2-4 digits where there are twelve, else the text as it stands."""
    return F.coalesce(twelve_digits(text), text)


def clean_month_year(text: Column) -> Column:
    pattern = r"(\d{1,2})[/-]?(\d{4})"
    month, year = captured(text, pattern, 1), captured(text, pattern, 2)
    good = month.try_cast("int").between(1, 12)
    return F.when(good, F.concat(F.lpad(month, 2, "0"), F.lit("/"), year)).otherwise(text)


def normalize_date(text: Column) -> Column:
    """The first three runs of digits, joined by slashes; the input where there are fewer."""
    runs = all_captured(text, r"(\d+)")
    return F.when(F.size(runs) >= 3, F.array_join(F.slice(runs, 1, 3), "/")).otherwise(text)


def _parts(text: Column) -> tuple[Column, Column, Column]:
    p = r"^(\d+)/(\d+)/(\d+)$"
    return tuple(captured(F.trim(text), p, i).try_cast("int") for i in (1, 2, 3))


def _good(day: Column, month: Column, year: Column) -> Column:
    longest = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(month.between(1, 12) & year.between(2000, 2099) & day.between(1, 31) & (day <= longest), F.lit(False))


def valid_date(text: Column) -> Column:
    """day/month/year as it stands if it can be a date from 2000 to 2099 (29 February in any year), else null."""
    day, month, year = _parts(text)
    return F.when(_good(day, month, F.when(year < 100, year + 2000).otherwise(year)), text)


def valid_or_clamped_date(text: Column) -> Column:
    """``valid_date``, else the date with each part moved into its range, if that is valid."""
    day, month, year = _parts(text)
    year = F.when(year < 100, year + 2000).otherwise(year)
    d, m, y = F.least(F.greatest(day, F.lit(1)), F.lit(31)), F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.least(F.greatest(year, F.lit(2000)), F.lit(2099))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clamped = F.when(_good(d, m, y), F.concat(two(d), F.lit("/"), two(m), F.lit("/"), y.cast("string")))
    return F.coalesce(valid_date(text), F.when(day.isNotNull(), clamped))


def as_date(text: Column) -> Column:
    """day/month/year as DATE; null where the calendar has no such day."""
    day, month, year = _parts(text)
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.try_to_date(F.concat_ws("/", day.cast("string"), month.cast("string"), year.cast("string")), "d/M/yyyy")


def statement_year(date: Column, default: str = rules.DEFAULT_YEAR) -> Column:
    """The year that day-month codes belong to."""
    return F.coalesce(captured(date, r"(\d{4})\s*$"), captured(date, r"/([^/]*)$"), F.lit(default))


_CODE = r"(\d{2})(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
_DATE = r"(\d{1,2}/\d{2}/\d{2,4})"
_MONTH_OF = [x for pair in rules.MONTH_CODES.items() for x in pair]


def _code_date(code: Column, year: Column) -> Column:
    months = F.create_map(*[F.lit(x) for x in _MONTH_OF])
    return F.when(code.isNotNull(), F.concat(F.substring(code, 1, 2), F.lit("/"), F.try_element_at(months, F.substring(code, 3, 3)), F.lit("/"), year))


def _full_date(text: Column) -> Column:
    """dd/mm/yyyy from d/mm/yy and the like."""
    p = r"^(\d+)/(\d+)/(\d+)$"
    day, month, year = (F.regexp_extract(text, p, i) for i in (1, 2, 3))
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.concat(F.lpad(day, 2, "0"), F.lit("/"), month, F.lit("/"), year)


def _pick(text: Column, statement_date: Column, last: bool, default: str) -> Column:
    side = F.lit(-1 if last else 1)
    code = F.try_element_at(F.regexp_extract_all(text, F.lit(_CODE), F.lit(0)), side)
    dates = F.filter(F.transform(all_captured(text, _DATE), _full_date), lambda d: valid_date(d).isNotNull() & ~d.eqNullSafe(statement_date))
    return F.coalesce(_code_date(code, statement_year(statement_date, default)), F.try_element_at(dates, side))


def first_transaction_date(text: Column, statement_date: Column, default: str = rules.DEFAULT_YEAR) -> Column:
    a, b = F.instr(text, "Transaction Details"), F.instr(text, "Butir-butir Transaksi")
    start = F.when(a > 0, a).when(b > 0, b).otherwise(1)
    return _pick(F.substring(text, start, F.length(text)), statement_date, False, default)


def last_transaction_date(text: Column, statement_date: Column, default: str = rules.DEFAULT_YEAR) -> Column:
    a, b = F.instr(text, "End of Statement"), F.instr(text, "Penyata Tamat")
    c = F.regexp_instr(text, F.lit(r"(?i)(?:Baki Sedia Ada|Available Balance|RINGKASAN|SUMMARY)"))
    end = F.when(a > 0, a).when(b > 0, b).when(c > 0, c).otherwise(F.length(text) + 1)
    return _pick(F.substring(text, F.lit(1), end - 1), statement_date, True, default)


def format_month_year(value: Column, text: Column, default: str = rules.DEFAULT_YEAR) -> Column:
    """A payslip's period as MM/YYYY where it can be told, else the value."""
    return let(value, lambda v: _month_year(v, text, default))


def _month_year(value: Column, text: Column, default: str) -> Column:
    a, b = F.regexp_extract(value, r"^(\d{1,2})/(\d+)$", 1), F.regexp_extract(value, r"^(\d{1,2})/(\d+)$", 2)
    year = captured(text, r"\b(20\d{2})\b")
    first, second = a.try_cast("int"), b.try_cast("int")
    swap = F.when(year.isNotNull(), ~first.between(1, 12) & second.between(1, 12) & (first > 12)).otherwise(first > 12)
    month = F.lpad(F.when(swap, b).otherwise(a), 2, "0")
    out = F.when(value.rlike(r"^\d{1,2}/\d{4}$"), F.concat(F.lpad(a, 2, "0"), F.lit("/"), b))
    out = out.when(value.rlike(r"^\d{1,2}/\d{1,2}$"), F.concat(month, F.lit("/"), F.coalesce(year, F.lit(default))))
    own = captured(value, r"(20\d{2})")
    low = F.lower(value)
    for name, number in rules.MONTH_NAMES.items():
        out = out.when(F.contains(low, F.lit(name)) & own.isNotNull(), F.concat(F.lit(number + "/"), own))
    return out.otherwise(value)
