"""Records by the older rules: a field's pattern anywhere in the text comes first, then its words.

All three payslip amounts share one pattern, so wherever a text holds an amount all three are its
first one; that is how these rules are defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import numbers
from paperloom.functions.text import captured
from paperloom.operators.bank import completeness, generic_field

#: Each field's pattern and words, in the order in which they are tried.
PAYSLIP = {
    "name": (None, ("name", "employee name", "employee")),
    "id_number": (r"\d{6}-\d{2}-\d{4}", ("id", "nric", "employee id", "identification")),
    "gross_income": (r"[\d,]+\.\d{2}", ("gross", "gross income", "gross salary", "total income")),
    "net_income": (r"[\d,]+\.\d{2}", ("net", "net income", "take home", "net salary")),
    "total_deduction": (r"[\d,]+\.\d{2}", ("deduction", "total deduction", "total deductions")),
    "month_year": (r"\d{2}/\d{4}", ("month", "period", "date", "month/year")),
}
BANK = {
    "account_number": (r"\d{2}-\d{7}-\d", ("account", "account number", "account no")),
    "statement_date": (r"\d{2}/\d{2}/\d{4}", ("date", "statement date", "statement period")),
    "opening_balance": (r"[\d,]+\.\d{2}", ("opening", "opening balance", "beginning balance")),
    "closing_balance": (r"[\d,]+\.\d{2}", ("closing", "closing balance", "ending balance", "balance")),
}
#: The fields when no settings can be read, with Malay and Arabic words.
DEFAULT_PAYSLIP = {
    "name": (None, ("name", "employee name", "nama", "nama pegawai", "الاسم", "اسم الموظف")),
    "id_number": (r"\d{6}-\d{2}-\d{4}|\d{12}", ("id", "nric", "employee id", "no. k/p", "no k/p", "رقم الهوية", "رقم الموظف")),
    "gross_income": (r"[\d,]+\.?\d{0,2}", ("gross", "gross income", "gross salary", "gaji kasar", "gaji pokok", "jumlah pendapatan", "الراتب الإجمالي", "الدخل الإجمالي")),
    "net_income": (r"[\d,]+\.?\d{0,2}", ("net", "net income", "take home", "gaji bersih", "صافي الراتب", "الدخل الصافي")),
    "total_deduction": (r"[\d,]+\.?\d{0,2}", ("deduction", "total deduction", "jumlah potongan", "الخصم الإجمالي", "إجمالي الخصومات")),
    "month_year": (r"\d{1,2}/\d{4}|\d{1,2}-\d{4}", ("month", "period", "date", "bulan", "tarikh", "الشهر", "التاريخ")),
}
DEFAULT_BANK = {
    "account_number": (r"\d{2}-\d{7}-\d|\d{10,12}", ("account", "account number", "no. akaun", "رقم الحساب")),
    "statement_date": (r"\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}", ("date", "statement date", "tarikh", "تاريخ الكشف")),
    "opening_balance": (r"[\d,]+\.?\d{0,2}", ("opening balance", "baki pembukaan", "الرصيد الافتتاحي")),
    "closing_balance": (r"[\d,]+\.?\d{0,2}", ("closing balance", "baki penutup", "الرصيد الختامي")),
}
#: Patterns of single fields and of lines that are no holder's.
NAME = r"(?i)Nama\s+([A-Za-z\s]+?)(?:\n|No)"
BASIC_PAY = r"(?i)Gaji\s+Pokok\s+([\d,\s]+?)(?:\s+\d{4}|$|\n)"
NET_PAY = (r"(?im)Gaji\s+Bersih\s+([\d,\s]+?)(?:\n|Pendapatan)", r"(?im)Gaji\s+Bersih\s+([\d,\s]+?)$")
DEDUCTION = r"(?i)Jumlah\s+Potongan\s+([\d\s,]+)"
HOLDER = r"(?i)(\d{2}/\d{2}/\d{4})\s+([A-Za-z\s]+?)\s+(\d+,?\s*JALAN|Summary|Ringkasan)"
NO_HOLDER = r"(?i)Statement|Tarikh|Penyata|Account|Akaun"
NO_HOLDER_LINE = (
    r"(?i)CIMB|Statement|Account|Number|Date|Balance|Period|Page|Halaman|Summary|Ringkasan|JALAN|KUALA|LUMPUR|RM|Tarikh|Penyata|Akaun|Simpanan|Transaksi|Butir|"
    r"Withdrawal|Deposit|GST|Baki|Pengeluaran|Rujukan|Diskripsi|51-|52-|53-|54-|55-|56-|57-|58-|59-|60-|Savings|Eligible|PIDM|Bonus|Points|Mata|Ganjaran|Diperolehi|"
    r"Dilunaskan|Dipindahkan|Terkini|Expiring|Lupus|Opening|Closing|Interest|Fee|Transfer|ATM|Debit|Credit"
)
OPENING = r"(?i)OPENING\s+BALANCE\s+([\d,.\s]+?)(?:\n|$|\d{2}/\d{2}/\d{4})"
CLOSING = r"(?i)(?:CLOSING\s+BALANCE|BAKI\s+PENUTUP)\s+([\d,.\s]+?)(?:\n|$|End\s+of)"


def _closed_up(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"\s", ""), F.lit(""))


def _field(text: Column, table: dict, name: str) -> Column:
    return generic_field(text, *table[name])


def holder_line(text: Column) -> Column:
    """The first line of 5 to 100 characters with two capitalised words and none of the usual headings."""
    lines = F.transform(F.split(text, "\n"), F.trim)
    good = F.filter(lines, lambda x: F.length(x).between(5, 100) & (F.size(F.regexp_extract_all(x, F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))) >= 2) & ~x.rlike(NO_HOLDER_LINE))
    return F.try_element_at(good, F.lit(1))


def payslip_record(df: DataFrame, text: str = "text", fields: dict = PAYSLIP) -> DataFrame:
    """``df`` with the payslip fields; ``fields`` are PAYSLIP or, where no settings can be read, DEFAULT_PAYSLIP."""
    t = F.col(text)
    first = {name: _field(t, fields, name) for name in fields}
    df = df.withColumns(
        {
            "name": F.coalesce(first["name"], F.trim(captured(t, NAME))),
            "id_number": first["id_number"],
            "gross_income": numbers.clean_currency(F.coalesce(first["gross_income"], _closed_up(captured(t, BASIC_PAY)))),
            "total_deduction": numbers.clean_currency(F.coalesce(first["total_deduction"], _closed_up(captured(t, DEDUCTION)))),
            "__net": numbers.clean_currency(F.coalesce(first["net_income"], *[_closed_up(captured(t, p)) for p in NET_PAY])),
            "month_year": first["month_year"],
        }
    )
    m = lambda c: F.col(c).try_cast(numbers.MONEY)
    net = F.when(F.col("__net") == "0.00", numbers.money_text(m("gross_income") - m("total_deduction"))).otherwise(F.col("__net"))
    return df.withColumn("net_income", net).drop("__net")


def bank_record(df: DataFrame, text: str = "text", fields: dict = BANK) -> DataFrame:
    """``df`` with the bank fields; ``fields`` are BANK or DEFAULT_BANK."""
    t = F.col(text)
    named = F.trim(captured(t, HOLDER, 2))
    named = F.when((F.length(named) > 3) & ~named.rlike(NO_HOLDER), named)
    return df.withColumns(
        {
            "account_holder_name": F.coalesce(named, holder_line(t)),
            "account_number": _field(t, fields, "account_number"),
            "statement_date": _field(t, fields, "statement_date"),
            "opening_balance": numbers.clean_currency(F.coalesce(_closed_up(captured(t, OPENING)), _field(t, fields, "opening_balance"))),
            "closing_balance": numbers.clean_currency(F.coalesce(_closed_up(captured(t, CLOSING)), _field(t, fields, "closing_balance"))),
        }
    )


def record_completeness(names: tuple[str, ...]) -> Column:
    return completeness([F.col(n) for n in names])
