"""Rule tables: keyword lists, patterns and thresholds that results depend on.

All names in capitals below are fixed values, kept in the order in which they are tried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- document type -------------------------------------------------------------------------

BANK_WORDS = (
    "account number", "account no", "nombor akaun", "no akaun", "statement date", "tarikh penyata", "penyata akaun",
    "opening balance", "closing balance", "baki pembukaan", "baki penutup", "total debit", "total credit", "jumlah debit",
    "jumlah kredit", "transaction", "transaksi", "urus niaga", "statement period", "tempoh penyata", "available balance",
    "baki sedia ada", "bank statement", "penyata bank", "current account", "savings account", "akaun semasa", "akaun simpanan",
)
PAYSLIP_WORDS = (
    "payslip", "pay slip", "slip gaji", "penyata gaji", "salary", "gaji", "pendapatan", "gross income", "gross salary",
    "jumlah pendapatan", "gaji kasar", "net income", "net salary", "gaji bersih", "pendapatan bersih", "deduction", "potongan",
    "epf", "kwsp", "kumpulan wang simpanan pekerja", "socso", "perkeso", "pertubuhan keselamatan sosial", "pcb", "income tax",
    "cukai pendapatan", "allowance", "elaun", "overtime", "kerja lebih masa", "basic salary", "gaji pokok", "gaji asas",
    "employee", "pekerja", "staff", "kakitangan", "employer", "majikan", "company",
)
#: The older pair of lists; one word stands twice and one in both, and each counts.
OLD_PAYSLIP_WORDS = (
    "payslip", "salary", "gross", "net income", "deduction", "employee", "month", "year", "eis", "socso", "epf", "income tax",
    "allowance", "overtime", "basic salary", "nric", "id number", "employee id", "department", "pay period", "payment date",
    "total deduction", "employer", "employee name", "designation", "gaji", "gaji pokok", "gaji bersih", "cukai pendapatan",
    "kwsp", "perkeso", "takaful", "potongan", "pendapatan", "jumlah", "bulan", "nama", "no k/p", "no gaji", "راتب", "الراتب",
    "الدخل", "الخصم", "الموظف", "الإجمالي", "الصافي", "الخصومات", "الهوية", "رقم",
)
OLD_BANK_WORDS = (
    "bank statement", "account", "balance", "transaction", "deposit", "withdrawal", "statement date", "account number",
    "opening balance", "closing balance", "statement period", "bank name", "account holder", "date", "amount", "reference",
    "description", "debit", "credit", "statement of account", "account summary", "penyata", "akaun", "baki", "transaksi",
    "tarikh", "pengeluaran", "deposit", "pembukaan", "penutup", "pemegang", "rujukan", "deskripsi", "jumlah", "كشف", "حساب",
    "رصيد", "معاملة", "تاريخ", "إيداع", "سحب", "الافتتاحي", "الختامي", "صاحب",
)

# --- language: common words, payslip words, bank words -------------------------------------

LANGUAGE_WORDS = {
    "en": (
        ("the", "and", "is", "to", "of", "in", "for", "that", "with", "a", "on"),
        ("salary", "gross", "net income", "deduction", "employee", "payslip", "basic", "allowance"),
        ("account", "balance", "transaction", "deposit", "withdrawal", "statement"),
    ),
    "ms": (
        ("yang", "dan", "adalah", "untuk", "di", "pada", "dengan", "dari", "ke", "ini"),
        ("gaji", "gaji pokok", "gaji bersih", "potongan", "pendapatan", "nama", "elaun", "kwsp"),
        ("akaun", "baki", "transaksi", "pengeluaran", "deposit", "penyata", "tarikh"),
    ),
    "ar": (
        ("في", "من", "إلى", "هو", "هي", "و", "أن", "على", "عن", "كل"),
        ("راتب", "الراتب", "الخصم", "الدخل", "الموظف", "الإجمالي", "صافي", "بدل"),
        ("حساب", "الرصيد", "معاملة", "إيداع", "سحب", "كشف", "التاريخ"),
    ),
}

# --- issuing bank: (sure words, likely words), tried bank by bank --------------------------

BANK_MARKS = {
    "bsn": (("BSN PENYATA AKAUN", "BSN GIRO"), ("BANK SIMPANAN NASIONAL",)),
    "public_islamic": (("PUBLIC ISLAMIC BANK",), ("PUBLIC BANK BERHAD", "PUBLICISLAMICBANK")),
    "bank_islam": (("BANKCISLAM", "BANK ISLAM"), ("BANKISLAM.COM", "MENARA BANK ISLAM")),
    "cimb": (("CIMB BANK", "CIMB BANK BERHAD"), ("CIMBBANK.COM", "CIMBCLICKS")),
}

# --- bank statement fields -----------------------------------------------------------------

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|April|May|June|July|August|September|October|November|December"
MONTH_CODES = {"JAN": "01", "FEB": "02", "MAR": "03", "APR": "04", "MAY": "05", "JUN": "06", "JUL": "07", "AUG": "08", "SEP": "09", "OCT": "10", "NOV": "11", "DEC": "12"}
AMOUNT = r"([0-9,\.]+)"
SUMMARY = r"(?i)(?:RINGKASAN|SUMMARY|HIGHLIGHTS)"
DATE_RANGE = r"(?i)(\d{2}/\d{2}/\d{2,4})\s*(?:-|to|TO)\s*(\d{2}/\d{2}/\d{2,4})"


@dataclass(frozen=True)
class BankRules:
    """How one bank's fields are found; patterns are tried in order."""

    account_exact: str | None = None
    account_words: tuple[str, ...] = ()
    account: str = r"\d{10,}"
    holder: tuple[str, ...] = ()
    date_words: tuple[str, ...] = ()
    date: str = r"\d{2}/\d{2}/\d{2,4}"
    opening: tuple[str, ...] = ()
    closing: tuple[str, ...] = ()
    debit: tuple[str, ...] = ()
    credit: tuple[str, ...] = ()
    section: str | None = None
    period_from: tuple[str, ...] = ("From", "Dari")
    period_to: tuple[str, ...] = ("To", "Hingga")
    period: str = r"\d{2}/\d{2}/\d{4}"
    extra: dict[str, tuple[str, ...]] = field(default_factory=dict)


BANKS = {
    "bsn": BankRules(
        account_exact=r"BSN\s+PENYATA\s+AKAUN\s+(\d{16})",
        account_words=("No.Akaun", "Account No"),
        account=r"\b\d{16}\b",
        holder=(r"([A-Z][A-Z\s]+)(?=\s+No\.Akaun)", r"([A-Z][A-Z\s]+?(?:BIN|BINTI|ANAK)\s+[A-Z\s]+?)(?=\s+No\.Akaun)"),
        date_words=("Statement Date:", "Tarikh Penyata"),
        date=r"\d{2}/\d{2}/\d{4}",
        opening=("Baki Hadapan",),
        closing=("Baki Sedia Ada", "Available Balance"),
        debit=("Jumlah Debit", "Total Debit:"),
        credit=("Jumlah Kredit", "Total Credit:"),
    ),
    "public_islamic": BankRules(
        account_exact=r"(\d{10})\s+Nombor Akaun",
        account_words=("Nombor Akaun", "Account Number"),
        account=r"\b\d{10}\b",
        holder=(
            r"((?:MOHAMAD|ENCIK|PUAN|CIKGU)\s+[A-Z\s]+)(?=\s+\d{10})",
            r"((?:MOHAMAD|ENCIK|PUAN|CIKGU|TN|TUAN|DATO)\s+[A-Z\s]+?(?:BIN|BINTI|ANAK)?\s+[A-Z\s]+?)(?=\s+\d{3}\s+\d{10})",
            r"((?:MOHAMAD|ENCIK|PUAN|CIKGU)\s+[A-Z\s]+?(?:BIN|BINTI|ANAK)\s+[A-Z\s]+?)(?=\s+(?:PENYATA AKAUN|STATEMENT OF ACCOUNT))",
        ),
        date_words=("Tarikh Penyata", "Statement Date"),
        date=rf"\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}",
        opening=("Balance From Last Statement",),
        closing=("Baki Penutup", "Closing Balance"),
        debit=("Jumlah Debit", "Total Debits"),
        credit=("Jumlah Kredit", "Total Credits"),
    ),
    "bank_islam": BankRules(
        account_exact=r"ACCOUNT NO\s+(\d{14})",
        account_words=("NOMBOR AKAUN", "ACCOUNT NO"),
        account=r"\b\d{14}\b",
        holder=(r"((?:ENCIK|PUAN|CIKGU)\s+[A-Z\s]+)(?=\s+TARIKH)", r"((?:ENCIK|PUAN|CIKGU)\s+[A-Z\s]+?)(?=\s+TARIKH)"),
        date_words=("TARIKH PENYATA", "STATEMENT DATE"),
        date=r"\d{2}/\d{2}/\d{2}",
        opening=("BAL B/F", "BAL BIF"),
        closing=("BAL C/F",),
        debit=("TOTAL DEBIT",),
        credit=("TOTAL CREDIT",),
        section="RINGKASAN AKAUN",
        period=r"\d{2}/\d{2}/\d{2}",
    ),
    "cimb": BankRules(
        account_exact=r"(\d{2}-\d{7}-\d{1})",
        account_words=("Account No", "No Akaun"),
        account=r"\d{2}-\d{7}-\d{1}",
        holder=(
            r"([A-Z][a-z]+\s+[A-Z][a-z]+\s+(?:Binti|Bin)\s+[A-Z][a-z]+)",
            r"([A-Z][A-Za-z]+\s+[A-Z][A-Za-z]+\s+(?:BINTI|BIN)\s+[A-Z][A-Za-z]+)(?=\s+\d+,?\s+(?:JALAN|LOT|NO\.))",
        ),
        date_words=("Statement Date", "Tarikh Penyata"),
        date=r"\d{2}/\d{2}/\d{4}",
        opening=("OPENING BALANCE",),
        closing=("CLOSING BALANCE", "BAKI PENUTUP"),
    ),
    "generic": BankRules(
        account_words=("ACCOUNT NO", "NO AKAUN", "account number", "account no", "akaun", "no akaun", "ACC NO", "A/C NO"),
        date_words=("STATEMENT DATE", "TARIKH PENYATA", "date", "statement date", "tarikh penyata", "tarikh", "period"),
        opening=("opening", "opening balance", "beginning balance", "baki awal", "BAKI AWAL", "baki hadapan", "BAKI HADAPAN", "BAL B/F", "BAKI B/F"),
        closing=("closing", "closing balance", "ending balance", "balance", "baki akhir", "baki penutup", "BAKI AKHIR", "BAKI PENUTUP", "BALANCE", "BAL C/F", "BAKI C/F"),
        debit=("total debit", "total debits", "jumlah debit", "TOTAL DEBIT", "JUMLAH DEBIT", "debit"),
        credit=("total credit", "total credits", "jumlah kredit", "TOTAL CREDIT", "JUMLAH KREDIT", "credit"),
        period_from=("from", "dari", "period from", "statement from", "tempoh dari"),
        period_to=("to", "hingga", "period to", "statement to", "tempoh hingga", "sehingga"),
        period=r"\d{2}/\d{2}/\d{2,4}",
    ),
}
#: Holder patterns for every bank, after its own.
HOLDERS = (
    r"((?:ENCIK|PUAN|CIKGU)\s+[A-Z\s]+?)(?=\s+(?:TARIKH|STATEMENT|DATE|JALAN|LOT|NO\.|NOMBOR))",
    r"([A-Z][A-Z\s]+?(?:ANAK|BINTI|BIN)\s+[A-Z]+)(?=\s+(?:No\.Akaun|Account\s+No|DIA\s+RUMAH|\d{10,}))",
)
AVAILABLE = r"(?i)(?:Baki Sedia Ada|Available Balance)[:\s]*([0-9,\.]+)"
ISLAMIC_CLOSING = (
    r"(?i)(?:Baki Penutup|Closing Balance)[:\s]*(?:RM)?[:\s]*([0-9,\.]+)",
    r"(?i)Closing Balance In This Statement[:\s]*([0-9,\.]+)",
    r"(?i)([0-9,\.]+)\s*(?:Baki Penutup|Closing Balance)",
)

# --- payslip fields ------------------------------------------------------------------------

_NAME = r"([A-Z][A-Z\s]+(?:BIN|BINTI)\s+[A-Z][A-Z\s]+)"
_MONEY = r"([\d\s,]+[\.-]\s*\d{2})"
_MONEY_OPEN = r"([\d\s,]+[\.-]?\s*\d{2})"
PAYSLIP = {
    "name": {
        "words": ("nama", "nama pekerja", "name", "employee name"),
        "pattern": _NAME,
        "more": (
            r"(?:Nama|NAMA|Name)\s*[:\-]?\s*([A-Z][A-Z\s]+(?:BIN|BINTI|Bin|Binti)\s+[A-Z][A-Z\s]+)",
            r"(?:Nama|NAMA|Name)\s*[:\-]?\s*([A-Z][a-z]+(?:\s+(?:bin|binti|Bin|Binti)\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
            r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,5})(?=\s+(?:No|Kump|bin|binti))",
            r"^([A-Z][a-z]+(?:\s+(?:bin|binti)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*))(?=\s+No)",
        ),
        "not_near": ("syarikat", "company", "sdn", "bhd", "bank", "penyata", "bulanan"),
    },
    "id_number": {
        "words": ("no. k/p", "no kp", "no k/p", "no ic", "nric"),
        "pattern": r"\d{6}-?\d{2}-?\d{4}",
        "more": (
            r"(?:no\.?\s*k/?p|no\.?\s*kp|no\.?\s*ic)\s*[:\-]?\s*(\d{6}-?\d{2}-?\d{4})",
            r"(?:no\.?\s*k/?p|no\.?\s*kp|no\.?\s*ic)\s*[:\-]?\s*(\d{12})",
            r"(?<!\d)(\d{6}-\d{2}-\d{4})(?!\d)",
            r"(?<!\d)(\d{12})(?!\d)",
        ),
        "not_near": ("amaun", "rm", "jumlah", "total", "amount", "gaji", "no gaji", "no siri"),
    },
    "gross_income": {
        "more": (
            rf"(?:Jumlah|Junlah)\s+Pendapatan\s+{_MONEY}",
            rf"(?:jumlah|junlah)\s+pendapatan\s+{_MONEY}",
            rf"(?:Surlah|Sumlah)\s+Pepdapatan\s+{_MONEY}",
            rf"(?:Pendapatan|PENDAPATAN)\s+(?:Kasar|KASAR)\s+{_MONEY}",
            rf"(?:Gross|GROSS)\s+(?:Income|INCOME)\s+{_MONEY}",
        ),
        "not_near": ("bersih", "potongan", "deduction", "pcrorgan", "net"),
    },
    "total_deduction": {
        "more": (
            rf"(?:Jumlah|Junlah|Sulab)\s+(?:Potongan|Pcrorgan)\s+{_MONEY_OPEN}",
            rf"(?:jumlah|junlah|sulab)\s+(?:potongan|pcrorgan)\s+{_MONEY_OPEN}",
            rf"Total\s+Deduction\s+{_MONEY_OPEN}",
        ),
        "items": (
            rf"(?:KWSP|EPF)\s+{_MONEY_OPEN}",
            rf"(?:Perkeso|SOCSO)\s+{_MONEY_OPEN}",
            rf"(?:Cukai|Cuxai|Tax)\s+(?:Pedapatan|Pendapatan|Pepdapacar)?\s+{_MONEY_OPEN}",
            rf"(?:Takaful|Insurance)\s+{_MONEY_OPEN}",
            rf"(?:PIIN|Perumahan)\s+{_MONEY_OPEN}",
        ),
        "not_near": ("gross", "jumlah pendapatan", "bersih", "junlah", "gaji"),
    },
    "net_income": {
        "more": (
            rf"Gaji[:\s]+Bersih\s+{_MONEY}",
            rf"Gaj:[:\s]+Bersil\s+{_MONEY}",
            rf"(?:gaji|gaj:)\s+(?:bersih|bersil|bersin)\s+{_MONEY}",
            rf"Net\s+(?:Income|Salary)\s+{_MONEY}",
        ),
        "not_near": ("gross", "jumlah pendapatan", "potongan", "junlah"),
    },
    "month_year": {
        "words": ("m/s", "bulan", "month"),
        "pattern": r"\d{1,2}/\d{1,4}",
        "more": (r"M/S\s*[:\-]?\s*(\d{1,2})/(\d{1,2})", r"(\d{1,2}/\d{1,2})"),
        "not_near": (),
    },
}
#: Labels on a page whose line breaks are kept.
PAGE_ID = (r"(?i)No\. K/P\s*:?\s*(\d{12}|\d{6}-\d{2}-\d{4})", r"(?i)No KP\s*:?\s*(\d{12}|\d{6}-\d{2}-\d{4})")
PAGE_GROSS = r"(?i)Jumlah\s+Pendapatan\s*:\s*([\d,]+\.[\d]{2})"
PAGE_DEDUCTION = r"(?i)Jumlah\s+Potongan\s*:\s*([\d,]+\.[\d]{2})"
PAGE_NET = r"(?i)Gaji\s+Bersih\s*:\s*([\d,]+\.[\d]{2})"
PAGE_NAMES = (
    r"(?i)Nama\s*:\s*([A-Z][A-Z\s]+(?:BIN|BINTI)\s+[A-Z][A-Z\s]+?)\s+Bulan",
    r"(?i)Nama\s*:\s*([A-Z][a-z]+(?:\s+(?:bin|binti|Bin|Binti)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)?)\s+Bulan",
    r"(?i)Nama\s*:\s*([A-Z][A-Z\s]+(?:BIN|BINTI)\s+[A-Z][A-Z\s]+)",
)
NAME_NEVER = ("PENYATA", "GAJI", "BULANAN", "NAMA")
#: Month names in the order in which they are looked for in a value.
MONTH_NAMES = {
    "januari": "01", "februari": "02", "mac": "03", "april": "04", "mei": "05", "jun": "06", "julai": "07", "ogos": "08",
    "september": "09", "oktober": "10", "november": "11", "disember": "12", "january": "01", "february": "02", "march": "03",
    "may": "05", "june": "06", "july": "07", "august": "08", "october": "10", "december": "12", "jan": "01", "feb": "02",
    "mar": "03", "apr": "04", "jul": "07", "agu": "08", "aug": "08", "sep": "09", "okt": "10", "oct": "10", "nov": "11",
    "des": "12", "dec": "12",
}

# --- thresholds ----------------------------------------------------------------------------

TEXT_LAYER_CHARS = 100
LOW_CONFIDENCE = 0.6
MATCH_IOU = 0.5
RUN_GAP = 10.0
RUN_TOLERANCE = 5.0
LINE_STEP = 10.0
LINE_TOLERANCE = 5.0
BELOW_REACH = 50.0
SCORE_REACH = 200.0
SCORE_LEAST = 0.5
SCORE_WEIGHTS = (0.3, 0.3, 0.25, 0.15)  # recognition, numeric, nearness, relation
RELATION = {"right": 1.0, "below": 0.7}
CONFIDENCE_WEIGHTS = (0.45, 0.30, 0.20, 0.05)  # recognition, pattern, nearness, source
CONFIDENCE_DEFAULT = 0.6
CONFIDENCE_PDF = 0.15
MOST_MONEY = 999999.99
DEFAULT_YEAR = "2025"

#: Label words of a bank record's fields on a page, and words that must not stand near a value.
LAYOUT_FIELDS = {
    "account_holder_name": (("ENCIK", "PUAN", "account holder", "name", "nama", "account name"), ()),
    "account_number": (("ACCOUNT NO", "NO AKAUN", "account number", "account no", "akaun", "no akaun", "ACC NO", "A/C NO"), ()),
    "statement_date": (("STATEMENT DATE", "TARIKH PENYATA", "date", "statement date", "tarikh penyata", "tarikh", "period"), ()),
    "opening_balance": (
        ("opening", "opening balance", "beginning balance", "baki awal", "BAKI AWAL", "baki hadapan", "BAKI HADAPAN", "BAL B/F", "BAKI B/F"),
        ("peratus", "rate", "kadar", "%", "percent"),
    ),
    "closing_balance": (
        ("closing", "closing balance", "ending balance", "balance", "baki akhir", "baki penutup", "BAKI AKHIR", "BAKI PENUTUP", "BALANCE", "BAL C/F", "BAKI C/F"),
        ("peratus", "rate", "kadar", "%", "percent", "available", "tersedia"),
    ),
    "total_debit": (("total debit",), ()),
    "total_credit": (("total credit",), ()),
    "statement_period_from": (("statement period from",), ()),
    "statement_period_to": (("statement period to",), ()),
}
