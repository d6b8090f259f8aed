"""Literal tables of the scalar functions and of records, pages and tokens."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import classify, dates, numbers
from paperloom.functions.text import clean_text, fix_lookalikes, postprocess
from paperloom.operators import bank, ensemble, pages, payslip, tokens, validate
from paperloom.sources import settings


def column(spark, values, make):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


MONEY = ["1,234.56", "1,23456", "12,34", "1.234.56", "RM 1 234.56", "-5.00", "9-90", "", None]


@pytest.mark.parametrize(
    ("make", "expected"),
    [
        (numbers.clean_currency, ["1234.56", "1234.56", "1234.00", "1234.56", "1234.56", "5.00", "990.00", "0.00", "0.00"]),
        (numbers.parse_number, [1234.56, 123456.0, 12.34, None, 1234.56, -5.0, None, None, None]),
        (lambda c: numbers.normalize_number(c, "generic").cast("double"), [1234.56, 123456.0, 1234.0, 0.0, 0.0, -5.0, 0.0, 0.0, 0.0]),
        (lambda c: numbers.normalize_number(c, "bsn").cast("double"), [1234.56, 123456.0, 1234.0, 1234.56, 0.0, -5.0, 0.0, 0.0, 0.0]),
        (numbers.payslip_currency, ["1234.56", "123456.00", "1234.00", "0.00", "1234.56", "0.00", "9.90", "0.00", "0.00"]),
    ],
)
def test_money(spark, make, expected):
    assert column(spark, MONEY, make) == expected


def test_dates(spark):
    given = ["28/02/2026", "29/02/2025", "31/04/2025", "32/13/2025", "31/07/25", "01/01/1999", "20 May 2025", None]
    assert column(spark, given, dates.valid_date) == ["28/02/2026", "29/02/2025", None, None, "31/07/25", None, None, None]
    assert column(spark, given, dates.valid_or_clamped_date) == ["28/02/2026", "29/02/2025", None, "31/12/2025", "31/07/25", "01/01/2000", None, None]
    assert column(spark, given[:3], lambda c: dates.as_date(c).cast("string")) == ["2026-02-28", None, None]


def test_identifiers(spark):
    assert column(spark, ["900101145555", "12-34"], dates.twelve_digits) == ["900101-14-5555", None]
    assert column(spark, ["900101145555", "12-34"], dates.clean_id_number) == ["900101-14-5555", "12-34"]
    assert column(spark, ["3/2026", "13/2026"], dates.clean_month_year) == ["03/2026", "13/2026"]
    with_year = lambda c: dates.format_month_year(c, F.lit("paid 2025"))
    assert column(spark, ["1/22", "22/1", "JANUARI 2025", "x"], with_year) == ["01/2025", "01/2025", "01/2025", "x"]


def test_text(spark):
    assert column(spark, ["a\n b c 10% (x) é", None, ""], clean_text) == ["a b c 10 x é", "", ""]
    assert column(spark, ["1 , 234 . 50", "12 345", "1 2 3"], postprocess) == ["1,234.50", "12,345", "123"]
    assert column(spark, ["1O5", "Ohm"], fix_lookalikes) == ["105", "Ohm"]


def test_classes(spark):
    assert column(spark, ["", None, "Salary transaction"], lambda c: classify.document_type(c)["document_type"]) == ["unknown", "unknown", "bank_statement"]
    assert column(spark, ["Account deposit jumlah"], lambda c: classify.old_document_type(c)["bank_hits"]) == [4]
    assert column(spark, ["BANK SIMPANAN NASIONAL CIMB BANK", "x"], lambda c: classify.issuing_bank(c)["bank"]) == ["bsn", "generic"]
    assert column(spark, ["dan untuk gaji yang dengan", "short"], lambda c: classify.language(c)["language"]) == ["ms", "en"]


STATEMENTS = {
    "cimb": "CIMB BANK BERHAD ALPHA BETA BINTI GAMMA 12, JALAN SATU Statement Date 28/02/2026 Account No 51-0000123-4 Transaction Details 01/02/2026 OPENING BALANCE 1,550.00 03/02/2026 TRANSFER 250.00 1,800.00 25/02/2026 PAYMENT 51.23 1,748.77 CLOSING BALANCE 1,748.77 End of Statement",
    "bsn": "BSN PENYATA AKAUN 1234567890123456 ALPHA ANAK BETA No.Akaun Statement Date: 01/08/2025 01JUL Baki Hadapan 19.54 05JUL GAJI 1.200.00 29JUL BAYARAN 1.109.38 Baki Sedia Ada 110.16 Jumlah Debit 1.109.38 Jumlah Kredit 1.200.00",
    "bank_islam": "BANK ISLAM ENCIK ALPHA BIN BETA TARIKH PENYATA 31/07/25 ACCOUNT NO 12345678901234 BAL B/F 142.52 01/07/25 TRANSFER 20.00 RINGKASAN AKAUN TOTAL DEBIT 4,340.78 TOTAL CREDIT 4,320.86",
    "public_islamic": "PUBLIC ISLAMIC BANK PUAN ALPHA BETA 1234567890 Nombor Akaun Tarikh Penyata 20 May 2025 Balance From Last Statement 48.20 RINGKASAN 21,968.67 Jumlah Debit 21,941.00 Jumlah Kredit Baki Penutup 20.53",
}
RECORDS = {
    "cimb": ("51-0000123-4", "ALPHA BETA BINTI GAMMA", "28/02/2026", "1550.00", "1748.77", None, None, "01/02/2026", "25/02/2026"),
    "bsn": ("1234567890123456", "ALPHA ANAK BETA", "01/08/2025", "19.54", "110.16", "1109.38", "1200.00", "01/07/2025", "29/07/2025"),
    "bank_islam": ("12345678901234", "ENCIK ALPHA BIN BETA", "31/07/25", "142.52", "122.60", "4340.78", "4320.86", "31/07/2025", "01/07/2025"),
    "public_islamic": ("1234567890", "PUAN ALPHA BETA", "20 May 2025", "48.20", "20.53", "21968.67", "21941.00", None, None),
}


def test_bank_records(spark):
    df = spark.createDataFrame(list(STATEMENTS.items()), "k string, text string")
    got = {r.k: r for r in bank.bank_record(df).collect()}
    for name, expected in RECORDS.items():
        assert got[name].detected_bank == name
        assert tuple(got[name][f] for f in bank.FIELDS) == expected


def test_payslip_page(spark):
    page = "Nama : ALPHA BETA BIN GAMMA Bulan : JANUARI 2025\nNo KP : 900101145555\nJumlah Pendapatan : 5,224.34 Jumlah Potongan : 1,508.50\nGaji Bersih : 3,715.84\nM/S : 1/22"
    df = spark.createDataFrame([(page,)], "page_text string").withColumn("text", clean_text(F.col("page_text")))
    r = payslip.page_record(df).first()
    assert tuple(r[f] for f in payslip.FIELDS) == ("ALPHA BETA BIN GAMMA", "900101145555", "5224.34", "3715.84", "1508.50", "01/2025")


PAGES = [
    (1, "A", "10.00", "0.00", None, "5.00", "d1", "d2"), (2, "A", "0.00", "12.00", "3.00", None, "d3", None), (3, None, "0.00", "7.00", None, None, None, None),
    (4, None, "0.00", "8.00", None, None, None, None), (5, "B", "1.00", "2.00", None, None, None, None), (6, "A", "9.00", "9.00", None, None, None, None),
]


def test_page_merge(spark):
    schema = "document_number int, account_number string, opening_balance string, closing_balance string, total_debit string, total_credit string, statement_period_from string, statement_period_to string"
    df = spark.createDataFrame(PAGES, schema).selectExpr(
        "*", "'u' as upload_id", "'bank_statement' as document_type", "'h' as account_holder_name", "'d' as statement_date", "cast(null as string) as available_balance",
        "'cimb' as detected_bank", "0.5D as confidence_score", "10 as text_length",
    )
    got = pages.merge_islands(pages.islands(df)).orderBy("document_number").collect()
    assert [r.page_count for r in got] == [2, 1, 1, 1, 1]
    m = got[0]
    assert (m.opening_balance, m.closing_balance, m.total_debit, m.total_credit, m.statement_period_from, m.statement_period_to) == ("10.00", "12.00", "3.00", "5.00", "d1", "d2")


def token_rows(spark, rows):
    schema = "upload_id int, page int, token_ix int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
    return spark.createDataFrame([(1, 1, i, t, 0.9, *map(float, box)) for i, (t, box) in enumerate(rows, 1)], schema)


def test_tokens(spark):
    runs = tokens.merge_runs(token_rows(spark, [("1,", (0, 0, 10, 5)), ("234", (15, 0, 30, 5)), ("RM", (40, 0, 50, 5)), ("10.00", (52, 0, 60, 5))])).orderBy("token_ix").collect()
    assert [(r.text, r.x0, r.x1) for r in runs] == [("1,234", 0, 30), ("RM", 40, 50), ("10.00", 52, 60)]
    text = tokens.page_text(token_rows(spark, [("a", (0, 0, 1, 5)), ("b", (0, 9, 1, 14)), ("c", (0, 18, 1, 23)), ("d", (0, 30, 1, 35))])).first().text
    assert text == "a b c\nd"
    lined = tokens.cluster_lines(token_rows(spark, [("a", (0, 0, 1, 2)), ("b", (2, 3, 3, 7)), ("c", (4, 7, 5, 11))])).orderBy("token_ix").collect()
    assert [r.line for r in lined] == [0, 0, 1]


def test_votes(spark):
    base = token_rows(spark, [("A", (0, 0, 10, 10))])
    make = lambda texts: [base.withColumns({"text": F.lit(t), "engine_ix": F.lit(i)}) for i, t in enumerate(texts)]

    def vote(texts):
        first, *rest = make(texts)
        for r in rest:
            first = first.unionByName(r)
        return ensemble.vote(base, first).first()

    r = vote(["A", "B", "B"])
    assert (r.text, r.vote_count, round(r.vote_agreement, 2)) == ("B", 2, 66.67)
    assert vote(["A", "B"]).text == "A"
    box = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    assert round(box.select(ensemble.iou("a", "b")).first()[0], 4) == 0.3333


def test_verdicts(spark):
    schema = "name string, id_number string, gross_income string, net_income string, total_deduction string, month_year string"
    df = spark.createDataFrame([("A", "900101-14-5555", "10.00", "8.00", "2.00", "01/2024"), (None, None, "10.00", "8.00", "2.00", "13/2024")], schema)
    got = df.select(validate.payslip_verdict().alias("v"), validate.sums_agree().alias("s"), validate.range_errors().alias("e")).collect()
    assert got[0].v.is_valid and got[0].s and got[0].e == []
    assert got[1].v.validation_message == "Missing fields: name, id_number" and got[1].e == ["Invalid month: 13"]


def test_settings():
    assert settings.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert settings.layered([{"api": {"max_upload_mb": 5}}], {"API_MAX_UPLOAD_MB": "7"})["api"]["max_upload_mb"] == 7
    assert settings.load("/nowhere.json") == {}
    assert settings.steps_in_order({"b": {"enabled": True}, "a": {"enabled": True, "order": 1}, "c": {"enabled": False}}) == ["a", "b"]
