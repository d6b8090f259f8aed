"""Registered queries of the document operators, with the SQL that gives the same rows.

The test tables hold no statements or payslips, so most queries render them from relational
columns and extract them again; their SQL selects the values that went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import samples
from paperloom.functions import classify, dates, numbers, rules
from paperloom.functions.text import clean_text, postprocess
from paperloom.operators import bank, ensemble, older, pages, payslip, spatial, tokens, validate
from paperloom.plans import results, scratch, sqlfunctions
from paperloom.registry import ORACLES
from paperloom.registry import query as _query
from paperloom.samples import SQL_PAGES, SQL_PAYSLIPS, SQL_STATEMENTS, SQL_TOKENS, table

def _contains(column: str, words) -> str:
    return " + ".join("contains({}, '{}')::INT".format(column, w.replace("'", "''")) for w in words)


# --- text and classes ----------------------------------------------------------------------


@_query(r"""
SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '[^\pL\pN_\s\-./,:]', '', 'g')))::BIGINT AS n_clean,
  md5(trim(regexp_replace(regexp_replace(text, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '[^\pL\pN_\s\-./,:]', '', 'g'))) AS clean_md5
FROM documents
""")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("clean"))
    return t.select("doc_id", F.length("clean").cast("long").alias("n_clean"), F.md5("clean").alias("clean_md5"))


def _language_sql() -> str:
    count = {k: _contains("low", [w for g in v for w in g]) for k, v in rules.LANGUAGE_WORDS.items()}
    return f"""
WITH d AS (SELECT doc_id, lower(text) AS low FROM documents), c AS (SELECT doc_id, low, {count["en"]} AS en, {count["ms"]} AS ms, {count["ar"]} AS ar FROM d)
SELECT doc_id, en, ms, ar,
  CASE WHEN length(trim(low)) < 10 OR en + ms + ar = 0 OR en >= greatest(ms, ar) THEN 'en' WHEN ms >= ar THEN 'ms' ELSE 'ar' END AS language,
  CASE WHEN length(trim(low)) < 10 OR en + ms + ar = 0 THEN 0.0::DOUBLE ELSE greatest(en, ms, ar) / (en + ms + ar) END AS raw_confidence
FROM c"""


@_query(_language_sql())
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", classify.language(F.col("text")).alias("l"))
    return d.select("doc_id", "l.en", "l.ms", "l.ar", "l.language", "l.raw_confidence")


def _class_sql(bank_words, payslip_words, tie: str) -> str:
    return f"""
WITH {SQL_STATEMENTS}, t AS (
  SELECT doc_id AS id, lower(text) AS low FROM documents
  UNION ALL SELECT -1 - c_custkey, lower(CASE c_custkey % 3 WHEN 0 THEN 'Account No 1 Statement Date Opening Balance ' WHEN 1 THEN 'Payslip Gaji Bersih KWSP ' ELSE 'Transaction Salary ' END || c_name) FROM customer
), c AS (SELECT id, {_contains("low", bank_words)} AS bank_hits, {_contains("low", payslip_words)} AS payslip_hits FROM t)
SELECT id, bank_hits, payslip_hits,
  CASE WHEN bank_hits + payslip_hits = 0 THEN 'unknown' WHEN bank_hits > payslip_hits THEN 'bank_statement' WHEN payslip_hits > bank_hits THEN 'payslip' ELSE '{tie}' END AS document_type,
  CASE WHEN bank_hits + payslip_hits = 0 THEN 0.0::DOUBLE WHEN bank_hits = payslip_hits THEN 0.5 ELSE greatest(bank_hits, payslip_hits) / (bank_hits + payslip_hits) END AS raw_confidence
FROM c"""


def _class_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, "Account No 1 Statement Date Opening Balance ").when(k % 3 == 1, "Payslip Gaji Bersih KWSP ").otherwise("Transaction Salary ")
    made = table(spark, sf_dir, "customer").select((-1 - k).alias("id"), F.concat(said, F.col("c_name")).alias("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(made)


@_query(_class_sql(rules.BANK_WORDS, rules.PAYSLIP_WORDS, "bank_statement"))
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _class_input(spark, sf_dir).select("id", classify.document_type(F.col("text")).alias("c"))
    return d.select("id", "c.bank_hits", "c.payslip_hits", "c.document_type", "c.raw_confidence")


@_query(_class_sql(rules.OLD_BANK_WORDS, rules.OLD_PAYSLIP_WORDS, "unknown"))
def classify_documents_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _class_input(spark, sf_dir).select("id", classify.old_document_type(F.col("text")).alias("c"))
    return d.select("id", "c.bank_hits", "c.payslip_hits", "c.document_type", "c.raw_confidence")


@_query("""
SELECT conv_id AS upload_id, coalesce(sum(length(text)) FILTER (turn < 3), 0)::BIGINT AS text_chars, coalesce(sum(length(text)) FILTER (turn < 3), 0) > 100 AS is_digital
FROM conversations WHERE turn < 3 GROUP BY conv_id
""")
def digital_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("page"), "text")
    return classify.digital_uploads(p).select("upload_id", "text_chars", "is_digital")


@_query("""
SELECT conv_id AS upload_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> '')) AS text_md5, count(*) AS pages FROM conversations GROUP BY conv_id
""")
def upload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.sources import landing

    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("page"), "text")
    return landing.whole_texts(p).join(landing.page_counts(p), "upload_id").select("upload_id", F.md5("text").alias("text_md5"), "pages")


@_query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, p, s, q || ',' || lpad((p % 1000)::VARCHAR, 3, '0') || '.' || lpad((s % 100)::VARCHAR, 2, '0') AS fixed, count(*) AS n FROM t GROUP BY ALL
""")
def postprocess_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("q"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    said = F.concat(F.col("q"), F.lit(" , "), F.lpad((F.col("p") % 1000).cast("string"), 3, "0"), F.lit(" . "), F.lpad((F.col("s") % 100).cast("string"), 2, "0"))
    return t.select("l_orderkey", "l_linenumber", "p", "s", postprocess(said).alias("fixed")).groupBy("l_orderkey", "l_linenumber", "p", "s", "fixed").agg(F.count("*").alias("n"))


# --- money, dates, identifiers -------------------------------------------------------------


def _money_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    v = F.col("o_totalprice").cast("decimal(18,2)")
    plain, comma = v.cast("string"), F.format_number(v, 2)
    shapes = F.array(plain, comma, F.concat(F.lit("RM "), comma), F.translate(comma, ",", "."), F.translate(plain, ".", "-"), F.concat(F.lit("-"), plain), F.lit(""), F.translate(comma, ".", ""))
    return o.select("o_orderkey", v.alias("v"), F.element_at(shapes, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("said"))


_V = "o_totalprice::DECIMAL(18,2)"
_CENTS = f"({_V} * 100)::BIGINT"


@_query(f"""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 4 THEN {_CENTS} || '.00' WHEN 6 THEN '0.00'
  WHEN 7 THEN CASE WHEN {_V} >= 1000 THEN {_V}::VARCHAR ELSE {_CENTS} || '.00' END ELSE {_V}::VARCHAR END AS cleaned FROM orders
""")
def money_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money_shapes(spark, sf_dir).select("o_orderkey", numbers.clean_currency(F.col("said")).alias("cleaned"))


@_query(f"""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 3 THEN CASE WHEN {_V} >= 1000 THEN NULL ELSE {_V}::DOUBLE END WHEN 4 THEN NULL WHEN 5 THEN -({_V}::DOUBLE) WHEN 6 THEN NULL
  WHEN 7 THEN {_CENTS}::DOUBLE ELSE {_V}::DOUBLE END AS parsed FROM orders
""")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money_shapes(spark, sf_dir).select("o_orderkey", numbers.parse_number(F.col("said")).alias("parsed"))


@_query(f"""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN '0.00' WHEN 4 THEN '0.00' WHEN 5 THEN '-' || {_V}::VARCHAR WHEN 6 THEN '0.00' WHEN 7 THEN {_CENTS} || '.00' ELSE {_V}::VARCHAR END AS bsn,
  CASE o_orderkey % 8 WHEN 2 THEN '0.00' WHEN 3 THEN CASE WHEN {_V} >= 1000 THEN '0.00' ELSE {_V}::VARCHAR END WHEN 4 THEN '0.00' WHEN 5 THEN '-' || {_V}::VARCHAR WHEN 6 THEN '0.00' WHEN 7 THEN {_CENTS} || '.00' ELSE {_V}::VARCHAR END AS other
FROM orders
""")
def money_by_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _money_shapes(spark, sf_dir)
    return m.select("o_orderkey", numbers.money_text(numbers.normalize_number(F.col("said"), "bsn")).alias("bsn"), numbers.money_text(numbers.normalize_number(F.col("said"), "cimb")).alias("other"))


@_query(f"""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 3 THEN CASE WHEN {_V} >= 1000 THEN '0.00' ELSE {_V}::VARCHAR END WHEN 5 THEN '0.00' WHEN 6 THEN '0.00' WHEN 7 THEN {_CENTS} || '.00' ELSE {_V}::VARCHAR END AS cleaned FROM orders
""")
def money_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money_shapes(spark, sf_dir).select("o_orderkey", numbers.payslip_currency(F.col("said")).alias("cleaned"))


_DAY = "(o_orderkey % 35)::INT"
_MONTH = "(o_custkey % 14)::INT"
_YEAR = "(1990 + o_orderkey % 120)::INT"
_GOOD = "({m} BETWEEN 1 AND 12 AND {y} BETWEEN 2000 AND 2099 AND {d} BETWEEN 1 AND (CASE WHEN {m} = 2 THEN 29 WHEN {m} IN (4, 6, 9, 11) THEN 30 ELSE 31 END))"


@_query(f"""
WITH p AS (SELECT o_orderkey, {_DAY} AS d, {_MONTH} AS m, {_YEAR} AS y, least(greatest({_DAY}, 1), 31) AS cd, least(greatest({_MONTH}, 1), 12) AS cm, least(greatest({_YEAR}, 2000), 2099) AS cy FROM orders),
s AS (SELECT *, printf('%02d/%02d/%d', d, m, y) AS said FROM p)
SELECT o_orderkey, CASE WHEN {_GOOD.format(d="d", m="m", y="y")} THEN said END AS valid,
  CASE WHEN {_GOOD.format(d="d", m="m", y="y")} THEN said WHEN {_GOOD.format(d="cd", m="cm", y="cy")} THEN printf('%02d/%02d/%d', cd, cm, cy) END AS fixed FROM s
""")
def date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.format_string("%02d/%02d/%d", (k % 35).cast("int"), (c % 14).cast("int"), (1990 + k % 120).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    return o.select("o_orderkey", dates.valid_date(F.col("said")).alias("valid"), dates.valid_or_clamped_date(F.col("said")).alias("fixed"))


@_query("""
SELECT c_custkey, '900101-' || substr(lpad(c_custkey::VARCHAR, 6, '0'), 1, 2) || '-' || substr(lpad(c_custkey::VARCHAR, 6, '0'), 3, 4) AS nric,
  CASE WHEN c_custkey % 2 = 0 THEN '900101-' || substr(lpad(c_custkey::VARCHAR, 6, '0'), 1, 2) || '-' || substr(lpad(c_custkey::VARCHAR, 6, '0'), 3, 4) ELSE '12-' || c_custkey END AS id_number,
  CASE WHEN c_custkey % 15 BETWEEN 1 AND 12 THEN lpad((c_custkey % 15)::VARCHAR, 2, '0') ELSE (c_custkey % 15)::VARCHAR END || '/2024' AS month_year,
  lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '/2023' AS period
FROM customer
""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    digits = F.concat(F.lit("900101"), F.lpad(k.cast("string"), 6, "0"))
    short = F.concat(F.lit("12-"), k.cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        dates.twelve_digits(digits).alias("nric"),
        dates.clean_id_number(F.when(k % 2 == 0, digits).otherwise(short)).alias("id_number"),
        dates.clean_month_year(F.concat((k % 15).cast("string"), F.lit("/2024"))).alias("month_year"),
        dates.format_month_year(F.concat((k % 12 + 1).cast("string"), F.lit("/22")), F.lit("paid in 2023 for work")).alias("period"),
    )


# --- records -------------------------------------------------------------------------------


@_query(f"WITH {SQL_STATEMENTS} SELECT upload_id, bank, CASE WHEN bank = 'generic' THEN 0.3 ELSE 1.0 END::DOUBLE AS confidence FROM st")
def bank_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples.statements(spark, sf_dir).select("upload_id", classify.issuing_bank(F.col("text")).alias("b"))
    return s.select("upload_id", "b.bank", "b.confidence")


def _bank_sql(name: str, account: str, holder: str, day: str, opening: str, closing: str, debit: str, credit: str, start: str, end: str) -> str:
    return f"""WITH {SQL_STATEMENTS} SELECT upload_id, {account} AS account_number, {holder} AS account_holder_name, {day} AS statement_date, {opening} AS opening_balance,
  {closing} AS closing_balance, {debit} AS total_debit, {credit} AS total_credit, {start} AS statement_period_from, {end} AS statement_period_to, '{name}' AS detected_bank FROM st WHERE bank = '{name}'"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned statements with the bank that is detected in their text, written as typed pages are."""
    s = samples.statements(spark, sf_dir).select("upload_id", clean_text(F.col("text")).alias("text")).withColumn("__b", classify.issuing_bank(F.col("text")))
    return scratch.checkpointed(s.select("upload_id", "text", F.col("__b.bank").alias("detected_bank"), F.col("__b.confidence").alias("bank_detection_confidence")))


def _extract(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    s = _detected(spark, sf_dir).where(F.col("detected_bank") == name)
    return bank.by_bank_record(s).select("upload_id", *bank.FIELDS, "detected_bank")


_FULL = "strftime({}, '%d/%m/%Y')"
_TEXT = "{}::VARCHAR"


@_query(_bank_sql("cimb", "'51-' || lpad(upload_id::VARCHAR, 7, '0') || '-' || upload_id % 10", "'ALPHA ' || letters || ' BINTI GAMMA'", _FULL.format("d0"),
                  "CASE WHEN balance <= 0 THEN '0.00' ELSE balance::VARCHAR END", _TEXT.format("closing"), "NULL::VARCHAR", "NULL::VARCHAR", _FULL.format("d1"), _FULL.format("d2")))
def extract_cimb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(spark, sf_dir, "cimb")


@_query(_bank_sql("bsn", "lpad(upload_id::VARCHAR, 16, '1')", "'ALPHA ' || letters || ' ANAK BETA'", _FULL.format("d0"), _TEXT.format("opening"), _TEXT.format("closing"),
                  _TEXT.format("debit"), _TEXT.format("credit"), "'01/07/' || year(d0)", "'29/07/' || year(d0)"))
def extract_bsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(spark, sf_dir, "bsn")


@_query(_bank_sql("bank_islam", "lpad(upload_id::VARCHAR, 14, '1')", "'ENCIK ALPHA ' || letters", "strftime(d0, '%d/%m/%y')", _TEXT.format("opening"),
                  "(opening + credit - debit)::DECIMAL(18,2)::VARCHAR", _TEXT.format("debit"), _TEXT.format("credit"), _FULL.format("d0"), _FULL.format("d1")))
def extract_bank_islam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(spark, sf_dir, "bank_islam")


@_query(_bank_sql("public_islamic", "lpad(upload_id::VARCHAR, 10, '1')", "'PUAN ALPHA ' || letters", "strftime(d0, '%d %B %Y')", _TEXT.format("opening"), _TEXT.format("closing"),
                  _TEXT.format("debit"), _TEXT.format("credit"), "NULL::VARCHAR", "NULL::VARCHAR"))
def extract_public_islamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(spark, sf_dir, "public_islamic")


@_query(_bank_sql("generic", "lpad(upload_id::VARCHAR, 12, '1')", "'ENCIK ALPHA ' || letters", _FULL.format("d0"), _TEXT.format("opening"), _TEXT.format("closing"),
                  _TEXT.format("debit"), _TEXT.format("credit"), _FULL.format("d1"), _FULL.format("d2")))
def extract_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(spark, sf_dir, "generic")


_PAYSLIP_COLUMNS = "gross::VARCHAR AS gross_income, net::VARCHAR AS net_income, deduction::VARCHAR AS total_deduction, lpad(month::VARCHAR, 2, '0')"


@_query(f"WITH {SQL_PAYSLIPS} SELECT upload_id, 'ALPHA ' || letters || ' BIN GAMMA' AS name, '900101' || lpad(upload_id::VARCHAR, 6, '0') AS id_number, {_PAYSLIP_COLUMNS} || '/2024' AS month_year FROM ps")
def extract_payslip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payslip.payslip_record(samples.payslips(spark, sf_dir)).select("upload_id", *payslip.FIELDS)


@_query(f"WITH {SQL_PAYSLIPS} SELECT upload_id, 'ALPHA ' || letters || ' BIN GAMMA' AS name, '900101' || lpad(upload_id::VARCHAR, 6, '0') AS id_number, {_PAYSLIP_COLUMNS} || '/2025' AS month_year FROM ps")
def extract_payslip_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = samples.payslip_pages(spark, sf_dir).withColumn("text", clean_text(F.col("page_text")))
    return payslip.page_record(p).select("upload_id", *payslip.FIELDS)


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN (150.25 + s_suppkey % 500)::DECIMAL(18,2)::VARCHAR END AS total FROM supplier")
def deduction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    one = F.concat(F.lit("KWSP "), F.format_number((F.lit(100) + k % 500).cast("decimal(18,2)"), 2), F.lit(" ringgit "))
    text = F.when(k % 2 == 0, F.concat(one, F.lit("Takaful 50.25 dan"))).otherwise(one)
    return table(spark, sf_dir, "supplier").select("s_suppkey", payslip.deduction_items(text).alias("total"))


@_query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate + INTERVAL 3 YEAR AS d FROM orders)
SELECT o_custkey, strftime(arg_min(d, o_orderkey) FILTER (year(d) >= 2000), '%d/%m/%Y') AS first_date, strftime(arg_max(d, o_orderkey) FILTER (year(d) >= 2000), '%d/%m/%Y') AS last_date FROM o GROUP BY 1
""")
def transaction_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.date_format(F.add_months("o_orderdate", 36), "dd/MM/yyyy"), F.lit(" PAYMENT"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"])
    t = o.groupBy("o_custkey").agg(F.concat(F.lit("Transaction Details "), F.array_join(lines, " "), F.lit(" End of Statement")).alias("text"))
    none = F.lit(None).cast("string")
    return t.select("o_custkey", dates.first_transaction_date(F.col("text"), none).alias("first_date"), dates.last_transaction_date(F.col("text"), none).alias("last_date"))


@_query(f"""
WITH {SQL_STATEMENTS}, n AS (SELECT upload_id, CASE bank WHEN 'cimb' THEN 9 WHEN 'bsn' THEN 12 WHEN 'public_islamic' THEN 9 ELSE 11 END AS known, CASE bank WHEN 'bsn' THEN 12 ELSE 11 END AS whole FROM st)
SELECT upload_id, known / whole AS completeness FROM n
""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bank.by_bank_record(_detected(spark, sf_dir))
    return r.select("upload_id", bank.bank_completeness(r).alias("completeness"))


@_query(f"""
WITH {SQL_STATEMENTS} SELECT upload_id, 'Alpha ' || letters AS account_holder_name, '51-' || lpad(upload_id::VARCHAR, 7, '0') || '-' || upload_id % 10 AS account_number,
  {_FULL.format("d0")} AS statement_date, opening::VARCHAR AS opening_balance, closing::VARCHAR AS closing_balance FROM st
""")
def extract_older_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("upload_id").cast("string")
    text = F.concat(
        F.date_format("d0", "dd/MM/yyyy"), F.lit(" Alpha "), F.col("letters"), F.lit(" 12, JALAN SATU Account 51-"), F.lpad(k, 7, "0"), F.lit("-"), (F.col("upload_id") % 10).cast("string"),
        F.lit("\nOPENING BALANCE "), F.format_number("opening", 2), F.lit("\nCLOSING BALANCE "), F.format_number("closing", 2), F.lit(" End of Statement"),
    )
    r = older.bank_record(samples.statement_values(spark, sf_dir).select("upload_id", text.alias("text")))
    return r.select("upload_id", "account_holder_name", "account_number", "statement_date", "opening_balance", "closing_balance")


@_query(f"""
WITH {SQL_PAYSLIPS} SELECT upload_id, 'ALPHA ' || letters AS name, floor(gross)::BIGINT || '.00' AS gross_income, floor(deduction)::BIGINT || '.00' AS total_deduction, (floor(gross)::BIGINT - floor(deduction)::BIGINT) || '.00' AS net_income,
  lpad(month::VARCHAR, 2, '0') || '/2024' AS month_year FROM ps
""")
def extract_older_payslip(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c: F.format_number(F.floor(c), 0)
    text = F.concat(
        F.lit("Nama ALPHA "), F.col("letters"), F.lit("\nNo 7\nGaji Pokok "), whole("gross"), F.lit("\nJumlah Potongan "), whole("deduction"),
        F.lit("\nBulan "), F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("/2024"),
    )
    r = older.payslip_record(samples.payslip_values(spark, sf_dir).select("upload_id", text.alias("text")))
    return r.select("upload_id", "name", "gross_income", "total_deduction", "net_income", "month_year")


# --- pages ---------------------------------------------------------------------------------

_ISLANDS = f"""{SQL_PAGES}, m AS (
  SELECT *, CASE WHEN account_number IS NOT NULL AND account_number IS NOT DISTINCT FROM lag(account_number) OVER (PARTITION BY upload_id, document_type ORDER BY document_number) THEN 0 ELSE 1 END AS new FROM pg
), isl AS (
  SELECT *, CASE WHEN document_type = 'bank_statement' THEN sum(new) OVER (PARTITION BY upload_id, document_type ORDER BY document_number)::BIGINT END AS island FROM m
)"""


@_query(f"WITH {_ISLANDS} SELECT upload_id, document_number, document_type, island FROM isl")
def page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.islands(samples.statement_pages(spark, sf_dir)).select("upload_id", "document_number", "document_type", "island")


@_query(f"""
WITH {_ISLANDS}
SELECT upload_id, island, min(document_number) AS document_number, min(account_number) AS account_number, min('bank_islam') AS detected_bank, arg_min(account_holder_name, document_number) AS account_holder_name, arg_min(statement_date, document_number) AS statement_date,
  arg_min(opening_balance, document_number) AS opening_balance,
  coalesce(arg_max(closing_balance, document_number) FILTER (closing_balance <> '0.00'), '0.00') AS closing_balance,
  arg_min(total_debit, document_number) FILTER (total_debit IS NOT NULL) AS total_debit, arg_min(total_credit, document_number) FILTER (total_credit IS NOT NULL) AS total_credit,
  arg_max(available_balance, document_number) FILTER (available_balance IS NOT NULL) AS available_balance,
  arg_min(statement_period_from, document_number) FILTER (statement_period_from IS NOT NULL) AS statement_period_from,
  arg_max(statement_period_to, document_number) FILTER (statement_period_to IS NOT NULL) AS statement_period_to,
  count(*) AS page_count, avg(confidence_score) AS raw_confidence, sum(text_length)::BIGINT AS text_length, count(*) > 1 AS is_merged
FROM isl WHERE island IS NOT NULL GROUP BY upload_id, island
""")
def statement_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = pages.merge_islands(pages.islands(samples.statement_pages(spark, sf_dir)))
    return merged.drop("confidence_score")  # the mean, rounded


@_query(f"""
WITH {SQL_PAGES}, f AS (
  SELECT *, CASE WHEN opening_balance <> '0.00' THEN document_number END AS opened FROM pg
), o AS (
  SELECT *, last_value(CASE WHEN opened IS NOT NULL THEN opening_balance END IGNORE NULLS) OVER w AS so_far,
    last_value(CASE WHEN opened IS NOT NULL OR total_debit IS NOT NULL THEN coalesce(total_debit, '-') END IGNORE NULLS) OVER w AS debit,
    last_value(CASE WHEN opened IS NOT NULL OR total_credit IS NOT NULL THEN coalesce(total_credit, '-') END IGNORE NULLS) OVER w AS credit
  FROM f WINDOW w AS (PARTITION BY upload_id ORDER BY document_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), g AS (SELECT *, CASE WHEN opening_balance = '0.00' THEN coalesce(so_far, '0.00') ELSE opening_balance END AS opening FROM o)
SELECT upload_id, document_number, opening AS opening_balance,
  CASE WHEN opening <> '0.00' AND nullif(debit, '-') IS NOT NULL AND nullif(credit, '-') IS NOT NULL
    THEN (opening::DECIMAL(18,2) + nullif(credit, '-')::DECIMAL(18,2) - nullif(debit, '-')::DECIMAL(18,2))::DECIMAL(18,2)::VARCHAR ELSE closing_balance END AS closing_balance
FROM g
""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.carry_forward(samples.statement_pages(spark, sf_dir)).select("upload_id", "document_number", "opening_balance", "closing_balance")


# --- tokens --------------------------------------------------------------------------------


@_query(rf"""
WITH {SQL_TOKENS}, g AS (
  SELECT *, CASE WHEN regexp_matches(text, '^[\d,.\s\-]+$') AND regexp_matches(lag(text) OVER w, '^[\d,.\s\-]+$') AND x0 - lag(x1) OVER w <= 10
    AND abs((y0 + y1) / 2 - lag((y0 + y1) / 2) OVER w) <= 5 THEN 0 ELSE 1 END AS new FROM tok WINDOW w AS (PARTITION BY upload_id ORDER BY token_ix)
), r AS (SELECT *, sum(new) OVER (PARTITION BY upload_id ORDER BY token_ix) AS run FROM g)
SELECT upload_id, min(token_ix)::INT AS token_ix, string_agg(text, '' ORDER BY token_ix) AS text, round(avg(confidence), 6) AS confidence, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS merged_from
FROM r GROUP BY upload_id, run
""")
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.merge_runs(samples.tokens(spark, sf_dir)).select("upload_id", "token_ix", "text", F.round("confidence", 6).alias("confidence"), "x0", "y0", "x1", "y1", "merged_from")


@_query(f"""
WITH {SQL_TOKENS}, g AS (
  SELECT *, CASE WHEN abs(y0 - lag(y0) OVER w) < 10 THEN 0 ELSE 1 END AS new FROM tok WINDOW w AS (PARTITION BY upload_id ORDER BY y0, x0, token_ix)
), l AS (SELECT *, sum(new) OVER (PARTITION BY upload_id ORDER BY y0, x0, token_ix ROWS UNBOUNDED PRECEDING) AS line FROM g),
t AS (SELECT upload_id, line, string_agg(text, ' ' ORDER BY y0, x0, token_ix) AS text FROM l GROUP BY ALL)
SELECT upload_id, string_agg(text, chr(10) ORDER BY line) AS text FROM t GROUP BY upload_id
""")
def token_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.page_text(samples.tokens(spark, sf_dir)).select("upload_id", "text")


@_query(f"""
WITH RECURSIVE {SQL_TOKENS}, o AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY y0, x0, token_ix) AS n FROM tok),
fold AS (
  SELECT upload_id, token_ix, x0, y0, n, 0 AS line, [y0] AS low, [y1] AS high FROM o WHERE n = 1
  UNION ALL
  SELECT upload_id, token_ix, x0, y0, n, k - 1,
    CASE WHEN k > len(low) THEN list_append(low, y0) ELSE list_transform(low, lambda v, i: CASE WHEN i = k THEN least(v, y0) ELSE v END) END,
    CASE WHEN k > len(high) THEN list_append(high, y1) ELSE list_transform(high, lambda v, i: CASE WHEN i = k THEN greatest(v, y1) ELSE v END) END
  FROM (
    SELECT o.upload_id, o.token_ix, o.x0, o.y0, o.y1, o.n, f.low, f.high,
      coalesce(nullif(list_position(list_transform(f.low, lambda v, i: abs((v + f.high[i]) / 2 - (o.y0 + o.y1) / 2) <= {rules.LINE_TOLERANCE}), true), 0), len(f.low) + 1) AS k
    FROM fold f JOIN o ON o.upload_id = f.upload_id AND o.n = f.n + 1
  )
), t AS (SELECT *, min(y0) OVER (PARTITION BY upload_id, line) AS top FROM fold)
SELECT upload_id, token_ix::INT AS token_ix, line::INT AS line, row_number() OVER (PARTITION BY upload_id ORDER BY top, line, x0, token_ix)::INT AS place FROM t
""")
def line_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = tokens.cluster_lines(samples.tokens(spark, sf_dir))
    return tokens.reading_order(lined).select("upload_id", "token_ix", "line", "place")


_NUMBER = r"regexp_matches(text, '^-?\d+(\.\d+)?$')"
_LABELS = "lab AS (SELECT upload_id, token_ix AS lix, text AS ltext, x0 AS lx0, y0 AS ly0, x1 AS lx1, y1 AS ly1 FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY token_ix) AS n FROM tok WHERE contains(lower(text), 'total')) WHERE n = 1)"


@_query(f"WITH {SQL_TOKENS}, {_LABELS} SELECT upload_id, lix::INT AS token_ix, ltext AS text FROM lab")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.find_labels(samples.tokens(spark, sf_dir), ("total",)).select("upload_id", "token_ix", "text")


def _row_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens on lines of eight units of height."""
    return samples.tokens(spark, sf_dir).withColumn("line", F.floor(F.col("y0") / 8))


@_query(rf"""
WITH {SQL_TOKENS}, {_LABELS}, p AS (
  SELECT t.upload_id, lix, token_ix, text, 0.3::DOUBLE * confidence + 0.3::DOUBLE * 1.0::DOUBLE + 0.25::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (x0 - lx1) / 200.0::DOUBLE) + 0.15::DOUBLE * 1.0::DOUBLE AS score
  FROM tok t JOIN lab l ON t.upload_id = l.upload_id AND t.token_ix <> lix AND floor(y0 / 8) = floor(ly0 / 8) AND x0 > lx1 WHERE {_NUMBER}
), r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY score DESC, token_ix) AS n FROM p)
SELECT upload_id, lix::INT AS label_ix, token_ix::INT AS token_ix, text FROM r WHERE n = 1 AND score >= 0.5
""")
def right_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _row_tokens(spark, sf_dir)
    return spatial.right_values(t, spatial.find_labels(t, ("total",))).select("upload_id", F.col("l_token_ix").alias("label_ix"), "token_ix", "text")


@_query(rf"""
WITH {SQL_TOKENS}, {_LABELS}, p AS (
  SELECT t.upload_id, lix, token_ix, text, 0.3::DOUBLE * confidence + 0.3::DOUBLE * 1.0::DOUBLE + 0.25::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (y0 - ly1) / 200.0::DOUBLE) + 0.15::DOUBLE * 0.7::DOUBLE AS score
  FROM tok t JOIN lab l ON t.upload_id = l.upload_id AND t.token_ix <> lix AND y0 - ly1 > 0 AND y0 - ly1 <= 50 WHERE {_NUMBER}
), r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY score DESC, token_ix) AS n FROM p)
SELECT upload_id, lix::INT AS label_ix, token_ix::INT AS token_ix, text FROM r WHERE n = 1 AND score >= 0.5
""")
def below_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples.tokens(spark, sf_dir)
    return spatial.below_values(t, spatial.find_labels(t, ("total",))).select("upload_id", F.col("l_token_ix").alias("label_ix"), "token_ix", "text")


_IOU = """greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"""
_JITTER = """
SELECT upload_id, page, {k} AS engine_ix, token_ix, CASE WHEN token_ix % ({k} + 1) = 0 THEN '~' || text ELSE text END AS text,
  CASE WHEN token_ix % 2 = {k} % 2 THEN 0.95::DOUBLE ELSE 0.3::DOUBLE END AS confidence, x0 + {k} AS x0, y0, x1 + {k} AS x1, y1 FROM tok"""
_MATCH = f"""j AS ({_JITTER.format(k=1)} UNION ALL {_JITTER.format(k=2)}),
e AS (SELECT upload_id, page, 0 AS engine_ix, token_ix, text, confidence, x0, y0, x1, y1 FROM tok UNION ALL SELECT * FROM j),
m AS (
  SELECT a.upload_id, a.token_ix, a.confidence AS own, b.engine_ix, b.token_ix AS other, b.text, b.confidence, {_IOU} AS i FROM tok a JOIN e b USING (upload_id)
), u AS (SELECT *, i / (96 + 96 - i) AS iou FROM m),
best AS (SELECT *, row_number() OVER (PARTITION BY upload_id, token_ix, engine_ix ORDER BY iou DESC, other) AS n FROM u WHERE iou > 0.5)"""


@_query(f"WITH {SQL_TOKENS}, {_MATCH} SELECT upload_id, token_ix::INT AS token_ix, other::INT AS match_ix, iou FROM best WHERE n = 1 AND engine_ix = 1")
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples.tokens(spark, sf_dir)
    boxes = lambda df: df.select("upload_id", "page", "token_ix", "x0", "y0", "x1", "y1")
    m = ensemble.best_matches(boxes(t), boxes(samples.jittered(t, 1)))
    return m.select("upload_id", F.col("t_token_ix").alias("token_ix"), F.col("c_token_ix").alias("match_ix"), "iou")


@_query(f"""
WITH {SQL_TOKENS.replace("tok AS (", "tok AS MATERIALIZED (", 1)}, j AS ({_JITTER.format(k=1)} UNION ALL {_JITTER.format(k=2)}),
every AS (
  SELECT a.upload_id, a.token_ix, b.engine_ix, b.token_ix AS other, b.confidence > a.confidence AS better, b.text, b.confidence, {_IOU} AS i
  FROM tok a JOIN j b ON a.upload_id = b.upload_id AND a.page = b.page WHERE a.confidence < 0.6
), best AS (
  SELECT *, row_number() OVER (PARTITION BY upload_id, token_ix, engine_ix ORDER BY i / (96 + 96 - i) DESC, other) AS n FROM every WHERE i / (96 + 96 - i) > 0.5
), took AS (SELECT upload_id, token_ix, arg_min(text, engine_ix) AS text, arg_min(confidence, engine_ix) AS confidence, min(engine_ix) AS used FROM best WHERE n = 1 AND better GROUP BY ALL)
SELECT t.upload_id, t.token_ix::INT AS token_ix, coalesce(k.text, t.text) AS text, coalesce(k.confidence, t.confidence) AS confidence, coalesce(k.used, 0) AS engine_used
FROM tok t LEFT JOIN took k ON k.upload_id = t.upload_id AND k.token_ix = t.token_ix
""")
def retry_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples.tokens(spark, sf_dir)
    return ensemble.retry(t, [samples.jittered(t, 1), samples.jittered(t, 2)]).select("upload_id", "token_ix", "text", "confidence", "engine_used")


@_query(f"""
WITH {SQL_TOKENS}, {_MATCH}, v AS (
  SELECT upload_id, token_ix, trim(text) AS text, count(*) AS n, min(engine_ix) AS first FROM best WHERE n = 1 GROUP BY ALL
), w AS (SELECT *, row_number() OVER (PARTITION BY upload_id, token_ix ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY upload_id, token_ix) AS total FROM v)
SELECT upload_id, token_ix::INT AS token_ix, text, n AS vote_count, 100.0::DOUBLE * n / total AS vote_agreement FROM w WHERE k = 1
""")
def vote_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = samples.tokens(spark, sf_dir)
    every = t.withColumn("engine_ix", F.lit(0))
    for k in (1, 2):
        every = every.unionByName(samples.jittered(t, k).withColumn("engine_ix", F.lit(k)))
    return ensemble.vote(t, every).select("upload_id", "token_ix", "text", "vote_count", "vote_agreement")


# --- verdicts and results ------------------------------------------------------------------


@_query(f"""
WITH {SQL_STATEMENTS} SELECT upload_id, bank = 'cimb' AS is_valid,
  CASE WHEN bank = 'cimb' THEN 'Valid bank statement data' ELSE 'Invalid account number format' END AS validation_message,
  bank IN ('cimb', 'bsn', 'generic') AS valid_by_bank FROM st
""")
def validate_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bank.by_bank_record(_detected(spark, sf_dir)).withColumns({"v": validate.bank_verdict(), "w": validate.bank_verdict(by_bank=True)})
    return r.select("upload_id", "v.is_valid", "v.validation_message", F.col("w.is_valid").alias("valid_by_bank"))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payslip records, one in seven each with a fault of its own kind."""
    k = F.col("upload_id")
    v = samples.payslip_values(spark, sf_dir)
    text = lambda c: c.cast("string")
    return v.select(
        "upload_id",
        F.when(k % 7 == 1, F.lit(None)).otherwise(F.lit("ALPHA")).alias("name"),
        F.when(k % 7 == 2, "12").otherwise(F.concat(F.lit("900101-14-"), F.lpad(text(k), 4, "0").substr(1, 4))).alias("id_number"),
        F.when(k % 7 == 3, "1000000.00").otherwise(text(F.col("gross"))).alias("gross_income"),
        F.when(k % 7 == 4, "-5.00").otherwise(text(F.col("net"))).alias("net_income"),
        text(F.col("deduction")).alias("total_deduction"),
        F.when(k % 7 == 5, "13/2024").when(k % 7 == 6, "01/1999").otherwise("01/2024").alias("month_year"),
    )


@_query("""
SELECT s_suppkey AS upload_id, s_suppkey % 7 IN (0, 3, 6) AS is_valid,
  CASE s_suppkey % 7 WHEN 1 THEN 'Missing fields: name' WHEN 2 THEN 'Invalid ID number format' WHEN 4 THEN 'Invalid net income format' WHEN 5 THEN 'Invalid month/year format' ELSE 'Valid payslip data' END AS validation_message
FROM supplier
""")
def validate_payslip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faulty(spark, sf_dir).select("upload_id", validate.payslip_verdict().alias("v")).select("upload_id", "v.*")


@_query("""
SELECT s_suppkey AS upload_id, CASE s_suppkey % 7 WHEN 3 THEN 'Gross income exceeds maximum (999999.99)' WHEN 4 THEN 'Net income cannot be negative' WHEN 5 THEN 'Invalid month: 13' WHEN 6 THEN 'Invalid year: 1999' ELSE '' END AS errors
FROM supplier
""")
def range_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faulty(spark, sf_dir).select("upload_id", F.array_join(validate.range_errors(), "; ").alias("errors"))


def _all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's statement twice, and suppliers' payslips as a third page of customers with the same key."""
    s = samples.statements(spark, sf_dir)
    p = samples.payslips(spark, sf_dir).select("upload_id", F.lit(3).alias("document_number"), "text")
    two = s.select("upload_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("document_number"), "text")
    return two.unionByName(p)


@_query("""
SELECT coalesce(c_custkey, s_suppkey) AS upload_id, (CASE WHEN c_custkey IS NULL THEN 0 ELSE 2 END + CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END)::BIGINT AS total_documents,
  CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END::BIGINT AS payslips, CASE WHEN c_custkey IS NULL THEN 0 ELSE 2 END::BIGINT AS bank_statements, 0::BIGINT AS other
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey
""")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = results.extract_documents(_all_pages(spark, sf_dir))
    return results.summarise(documents).select("upload_id", "total_documents", "payslips", "bank_statements", "other")


@_query(f"""
WITH {SQL_STATEMENTS}, n AS (
  SELECT upload_id, bank, opening, balance, round_even(CASE bank WHEN 'cimb' THEN 9.0 WHEN 'bsn' THEN 12.0 WHEN 'public_islamic' THEN 9.0 ELSE 11.0 END / CASE bank WHEN 'bsn' THEN 12.0 ELSE 11.0 END, 2) AS score FROM st
)
SELECT upload_id, (1 + (s_suppkey IS NOT NULL)::INT)::INT AS documents, 2::BIGINT AS most_pages, CASE WHEN bank = 'cimb' AND balance <= 0 THEN '0.00' WHEN bank = 'cimb' THEN balance::DECIMAL(18,2)::VARCHAR ELSE opening::VARCHAR END AS opening_balance,
  (2 + (s_suppkey IS NOT NULL)::INT)::BIGINT AS total_documents, (s_suppkey IS NOT NULL)::BIGINT AS payslips, 2::BIGINT AS bank_statements, 0::BIGINT AS other,
  CASE WHEN s_suppkey IS NULL THEN 'bank_statement:1:2:true' ELSE 'bank_statement:1:2:true,payslip:3:1:false' END AS parts,
  round_even((2 * score + CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END) / CASE WHEN s_suppkey IS NULL THEN 2 ELSE 3 END, 2)::DOUBLE AS average_confidence, bank AS detected_bank, true AS lengths_add_up, true AS stamped
FROM n LEFT JOIN supplier ON n.upload_id = s_suppkey
""")
def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole envelope of each upload: its documents, their summary, lengths and time."""
    given = _known_pages(spark, sf_dir)
    r = results.result_records(given)
    lengths = given.groupBy("upload_id").agg(F.sum(F.length(clean_text(F.col("text")))).alias("n"))
    bank_doc = F.filter("documents", lambda d: d["document_type"] == "bank_statement")[0]
    part = lambda d: F.concat_ws(":", d["document_type"], d["document_number"].cast("string"), d["merged_from_pages"].cast("string"), d["is_merged"].cast("string"))
    return r.join(lengths, "upload_id").select(
        "upload_id", F.size("documents").alias("documents"), F.array_max(F.transform("documents", lambda d: d["merged_from_pages"])).alias("most_pages"),
        bank_doc["extracted_data"]["opening_balance"].alias("opening_balance"), "total_documents", "summary.payslips", "summary.bank_statements", "summary.other",
        F.array_join(F.transform("documents", part), ",").alias("parts"), "summary.average_confidence", bank_doc["extracted_data"]["detected_bank"].alias("detected_bank"),
        (F.col("total_text_length") == F.col("n")).alias("lengths_add_up"), F.col("processing_completed_at").isNotNull().alias("stamped"),
    )


@_query("""
WITH w AS (SELECT s_suppkey * 2 AS upload_id FROM supplier)
SELECT w.upload_id, CASE WHEN c_custkey IS NULL THEN 404 WHEN c_custkey % 3 = 0 THEN 202 WHEN c_custkey % 3 = 1 THEN 400 ELSE 200 END AS outcome FROM w LEFT JOIN customer ON c_custkey = w.upload_id
""")
def status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    status = table(spark, sf_dir, "customer").select(k.alias("upload_id"), F.when(k % 3 == 0, "processing").when(k % 3 == 1, "failed").otherwise("completed").alias("status"))
    wanted = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("upload_id"))
    return results.lookup(status, wanted).select("upload_id", "outcome")


def _known_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_all_pages`` of customers."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("upload_id"))
    return _all_pages(spark, sf_dir).join(known, "upload_id", "left_semi")


@_query("""
SELECT c_custkey::VARCHAR AS upload_id, 'completed' AS status, (CASE WHEN s_suppkey IS NULL THEN 2 ELSE 3 END)::BIGINT AS pages, true AS same_as_batch FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
UNION ALL SELECT 'broken', 'failed', 1, false
""")
def stream_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file-arrival stream over all customers' pages and one broken upload: statuses, and whether whole results are the batch job's."""
    from paperloom.plans.scratch import fresh
    from paperloom.streaming import intake

    root = fresh(spark, "stream")
    given = _known_pages(spark, sf_dir).select(F.col("upload_id").cast("string").alias("upload_id"), "document_number", "text")
    lines = given.repartition("upload_id").select(F.to_json(F.struct(*given.columns)).alias("value"))
    broken = spark.range(1).select(F.lit('{"upload_id": "broken", "document_number": "one", "text": "Account No"}').alias("value"))
    lines.unionByName(broken).write.text(f"{root}/in")
    intake.run_once(intake.arrivals(spark, f"{root}/in"), intake.results_of, f"{root}/out", f"{root}/status", f"{root}/checkpoint").awaitTermination()
    batch = results.result_records(given).drop("processing_completed_at")
    streamed = spark.read.schema(batch.schema).parquet(f"{root}/out")
    whole = lambda df, name: df.select("upload_id", F.to_json(F.struct(*[c for c in batch.columns if c != "upload_id"])).alias(name))
    same = whole(batch, "a").join(whole(streamed, "b"), "upload_id").select("upload_id", (F.col("a") == F.col("b")).alias("same"))
    out = intake.statuses(spark, f"{root}/status").join(same, "upload_id", "left")
    return out.select("upload_id", "status", "pages", F.coalesce("same", F.lit(False)).alias("same_as_batch"))



@_query("""
SELECT c_custkey::VARCHAR AS upload_id, CASE WHEN c_custkey IN (7, 13) THEN 'failed' ELSE 'completed' END AS status, (CASE WHEN s_suppkey IS NULL THEN 2 ELSE 3 END)::BIGINT AS pages, c_custkey NOT IN (7, 13) AS same_as_batch
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
UNION ALL VALUES ('broken', 'failed', 1, false), ('clock', 'completed', 1, false), ('partial', 'processing', 0, false)
""")
def stream_split_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads whose pages come in files of three runs of a stream.

    Most say how many pages they have, every fourth is whole when no page came for ten minutes.  Every
    tenth gets a page too late, which changes nothing; work fails for two uploads, whose neighbours are
    completed; one upload is broken and one isn't whole yet.  Results are compared with the batch job's.
    """
    from paperloom.plans.scratch import fresh
    from paperloom.streaming import assembly, intake

    root, k = fresh(spark, "stream"), F.col("upload_id")
    given = _known_pages(spark, sf_dir).select(k.cast("string").alias("upload_id"), F.col("document_number").cast("int").alias("document_number"), "text")
    counted = given.join(given.groupBy("upload_id").agg(F.count("*").cast("int").alias("n")), "upload_id")
    counted.select("upload_id", "document_number", "text", F.when(k.cast("long") % 4 != 0, F.col("n")).alias("expected")).write.parquet(f"{root}/pages")  # read by every run
    told = spark.read.schema("upload_id string, document_number int, text string, expected int").parquet(f"{root}/pages")
    late = told.where((F.col("document_number") == 1) & (k.cast("long") % 10 == 1)).withColumn("document_number", F.lit(99))
    alone = spark.createDataFrame([("clock", 1, "tick", 1), ("partial", 1, "one", 5)], told.schema)

    def work(pages: DataFrame) -> DataFrame:
        read = F.when(k.isin("7", "13"), F.raise_error(F.lit("unreadable")).cast("string")).otherwise(F.col("text"))
        return _digests(pages.select("upload_id", "document_number", read.alias("text")))

    for step, (rows, minute) in enumerate(((told.where("document_number = 1"), 0), (told.where("document_number > 1"), 5), (late.unionByName(alone), 120))):
        lines = rows.withColumn("at", F.lit(f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z")).select(F.to_json(F.struct("*")).alias("value"))
        if step == 0:
            lines = lines.unionByName(spark.range(1).select(F.lit('{"upload_id": "broken", "document_number": "one", "text": "x", "expected": 1, "at": "2024-01-01T00:00:00Z"}').alias("value")))
        lines.write.mode("append").text(f"{root}/in")
        stream = assembly.together(intake.arrivals(spark, f"{root}/in"))
        intake.run_once(stream, work, f"{root}/out", f"{root}/status", f"{root}/checkpoint").awaitTermination()
    batch = _digests(told.select(*given.columns))
    streamed = spark.read.schema(batch.schema).parquet(f"{root}/out")
    same = batch.join(streamed.withColumnsRenamed({"texts_md5": "streamed_md5"}), "upload_id").select("upload_id", (F.col("texts_md5") == F.col("streamed_md5")).alias("same"))
    out = intake.statuses(spark, f"{root}/status").join(same, "upload_id", "left")
    return out.select("upload_id", "status", "pages", F.coalesce("same", F.lit(False)).alias("same_as_batch"))


def _digests(pages: DataFrame) -> DataFrame:
    """(upload_id, texts_md5): an upload's page texts in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("document_number", "text"))), lambda p: p["text"])
    return pages.groupBy("upload_id").agg(F.md5(F.array_join(texts, "|")).alias("texts_md5"))


# --- the same in SQL -----------------------------------------------------------------------


@_query(f"SELECT o_orderkey, cleaned, parsed FROM ({ORACLES['money_clean']}) a JOIN ({ORACLES['money_parse']}) b USING (o_orderkey)")
def money_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts by SQL functions alone."""
    sqlfunctions.register(spark, "paperloom_")
    _money_shapes(spark, sf_dir).createOrReplaceTempView("paperloom_amounts")
    return spark.sql("SELECT o_orderkey, paperloom_clean_currency(said) AS cleaned, paperloom_parse_number(said) AS parsed FROM paperloom_amounts")


@_query(ORACLES["clean_texts"])
def clean_texts_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts by SQL functions alone."""
    sqlfunctions.register(spark, "paperloom_")
    table(spark, sf_dir, "documents").createOrReplaceTempView("paperloom_documents")
    return spark.sql("SELECT doc_id, CAST(length(c) AS LONG) AS n_clean, md5(c) AS clean_md5 FROM (SELECT doc_id, paperloom_clean_text(text) AS c FROM paperloom_documents)")


@_query(f"WITH {SQL_TOKENS} SELECT upload_id, page, count(*) FILTER (confidence < 0.6) AS weak, max(x1) AS widest, count(DISTINCT y0) AS heights, count(*) AS tokens FROM tok GROUP BY ALL")
def lines_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by a query in SQL over the view of their lines."""
    sqlfunctions.layout_views(samples.tokens(spark, sf_dir), "paperloom_")
    return spark.sql("SELECT upload_id, page, count_if(confidence < 0.6) AS weak, max(x1) AS widest, count(DISTINCT y0) AS heights, count(*) AS tokens FROM paperloom_lines GROUP BY upload_id, page")
