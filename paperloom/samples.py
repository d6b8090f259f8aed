"""Inputs of the registered queries: statements, payslips, pages and tokens made from the relational test tables.

No operator imports this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BANKS = ("cimb", "bsn", "bank_islam", "public_islamic", "generic")
FILLER = "xx " * 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a small table that one task renders as texts, and tokens of a task.
ROWS_PER_TASK = 10_000
TOKENS_PER_TASK = 150_000


def spread(df: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` in a number of partitions that grows with its rows (by ``keys``, if any).

    A file of a few MB is else read by one task, whatever is made of its rows, and a task's share of a shuffle
    grows with the table.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def letters(key: Column) -> Column:
    return F.translate(F.lpad(key.cast("string"), 6, "0"), "0123456789", "ABCDEFGHIJ")


def _money(c: Column) -> Column:
    return F.format_number(c.cast("decimal(18,2)"), 2)


def statement_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: the values that its statement shows."""
    k = F.col("c_custkey")
    d = F.date_add(F.lit("2020-01-01").cast("date"), (k % 2000).cast("int"))
    balance = F.col("c_acctbal").cast("decimal(18,2)")
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).select(
        k.alias("upload_id"),
        F.element_at(F.array(*[F.lit(b) for b in BANKS]), (k % 5 + 1).cast("int")).alias("bank"),
        letters(k).alias("letters"),
        d.alias("d0"), F.date_add(d, 1).alias("d1"), F.date_add(d, 20).alias("d2"),
        balance.alias("balance"),
        (F.abs(balance) + F.lit("0.01").cast("decimal(4,2)")).cast("decimal(18,2)").alias("opening"),
        (F.lit("1000.25").cast("decimal(18,2)") + k % 5000).cast("decimal(18,2)").alias("debit"),
        (F.lit("2000.50").cast("decimal(18,2)") + k % 777).cast("decimal(18,2)").alias("credit"),
        (F.lit("1.75").cast("decimal(18,2)") + k % 9000).cast("decimal(18,2)").alias("closing"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(upload_id, bank, text): one-page statements in five layouts."""
    v = statement_values(spark, sf_dir)
    key, name = F.col("upload_id"), F.col("letters")
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    short = lambda c: F.date_format(c, "dd/MM/yy")
    digits = lambda n: F.lpad(key.cast("string"), n, "1")
    o, d, c, z = (_money(F.col(x)) for x in ("opening", "debit", "credit", "closing"))
    dots = lambda m: F.translate(m, ",", ".")
    text = {
        "cimb": F.concat(
            F.lit("CIMB BANK BERHAD ALPHA "), name, F.lit(" BINTI GAMMA 12, JALAN SATU Statement Date "), day("d0"), F.lit(" Account No 51-"),
            F.lpad(key.cast("string"), 7, "0"), F.lit("-"), (key % 10).cast("string"), F.lit(" Transaction Details "), day("d1"),
            F.lit(" OPENING BALANCE "), _money(F.col("balance")), F.lit(" "), day("d2"), F.lit(" PAYMENT 51.23 CLOSING BALANCE "), z, F.lit(" End of Statement"),
        ),
        "bsn": F.concat(
            F.lit("BSN PENYATA AKAUN "), digits(16), F.lit(" ALPHA "), name, F.lit(" ANAK BETA No.Akaun Statement Date: "), day("d0"),
            F.lit(" 01JUL Baki Hadapan "), dots(o), F.lit(" 29JUL BAYARAN 5.00 Baki Sedia Ada "), dots(z), F.lit(" Jumlah Debit "), dots(d),
            F.lit(" Jumlah Kredit "), dots(c),
        ),
        "bank_islam": F.concat(
            F.lit("BANK ISLAM ENCIK ALPHA "), name, F.lit(" TARIKH PENYATA "), short("d0"), F.lit(" ACCOUNT NO "), digits(14), F.lit(" BAL B/F "), o,
            F.lit(" "), short("d1"), F.lit(" TRANSFER 20.00 RINGKASAN AKAUN TOTAL DEBIT "), d, F.lit(" TOTAL CREDIT "), c,
        ),
        "public_islamic": F.concat(
            F.lit("PUBLIC ISLAMIC BANK PUAN ALPHA "), name, F.lit(" "), digits(10), F.lit(" Nombor Akaun Tarikh Penyata "), F.date_format("d0", "dd MMMM yyyy"),
            F.lit(" Balance From Last Statement "), o, F.lit(" RINGKASAN "), d, F.lit(" Jumlah Debit "), c, F.lit(" Jumlah Kredit Baki Penutup "), z,
        ),
        "generic": F.concat(
            F.lit("SOME COOPERATIVE Account No: "), digits(12), F.lit(" ENCIK ALPHA "), name, F.lit(" JALAN DUA Statement Date "), day("d0"),
            F.lit(" Opening Balance "), o, F.lit(" Closing Balance "), z, F.lit(" Total Debit "), d, F.lit(" Total Credit "), c, F.lit(" From "), day("d1"),
            F.lit(" To "), day("d2"),
        ),
    }
    out = None
    for b in BANKS:
        out = F.when(F.col("bank") == b, text[b]) if out is None else out.when(F.col("bank") == b, text[b])
    return v.select("upload_id", "bank", out.alias("text"))


def payslip_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier; every third has no net income, which is then derived."""
    k = F.col("s_suppkey")
    gross = (F.lit("3000.40").cast("decimal(18,2)") + k % 4000).cast("decimal(18,2)")
    less = (F.lit("100.15").cast("decimal(18,2)") + k % 900).cast("decimal(18,2)")
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(
        k.alias("upload_id"), letters(k).alias("letters"), gross.alias("gross"), less.alias("deduction"), (gross - less).cast("decimal(18,2)").alias("net"),
        (k % 3 == 0).alias("no_net"), (k % 12 + 1).alias("month"),
    )


def payslips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(upload_id, text): payslips as one line, labels without colons before amounts."""
    v = payslip_values(spark, sf_dir)
    gap = F.lit(" " + FILLER)
    net = F.when(F.col("no_net"), F.lit("")).otherwise(F.concat(F.lit("Gaji Bersih "), _money(F.col("net"))))
    text = F.concat(
        F.lit("Nama: ALPHA "), F.col("letters"), F.lit(" BIN GAMMA 1"), gap, F.lit("No KP 900101"), F.lpad(F.col("upload_id").cast("string"), 6, "0"), gap,
        F.lit("Jumlah Pendapatan "), _money(F.col("gross")), gap, F.lit("Jumlah Potongan "), _money(F.col("deduction")), gap, net, gap,
        F.lit("M/S "), F.col("month").cast("string"), F.lit("/2024"),
    )
    return v.select("upload_id", text.alias("text"))


def payslip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(upload_id, page_text): payslips with line breaks and colons."""
    v = payslip_values(spark, sf_dir)
    text = F.concat(
        F.lit("Nama : ALPHA "), F.col("letters"), F.lit(" BIN GAMMA Bulan : JANUARI 2025\nNo KP : 900101"), F.lpad(F.col("upload_id").cast("string"), 6, "0"),
        F.lit("\nJumlah Pendapatan : "), _money(F.col("gross")), F.lit(" Jumlah Potongan : "), _money(F.col("deduction")),
        F.lit("\nGaji Bersih : "), _money(F.col("net")), F.lit("\nM/S : "), F.col("month").cast("string"), F.lit("/22"),
    )
    return v.select("upload_id", text.alias("page_text"))


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bank pages: a customer is an upload, its orders are pages, the status is the account."""
    k = F.col("o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    money = lambda c: c.cast("decimal(18,2)").cast("string")
    total = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("upload_id"),
        F.row_number().over(w).alias("document_number"),
        F.when(k % 11 == 0, "payslip").otherwise("bank_statement").alias("document_type"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("account_number"),
        F.concat(F.lit("HOLDER "), k.cast("string")).alias("account_holder_name"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("statement_date"),
        F.when(k % 3 == 0, "0.00").otherwise(money(total)).alias("opening_balance"),
        F.when(k % 4 == 0, "0.00").otherwise(money(total + 1)).alias("closing_balance"),
        F.when(k % 5 == 0, money(total + 2)).alias("total_debit"),
        F.when(k % 6 == 0, money(total + 4)).alias("total_credit"),
        F.when(k % 9 == 0, money(total)).alias("available_balance"),
        F.when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("statement_period_from"),
        F.when(k % 5 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("statement_period_to"),
        F.lit("bank_islam").alias("detected_bank"),
        ((k % 8) / 8).alias("confidence_score"),
        (k % 1000).alias("text_length"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tokens: an order is a page; boxes, texts and confidences come from its columns."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    x0, y0 = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 24).cast("double")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Total "), F.col("l_returnflag"))).when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity").cast("int").cast("string")).otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".50")))
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return spread(used, "l_orderkey", rows=TOKENS_PER_TASK).select(
        F.col("l_orderkey").alias("upload_id"), F.lit(1).alias("page"), F.row_number().over(w).alias("token_ix"), text.alias("text"),
        ((F.lit(100) - F.col("l_quantity")) / 100).alias("confidence"), x0.alias("x0"), y0.alias("y0"), (x0 + 12).alias("x1"), (y0 + 8).alias("y1"),
    )


def jittered(tokens: DataFrame, engine: int) -> DataFrame:
    """Another recogniser's view of the same tokens: boxes shifted by ``engine``, some texts read otherwise."""
    other = F.when(F.col("token_ix") % (engine + 1) == 0, F.concat(F.lit("~"), F.col("text"))).otherwise(F.col("text"))
    better = F.when(F.col("token_ix") % 2 == engine % 2, F.lit(0.95)).otherwise(F.lit(0.3))
    return tokens.withColumns({"text": other, "confidence": better, "x0": F.col("x0") + engine, "x1": F.col("x1") + engine})


#: The tables above in SQL, as common table expressions.
SQL_TOKENS = """
tok AS (
  SELECT l_orderkey AS upload_id, 1 AS page,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS token_ix,
    CASE WHEN l_linenumber % 3 = 0 THEN 'Total ' || l_returnflag WHEN l_linenumber % 3 = 1 THEN l_quantity::INT::VARCHAR ELSE l_quantity::INT::VARCHAR || '.50' END AS text,
    (100 - l_quantity) / 100 AS confidence, (l_partkey % 40)::DOUBLE AS x0, (l_suppkey % 24)::DOUBLE AS y0,
    (l_partkey % 40)::DOUBLE + 12 AS x1, (l_suppkey % 24)::DOUBLE + 8 AS y1
  FROM lineitem
)"""
SQL_PAGES = """
pg AS (
  SELECT o_custkey AS upload_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS document_number,
    CASE WHEN o_orderkey % 11 = 0 THEN 'payslip' ELSE 'bank_statement' END AS document_type,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS account_number,
    'HOLDER ' || o_orderkey AS account_holder_name, strftime(o_orderdate, '%d/%m/%Y') AS statement_date,
    CASE WHEN o_orderkey % 3 = 0 THEN '0.00' ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS opening_balance,
    CASE WHEN o_orderkey % 4 = 0 THEN '0.00' ELSE (o_totalprice + 1)::DECIMAL(18,2)::VARCHAR END AS closing_balance,
    CASE WHEN o_orderkey % 5 = 0 THEN (o_totalprice + 2)::DECIMAL(18,2)::VARCHAR END AS total_debit,
    CASE WHEN o_orderkey % 6 = 0 THEN (o_totalprice + 4)::DECIMAL(18,2)::VARCHAR END AS total_credit,
    CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice::DECIMAL(18,2)::VARCHAR END AS available_balance,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS statement_period_from,
    CASE WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%d/%m/%Y') END AS statement_period_to,
    (o_orderkey % 8) / 8 AS confidence_score, (o_orderkey % 1000) AS text_length
  FROM orders
)"""
SQL_STATEMENTS = """
st AS (
  SELECT c_custkey AS upload_id, (['cimb', 'bsn', 'bank_islam', 'public_islamic', 'generic'])[c_custkey % 5 + 1] AS bank,
    translate(lpad(c_custkey::VARCHAR, 6, '0'), '0123456789', 'ABCDEFGHIJ') AS letters,
    DATE '2020-01-01' + (c_custkey % 2000)::INT AS d0, DATE '2020-01-01' + (c_custkey % 2000)::INT + 1 AS d1, DATE '2020-01-01' + (c_custkey % 2000)::INT + 20 AS d2,
    c_acctbal::DECIMAL(18,2) AS balance, (abs(c_acctbal::DECIMAL(18,2)) + 0.01)::DECIMAL(18,2) AS opening,
    (1000.25 + c_custkey % 5000)::DECIMAL(18,2) AS debit, (2000.50 + c_custkey % 777)::DECIMAL(18,2) AS credit, (1.75 + c_custkey % 9000)::DECIMAL(18,2) AS closing
  FROM customer
)"""
SQL_PAYSLIPS = """
ps AS (
  SELECT s_suppkey AS upload_id, translate(lpad(s_suppkey::VARCHAR, 6, '0'), '0123456789', 'ABCDEFGHIJ') AS letters,
    (3000.40 + s_suppkey % 4000)::DECIMAL(18,2) AS gross, (100.15 + s_suppkey % 900)::DECIMAL(18,2) AS deduction,
    (3000.40 + s_suppkey % 4000 - 100.15 - s_suppkey % 900)::DECIMAL(18,2) AS net, s_suppkey % 12 + 1 AS month
  FROM supplier
)"""
