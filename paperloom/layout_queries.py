"""Further registered queries: page layout, helpers of text and numbers, scores, sinks and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom import samples
from paperloom.functions import classify, dates, numbers, text
from paperloom.operators import bank, contracts, older, pages, payslip, spatial, tokens, validate
from paperloom.plans import results, scratch, sinks
from paperloom.queries import _LABELS, _NUMBER, _row_tokens
from paperloom.registry import query as _query
from paperloom.samples import SQL_PAGES, SQL_TOKENS, table
from paperloom.sources import landing, settingrows

# --- layout --------------------------------------------------------------------------------

_RIGHT = f"""p AS (
  SELECT t.upload_id, lix, ltext, token_ix, text, x0 - lx1 AS gap FROM tok t JOIN lab l ON t.upload_id = l.upload_id AND t.token_ix <> lix AND floor(y0 / 8) = floor(ly0 / 8) AND x0 > lx1
)"""


@_query(rf"""
WITH {SQL_TOKENS}, {_LABELS}, {_RIGHT}, r AS (
  SELECT *, row_number() OVER (PARTITION BY upload_id, lix ORDER BY gap, token_ix) AS n FROM p WHERE NOT regexp_matches(text, '^[\d,.\s\-]+$') AND regexp_matches(text, '\d')
) SELECT upload_id, lix::INT AS label_ix, token_ix::INT AS token_ix, text FROM r WHERE n = 1
UNION ALL
SELECT upload_id, lix::INT, token_ix::INT, text FROM (
  SELECT *, row_number() OVER (PARTITION BY upload_id, lix ORDER BY gap, token_ix) AS n FROM p WHERE NOT regexp_matches(text, '^[\d,.\s\-]+$')
) WHERE n = 1
""")
def right_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest text right of a label, once only if it has a digit, once any."""
    t = _row_tokens(spark, sf_dir)
    labels = spatial.find_labels(t, ("total",))
    both = spatial.right_texts(t, labels, need_digit=True).unionByName(spatial.right_texts(t, labels))
    return both.select("upload_id", F.col("l_token_ix").alias("label_ix"), "token_ix", "text")


_SCORE = "0.3::DOUBLE * confidence + 0.3::DOUBLE + 0.25::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - {gap} / 200.0::DOUBLE) + 0.15::DOUBLE * {relation}::DOUBLE"


@_query(rf"""
WITH {SQL_TOKENS}, {_LABELS}, a AS (
  SELECT t.*, lix, ltext, {_SCORE.format(gap="(x0 - lx1)", relation="1.0")} AS score FROM tok t JOIN lab l ON t.upload_id = l.upload_id AND token_ix <> lix AND floor(y0 / 8) = floor(ly0 / 8) AND x0 > lx1
  WHERE {_NUMBER} AND NOT contains(lower(ltext || ' ' || text), 'total r')
), b AS (
  SELECT t.*, lix, ltext, {_SCORE.format(gap="(y0 - ly1)", relation="0.7")} AS score FROM tok t JOIN lab l ON t.upload_id = l.upload_id AND token_ix <> lix AND y0 - ly1 > 0 AND y0 - ly1 <= 50
  WHERE {_NUMBER} AND NOT contains(lower(ltext || ' ' || text), 'total r')
), r AS (SELECT upload_id, ltext, text FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY score DESC, token_ix) AS n FROM a) WHERE n = 1 AND score >= 0.5),
s AS (SELECT upload_id, ltext, text FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY score DESC, token_ix) AS n FROM b) WHERE n = 1 AND score >= 0.5)
SELECT coalesce(r.upload_id, s.upload_id) AS upload_id, coalesce(r.ltext, s.ltext) AS label, coalesce(r.text, s.text) AS value FROM r FULL JOIN s ON r.upload_id = s.upload_id
""")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's number right of its label, else below it; labels "Total R" are not wanted."""
    return spatial.field_values(_row_tokens(spark, sf_dir), ("total",), exclude=("total r",)).select("upload_id", "label", "value")


def _percent_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of which every fifth shows a percentage."""
    share = F.col("token_ix") % 5 == 0
    t = _row_tokens(spark, sf_dir)
    return t.withColumn("text", F.when(share, F.concat("text", F.lit(" %"))).otherwise(F.col("text")))


@_query(rf"""
WITH {SQL_TOKENS.replace("tok AS (", "raw AS (", 1)}, tok AS (SELECT * REPLACE (CASE WHEN token_ix % 5 = 0 THEN text || ' %' ELSE text END AS text) FROM raw), {_LABELS}, a AS (
  SELECT t.*, lix, {_SCORE.format(gap="(x0 - lx1)", relation="1.0")} AS score FROM tok t JOIN lab l ON t.upload_id = l.upload_id AND token_ix <> lix AND floor(y0 / 8) = floor(ly0 / 8) AND x0 > lx1
  WHERE {_NUMBER} AND NOT contains(ltext, '%')
), r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY score DESC, token_ix) AS n FROM a)
SELECT upload_id, lix::INT AS label_ix, token_ix::INT AS token_ix, text FROM r WHERE n = 1 AND score >= 0.5
""")
def no_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers right of labels where neither shows a percentage."""
    t = _percent_tokens(spark, sf_dir)
    return spatial.right_values(t, spatial.find_labels(t, ("total",))).select("upload_id", F.col("l_token_ix").alias("label_ix"), "token_ix", "text")


_BLOCK = """(SELECT upload_id, lix, token_ix, text, row_number() OVER (PARTITION BY upload_id ORDER BY gap, token_ix) AS n FROM ({}) )"""


@_query(f"""
WITH {SQL_TOKENS}, {_LABELS}, r AS (
  SELECT t.upload_id, lix, token_ix, text, x0 - lx1 AS gap FROM tok t JOIN lab l ON t.upload_id = l.upload_id AND token_ix <> lix AND abs(y0 - ly0) < 10 AND x0 > lx1 + 5
), b AS (
  SELECT t.upload_id, lix, token_ix, text, y0 - ly1 AS gap FROM tok t JOIN lab l ON t.upload_id = l.upload_id AND token_ix <> lix AND y0 > ly1 AND abs(x0 - lx0) < 50
)
SELECT 'right' AS side, upload_id, lix::INT AS label_ix, token_ix::INT AS token_ix, trim(text) AS text FROM {_BLOCK.format("SELECT * FROM r")} WHERE n = 1
UNION ALL SELECT 'below', upload_id, lix::INT, token_ix::INT, trim(text) FROM {_BLOCK.format("SELECT * FROM b")} WHERE n = 1
""")
def block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest block right of a label and that below it."""
    t = samples.tokens(spark, sf_dir)
    labels = spatial.find_labels(t, ("total",))
    found = [spatial.nearest_block(t, labels, side).withColumn("side", F.lit(side)) for side in ("right", "below")]
    return found[0].unionByName(found[1]).select("side", "upload_id", F.col("l_token_ix").alias("label_ix"), "token_ix", "text")


@_query(f"""
WITH {SQL_TOKENS}, a AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY confidence DESC, token_ix) AS n FROM tok),
b AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY confidence DESC, token_ix) AS m FROM a WHERE n > 1)
SELECT upload_id, 'net' AS field, token_ix::INT AS token_ix FROM a WHERE n = 1 UNION ALL SELECT upload_id, 'gross', token_ix::INT FROM b WHERE m = 1
""")
def consumed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields want the same tokens; what the first takes is gone for the second."""
    t = samples.tokens(spark, sf_dir).select("upload_id", "page", "token_ix", F.col("confidence").alias("score"))
    wanted = t.withColumn("field", F.explode(F.array(F.lit("gross"), F.lit("net"))))
    return spatial.consume(wanted, ("net", "gross")).select("upload_id", "field", "token_ix")


@_query(f"""
WITH {SQL_TOKENS}, t AS (SELECT * FROM tok WHERE token_ix % 4 <> 0)
SELECT upload_id, token_ix::INT AS token_ix, round(confidence / 100, 8) AS confidence, CASE WHEN token_ix % 3 = 0 THEN 0.0 ELSE x0 END AS x0, CASE WHEN token_ix % 3 = 0 THEN 0.0 ELSE y0 END AS y0,
  CASE WHEN token_ix % 3 = 0 THEN 0.0 ELSE x1 END AS x1, CASE WHEN token_ix % 3 = 0 THEN 0.0 ELSE y1 END AS y1, confidence / 100 < 0.6 AS weak,
  CASE WHEN token_ix % 3 = 0 THEN 0.0 ELSE (y0 + y1) / 2 END AS middle, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS diagonal
FROM t
""")
def recognised_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser output as tokens: blank texts go, polygons become boxes, those without four points zeros."""
    point = lambda x, y: F.array(F.col(x), F.col(y))
    four = F.array(point("x1", "y0"), point("x0", "y0"), point("x0", "y1"), point("x1", "y1"))
    raw = samples.tokens(spark, sf_dir).withColumns({"polygon": F.when(F.col("token_ix") % 3 == 0, F.slice(four, 1, 3)).otherwise(four), "text": F.when(F.col("token_ix") % 4 == 0, "  ").otherwise(F.col("text"))})
    diagonal = raw.select("upload_id", "token_ix", tokens.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("diagonal"))
    got = tokens.from_recognised(raw).withColumns({"weak": tokens.low_confidence(), "middle": tokens.center_y()})
    return got.join(diagonal, ["upload_id", "token_ix"]).select("upload_id", "token_ix", F.round("confidence", 8).alias("confidence"), "x0", "y0", "x1", "y1", "weak", "middle", "diagonal")


@_query(f"""
WITH {SQL_TOKENS} SELECT upload_id, token_ix::INT AS token_ix, round(least(greatest(0.45::DOUBLE * confidence + 0.3::DOUBLE * (CASE WHEN {_NUMBER} THEN 1 ELSE 0 END) + 0.2::DOUBLE * x0 / 40 + 0.05::DOUBLE * (CASE WHEN token_ix % 2 = 0 THEN {{pdf}}::DOUBLE ELSE 0 END), 0), 1), 9) AS score FROM tok
""".replace("{pdf}", str(float(bank.rules.CONFIDENCE_PDF))))
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted confidence of a field found in a token."""
    source = F.when(F.col("token_ix") % 2 == 0, "pdf").otherwise("ocr")
    score = bank.weighted_confidence(F.col("confidence"), F.col("text").rlike(r"^-?\d+(\.\d+)?$"), F.col("x0") / 40, source)
    return samples.tokens(spark, sf_dir).select("upload_id", "token_ix", F.round(score, 9).alias("score"))


# --- helpers -------------------------------------------------------------------------------


@_query(r"""
WITH o AS (SELECT o_orderkey, o_orderdate AS d, 'RM ' || printf('%,.2f', o_totalprice::DOUBLE) || ' only' AS said, 'Due ' || printf('%d', floor(o_totalprice)::BIGINT) AS whole FROM orders)
SELECT o_orderkey, regexp_extract(said, '[\d,\.]+\.?\d{0,2}') AS first_number, regexp_replace(said, '[^\d,.]', '', 'g') AS amount_chars, regexp_extract(replace(said, ',', ''), '\d+\.\d{2}') AS label_value,
  regexp_extract(whole, '\d+') || '.00' AS whole_value, strftime(d, '%d/%m/%Y') AS digits_date, strftime(d, '%Y') AS stated_year, strftime(d, '%Y-%m-%d') AS typed_date
FROM o
""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    said = F.concat(F.lit("RM "), F.format_number("o_totalprice", 2), F.lit(" only"))
    whole = F.concat(F.lit("Due "), F.floor("o_totalprice").cast("string"))
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    return o.select(
        "o_orderkey", numbers.first_number(said).alias("first_number"), numbers.keep_amount_chars(said).alias("amount_chars"), numbers.label_value(said).alias("label_value"), numbers.label_value(whole).alias("whole_value"),
        dates.normalize_date(F.concat(F.lit("on "), F.date_format("o_orderdate", "dd-MM-yyyy"))).alias("digits_date"), dates.statement_year(day).alias("stated_year"), dates.as_date(day).cast("string").alias("typed_date"),
    )


@_query("""
WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS k, printf('%,d', 1000 + c_custkey % 8999) AS v, lpad((c_custkey % 100)::VARCHAR, 2, '0') AS cents FROM customer)
SELECT c_custkey, 'Total ' || v || '.' || cents || ' for ' || k || '.00 x' || k || '.y and ' || v || ' 5 ' || v || ' 123.00' AS decimals, 'a, b (c) d' || k AS spaces,
  '1050' || k || ' BOX 0' || k || ' ' || k || '1 aSb 5' || k || '28' AS digits, 'Report ' || k || '.v1' AS filename, '.pdf' AS extension FROM c
""")
def text_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of texts made from columns, with near misses: a point within a word, one or three digits after a thousand."""
    k, v = F.col("c_custkey").cast("string"), F.format_number(F.lit(1000) + F.col("c_custkey") % 8999, 0)
    amounts = F.concat(F.lit("Total "), v, F.lit(" "), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit(" for "), k, F.lit(". x"), k, F.lit(".y and "), v, F.lit(" 5 "), v, F.lit(" 123."))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.fix_decimal_points(amounts).alias("decimals"), text.remove_extra_spaces(F.concat(F.lit(" a , b  ( c ) d"), k)).alias("spaces"),
        text.fix_lookalikes(F.concat(F.lit("1O5O"), k, F.lit(" BOX O"), k, F.lit(" "), k, F.lit("l aSb S"), k, F.lit("Z8"))).alias("digits"), text.clean_filename(F.concat(F.lit(" Report* "), k, F.lit(".v1?"))).alias("filename"),
        text.file_extension(F.concat(F.lit("/in/"), k, F.lit(".x.PDF"))).alias("extension"),
    )


@_query(f"""
WITH {SQL_PAGES}
SELECT upload_id, count(*) AS total_documents, count(*) FILTER (document_type = 'payslip') AS payslips, count(*) FILTER (document_type = 'bank_statement') AS bank_statements, 0::BIGINT AS other,
  avg(confidence_score) AS raw_average_confidence, sum(text_length)::BIGINT AS total_text_length FROM pg GROUP BY upload_id
""")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = samples.statement_pages(spark, sf_dir).withColumn("raw_confidence", F.col("confidence_score"))
    return results.summarise(p).drop("average_confidence")


@_query(f"""
WITH {SQL_PAGES} SELECT upload_id, document_number, first_value(document_type) OVER (PARTITION BY upload_id ORDER BY document_number) AS document_type FROM pg
""")
def first_page_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.type_of_first_page(samples.statement_pages(spark, sf_dir)).select("upload_id", "document_number", "document_type")


@_query(f"""
WITH {SQL_PAGES}, n AS (
  SELECT *, CASE WHEN account_number IS NULL THEN 0 ELSE 1 END + 2 + (opening_balance <> '0.00')::INT + (closing_balance <> '0.00')::INT AS known,
    3 + (account_number IS NOT NULL)::INT + (total_debit IS NOT NULL)::INT AS present FROM pg
)
SELECT upload_id, document_number, known / 5 AS truthy, present / 5 AS not_null,
  concat_ws(' ', account_number, account_holder_name, total_debit) AS said FROM n
""")
def record_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a record's values that are there, by both rules, and the text that its language is told by."""
    strict = [F.col(c) for c in ("account_number", "account_holder_name", "statement_date", "opening_balance", "closing_balance")]
    loose = [F.col(c) for c in ("account_number", "account_holder_name", "statement_date", "opening_balance", "total_debit")]
    return samples.statement_pages(spark, sf_dir).select(
        "upload_id", "document_number", bank.completeness(strict, truthy=True).alias("truthy"), bank.completeness(loose).alias("not_null"),
        results.values_text(("account_number", "account_holder_name", "total_debit")).alias("said"),
    )


@_query("""
SELECT s_suppkey, s_suppkey % 3 = 0 AS same_major, CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS sums_agree FROM supplier
""")
def version_and_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    version = F.concat((k % 3 + 2).cast("string"), F.lit(".1.0"))
    net = F.when(k % 4 == 0, "80.50").when(k % 4 == 1, "70.00").when(k % 4 == 2, "0.00")
    rows = table(spark, sf_dir, "supplier").withColumns({"gross_income": F.lit("100.00"), "total_deduction": F.lit("20.00"), "net_income": net})
    return rows.select("s_suppkey", validate.same_major(version, F.lit("2.0")).alias("same_major"), validate.sums_agree().alias("sums_agree"))


@_query(f"""
WITH {SQL_PAGES} SELECT upload_id, count(*) AS pages, sum(text_length)::BIGINT AS total FROM pg GROUP BY upload_id
""")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records through the JSON sink and back."""
    p = samples.statement_pages(spark, sf_dir)
    path = scratch.fresh(spark, "results")
    nested = p.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("document_number", "text_length"))).alias("documents"))
    sinks.write_results(nested, path, 16)
    back = sinks.read_results(spark, path, nested.schema)
    total = F.aggregate("documents", F.lit(0).cast("long"), lambda a, d: a + d["text_length"])
    return back.select("upload_id", F.size("documents").cast("long").alias("pages"), total.alias("total"))


@_query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id AS upload_id, CASE WHEN conv_id % 3 = 0 THEN 'cimb' WHEN conv_id % 3 = 1 THEN 'bsn' ELSE 'generic' END AS bank FROM c WHERE n = 1
""")
def bank_of_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank that an upload's first page names; later pages name another."""
    k = F.col("conv_id")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    said = F.when(F.col("turn") != first, "BANK ISLAM").when(k % 3 == 0, "CIMB BANK").when(k % 3 == 1, "BANK SIMPANAN NASIONAL BSN").otherwise("SOME COOPERATIVE")
    p = c.select(k.alias("upload_id"), F.col("turn").alias("document_number"), said.alias("text"))
    return classify.bank_of_first_page(p).select("upload_id", "bank")


@_query(f"""
WITH k AS (SELECT c_custkey, translate(lpad(c_custkey::VARCHAR, 6, '0'), '0123456789', 'abcdefghij') AS name FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 OR regexp_matches('Alpha B' || name, '{older.NO_HOLDER_LINE}') THEN NULL ELSE 'Alpha B' || name END AS holder FROM k
""")
def holder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holder's line among headings, short lines and lines with one capitalised word."""
    k = F.col("c_custkey")
    name = F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "abcdefghij")
    line = F.when(k % 4 == 3, F.lit("Alpha only")).otherwise(F.concat(F.lit("Alpha B"), name))
    page = F.concat(F.lit("Statement Date Here\nAb C\n"), line, F.lit("\nOpening Balance Today\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", older.holder_line(page).alias("holder"))


@_query("""
SELECT s_suppkey AS upload_id, 'Alpha B' || translate(lpad(s_suppkey::VARCHAR, 6, '0'), '0123456789', 'abcdefghij') AS account_holder_name, '1' || lpad(s_suppkey::VARCHAR, 9, '0') AS account_number, 'Day 01/02/2024' AS statement_date,
  CASE WHEN s_suppkey % 5 = 0 THEN '0.00' ELSE (100 + s_suppkey % 900)::VARCHAR || '.00' END AS opening_balance, (200 + s_suppkey % 900)::VARCHAR || '.00' AS closing_balance,
  CASE WHEN s_suppkey % 3 > 0 THEN (300 + s_suppkey % 900)::VARCHAR || '.25' END AS total_debit, CASE s_suppkey % 3 WHEN 1 THEN (400 + s_suppkey % 900)::VARCHAR || '.50' WHEN 2 THEN (300 + s_suppkey % 900)::VARCHAR || '.25' END AS total_credit,
  '01/' || lpad((s_suppkey % 12 + 1)::VARCHAR, 2, '0') || '/2024 on' AS statement_period_from, '28/' || lpad((s_suppkey % 12 + 1)::VARCHAR, 2, '0') || '/2024 incl' AS statement_period_to
FROM supplier
""")
def tokens_to_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank record put together from positioned tokens: values right of their labels, or below.

    Some pages lack a label; where only the first word of one is found, that counts.
    """
    k = F.col("s_suppkey")
    money = lambda n, cents="00": F.concat((k % 900 + n).cast("string"), F.lit(f".{cents}"))
    month = F.lpad((k % 12 + 1).cast("string"), 2, "0")
    name = F.concat(F.lit("Alpha B"), F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "abcdefghij"))
    said = [
        (F.lit("Account Holder"), 10, 200), (name, 120, 203), (F.lit("Account Number"), 10, 10), (F.concat(F.lit("No 1"), F.lpad(k.cast("string"), 9, "0")), 120, 10),
        (F.lit("Statement Date"), 10, 60), (F.lit("Day 01/02/2024"), 120, 63), (F.lit("elsewhere"), 300, 60), (F.lit("Closing Balance"), 300, 110), (money(200), 300, 140),
        (F.when(k % 5 == 0, "Opening Balance rate").otherwise("Opening Balance"), 10, 110), (money(100), 120, 110),
        (F.when(k % 3 > 0, "Total Debit").otherwise("Sum"), 10, 260), (F.concat(F.lit("RM "), money(300, "25")), 120, 260), (F.when(k % 3 == 1, "Total Credit").otherwise("Sum"), 10, 300), (F.concat(F.lit("RM "), money(400, "50")), 120, 300),
        (F.lit("Statement Period From"), 10, 340), (F.concat(F.lit("01/"), month, F.lit("/2024 on")), 120, 340), (F.lit("Statement Period To"), 10, 380), (F.concat(F.lit("28/"), month, F.lit("/2024 incl")), 120, 380),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("token_ix"), t.alias("text"), F.lit(0.9).alias("confidence"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(x + 100.0).alias("x1"), F.lit(y + 20.0).alias("y1")) for i, (t, x, y) in enumerate(said)])
    rows = table(spark, sf_dir, "supplier").select(k.alias("upload_id"), F.lit(1).alias("page"), F.inline(each))
    return spatial.bank_record(rows).drop("page")


@_query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'Invalid account number format' WHEN c_custkey % 3 = 2 THEN 'Invalid statement date format' ELSE 'Valid bank statement data' END AS validation_message FROM customer
""")
def rule_table_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by a table of patterns and ranges."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k, F.lit("ALPHA").alias("account_holder_name"), F.when(k % 3 == 1, "A-1").otherwise("AC12").alias("account_number"), F.when(k % 3 == 2, "01/02/2031").otherwise("01/02/2024").alias("statement_date"),
        F.lit("1,000.00").alias("opening_balance"), F.lit("2.00").alias("closing_balance"),
    )
    table_ = {"account_number_pattern": r"^AC\d{2}$", "date_range": {"min_year": 2000, "max_year": 2030}}
    return rows.select("c_custkey", validate.bank_verdict(table=table_)["validation_message"].alias("validation_message"))


@_query("""
SELECT c_custkey, c_custkey % 3 = 0 AS surely_bank, c_custkey % 3 <> 1 AS bank, c_custkey % 3 = 1 AS payslip, 'bank_statement' AS constant_type,
  CASE WHEN c_custkey % 2 = 0 THEN '900101-' || substr(lpad(c_custkey::VARCHAR, 6, '0'), 1, 2) || '-' || substr(lpad(c_custkey::VARCHAR, 6, '0'), 3, 4) ELSE ' 12-' || c_custkey || ' ' END AS id_number
FROM customer
""")
def class_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is of a type with over half, or at least half, of the confidence; and identifiers as they are normalised."""
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, "Account No 1 Statement Date Opening Balance ").when(k % 3 == 1, "Payslip Gaji Bersih KWSP ").otherwise("Transaction Salary ")
    rows = table(spark, sf_dir, "customer").select(k, classify.document_type(said).alias("c"), F.when(k % 2 == 0, F.concat(F.lit("900101"), F.lpad(k.cast("string"), 6, "0"))).otherwise(F.concat(F.lit(" 12-"), k.cast("string"), F.lit(" "))).alias("said"))
    return rows.select(
        "c_custkey", classify.is_type(F.col("c"), "bank_statement").alias("surely_bank"), classify.is_type(F.col("c"), "bank_statement", strict=False).alias("bank"),
        classify.is_type(F.col("c"), "payslip").alias("payslip"), classify.only_bank_statements()["document_type"].alias("constant_type"), dates.normalize_id_number(F.col("said")).alias("id_number"),
    )


@_query("""
SELECT conv_id AS upload_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text)::INT AS document_number, text FROM conversations
""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of page texts as numbered pages."""
    c = table(spark, sf_dir, "conversations")
    lists = c.groupBy(F.col("conv_id").alias("upload_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"]).alias("texts"))
    return landing.split_pages(lists).select("upload_id", "document_number", "text")


# --- second layouts ------------------------------------------------------------------------


@_query("""
WITH k AS (SELECT s_suppkey AS id, translate(lpad(s_suppkey::VARCHAR, 6, '0'), '0123456789', 'ABCDEFGHIJ') AS n, s_suppkey % 5 AS b, (1000 + s_suppkey % 9000) AS m FROM supplier)
SELECT id AS upload_id, (['cimb', 'bsn', 'bank_islam', 'public_islamic', 'generic'])[b + 1] AS detected_bank,
  CASE b WHEN 0 THEN '51-0000123-4' WHEN 1 THEN lpad(id::VARCHAR, 16, '1') WHEN 2 THEN lpad(id::VARCHAR, 14, '1') WHEN 3 THEN lpad(id::VARCHAR, 10, '1') ELSE lpad(id::VARCHAR, 12, '1') END AS account_number,
  CASE b WHEN 0 THEN 'ALPHA ' || n || ' BIN GAMMA' WHEN 1 THEN 'ALPHA ' || n || ' BIN BETA' WHEN 2 THEN 'PUAN ALPHA ' || n WHEN 3 THEN 'ENCIK ALPHA ' || n || ' BIN BETA' ELSE 'PUAN ALPHA ' || n END AS account_holder_name,
  CASE b WHEN 0 THEN '28/02/2024' WHEN 1 THEN '03/04/2024' WHEN 2 THEN '05/06/24' WHEN 3 THEN '9 June 2024' ELSE '03/04/24' END AS statement_date,
  m || '.50' AS opening_balance, CASE b WHEN 2 THEN '7.00' ELSE (m + 1) || '.10' END AS closing_balance,
  CASE WHEN b IN (0, 2) THEN NULL ELSE '5.00' END AS total_debit, CASE WHEN b IN (0, 2) THEN NULL ELSE '6.00' END AS total_credit,
  CASE b WHEN 0 THEN '01/02/2024' WHEN 1 THEN '01/03/2024' WHEN 2 THEN '01/05/24' WHEN 3 THEN NULL ELSE '01/03/24' END AS statement_period_from,
  CASE b WHEN 0 THEN '27/02/2024' WHEN 1 THEN '31/03/2024' WHEN 2 THEN '31/05/24' WHEN 3 THEN NULL ELSE '30/03/24' END AS statement_period_to
FROM k
""")
def extract_other_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose fields are found by the later words and patterns of each bank."""
    k = F.col("s_suppkey")
    n, m = samples.letters(k), k % 9000 + 1000
    digits = lambda w: F.lpad(k.cast("string"), w, "1")
    opening, closing = F.format_number(m + F.lit(0.5), 2), F.format_number(m + F.lit(1.1), 2)
    dots = F.translate(opening, ",", "."), F.translate(closing, ",", ".")
    layouts = [
        F.concat(F.lit("CIMB BANK 7 Alpha "), n, F.lit(" Bin Gamma 12 Tarikh Penyata 28/02/2024 No Akaun 51-0000123-4 OPENING BALANCE "), opening, F.lit(" BAKI PENUTUP "), closing, F.lit(" From 01/02/2024 To 27/02/2024")),
        F.concat(F.lit("BANK SIMPANAN NASIONAL BSN 1 ALPHA "), n, F.lit(" BIN BETA Account No "), digits(16), F.lit(" Tarikh Penyata 03/04/2024 Baki Hadapan "), dots[0], F.lit(" Available Balance "), dots[1], F.lit(" Total Debit: 5.00 Total Credit: 6.00 From 01/03/2024 To 31/03/2024")),
        F.concat(F.lit("BANK ISLAM PUAN ALPHA "), n, F.lit(" NOMBOR AKAUN "), digits(14), F.lit(" STATEMENT DATE 05/06/24 BAL BIF "), opening, F.lit(" BAL C/F 7.00 From 01/05/24 To 31/05/24")),
        F.concat(F.lit("PUBLIC ISLAMIC BANK ENCIK ALPHA "), n, F.lit(" BIN BETA STATEMENT OF ACCOUNT Account Number: "), digits(10), F.lit(" Statement Date 2024 June 9 Balance From Last Statement "), opening, F.lit(" Closing Balance RM "), closing, F.lit(" Total Debits 5.00 Total Credits 6.00")),
        F.concat(F.lit("KOPERASI SATU ACC NO: "), digits(12), F.lit(" PUAN ALPHA "), n, F.lit(" tarikh 03/04/24 baki awal "), opening, F.lit(" baki akhir "), closing, F.lit(" jumlah debit 5.00 jumlah kredit 6.00 dari 01/03/24 hingga 30/03/24")),
    ]
    said = F.element_at(F.array(*layouts), (k % 5 + 1).cast("int"))
    r = bank.bank_record(table(spark, sf_dir, "supplier").select(k.alias("upload_id"), text.clean_text(said).alias("text")))
    return r.select("upload_id", "detected_bank", *bank.FIELDS)


@_query("""
WITH k AS (SELECT s_suppkey AS id, (100 + s_suppkey % 900) AS m FROM supplier)
SELECT id AS upload_id, m || '.25' AS gross_income, CASE WHEN id % 2 = 0 THEN '60.75' ELSE '45.50' END AS total_deduction, '01/2023' AS month_year FROM k
""")
def extract_payslip_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payslips without a total of deductions on every other one: the items are added up."""
    k = F.col("s_suppkey")
    gap = F.lit(" " + samples.FILLER)
    gross = F.concat((k % 900 + 100).cast("string"), F.lit(".25"))
    less = F.when(k % 2 == 0, F.concat(F.lit("KWSP 50.50 ringgit "), gap, F.lit("Takaful 10.25 dan"))).otherwise(F.lit("Jumlah Potongan 45.50"))
    said = F.concat(F.lit("Nama: ALPHA BIN GAMMA 1"), gap, F.lit("No KP 900101145555"), gap, F.lit("Jumlah Pendapatan "), gross, gap, less, gap, F.lit("M/S 1/2023"))
    r = payslip.payslip_record(table(spark, sf_dir, "supplier").select(k.alias("upload_id"), said.alias("text")))
    return r.select("upload_id", "gross_income", "total_deduction", "month_year")


@_query("SELECT doc_id::VARCHAR AS upload_id, doc_id || '.pdf' AS name, md5(text) AS content_md5, strlen(text) AS n_bytes FROM documents WHERE doc_id % 7 <> 0")
def kept_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bytes of accepted uploads, through their sink and its reader."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("upload_id"), F.encode("text", "UTF-8").alias("content"), (F.col("doc_id") % 7 != 0).alias("accepted"))
    path = scratch.fresh(spark, "uploads")
    sinks.keep_uploads(d, path, 16)
    return sinks.read_uploads(spark, path).select("upload_id", "name", F.md5("content").alias("content_md5"), F.octet_length("content").cast("long").alias("n_bytes"))


@_query("""
SELECT conv_id::VARCHAR AS upload_id, 'extracted_text_page_' || n || '.txt' AS name, md5(text) AS text_md5
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations)
""")
def kept_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts, through their sink and its reader."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("upload_id"), number.alias("document_number"), "text")
    path = scratch.fresh(spark, "texts")
    sinks.keep_page_texts(p, path, 16)
    return sinks.read_page_texts(spark, path).select("upload_id", "name", F.md5("text").alias("text_md5"))


@_query(f"WITH {SQL_TOKENS} SELECT upload_id, page::INT AS page, token_ix::INT AS token_ix, text, confidence, x0, y0, x1, y1 FROM tok")
def kept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned tokens, through their sink and its reader."""
    t = samples.tokens(spark, sf_dir).select("upload_id", F.col("page").cast("int").alias("page"), F.col("token_ix").cast("int").alias("token_ix"), "text", *[F.col(c).cast("double").alias(c) for c in ("confidence", "x0", "y0", "x1", "y1")])
    path = scratch.fresh(spark, "tokens")
    sinks.keep_tokens(t, path, 16)
    return sinks.read_tokens(spark, path, t.schema)


@_query(f"WITH {SQL_TOKENS} SELECT upload_id, token_ix::INT AS token_ix, (dense_rank() OVER (PARTITION BY upload_id, page ORDER BY y0) - 1)::INT AS line FROM tok")
def relative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by a tolerance relative to the page's height, so narrow that each height of equal boxes is a line."""
    return tokens.cluster_lines(samples.tokens(spark, sf_dir), tokens.relative_tolerance(0.05)).select("upload_id", "token_ix", "line")


@_query("""
SELECT c_custkey AS upload_id, CASE WHEN k % 3 = 0 THEN '"e' || k || '"' ELSE '"paddle"' END AS engine, CASE WHEN k % 3 = 2 THEN '["ar"]' ELSE '["en","ms"]' END AS languages,
  CASE WHEN k % 3 = 0 THEN k::VARCHAR ELSE '1' END AS times, '2' AS pause, CASE WHEN k % 5 = 0 THEN (100 + k)::VARCHAR WHEN k % 3 = 1 THEN NULL ELSE '10' END AS upload_mb,
  CASE WHEN k % 3 = 1 AND k % 5 <> 0 THEN '5' END AS limits, CASE WHEN k % 3 <> 2 THEN '"base"' END AS note, CASE WHEN k % 3 = 2 THEN '"' || n_name || '"' END AS note_by
FROM customer JOIN (SELECT n_nationkey AS k, n_name FROM nation) ON c_nationkey = k
""")
def settings_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of many templates, each under the settings that its three layers resolve to."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string")
    base = spark.createDataFrame([(None, 0, '{"ocr": {"engine": "paddle", "languages": ["en", "ms"], "retry": {"times": 1, "pause": 2}}, "limits": {"upload_mb": 10}, "note": "base"}')], settingrows.LAYERS)
    own = (
        F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('{"ocr": {"engine": "e'), k, F.lit('", "retry": {"times": '), k, F.lit("}}}")))
        .when(F.col("n_nationkey") % 3 == 1, F.lit('{"limits": 5}')).otherwise(F.concat(F.lit('{"note": {"by": "'), F.col("n_name"), F.lit('"}, "ocr": {"languages": ["ar"]}}')))
    )
    above = F.concat(F.lit('{"limits": {"upload_mb": '), (F.col("n_nationkey") + 100).cast("string"), F.lit('}, "ocr": {"retry": {}}}'))
    layers = base.unionByName(n.select(F.col("n_name").alias("template"), F.lit(1).alias("layer"), own.alias("document"))).unionByName(n.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("template"), F.lit(2).alias("layer"), above.alias("document")))
    uploads = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("upload_id"), F.col("n_name").alias("template"))
    wanted = {"engine": ("ocr", "engine"), "languages": ("ocr", "languages"), "times": ("ocr", "retry", "times"), "pause": ("ocr", "retry", "pause"), "upload_mb": ("limits", "upload_mb"), "limits": ("limits",), "note": ("note",), "note_by": ("note", "by")}
    return settingrows.with_settings(uploads, settingrows.resolved(layers), wanted).drop("template")


_BROKEN = "CASE s_suppkey % 9 WHEN 1 THEN 'name: missing' WHEN 2 THEN 'id_number: not of its shape' WHEN 3 THEN 'gross_income: no money' WHEN 4 THEN 'net_income: missing' WHEN 5 THEN 'month_year: no month' WHEN 6 THEN 'name: over 100 characters; month_year: not of its shape' END"


def _unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payslip records, six in nine each with faults of its own kind."""
    k = F.col("s_suppkey")
    other = lambda n, x, c: F.when(k % 9 == n, x).otherwise(c)
    return table(spark, sf_dir, "supplier").select(
        k.alias("upload_id"), F.when(k % 9 == 1, "").when(k % 9 == 6, F.repeat(F.lit("x"), 101)).otherwise("ALPHA").alias("name"), other(2, F.lit("12"), F.lit("900101-14-1234")).alias("id_number"),
        other(3, F.lit("1.2.3"), F.concat((k % 900).cast("string"), F.lit(".50"))).alias("gross_income"), other(4, F.lit(None), F.lit("80.25")).alias("net_income"), F.lit("20.25").alias("total_deduction"),
        F.when(k % 9 == 5, "13/2024").when(k % 9 == 6, "2024").otherwise("07/2024").alias("month_year"),
    )


@_query("SELECT s_suppkey AS upload_id, 'ALPHA' AS name, '900101-14-1234' AS id_number, (s_suppkey % 900 + 0.5)::DECIMAL(18,2)::VARCHAR AS gross_income, '80.25' AS net_income, '20.25' AS total_deduction, '2024-07-01' AS month_year FROM supplier WHERE s_suppkey % 9 IN (0, 7, 8)")
def records_by_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that keep their contract; amounts and months are typed ones, shown as text."""
    good = contracts.divide(_unchecked(spark, sf_dir), contracts.PAYSLIP, scratch.fresh(spark, "contract"))[0]
    return good.select("upload_id", *[F.col(f.name).cast("string").alias(f.name) for f in contracts.PAYSLIP])


@_query(f"SELECT s_suppkey AS upload_id, CASE s_suppkey % 9 WHEN 3 THEN '1.2.3' ELSE s_suppkey % 900 || '.50' END AS gross_income, {_BROKEN} AS reasons FROM supplier WHERE s_suppkey % 9 BETWEEN 1 AND 6")
def quarantined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that break their contract, as they came, with every reason."""
    broken = contracts.divide(_unchecked(spark, sf_dir), contracts.PAYSLIP, scratch.fresh(spark, "contract"))[1]
    return broken.select("upload_id", "gross_income", F.array_join("reasons", "; ").alias("reasons"))
