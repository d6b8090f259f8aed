"""Functions in SQL give what they give over columns, by the same plan."""

import re

import pytest
from pyspark.sql import functions as F

from paperloom import samples
from paperloom.operators import tokens
from paperloom.plans import sqlfunctions

SF = "/root/testdata/sf0.001"
SAID = [
    "RM 1,234.50", "1.234.567", "12,50", "-5.00", "10 000 , 50", "1,234 56 for 12.", " a , b ( c )", "1O5 BOX S5", "in/x.PDF", "29/02/2023", "31/12/1999", "5/3/24", "900101141234", "", None,
    "Transaction Details 01/02/2024 x 3/4/24 Baki", "Account No 1 BANK ISLAM Statement Date Opening Balance", "Payslip Gaji Bersih yang dan", "it's a \\ \"quote\" 日本 1,00000",
]


@pytest.fixture(scope="module")
def said(spark):
    sqlfunctions.register(spark, "f_")
    df = spark.createDataFrame([(x, "bsn" if i % 2 else "cimb", "01/02/2024") for i, x in enumerate(SAID)], "said string, bank string, day string").withColumn("path", F.col("said"))
    df.createOrReplaceTempView("said")
    return df


@pytest.mark.parametrize("name", list(sqlfunctions.FUNCTIONS))
def test_sql_gives_what_columns_give(spark, said, name):
    arguments, make = sqlfunctions.FUNCTIONS[name]
    want = said.select("said", make(*[F.col(a) for a in arguments]).alias("v"))
    got = spark.sql(f"SELECT said, f_{name}({', '.join(arguments)}) AS v FROM said")
    assert got.dtypes == want.dtypes
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize("name", ["clean_text", "fix_decimal_points", "remove_extra_spaces", "fix_lookalikes", "parse_number"])
def test_the_plan_is_that_of_columns(spark, said, name):
    arguments, make = sqlfunctions.FUNCTIONS[name]
    plan = lambda df: re.sub(r"#\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
    a, b = said.select(make(*[F.col(a) for a in arguments]).alias("v")), spark.sql(f"SELECT f_{name}({', '.join(arguments)}) AS v FROM said")
    assert plan(a) == plan(b)


def test_whole_queries_in_sql(spark, said):
    spark.read.parquet(f"{SF}/documents.parquet").createOrReplaceTempView("documents")
    got = spark.sql("SELECT f_told_language(text).language AS language, count(*) AS n, sum(length(f_clean_text(text))) AS chars FROM documents GROUP BY 1").collect()
    assert sum(r.n for r in got) == spark.table("documents").count() and all(r.chars > 0 for r in got)
    t = samples.tokens(spark, SF)
    sqlfunctions.layout_views(t, "t_")
    lines = spark.sql("SELECT upload_id, page, line, array_join(transform(array_sort(collect_list(struct(place, text))), x -> x.text), ' ') AS said FROM t_lines GROUP BY ALL")
    assert lines.groupBy("upload_id", "page").agg(F.max("line")).count() == t.select("upload_id", "page").distinct().count()
    assert spark.sql("SELECT sum(merged_from) FROM t_runs").first()[0] == t.count()
    assert spark.sql("SELECT count(*) FROM t_page_texts").first()[0] == tokens.page_text(t).count()
