"""Names whose letters spell a word that no name has."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions.text import clean_text
from paperloom.operators import payslip


@pytest.mark.parametrize(("name", "known"), [("ALPHA AAABHD BIN GAMMA", True), ("ALPHA ABANKA BIN GAMMA", True), ("ALPHA BHD BIN GAMMA", False)])
def test_one_line(spark, name, known):
    df = spark.createDataFrame([(f"Nama: {name} 1 No KP 900101000173",)], "text string")
    assert payslip.payslip_record(df).first().name == (name if known else None)


@pytest.mark.parametrize("name", ["ALPHA AAGAJI BIN GAMMA", "ALPHA NAMAAA BIN GAMMA"])
def test_page(spark, name):
    df = spark.createDataFrame([(f"Nama : {name} Bulan : JANUARI 2025\nNo KP : 900101006098\nGaji Bersih : 10.00",)], "page_text string")
    assert payslip.page_record(df.withColumn("text", clean_text(F.col("page_text")))).first().name == name
