"""The registered queries against their SQL, and the pipeline against its parts, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from paperloom.llm import catalog, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if pd.isna(x) else x.item() if hasattr(x, "item") else x
    return sorted((tuple(clean(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(c.execute(catalog.oracle_sql()[name]).fetch_df())


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_query_covers_its_table(spark, name):
    source = "conversations" if name.startswith("op4") else "documents"
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if i < 4:
            assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert docs.where("n_tokens <> size(ids)").count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_pipeline_on_few_rows(spark, n, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(n).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 2 * n


def test_pipeline_on_odd_rows(spark, tmp_path):
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "", None, "a", 0), (None, "", None, "a", 0), (2, "w " * 3000, "en", None, 5), (2, "w " * 3000, "en", None, 5), (3, "some words here", "en", "b", 3)]
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as score", "2 as kept", "3 as size").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in got)
    # texts without words are one class, as are the repeated rows; every source has a rate of 1.5
    assert set(copies) == {1, 2, 3} and set(copies.values()) <= {1, 2}
    assert {r.n_tokens for r in got if r.doc_id == 1} == {0}
    assert {tuple(r.ids) for r in got if r.doc_id == 2} == {tuple(lone.ids) for lone in pieces.encode(spark.createDataFrame([(2, "w")], "doc_id long, text string"), MODEL, dropout=0.0).collect()}
