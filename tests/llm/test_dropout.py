"""Merge-dropout draws for each occurrence of a chunk, as its own agenda would."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_every_occurrence_is_its_own_agenda(monkeypatch):
    m = pieces.Model.at(MODEL)
    rnd = random.Random(7)
    some = ["international", "documentation", "x", "straße", "日本語", "internationalisation" * 3, "the", "q7▁z"]
    texts = [" ".join(rnd.choice(some) for _ in range(rnd.randrange(0, 300))) for _ in range(30)]
    drawn = pieces.keys(np.arange(30) // 2, np.ones(30, bool), np.arange(30) % 2)
    limit = int(0.3 * 2.0**64)
    for most, block in ((pieces.CACHE_NODES, pieces.BLOCK_CHUNKS), (100, 7)):
        monkeypatch.setattr(pieces, "CACHE_NODES", most)
        monkeypatch.setattr(pieces, "BLOCK_CHUNKS", block)
        m.clear()
        ids, off = m.encode(pa.array(texts), drawn, 0.3)
        for i, t in enumerate(texts):
            expected, at = [], 0
            for w in t.split(" ") if t else []:
                own = pieces.mix(drawn[i : i + 1] ^ pieces.mix(np.array([at], np.uint64)))
                expected += m.expand(m.by_heap(m.symbols(" " + w).tolist(), int(own[0]), limit))
                at += 1 + len(w.encode())
            assert ids[off[i] : off[i + 1]].tolist() == expected
    monkeypatch.undo()
    m.clear()


def test_variety_grows_with_the_data(spark):
    df = spark.createDataFrame([(i, "internationalisation") for i in range(400)], "doc_id long, text string")
    assert len({tuple(r.ids) for r in pieces.encode(df, MODEL, dropout=0.3).collect()}) > 10
    one = spark.createDataFrame([(1, "internationalisation " * 400)], "doc_id long, text string")
    assert len(set(pieces.encode(one, MODEL, dropout=0.3).first().ids)) > 30


def test_copies_are_cut_apart(spark):
    rows = [(i, " ".join(["international documentation"] * 50), "en", "s", 1) for i in range(5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.encode_pieces(spark, df, "").collect()
    assert len({tuple(r.ids) for r in got}) == len(got) == 10
    again = corpus_pipeline.encode_pieces(spark, df.repartition(3), "")
    assert sorted(tuple(r.ids) for r in again.collect()) == sorted(tuple(r.ids) for r in got)
    assert again.where(F.col("n_tokens") != F.size("ids")).isEmpty()
