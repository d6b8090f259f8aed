"""Texts made so that polynomial hashes modulo 2**64 can't tell them apart, whatever their base."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from paperloom.llm import ledger, pieces, substring, tokenids, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def twins(n):
    """Two words of n letters in Thue-Morse order and its mirror."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_word_hashes_differ():
    for n in (1024, 4096):
        h, other = words.split(pa.array([" ".join(twins(n))])).hashes()
        assert h[0] != h[1] and other[0] != other[1]


def test_token_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokenids.Encoder.at(path)
    for text in twins(4096):
        assert own.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_decode_to_each_text():
    m = pieces.Model.at(MODEL)
    for texts in (twins(4096), twins(32), [" ".join(twins(1024) * 3)]):
        for dropout in (0.0, 0.2, 1.0):
            ids, off = m.encode(pa.array(list(texts)), pieces.keys(np.arange(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts), int)), dropout)
            assert [t.decode() for t in m.decode(ids, off)] == list(texts)


def test_lines_and_windows_are_told_apart(spark):
    a, b = twins(1024)
    df = spark.createDataFrame([(1, f"{a}\n{b}\n{a}"), (2, f"{a} {b} {b} {a} {a} {b}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in ledger.ledger(df).collect()}
    assert got == {1: (1, 0), 2: (0, 0)}


def test_repeats_are_told_apart(spark):
    a, b = twins(1024)
    rest = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"x {b} {rest}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in substring.remove_repeats(df).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (20, "x")}
