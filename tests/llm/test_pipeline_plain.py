"""The whole pipeline against plain code on the smallest table, and that no query leaves intermediate files."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from paperloom.llm import toxicity
from paperloom.plans import scratch

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def plain_toxic(machine, text):
    """The score by the sum over all pairs of terms."""
    _, bucket = toxicity.features(pa.array([text or ""], pa.string()))
    v = machine.factors[bucket].astype(np.float64)
    pairs = v @ v.T
    z = machine.bias + machine.linear[bucket].sum(dtype=np.float64) + (pairs.sum() - np.trace(pairs)) / 2
    return 1 / (1 + np.exp(-z))


def plain_near(docs):
    """One document of each class that pairs of a similarity of 0.8 make, over all pairs."""
    sets = {}
    for d in docs:
        w = words((d["text"] or "").translate(LOWER))
        sets[d["doc_id"]] = {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def plain_repeats(docs):
    seen, out = set(), []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        w = words(d["text"])
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if key in seen else set()
            seen.add(key)
        left = [x for i, x in enumerate(w) if i not in gone]
        if not gone or left:
            out.append(d | ({"text": " ".join(left)} if gone else {}))
    return out


def plain_mix(docs):
    """Each document as often as its source's rate and its own draw say."""
    size = Counter()
    for d in docs:
        size[d["source"]] += len(words(d["text"]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / whole >= 2.0 * size[s]]
        if not full:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    out = []
    for d in docs:
        rate = target[d["source"]] / size[d["source"]] if size[d["source"]] else 0.0
        draw = int(hashlib.md5(f"mix-1:{d['doc_id']}:{d['text'] or ''}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [d] * (int(rate) + (draw < rate % 1))
    return out


def test_the_whole_run(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    machine = toxicity.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = [r.asDict() for r in source.collect()]
    clean = [d for d in docs if plain_toxic(machine, d["text"]) < 0.5]
    near = plain_near(clean)
    fresh = plain_repeats(near)
    want = plain_mix(fresh)
    assert len(docs) > len(clean) > len(near) and len(want) > len(fresh) // 2  # each stage has work here
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    said = lambda text: model.decode(model.encode(text or ""))
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert Counter((r.doc_id, r.lang, r.source, model.decode(list(r.ids))) for r in got) == Counter((d["doc_id"], d["lang"], d["source"], said(d["text"])) for d in want)


def files(spark):
    at = scratch.root(spark).removeprefix("file://")
    return {os.path.join(d, f) for d, _, names in os.walk(at) for f in names}


@pytest.mark.parametrize("name", ["op1_warc_dictionary", "op2_simple8b_ids", "op9_recompression", "op10_progressive_jpeg", "op11_radix_suffixes", "op12_merkle_manifest", "op13_drake_bounds", "pipeline"])
def test_no_query_leaves_files(spark, name):
    before, tables = files(spark), {t.name for t in spark.catalog.listTables()}
    with scratch.workspace(spark):
        assert entry.queries()[name](spark, SF).collect()
    assert files(spark) == before and {t.name for t in spark.catalog.listTables()} == tables
