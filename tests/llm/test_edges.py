"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import chat, jpeg, ledger, media, mixing, pieces, simhash, substring, tokenids, toxicity, warc
from paperloom.llm.shared import fresh_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, fp long, media string, ids string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rnd = random.Random(5)
    some = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "Delta", "épsilon", "zeta,", "eta", "theta", "x"]) + str(rnd.randrange(40)) for _ in range(n))
    base, passage = some(120), some(45)
    out = [base, base, base + " tail", base.replace("alpha", "alpha2", 1), some(30) + " " + passage + " " + some(30), "head " + passage, some(9), "", None, " \n\t ", "one", "a b c"]
    out += [passage + "\n" + passage, "idiot " * 30, "same " * 50, "▁ <s> <|endoftext|> it's 日本語   \x1c x", some(20000), "x" * 5000, "l1\nl1\nl2 w\nl1"]
    out += [some(25) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def rows():
    got = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, 9.0, "mine", 7, "m", "i", 3) for i, t in enumerate(texts())]
    return [*got, (None, "null id text " * 8, None, None, None, None, None, None, None, None, None), got[4], got[4]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_warc(spark, rows):
    pages = [(r[0], None if i % 4 == 0 else f"http://h/{i} x", r[1], "clash") for i, r in enumerate(rows)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload_digest string")
    path = fresh_dir(spark, "t")
    warc.write_archives(warc.with_revisits(df), path, archive_bytes=40_000)
    got = warc.read_archives(spark, path).collect()
    first = {}
    for p, _, h, _ in pages:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    expected = Counter()
    for p, _, h, _ in pages:
        b = (h or "").encode()
        to = first.get(h) if p is not None and h in first and p > first[h] else None
        expected[p, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert {r.payload for r in got if r.record_type == "response"} >= {(t or "").encode() for _, _, t, _ in pages}
    empty = fresh_dir(spark, "t")
    warc.write_archives(warc.with_revisits(df.limit(0)), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_dictionary_frame():
    records = [warc.page_record(i, "u", b"<html>some shared text %d</html>" % i * 20, 1, "d", None) for i in range(200)]
    data = warc.archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert list(warc.frames(data + warc.FOOTER.encode()))[1:] == records
    huge = warc.page_record(999, "u", b"<p>" + b"z" * (40 << 20), 1, "d", None)
    data = warc.archive([*records[:50], huge, *records[50:]])
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC


def test_simple8b():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 4000):
        for high in (2, 50, 60_000, 1 << 32):
            a = rnd.integers(0, high, n).astype(np.uint32)
            if n > 10:
                a[[3, 5, 7]] = tokenids.ESCAPE, tokenids.ESCAPE - 1, (1 << 32) - 1
            w, first, esc, _ = tokenids.pack(a)
            assert (tokenids.unpack(w, first, esc, n) == a).all()


def test_simple8b_in_pieces(monkeypatch):
    monkeypatch.setattr(tokenids, "PIECE_IDS", 3000)
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2048, 2049, 9000):
        a = rnd.integers(0, 60_000, n).astype(np.uint32)
        a[::97] = (1 << 32) - 1 - np.arange(len(a[::97]), dtype=np.uint32)
        place, keys, lengths, ids = tokenids.from_file(tokenids.to_file(7, [5, None], np.array([n, 0]), a) + tokenids.FOOTER.encode())
        assert (place, keys, lengths.tolist()) == (7, [5, None], [n, 0]) and (ids == a).all()
        assert all((x == y).all() for x, y in zip(tokenids.pack_pieces(a), tokenids.pack(a), strict=True))


def test_token_files(spark, docs, rows, none):
    from tokenizers import Tokenizer

    model = public_tokenizers.path("byte_bpe_50k.json")
    path = fresh_dir(spark, "t")
    tokenids.write_ids(docs, path, model, file_ids=5000)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in tokenids.read_ids(spark, path).collect()))
    t = Tokenizer.from_file(model)
    at, last = 0, None
    expected = Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows)
    for start, doc, n, crc, ids in got:
        assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert last is None or doc is None or doc >= last
        at, last = at + n, doc
    assert Counter((g[1], tuple(g[4])) for g in got) == expected
    empty = fresh_dir(spark, "t")
    tokenids.write_ids(none, empty, model)
    assert tokenids.read_ids(spark, empty).count() == 0


def test_mix(spark, docs, rows, none):
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(rows) and "score" in got[0].asDict()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == size[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 2
    assert {(r.doc_id, r.text, r.copies) for r in got} == {(r.doc_id, r.text, r.copies) for r in mixing.mix_counts(docs.repartition(7)).collect()}
    assert mixing.mix(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == 0


def test_toxicity(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, 1 if t and "idiot" in t else 0) for i, t in enumerate(texts())] * 2 + [(3, None), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(none, machine).count() == 0
    blank = toxicity.fit(none, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, blank).select("predicted").collect()} <= {0, 1}


def test_toxicity_learns_pairs(spark):
    rnd = random.Random(1)
    made = []
    for i in range(900):
        w = [f"w{rnd.randrange(200)}" for _ in range(30)]
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        made.append((i, " ".join(w + ["insultword"] * a + ["groupword"] * b), int(a and b)))
    df = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    machine = toxicity.fit(df, spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(df, machine).collect()}
    held = [m for m in made if zlib.crc32(str(m[0]).encode()) % 5 == 0]
    assert sum(got[m[0]] == m[2] for m in held) / len(held) > 0.95


def brute_measures(t):
    t = t or ""
    w = words(t)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", t)), t.count("!"))


def test_ledger(spark, docs, rows, none):
    led = ledger.ledger(docs)
    got = Counter((r.doc_id, *(r[m] for m in ledger.MEASURES)) for r in led.collect())
    assert got == Counter((r[0], *brute_measures(r[1])) for r in rows)
    kept = ledger.apply_policy(led, "v1")
    only = {r.rule: (r.failed, r.only) for r in ledger.ablations(led, "v1").collect()}
    bits = [r.failed for r in kept.collect()]
    for name, b in ledger.BIT.items():
        assert only[name] == (sum(x & b > 0 for x in bits), sum(x == b for x in bits))
    assert ledger.ledger(none).count() == 0 and {r.failed for r in ledger.ablations(ledger.ledger(none), "v1").collect()} == {0}


def brute_fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, docs, rows, none):
    fp = simhash.fingerprints(docs, keep=("doc_id",))
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(fp).collect())
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_classes(fps)
    least = {}
    for r, k in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[k] = min(r[0], least.get(k, r[0]))
    assert got == Counter((r[0], f, least.get(k)) for r, f, k in zip(rows, fps, roots, strict=True))
    kept = simhash.keep_one(docs).collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept) <= len({r[1] or "" for r in rows}) and kept[0].asDict().keys() == dict(zip(docs.columns, docs.columns, strict=True)).keys()
    assert simhash.classes(simhash.fingerprints(none)).count() == 0 and simhash.keep_one(none).count() == 0


def test_keep_one_takes_near_copies(spark):
    rnd = random.Random(6)
    made, groups = [], 0
    for g in range(40):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(80, 300))]
        groups += 1
        made.append((len(made), " ".join(base)))
        if g % 2 == 0:
            other = list(base)
            for _ in range(max(1, len(base) // 100)):  # a similarity of about 0.9
                other[rnd.randrange(len(base))] = "new"
            made.append((len(made), " ".join(other)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert groups <= len(kept) <= groups + 1 and kept >= {d for d, t in made if "new" not in t}


@pytest.mark.parametrize("tile", [4, 512])
def test_links_of_dense_fingerprints(spark, tile):
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    fps = {0, (1 << 64) - 1}
    for _ in range(150):
        x = centre
        for b in rnd.sample(range(64), rnd.randrange(0, 9)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.linked(nodes, tile=tile).collect()]
    at = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == brute_classes(fps)


def test_piece_model(spark, docs, rows, none):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode(docs, model, dropout=0.0).collect() if r.text and "▁" not in r.text)
    assert plain == Counter((r[0], tuple(lib.encode(r[1]))) for r in rows if r[1] and "▁" not in r[1])
    some = pieces.encode(docs, model, dropout=0.3)
    back = pieces.decode(some.select("doc_id", F.col("text").alias("was"), "ids"), model).collect()
    assert all(r.text == (r.was or "") for r in back) and len(back) == len(rows)
    again = pieces.encode(docs.repartition(5), model, dropout=0.3)
    key = lambda r: (r.doc_id, r.text, tuple(r.ids))
    assert Counter(map(key, some.collect())) == Counter(map(key, again.collect()))
    assert Counter(map(key, some.collect())) != Counter(map(key, pieces.encode(docs, model, dropout=0.3, seed=2).collect()))
    assert pieces.encode(none, model).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), model).first().text == ""


def test_heap_and_trees_agree():
    m = pieces.Model.at(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(2)
    chunks = [" " + "".join(rnd.choice("abcdetionsß日 ") for _ in range(rnd.randrange(1, 30))) for _ in range(500)]
    keys = np.array([rnd.getrandbits(64) for _ in chunks], dtype=np.uint64)
    for dropout in (0.0, 0.3, 1.0):
        limit = min(int(dropout * 2**64), 2**64 - 1)
        leaf = m._walk(m._roots([c.encode() for c in chunks]), keys, limit)
        got = [m.sym[m.first[x] : m.first[x] + m.size[x]].tolist() for x in leaf]
        assert got == [m.by_heap(m.symbols(c).tolist(), int(k), limit) for c, k in zip(chunks, keys, strict=True)]


def brute_repeats(rows, window=20):
    order = sorted(set((r[0] if r[0] is not None else 1 << 63, hashlib.sha256(" ".join(words(r[1])).encode()).digest()[:16], " ".join(words(r[1]))) for r in rows))
    seen, out = set(), {}
    for doc, _, joined in order:
        w = joined.split(" ") if joined else []
        gone, new = set(), []
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone |= set(range(i, i + window))
            seen.add(k)
        out[doc, joined] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
        del new
    return out


def test_substring(spark, docs, rows, none):
    got = substring.remove_repeats(docs).collect()
    expected = brute_repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        joined = " ".join(words(r.text))
        n, gone, kept = expected[r.doc_id if r.doc_id is not None else 1 << 63, joined]
        assert (r.n_words, r.n_removed) == (n, gone)
        assert (joined if r.kept is None else r.kept) == kept
        assert r.words_sha256 == hashlib.sha256(joined.encode()).digest()
    assert substring.remove_repeats(none).count() == 0


def test_recompression_is_local():
    """Symbols strictly inside a passage are the same wherever it stands."""
    rnd = np.random.default_rng(4)
    passage = rnd.integers(0, 30, 60).astype(np.uint64)
    found = []
    for _ in range(5):
        a, b = rnd.integers(0, 30, rnd.integers(1, 40)).astype(np.uint64), rnd.integers(0, 30, rnd.integers(1, 40)).astype(np.uint64)
        h = substring.mix(np.concatenate([a, passage, b]))
        name, low, high = substring.recompress(h, np.array([0, len(h)]))
        inside = (low >= len(a)) & (high <= len(a) + 60)
        found.append(sorted(zip(name[inside].tolist(), (low[inside] - len(a)).tolist(), (high[inside] - len(a)).tolist(), strict=True)))
    assert all(f == found[0] for f in found) and len(found[0]) > 10


def test_jpeg_round_trip():
    rnd = np.random.default_rng(1)
    for n in (64, 128, 448, 64 * 700):
        p = rnd.integers(0, 256, n, dtype=np.uint8).tobytes()
        d = jpeg.decode(jpeg.encode_payload(p))
        assert d.payload() == p and d.rgb().shape == (d.height, d.width, 3)
    with pytest.raises(ValueError):
        jpeg.encode_payload(b"x")


def test_jpeg_general_entropy_coding():
    """Scans with runs, new coefficients in refinement, and restarts, through the walking decoder."""
    values = {0: 5, 1: -3, 4: 2, 40: 1}
    dc_codes, ac_codes = jpeg._canonical({3: 2, 2: 2, 0: 3}), jpeg._canonical({0x00: 2, 0x01: 2, 0x31: 3, 0xF0: 4, 0x21: 4})

    def bits(*parts):
        return _scan(np.array([int(b) for v, n in parts for b in format(v, f"0{n}b")], dtype=np.uint8))

    _scan = jpeg._scan_bytes
    out = [b"\xff\xd8", jpeg._DQT, jpeg._segment(jpeg.SOF2, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))]
    out += [jpeg._table(0, 0, {3: 2, 2: 2, 0: 3}), jpeg._table(1, 0, {0x00: 2, 0x01: 2, 0x31: 3, 0xF0: 4, 0x21: 4})]
    out += [jpeg._sos([1], (0, 0), 0, 0), bits(dc_codes[3], (5, 3))]
    # first pass without the last bit: only -3 -> -1 at 1 and 2 -> 1 at 4 (two zeros between)
    out += [jpeg._sos([1], (1, 63), 0, 1), bits(ac_codes[0x01], (0, 1), ac_codes[0x21], (1, 1), ac_codes[0x00])]
    # second pass: 1 gets its bit on the way, 4 gets 0; the new one at 40 comes after 31 zeros of value zero (two runs of 16 skip 33 - 2)
    zeros = [k for k in range(1, 40) if k not in (1, 4)]
    parts, left = [], len(zeros)
    parts += [ac_codes[0xF0], (1, 1), (0, 1)]  # 16 zeros; corrections of 1 and 4 follow
    left -= 16
    parts += [ac_codes[0xF0]]
    left -= 16
    assert 0 <= left < 16
    out_table = {0x00: 2, 0x01: 2, 0x31: 3, 0xF0: 4, 0x21: 4, left << 4 | 1: 5}
    out.append(jpeg._table(1, 0, out_table))
    codes = jpeg._canonical(out_table)
    parts = [codes[0xF0], (1, 1), (0, 1), codes[0xF0], codes[left << 4 | 1], (1, 1), codes[0x00]]
    out += [jpeg._sos([1], (1, 63), 1, 0), bits(*parts), b"\xff\xd9"]
    got = jpeg.decode(b"".join(out)).coefficients()[0][0]
    assert {k: int(v) for k, v in enumerate(got) if v} == values


def test_media(spark, docs, rows, none):
    stored = media.with_media(docs, keep=("doc_id", "text"))
    back = media.payloads(stored).collect()
    for r in back:
        data = (r.text or "").encode()
        assert r.payload == media.padded(data) and r.n_bytes == len(data) and len(r.payload) % 64 == 0 and r.payload
    t = media.tensors(stored).first()
    assert len(t.rgb) == t.height * t.width * 3
    by_text = defaultdict(set)
    for r in stored.collect():
        by_text[r.text or ""].add(bytes(r.media))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.with_media(none).count() == 0 and media.summaries(media.with_media(none)).count() == 0
    assert media.tensors(spark.createDataFrame([(None,)], "media binary")).first().rgb is None


def test_chat(spark):
    made = []
    for c in range(60):
        for t in range(6):
            role = ("user", "assistant")[t % 2]
            made.append((c, t, role, ("short ask?" if role == "user" else "a longer reply that goes on and on for quite some time\nwith a second line")))
    extra = [(None, None, None, None), (None, None, None, None), (3, 99, "tool", "x"), (7, 1, "assistant", "again"), (7, 1, "assistant", "again"), (8, 50, "user", "")]
    df = spark.createDataFrame(made + extra, "conv_id long, turn int, role string, text string").withColumn("rendered", F.lit("clash"))
    packed = chat.blocks(chat.as_transcript(df))
    model = chat.fit(packed)
    got = chat.parse(packed, model).collect()
    assert len(got) == len(made) + len(extra)
    known = [r for r in got if r.label in chat.ROLES]
    assert sum(r.role == r.label for r in known) / len(known) > 0.9
    assert chat.parse(chat.blocks(df.limit(0)), model).count() == 0


def test_chat_blocks_keep_the_score(spark, monkeypatch):
    """A conversation cut into many blocks scores the same as in one piece."""
    rnd = random.Random(8)
    made = [(1, t, ("user", "assistant")[t % 2], " ".join("w" * rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 60)))) for t in range(200)]
    df = chat.as_transcript(spark.createDataFrame(made, "conv_id long, turn int, role string, text string"))
    whole = chat.blocks(df.coalesce(1))
    model = chat.fit(whole)
    many = whole.select("conv_id", "turns", "roles", "texts").collect()
    turns, roles, texts_ = ([x for r in sorted(many, key=lambda r: r.turns[0]) for x in r[k]] for k in ("turns", "roles", "texts"))
    cut = [(1, 0, i, turns[k : k + 7], roles[k : k + 7], texts_[k : k + 7]) for i, k in enumerate(range(0, 200, 7))]
    cut_df = spark.createDataFrame(cut, chat._BLOCK)
    one_df = spark.createDataFrame([(1, 0, 0, turns, roles, texts_)], chat._BLOCK)

    def score(df):
        obs = [np.concatenate(chat._observed([texts_]))]
        states = []
        for r in sorted(chat.joints(df, model).collect(), key=lambda r: r.seq):
            part = [c for c in df.collect() if c.seq == r.seq][0]
            states += model.paths(chat._observed([part.texts]), np.array([r.entry]), np.array([r.leave]))[0].tolist()
        if not states:
            states = model.paths(obs, np.array([chat.START]), np.array([-1]))[0].tolist()
        before = [chat.START, *states[:-1]]
        return sum(int(model.move[a, b] + model.emit[b, o]) for a, b, o in zip(before, states, obs[0].tolist(), strict=True))

    assert score(cut_df) == score(one_df)
