"""Every column of the media query against plain recomputation, and stored tensors."""

import hashlib
import math
import random
import zlib

import numpy as np

from paperloom.llm import jpeg, media
from paperloom.llm.shared import fresh_dir


def plain_rgb(d):
    """The image by the textbook inverse transform, pixel by pixel."""
    c = lambda k: 1 / math.sqrt(2) if k == 0 else 1.0
    planes = []
    for part in d.components:
        plane = np.zeros((8 * part["down"], 8 * part["across"]))
        for b, coded in enumerate(part["blocks"]):
            f = np.zeros(64)
            f[jpeg.ZIGZAG] = coded * d.quant[part["q"]]
            f = f.reshape(8, 8)
            for y in range(8):
                for x in range(8):
                    s = sum(c(u) * c(v) * f[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8))
                    plane[8 * (b // part["across"]) + y, 8 * (b % part["across"]) + x] = min(255, max(0, round(s / 4 + 128)))
        planes.append(plane)
    out = np.zeros((d.height, d.width, 3))
    for y in range(d.height):
        for x in range(d.width):
            lum, cb, cr = (p[y * part["v"] // d.v, x * part["h"] // d.h] for p, part in zip(planes, d.components, strict=True))
            cb, cr = cb - 128, cr - 128
            out[y, x] = [lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb]
    return np.clip(np.rint(out), 0, 255)


def test_pixels_are_the_textbooks():
    rnd = random.Random(2)
    for n in (64, 384, 448):
        d = jpeg.decode(jpeg.encode_payload(bytes(rnd.randrange(256) for _ in range(n))))
        got, expected = d.rgb().astype(int), plain_rgb(d).astype(int)
        assert got.shape == expected.shape
        assert np.abs(got - expected).max() <= 3 and (np.abs(got - expected) > 1).mean() < 0.01  # samples half way between two values may round apart


def test_query_columns(spark, tmp_path):
    rnd = random.Random(3)
    texts = ["", None, "a", "x" * 64, "é" * 40, "".join(rnd.choice("ab cd\n") for _ in range(5000)), "a", "".join(map(chr, range(32, 1200)))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        stored = jpeg.encode_payload(payload)
        rgb = jpeg.decode(stored).rgb()
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        flat = rgb.reshape(-1, 3).astype(int).sum(axis=0).tolist()
        assert r.feature == f"{rgb.shape[0]}x{rgb.shape[1]}:{','.join(map(str, flat))}:{zlib.crc32(rgb.tobytes()):08x}"
    assert got[2][1:] == got[6][1:] and got[0][1:] == got[1][1:]


def test_stored_tensors_come_back(spark):
    df = spark.createDataFrame([(1, "some text " * 90), (2, None)], "doc_id long, text string")
    stored = media.with_media(df)
    path = fresh_dir(spark, "tensors")
    media.write_tensors(stored, path)
    back = {r.doc_id: r for r in spark.read.parquet(path).collect()}
    for r in stored.collect():
        rgb = jpeg.decode(bytes(r.media)).rgb()
        assert (back[r.doc_id].height, back[r.doc_id].width) == rgb.shape[:2] and bytes(back[r.doc_id].rgb) == rgb.tobytes()
