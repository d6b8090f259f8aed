"""Media columns: payloads and images as progressive JPEG, and tensors decoded from them.

``with_media`` stores a binary column losslessly in JPEG coefficients (see ``paperloom.llm.jpeg``);
``tensors`` decodes any progressive JPEG column to full-resolution RGB tensors, and ``payloads``
reads stored bytes back.  All three are row-wise over Arrow batches, a few MB at a time, without
a shuffle; the media table is written to the shared folder between storing and reading.

Defined results: a null or empty text is a payload of 64 zero bytes; repeated rows and equal
texts get equal media; an empty table gives an empty one; columns of the input named like an
output column are replaced; a media value that is null gives null outputs in ``tensors``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.jpeg import decode, encode_payload
from paperloom.llm.shared import saved
from paperloom.llm.words import raw, slices, strings

UNIT = 64


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``UNIT``."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def _schema(df: DataFrame, own: list[str], more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*own).schema] + [more])


def with_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all but the text, by default), n_bytes, and media, a JPEG that holds the text's bytes."""
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "media") and (keep is not None or c != text)]
    rows = docs.select(*own, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "__text"):
                data, off = raw(strings(s.column("__text")))
                media = [encode_payload(padded(data[a:z].tobytes())) for a, z in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in own), pa.array(np.diff(off)), pa.array(media, pa.binary())], [*own, "n_bytes", "media"])

    return rows.mapInArrow(run, _schema(rows, own, "n_bytes long, media binary"))


def tensors(media: DataFrame, column: str = "media", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all others, by default), height, width, and rgb, the image's bytes by row, column, channel."""
    new = ("height", "width", "rgb")
    own = [c for c in (media.columns if keep is None else keep) if c not in new and (keep is not None or c != column)]
    rows = media.select(*own, F.col(column).cast("binary").alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "__media"):
                images = [None if x is None else decode(x).rgb() for x in s.column("__media").to_pylist()]
                cols = [pa.array([None if x is None else x.shape[k] for x in images], pa.int32()) for k in (0, 1)]
                cols.append(pa.array([None if x is None else x.tobytes() for x in images], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in own), *cols], [*own, *new])

    return rows.mapInArrow(run, _schema(rows, own, "height int, width int, rgb binary"))


def write_tensors(media: DataFrame, path: str, column: str = "media") -> None:
    """Stores the tensors of a media column, with its other columns, as zstd Parquet.

    A tensor has twice the bytes of a stored payload, so the query digests tensors and doesn't store them.
    """
    tensors(media, column).write.option("compression", "zstd").parquet(path)


def payloads(media: DataFrame, column: str = "media", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all others, by default) and payload, the bytes stored in the JPEG."""
    own = [c for c in (media.columns if keep is None else keep) if c != "payload" and (keep is not None or c != column)]
    rows = media.select(*own, F.col(column).cast("binary").alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "__media"):
                got = [None if x is None else decode(x).payload() for x in s.column("__media").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in own), pa.array(got, pa.binary())], [*own, "payload"])

    return rows.mapInArrow(run, _schema(rows, own, "payload binary"))


def feature(rgb: np.ndarray) -> str:
    """Height, width, sums of the channels, and a checksum of the pixels."""
    sums = rgb.sum(axis=(0, 1), dtype=np.int64)
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{sums[0]},{sums[1]},{sums[2]}:{zlib.crc32(rgb.tobytes()):08x}"


def summaries(media: DataFrame) -> DataFrame:
    """Digests of the stored bytes, of the payload read back from them, and of the tensor, by (doc_id, n_bytes)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "media"):
                rows = []
                for stored in s.column("media").to_pylist():
                    image = decode(stored)
                    p = image.payload()
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(image.rgb())))
                cols = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("n_bytes"), *cols], names)

    schema = _schema(media, ["doc_id", "n_bytes"], "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return summaries(saved(with_media(docs, keep=("doc_id",)), "media"))
