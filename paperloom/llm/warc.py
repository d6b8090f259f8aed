"""WARC archives compressed record by record with a dictionary of their own.

``write_archives`` packs records into files: a leading skippable frame (magic 0x184D2A5D) holds a
Zstandard dictionary trained on that file's records, then each record is a frame of its own, and
an empty skippable frame ends the file.  Any reader of dictionary-compressed WARC files can open
them.  ``read_archives`` does so and returns one row per record.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id is
a response; others are revisits without payload that refer to it.  The table of repeated digests
is aggregated before it is joined, so a payload that fills a third of the table costs a row per
task; pages are not shuffled while that table is small (see ``join_small``).

Defined results: a null payload is an empty one; a record with a null id is a response and never
referred to; rows that repeat the smallest id are all responses; a null url is left out of the
record; an empty table writes no file.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import fresh_dir, join_small, read_blobs, write_blobs

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
FOOTER = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to); payload null for revisits."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    repeated = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("__first"), F.count("*").alias("__n"))
        .where("__n > 1 and __first is not null")
        .drop("__n")
    )
    joined = join_small(rows, repeated, "payload_digest")
    refers = F.when(F.col("page_id") > F.col("__first"), F.col("__first"))
    joined = joined.withColumn("refers_to", refers)
    return joined.select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        "payload_bytes", "payload_digest", "refers_to",
    )


def _record(kind: str, ident: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload, payload_bytes, payload_digest, refers_to) -> bytes:
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    fields = [("WARC-Payload-Digest", f"sha256:{payload_digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    return _record("response" if refers_to is None else "revisit", name(page_id), fields, head + (payload or b""))


def train(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> zstd.ZstdCompressionDict | None:
    """A dictionary from records spread over the file; None if they are too few or too short to train on.

    Records of over an eighth of the sample are left out, so that one of them doesn't take the place of all others.
    """
    fit = [r for r in records if 8 <= len(r) <= sample // 8]
    chosen = fit[:: max(1, -(-sum(map(len, fit)) // sample))]
    size = min(size, sum(map(len, chosen)) // 16)
    if len(chosen) < 8 or size < 1024:
        return None
    try:
        return zstd.train_dictionary(size, chosen, k=512, d=8)
    except zstd.ZstdError:  # too uniform to train on
        return None


def archive(records: list[bytes]) -> bytes:
    """One file without its footer."""
    out, used = [], train(records)
    if used is not None:
        data = used.as_bytes()
        out += [struct.pack("<II", DICTIONARY_MAGIC, len(data)), data]
        used.precompute_compress(level=LEVEL)
    c = zstd.ZstdCompressor(level=LEVEL, dict_data=used, write_checksum=True, write_content_size=True)
    info = _record("warcinfo", "<urn:paperloom:archive>", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    out += [c.compress(r) for r in [info, *records]]
    return b"".join(out)


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes rows of ``with_revisits`` as archives of about ``archive_bytes`` before compression."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        n = 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["archive"])
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")), strict=True):
                held.append(page_record(*row))
                n += len(held[-1])
                if n >= archive_bytes:
                    yield done()
                    held, n = [], 0
        if held:
            yield done()

    write_blobs(rows.mapInArrow(pack, "archive binary"), "archive", path, FOOTER)


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed."""
    at, d = 0, zstd.ZstdDecompressor()
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic in SKIPPABLE:
            (n,) = struct.unpack_from("<I", data, at + 4)
            if magic == DICTIONARY_MAGIC:
                d = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data[at + 8 : at + 8 + n]))
            at += 8 + n
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        head = data[at : at + 18]
        end, last = at + zstd.frame_header_size(head), 0
        while not last:
            x = int.from_bytes(data[end : end + 3], "little")
            last = x & 1
            end += 3 + (1 if x >> 1 & 3 == 1 else x >> 3)
        end += 4 * zstd.get_frame_parameters(head).has_checksum
        yield d.decompress(data[at:end])
        at = end


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _page(name: str) -> int | None:
    x = name[len("<urn:page:") : -1]
    return None if x == "null" else int(x)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per page record; payloads are checked against the digest in the record."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)
        for b in batches:
            for content in b.column("content"):
                rows, n = [], 0
                for record in frames(content.as_buffer().to_pybytes()):
                    f, block = parse_record(record)
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
                    digest = f["WARC-Payload-Digest"].partition(":")[2]
                    if f["WARC-Type"] == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"payload of {f['WARC-Record-ID']} is damaged")
                    to = f.get("WARC-Refers-To")
                    rows.append((_page(f["WARC-Record-ID"]), length, digest, f["WARC-Type"], to and _page(to), f.get("WARC-Target-URI"), body if payloads and to is None else None))
                    n += len(body)
                    if n > 16 << 20 and payloads:
                        yield make(rows)
                        rows, n = [], 0
                if rows:
                    yield make(rows)

    return read_blobs(spark, path).select("content").mapInArrow(parse, _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = fresh_dir(spark, "warc")
    write_archives(with_revisits(pages), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, payload_bytes, p.payload_digest,
  CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
