"""Dictionary-compressed WARC archives.

Every archive file is a sequence of Zstandard frames: first a skippable frame (magic
0x184D2A5D) with a dictionary built from the archive's own records, then one frame
per record, compressed alone with that dictionary, so records can be read one by one.
Files are written by Spark's text writer, one archive a row and file: the row's bytes
are the archive and the line separator is an empty skippable frame, which readers
skip.  They lie wherever Spark can write, and the commit protocol keeps archives of
lost or repeated tasks out.

Pages with equal payloads of ``REVISIT`` bytes or more are stored once: the one with
the largest id as ``response``, the others as ``revisit`` records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import lookup, quoted

REVISIT = 1_000
#: bytes of records after which a task starts the next archive
ARCHIVE_BYTES = 64 << 20
#: size of an archive's dictionary, and bytes of records it is trained on
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 2 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: magics of the dictionary frame and of the empty frame between archives (fixed values)
DICTIONARY_MAGIC, EMPTY_FRAME = 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"
RECORD_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 9562


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_NAMES, f'{page_id} {url}')}>"


def clean(value: str) -> str:
    """A header value without control characters (percent-encoded)."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response with the payload or, with ``refers_to``, a
    revisit without it.  The header fields ``X-`` hold what the format has no field for."""
    size = len(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, url)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", clean(url)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page", str(page_id)))
    head.append(("X-Payload-Length", str(size)))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[:int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("truncated WARC record")
    return fields, block.partition(b"\r\n\r\n")[2]


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> bytes:
    """Zstandard dictionary from records spread evenly over the archive, as many as
    fit the sample; empty if there is too little to build one from."""
    import zstandard

    total = sum(map(len, records))
    some = records[::max(1, -(-total // sample))]
    some = [r[:128 << 10] for r in some]
    try:
        return zstandard.train_dictionary(size, some, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The archive file of some records, at least one."""
    import zstandard

    words = build_dictionary(records)
    options = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **options)
    return struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words + b"".join(map(packer.compress, records))


def unpack(data: bytes):
    """The records of an archive file, one after another."""
    import zstandard

    at, words = 0, b""
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        magic, = struct.unpack_from("<I", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size, = struct.unpack_from("<I", data, at + 4)
            if magic == DICTIONARY_MAGIC and size:
                words = data[at + 8:at + 8 + size]
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            at += 8 + size
            continue
        one, out = reader.decompressobj(), []
        while not one.eof:  # in steps, so that a record costs its own bytes only
            if at >= len(data):
                raise ValueError("truncated frame")
            step = data[at:at + (64 << 10)]
            out.append(one.decompress(step))
            at += len(step)
        at -= len(one.unused_data)
        yield b"".join(out)


def roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", revisit: int = REVISIT) -> DataFrame:
    """``digest, response``: of payloads of at least ``revisit`` bytes that several
    rows have, the largest page id (null if none has an id).  Only digests are shuffled,
    summed per task before."""
    payload = F.coalesce(quoted(html_col), F.lit("")).cast("binary")
    narrow = pages.select(quoted(id_col).alias("page"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    return narrow.where(F.col("size") >= revisit).groupBy("digest") \
        .agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("response")).where("n > 1").select("digest", "response")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          revisit: int = REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write all rows of ``pages`` as archives below ``path``.

    A null html is an empty payload, a null url leaves its field out.  Rows that share
    the largest id of a payload (repeated rows, or all ids null) are responses each.
    A record larger than ``archive_bytes`` gets an archive that ends with it."""
    payload = F.coalesce(quoted(html_col), F.lit("")).cast("binary")
    rows = pages.select(quoted(id_col).cast("long").alias("page"), quoted(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    met = lookup(rows, roles(pages, id_col, html_col, revisit), ["digest"], F.xxhash64("page"))
    refers = F.when(F.col("page").isNull() | (F.col("page") < F.col("response")), F.col("response"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for page, url, data, digest, to in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page, url, data, digest, to))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["data"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["data"])

    files = met.select("page", "url", "payload", "digest", refers.alias("refers")).mapInArrow(run, "data binary")
    files.select(F.col("data").cast("string").alias("value")).write.mode("overwrite") \
        .option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``: ``page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, payload`` (null for revisits).

    A response's digest and length are made from its payload and must be the header's;
    a revisit's are those of its header.  A file is read whole: files are as large as
    the writer's ``archive_bytes``."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for file in batch.column(0):
                rows, size = [], 0
                for fields, payload in map(parse, unpack(file.as_py())):
                    kind, digest = fields["warc-type"], base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, int(fields["x-payload-length"])):
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                    page, to = fields.get("x-page"), fields.get("x-refers-to-page")
                    rows.append((page and int(page), fields.get("warc-target-uri"), kind, int(fields["x-payload-length"]), digest, to and int(to),
                                 payload if kind == "response" else None))
                    size += len(payload)
                    if size >= 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` to ``path`` (a new folder in the shared one) and read it back."""
    target = path or scratch_path(pages.sparkSession, "warc")
    write(pages, target, **options)
    return read(pages.sparkSession, target)
