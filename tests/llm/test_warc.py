"""WARC archives: exact round trips."""

import base64
import hashlib
import random

import pytest
import zstandard
from sieve.llm import warc

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def plain(rows):
    """[(page, size, digest, kind, refers_to)] by the documented rules."""
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, x in data:
        twins = [j for j, y in data if y == x and j is not None] if len(x) >= 1000 else []
        best = max(twins, default=None)
        again = best is not None and (i is None or i < best)
        out.append((i, len(x), hashlib.sha1(x).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=repr)


def got(rows):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows.collect()), key=repr)


def made_rows():
    rng = random.Random(1)
    big = "<p>" + " ".join(f"w{rng.randrange(999)}" for _ in range(400))
    other = big[::-1]
    rows = [(k, f"http://h/{k}", rng.choice([big, other, "small", "ä" * 499, "é" * 500, ""])) for k in range(60)]
    rows += [(100, None, None), (101, "http://a\r\nX: y/  ü", big + "\x00\r\n\r\nWARC/1.1\r\n"), (102, "", "P*M\x18\x00\x00\x00\x00" * 300),
             (None, "u", big), (None, None, other), (59, "again", rows[59][2]), (103, "long", "".join(rng.choice("abc\n") for _ in range(3_000_000)))]
    return rows


def test_round_trip(spark):
    rows = made_rows()
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    back = warc.round_trip(pages, archive_bytes=40_000)
    assert got(back) == plain(rows)
    payloads = {}
    for r in back.collect():
        if r["record_type"] == "response":
            payloads.setdefault(r["page_id"], set()).add(bytes(r["payload"]).decode())
    for i, _, h in rows:
        if i in payloads and i is not None:
            assert (h or "") in payloads[i]


def test_files_follow_the_format(spark, tmpdir_path):
    """Each file: the dictionary frame, then frames that unpack alone with it."""
    rows = [(k, f"http://host/{k}", f"<html><body><p>page {k} " + "common words of every page " * 20) for k in range(400)]
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmpdir_path}/warc", archive_bytes=100_000)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{tmpdir_path}/warc").collect()]
    assert len(files) > 1
    seen = 0
    for data in files:
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        words, rest = zstandard.ZstdCompressionDict(data[8:8 + size]), data[8 + size:]
        assert words.dict_id() != 0 and rest.endswith(warc.EMPTY_FRAME.encode())
        assert zstandard.get_frame_parameters(rest).dict_id == words.dict_id()
        whole = zstandard.ZstdDecompressor(dict_data=words).stream_reader(rest, read_across_frames=True).read()
        records = list(warc.unpack(data))
        assert b"".join(records) == whole and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
        seen += len(records)
    assert seen == len(rows)


def test_record_fields():
    data = "ü".encode() * 600
    digest = hashlib.sha1(data).hexdigest()
    fields, payload = warc.parse(warc.record(7, "http://x/", data, digest, None))
    assert payload == data and fields["warc-type"] == "response" and fields["warc-target-uri"] == "http://x/"
    assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    fields, payload = warc.parse(warc.record(5, "http://x/", data, digest, 7))
    assert payload == b"" and fields["warc-type"] == "revisit" and fields["x-refers-to-page"] == "7"
    assert fields["warc-profile"].endswith("identical-payload-digest") and fields["x-payload-length"] == "1200"
    with pytest.raises(ValueError):
        warc.parse(warc.record(7, "u", data, digest, None)[:-300])


def test_damage_is_seen():
    records = [warc.record(k, "u", b"words " * 50 + bytes([65 + k % 26]) * 50, hashlib.sha1(b"").hexdigest(), None) for k in range(60)]
    data = warc.archive(records)
    assert list(warc.unpack(data)) == records
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.unpack(data[:-9]))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.unpack(data[:-40] + bytes([data[-40] ^ 255]) + data[-39:]))


def test_dictionary_pays_and_may_be_missing():
    records = [warc.record(k, f"http://h/{k}", f"<div class='entry'><p>item {k}</p></div>".encode() * 4, "00" * 20, None) for k in range(500)]
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(warc.archive(records)) < 0.8 * alone
    assert warc.build_dictionary([b"x"]) == b"" and list(warc.unpack(warc.archive([b"x"]))) == [b"x"]


def test_empty_table_and_odd_columns(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "u", "x", "d", 5)], SCHEMA + ", digest string, response long")
    assert got(warc.round_trip(rows)) == plain([(1, "u", "x")])


def test_registered_query(oracle):
    assert oracle("op2_warc") == 50
