"""op12: exact round trip, and archives that something is wrong with."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections import Counter

import numpy as np
import pytest
import zstandard

from costlens.llm import warc

DATE = "2024-01-01T00:00:00Z"


def brute(rows, min_bytes=0):
    digests = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= min_bytes and page is not None:
            digests[payload] = min(page, digests.get(payload, page))
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = digests.get(payload)
        kind = "response" if first is None or page == first else "revisit"
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, kind, first if kind == "revisit" else None))
    return Counter(out)


def got(df):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    html = lambda: "<html><p>" + " ".join(rng.choice(["één", "two", "<b>three</b>", "four\r\n\r\n"], 80)) + "</p></html>"
    out = [(i, f"http://h/{i}", html()) for i in range(300)]
    out += [(500 + i, f"http://h/{i}", out[11][2]) for i in range(200)]  # a common payload
    out += [(900, None, out[12][2]), (899, "http://h/a b\r\nX: y", out[12][2])]
    out += [(1000, "u", None), (1001, "u", ""), (1002, "u", None), (None, "u", out[13][2]), (None, "u", "only null ids"), (None, "v", "only null ids")]
    out += [(14, "again", out[14][2]), (1100, "long", "x" * 3_000_000), (1101, "long", "y\n" * 100)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, "r", 1) for a, b, c in rows], "page_id long, url string, html string, key string, first int")


@pytest.mark.parametrize("min_bytes", [0, 1, 250])
def test_round_trip(spark, rows, min_bytes):
    assert got(warc.report(frame(spark, rows).repartition(3), min_bytes)) == brute(rows, min_bytes)


def test_payloads_come_back_from_many_small_archives(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/crawl"
    manifest = warc.write_archives(frame(spark, rows), folder, archive_bytes=20_000, dictionary_bytes=4096, date=DATE)
    assert manifest.count() > 5
    (tmp_path / "crawl" / "left-by-a-lost-task.warc.zst").write_bytes(b"broken")
    back = warc.read_written(manifest)
    responses = {(r["page_id"], bytes(r["payload"])) for r in back.filter("record_type = 'response'").collect()}
    first = {(page, (html or "").encode()) for page, _, html in rows}
    assert responses <= first and {p for _, p in responses} == {p for _, p in first}
    assert got(back) == brute(rows) and back.filter("problem IS NOT NULL").count() == 0
    assert {r["date"] for r in back.select("date").distinct().collect()} == {DATE}
    assert back.filter("page_id = 899").first()["url"] == "http://h/a%20b%0D%0AX:%20y"
    # all files of the folder, by Spark's own reader: the stray file is one row with a problem
    every = warc.read_archives(spark, [folder])
    assert got(every.filter("problem IS NULL")) == brute(rows)
    assert every.filter("problem IS NOT NULL").count() == 1


def test_empty(spark, rows):
    assert warc.report(frame(spark, rows).limit(0)).collect() == []


def records(n: int) -> list[bytes]:
    rng = np.random.default_rng(1)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "<p>delta</p>", "epsilon"], 300)).encode()
    return [warc.record_bytes(i, f"http://x/{i}", text(), None if i % 3 else 99, DATE) for i in range(n)]


def read(content: bytes, piece: int = 1 << 20) -> list[dict]:
    stream = io.BytesIO(content)
    return list(warc.read_archive(lambda n: stream.read(min(n, piece))))


def test_dictionary_leads_and_frames_stand_alone():
    parts = records(200)
    content = warc.archive_bytes_of(parts, 4096, 3)
    magic, size = struct.unpack("<II", content[:8])
    assert magic == 0x184D2A5D and size <= 4096
    dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    found = read(content)
    assert [r["page_id"] for r in found] == list(range(200)) == [r["page_id"] for r in read(content, piece=7)]
    for record, nxt, want in zip(found, found[1:], parts):
        frame = content[record["at"] : nxt["at"]]
        assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frame) == want
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(content[found[0]["at"] : found[1]["at"]])
    assert len(content) < sum(len(zstandard.compress(p)) for p in parts)


def test_compressed_dictionary_and_other_skippable_frames():
    parts = records(50)
    content = warc.archive_bytes_of(parts, 2048, 3)
    size = struct.unpack("<I", content[4:8])[0]
    small = zstandard.compress(content[8 : 8 + size])
    other = struct.pack("<II", 0x184D2A53, 5) + b"hello"
    again = struct.pack("<II", 0x184D2A5D, len(small)) + small + other + content[8 + size :] + other
    assert [r.get("problem") for r in read(again)] == [None] * 50


def test_no_dictionary_for_few_records():
    content = warc.archive_bytes_of(records(3), 4096, 3)
    assert struct.unpack("<I", content[:4])[0] == 0xFD2FB528 and len(read(content)) == 3


def test_damage_is_reported_and_reading_goes_on():
    parts = records(20)
    content = bytearray(warc.archive_bytes_of(parts, 2048, 3))
    at = [r["at"] for r in read(bytes(content))]
    content[at[5] - 1] ^= 1  # the checksum of record 4
    found = read(bytes(content))
    assert len(found) == 20 and [i for i, r in enumerate(found) if "problem" in r] == [4]
    cut = read(bytes(content[: at[10] + 30]))
    assert len(cut) == 11 and "cut" in cut[-1]["problem"]
    assert "problem" in read(b"no archive at all")[0] and read(b"") == []


@pytest.mark.parametrize(
    "old,new,said",
    [
        (b"WARC/1.1", b"WARC/9.9", "not a WARC/1.1 record"),
        (b"WARC-Date", b"XARC-Date", "no warc-date"),
        (b"Content-Length: 5\r\n\r\nhello", b"Content-Length: 4\r\n\r\nhello", "payload of 5 bytes"),
        (b"hello", b"jello", "digest differs"),
        (b"\r\n\r\nhello\r\n\r\n", b"\r\n\r\nhello\r\n", "content length"),
        (b"sha1:", b"md5:", "no SHA-1"),
        (b"Content-Type: application", b"Content-Type application", "not a header"),
        (b"<urn:page:1>", b"<urn:leaf:1>", "not a page"),
    ],
)
def test_validation(old, new, said):
    record = warc.record_bytes(1, "http://x/", b"hello", None, DATE)
    assert warc.parse_record(record)["payload"] == b"hello" and old in record
    with pytest.raises(ValueError, match=said):
        warc.parse_record(record.replace(old, new))


def test_other_record_types_pass():
    block = b"software: none\r\n"
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Date: 2024\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(block), block)
    assert warc.parse_record(info)["record_type"] == "warcinfo"
