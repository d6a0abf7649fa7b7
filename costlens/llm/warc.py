"""WARC archives with Zstandard: one frame a record, the dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary of its frames; each further frame is one WARC/1.1 record. Writing
trains the dictionary on records spread evenly over the archive, at most 100
times its own size, so it changes how small an archive is and nothing else; an
archive with too few records for a training has no skippable frame. Archives
are cut after ``archive_bytes`` of records, which bounds what a task holds
(a longer record stands alone).

A record's payload digest (SHA-1, base32) finds equal payloads: that with the
smallest page_id is written as a response, the others as revisits that refer to
it and keep only the HTTP header with the payload's length. Each archive gets a
name of its own and counts only once the written manifest lists it, so what a
lost or repeated task leaves behind is never read.

Reading streams the archives that the manifest lists, or any archives by Spark's
binary file source. Frames are found by their block headers, each is decoded alone with the archive's dictionary and
its checksum, and the record's version line, headers, lengths and digest are
validated. What fails becomes a row with a ``problem`` and no payload; reading
goes on at the next frame while frames can be told apart.

Defined results: a null html is an empty payload; a null page_id is never
referred to, unless no page of its payload has one: then all are responses; rows that
repeat the smallest page_id with its payload are all responses; a null url gives
no target URI; line ends in a url are percent-encoded; no pages give no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import materialise, shared_dir, small_batches

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "archive string, at long, record_type string, page_id long, url string, date string, refers_to long, "
    "payload binary, payload_bytes long, payload_digest string, problem string"
)
_COLUMNS = [part.split()[0] for part in RECORD.split(", ")]


# ---- records ----------------------------------------------------------------
def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", uri)
    if found is None:
        raise ValueError(f"not a page's record id: {uri!r}")
    return int(found[1]) if found[1] else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit where ``refers_to`` names a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _uri(page_id), "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20]", lambda c: f"%{ord(c[0]):02X}", url)
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _uri(refers_to)}
    headers |= {
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        found[name.strip().decode().lower()] = value.strip().decode()
    return found


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise ValueError("no content length")
    return int(value)


def parse_record(data: bytes) -> dict:
    """The fields of one record; raises ValueError where it is not valid."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] != VERSION:
        raise ValueError(f"not a {VERSION.decode()} record")
    headers = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if name not in headers:
            raise ValueError(f"no {name}")
    size = _length(headers)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content length {size}, but {max(len(rest) - 4, 0)} bytes")
    record = {"record_type": headers["warc-type"], "date": headers["warc-date"], "url": headers.get("warc-target-uri")}
    if record["record_type"] not in ("response", "revisit"):
        return record
    http, blank, payload = rest[:size].partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    n_bytes = _length(_headers(http.split(b"\r\n")[1:]))
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1" or not re.fullmatch(r"[A-Z2-7]{32}", digest):
        raise ValueError("no SHA-1 payload digest")
    record |= {"page_id": _page_of(headers["warc-record-id"]), "payload_bytes": n_bytes, "payload_digest": digest}
    if record["record_type"] == "revisit":
        if payload or headers.get("warc-profile") != PROFILE:
            raise ValueError("a revisit of another profile")
        return record | {"refers_to": _page_of(headers.get("warc-refers-to", ""))}
    if len(payload) != n_bytes:
        raise ValueError(f"payload of {len(payload)} bytes, {n_bytes} announced")
    if digest_of(payload) != digest:
        raise ValueError("payload digest differs")
    return record | {"payload": payload}


# ---- archives ---------------------------------------------------------------
def archive_bytes_of(records: list[bytes], dictionary_bytes: int, level: int) -> bytes:
    """The whole archive: the dictionary's frame, then a frame a record."""
    chosen, room = [], 100 * dictionary_bytes
    total = sum(map(len, records))
    step = max(1, -(-total // room))
    for record in records[::step]:
        if len(record) <= room:
            chosen.append(record)
            room -= len(record)
    try:
        dictionary = zstandard.train_dictionary(dictionary_bytes, chosen, level=level) if len(chosen) >= 8 else None
    except zstandard.ZstdError:  # too little or too uniform
        dictionary = None
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
    parts = []
    if dictionary is not None:
        front = dictionary.as_bytes()
        parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(front)) + front)
    parts += map(compressor.compress, records)
    return b"".join(parts)


class _Ahead:
    """A stream read in pieces, with the bytes from one frame's start on."""

    def __init__(self, read: Callable[[int], bytes], piece: int = 1 << 20):
        self.read, self.piece = read, piece
        self.data, self.used, self.at = b"", 0, 0

    def has(self, n: int) -> bool:
        """Are ``n`` bytes there from the frame's start?"""
        while len(self.data) - self.used < n:
            more = self.read(max(self.piece, n - len(self.data) + self.used))
            if not more:
                return False
            self.data, self.used = self.data[self.used :] + more, 0
        return True

    def part(self, start: int, end: int) -> bytes:
        return self.data[self.used + start : self.used + end]

    def skip(self, n: int) -> None:
        self.used += n
        self.at += n


def frame_length(ahead: _Ahead) -> int:
    """Length of the Zstandard frame that begins here, by its block headers."""
    ahead.has(18)
    front = ahead.part(0, 18)
    end, last = zstandard.frame_header_size(front), False
    while not last:
        if not ahead.has(end + 3):
            raise ValueError("the frame is cut")
        header = int.from_bytes(ahead.part(end, end + 3), "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        if kind == 3:
            raise ValueError("a reserved block")
        end += 3 + (1 if kind == 1 else size)
    end += 4 if zstandard.get_frame_parameters(front).has_checksum else 0
    if not ahead.has(end):
        raise ValueError("the frame is cut")
    return end


def read_archive(read: Callable[[int], bytes]) -> Iterator[dict]:
    """Every record of one archive in order, with ``at``, its frame's place.
    ``read(n)`` gives the next bytes; one frame is held at a time."""
    ahead = _Ahead(read)
    decompressor = zstandard.ZstdDecompressor()
    while ahead.has(1):
        try:
            magic, size = struct.unpack("<II", ahead.part(0, 8)) if ahead.has(8) else (0, 0)
            if magic >> 4 == DICTIONARY_MAGIC >> 4:  # skippable
                if not ahead.has(8 + size):
                    raise ValueError("a skippable frame is cut")
                if magic == DICTIONARY_MAGIC and ahead.at == 0:
                    front = ahead.part(8, 8 + size)
                    if front[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may be compressed itself
                        front = zstandard.ZstdDecompressor().decompressobj().decompress(front)
                    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(front))
                ahead.skip(8 + size)
                continue
            if magic != FRAME_MAGIC:
                raise ValueError("no Zstandard frame")
            length = frame_length(ahead)
        except (ValueError, zstandard.ZstdError) as e:  # the next frame cannot be found
            yield {"at": ahead.at, "problem": str(e)}
            return
        try:
            record = parse_record(decompressor.decompressobj().decompress(ahead.part(0, length)))
        except (ValueError, zstandard.ZstdError) as e:
            record = {"problem": str(e)}
        yield {"at": ahead.at, **record}
        ahead.skip(length)


# ---- writing ----------------------------------------------------------------
def _write_task(folder: str, archive_bytes: int, dictionary_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)

        def close(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            content = archive_bytes_of(records, dictionary_bytes, level)
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(content)
            values = [[f"{folder}/{name}"], [len(records)], [len(content)]]
            kinds = (pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["archive", "n_records", "n_bytes"])

        held, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns):
                payload = (html.as_py() or "").encode()
                record = record_bytes(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), date)
                if held and size + len(record) > archive_bytes:
                    yield close(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield close(held)

    return run


def payload_key(html: Column) -> Column:
    return F.unhex(F.sha1(F.encode(F.coalesce(html, F.lit("")), "UTF-8")))


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: the smallest page_id of the payload to all others.

    Payloads that are alone leave the shuffle as (key, count) rows. Those that
    hold a ten-thousandth of all rows or more, 10,000 at most, are joined by
    broadcast, so that a very common payload is never dealt to one task."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    keyed = pages.withColumn("key", F.when(size >= min_bytes, payload_key(F.col("html"))))
    groups = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    shared = materialise(groups.filter("n > 1 AND first IS NOT NULL"), "warc-payloads")
    often = F.col("n") * 10000 >= F.lit(max(pages.count(), 1))
    common = shared.filter(often).select("key", F.col("first").alias("common"))
    rare = shared.filter(~often).select("key", F.col("first").alias("rare"))
    joined = keyed.join(F.broadcast(common), "key", "left").withColumn("rare", F.lit(None).cast("long"))
    if not rare.isEmpty():
        # Rows that the broadcast has settled go anywhere, not to their payload's task.
        elsewhere = F.encode(F.monotonically_increasing_id().cast("string"), "UTF-8")
        waiting = F.col("common").isNull() & F.col("key").isNotNull()
        joined = joined.withColumn("key", F.when(waiting, F.col("key")).otherwise(elsewhere)).drop("rare").join(rare, "key", "left")
    first = F.coalesce("common", "rare")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(first), first)).select(*pages.columns, "refers_to")


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = 32 << 20, dictionary_bytes: int = 32 << 10,
    level: int = 3, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record a row of ``pages`` (page_id, url, html) below ``folder``, a
    URI of a store that all tasks reach; returns the manifest (archive,
    n_records, n_bytes)."""
    small_batches(pages.sparkSession)
    rows = with_references(pages.select(F.col("page_id").cast("long"), "url", "html"), min_bytes)
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    task = _write_task(folder, archive_bytes, dictionary_bytes, level, date)
    return materialise(rows.select("page_id", "url", "html", "refers_to").mapInArrow(task, "archive string, n_records long, n_bytes long"), "warc-manifest")


# ---- reading ----------------------------------------------------------------
_KINDS = {"payload": pa.binary(), "at": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}
_ROWS = pa.schema([(c, _KINDS.get(c, pa.string())) for c in _COLUMNS])


def _rows_of(archive: str, read: Callable[[int], bytes]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for record in read_archive(read):
        rows.append({"archive": archive, **record})
        size += len(record.get("payload", b""))
        if len(rows) == 512 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(rows, _ROWS)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ROWS)


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            store, path = pyarrow.fs.FileSystem.from_uri(archive)
            with store.open_input_stream(path, compression=None) as stream:
                yield from _rows_of(archive, stream.read)


def _read_content_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, content in zip(*batch.columns):
            yield from _rows_of(archive.as_py(), pa.BufferReader(content.as_buffer()).read)


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every record below ``paths`` (archives or folders of them), through
    Spark's binary file source: any store that Spark reaches, archives of up to 2 GB."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("path").alias("archive"), "content").mapInArrow(_read_content_task, RECORD)


def read_written(manifest: DataFrame, tasks: int = 100000) -> DataFrame:
    """The records of the archives that a manifest lists, an archive a task up
    to ``tasks`` tasks; a task streams and holds one frame at a time."""
    small_batches(manifest.sparkSession)
    dealt = manifest.select("archive").repartition(min(max(manifest.count(), 1), tasks), "archive")
    return dealt.mapInArrow(_read_task, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages below the shared folder and read the archives back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_written(write_archives(pages, folder, min_bytes))


def report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every
    record read back, and what is wrong with it (null: nothing)."""
    return round_trip(pages, min_bytes).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )
