"""Landed lines with the place they stand at: a Spark data source over growing files.

``spark.read.format("landed_lines")`` reads all files below ``path`` whole;
``spark.readStream.format("landed_lines")`` goes on where the last batch
ended, also in files that were appended to, rotated or cut off in the middle
of a line. Rows are (value, file, mark, offset): a line, the path of its file,
the file's mark (a hash of its first line, which tells a file from the one
that took its name) and the byte its line begins at. None of them depends on
how a file is split into tasks.

A stream's offset holds every file's mark and the byte after its last line
end, so an unterminated line waits until it is whole. Where a path now holds
another mark, its former file has been moved: it is looked for by its mark
and read on from the byte reached; the new file is read from its start. A task
that finds another mark at its path looks for the moved file too, so that a
batch repeated after a rotation reads the same bytes. What was deleted unread
is lost. A batch read takes an unterminated last line as a line.

Files are split into ranges of ``rangeBytes``; a range owns the lines that
begin in it. The driver lists the folder and reads the first and last bytes
of new and changed files only. Files are reached by ``pyarrow.fs``: local
paths and every store it knows (hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "landed_lines"
SCHEMA = "value string, file string, mark string, offset long"
RANGE_BYTES = 64 << 20
PIECE = 4 << 20
BATCH_ROWS = 10000
LINE_END = 10
RETURN = 13


@dataclass
class LineRange(InputPartition):
    """Lines of ``file`` that begin in [start, stop); ``end`` is where the file
    ended when the range was planned. ``mark`` is None where a task finds it."""

    root: str
    file: str
    mark: str | None
    start: int
    stop: int
    end: int
    keep_tail: bool


def _store(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root) if "://" in root else pyarrow.fs.FileSystem.from_uri(f"file://{root}")


def _files(root: str) -> dict[str, tuple[int, int]]:
    """Path below the root → size and time of change, of the files that are not hidden."""
    store, base = _store(root)
    base = base.rstrip("/")
    found = {}
    for info in store.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True, recursive=True)):
        name = info.path[len(base) + 1 :]
        if info.type == pyarrow.fs.FileType.File and not any(p.startswith(("_", ".")) for p in name.split("/")):
            found[name] = (info.size, info.mtime_ns or 0)
    return found


def _open(root: str, name: str):
    store, base = _store(root)
    return store.open_input_file(f"{base.rstrip('/')}/{name}")


def mark_of(source, size: int, whole: bool = False) -> str | None:
    """Hash of the first line; None while it is not whole, unless ``whole``
    says that the file will not grow."""
    digest, at = hashlib.sha256(), 0
    source.seek(0)
    while at < size:
        piece = source.read(min(64 << 10, size - at))
        if not piece:
            break
        end = piece.find(b"\n")
        digest.update(piece if end < 0 else piece[:end])
        if end >= 0:
            return digest.hexdigest()[:16]
        at += len(piece)
    return digest.hexdigest()[:16] if whole and at else None


def last_line_end(source, size: int) -> int:
    """The byte after the last line end before ``size``; 0 where there is none."""
    end = size
    while end > 0:
        start = max(0, end - (64 << 10))
        source.seek(start)
        at = source.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def _batch(file: str, mark: str, base: int, data: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """The lines of ``data`` that end before each of ``ends``."""
    starts = np.concatenate([[0], ends[:-1] + 1])
    data = data[: ends[-1] + 1]
    kept = np.ones(len(data), bool)
    kept[ends] = False
    before = np.maximum(ends - 1, 0)
    returns = (data[before] == RETURN) & (ends > starts)
    kept[before[returns]] = False
    places = np.concatenate([[0], np.cumsum(ends - starts - returns)]).astype(np.int32)
    values = pa.StringArray.from_buffers(len(ends), pa.py_buffer(places), pa.py_buffer(data[kept].tobytes()))
    same = lambda text: pa.array([text], pa.string()).take(pa.array(np.zeros(len(ends), np.int32)))
    return pa.RecordBatch.from_arrays([values, same(file), same(mark), pa.array(starts + base)], ["value", "file", "mark", "offset"])


def read_range(part: LineRange) -> Iterator[pa.RecordBatch]:
    """The lines of one range, a few thousand at a time."""
    try:
        source = _open(part.root, part.file)
        mark = mark_of(source, part.end, part.keep_tail)
    except FileNotFoundError:
        if part.mark is None:
            raise
        source = mark = None
    if part.mark is not None and mark != part.mark:
        source, mark = _moved(part), part.mark
    if mark is None:
        return
    file = f"{part.root.rstrip('/')}/{part.file}"
    at, carry, skip = part.start, b"", part.start > 0
    if skip:  # a line that began before the range belongs to the range before
        at -= 1
    source.seek(at)
    while at < part.stop:
        piece = source.read(min(PIECE, part.end - at - len(carry)))
        data = carry + piece
        if skip:
            first = data.find(b"\n")
            if first < 0:
                if not piece:
                    return
                at += len(data)
                carry = b""
                continue
            data, at, skip = data[first + 1 :], at + first + 1, False
            if at >= part.stop:
                return
        bytes_ = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(bytes_ == LINE_END)
        if not piece and len(data) and part.keep_tail and not (len(ends) and ends[-1] == len(data) - 1):
            bytes_ = np.append(bytes_, np.uint8(LINE_END))
            ends = np.append(ends, len(data))
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        owned = int(np.searchsorted(starts + at, part.stop))
        for i in range(0, owned, BATCH_ROWS):
            rows = ends[i : min(i + BATCH_ROWS, owned)]
            begin = int(starts[i])
            yield _batch(file, mark, at + begin, bytes_[begin:], rows - begin)
        if not piece:
            return
        done = int(ends[-1]) + 1 if len(ends) else 0
        carry, at = data[done:], at + done


def _moved(part: LineRange):
    """The file with the range's mark, wherever it is now."""
    for name, (size, _) in sorted(_files(part.root).items()):
        if size >= part.end and name != part.file:
            source = _open(part.root, name)
            if mark_of(source, size) == part.mark:
                return source
    raise FileNotFoundError(f"{part.file} has been replaced, and no other file of {part.root} begins with its first line")


def _ranges(root: str, name: str, mark: str | None, start: int, end: int, size: int, keep_tail: bool) -> list[LineRange]:
    return [LineRange(root, name, mark, at, min(at + size, end), end, keep_tail) for at in range(start, end, size)]


class WholeFiles(DataSourceReader):
    def __init__(self, options):
        self.root, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self):
        files = sorted(_files(self.root).items())
        found = [r for name, (size, _) in files for r in _ranges(self.root, name, None, 0, size, self.size, True)]
        return found or [LineRange(self.root, "", None, 0, 0, 0, False)]

    def read(self, partition):
        if partition.file:
            yield from read_range(partition)


class GrowingFiles(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.known: dict[str, tuple[tuple[int, int], dict]] = {}

    def initialOffset(self):
        return {"files": {}}

    def latestOffset(self):
        """Mark and last line end of every file; files that did not change
        since the last call are not opened."""
        known = {}
        for name, state in _files(self.root).items():
            if self.known.get(name, (None,))[0] == state:
                known[name] = self.known[name]
                continue
            with _open(self.root, name) as source:
                mark = mark_of(source, state[0])
                if mark is not None:
                    known[name] = (state, {"mark": mark, "end": last_line_end(source, state[0])})
        self.known = known
        return {"files": {name: file for name, (_, file) in known.items()}}

    def partitions(self, start: dict, end: dict):
        before, now = start["files"], end["files"]
        # Files whose path holds another mark now, or nothing: to be found by mark.
        gone = {f["mark"]: f["end"] for name, f in before.items() if now.get(name, {}).get("mark") != f["mark"]}
        found = []
        for name, file in sorted(now.items()):
            last = before.get(name)
            if last is not None and last["mark"] == file["mark"]:
                reached = last["end"]
            else:
                reached = gone.pop(file["mark"], 0)
            if reached > file["end"]:  # cut off and written anew
                reached = 0
            found += _ranges(self.root, name, file["mark"], reached, file["end"], self.size, False)
        return found

    def read(self, partition):
        yield from read_range(partition)


class LandedLines(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WholeFiles(self.options)

    def streamReader(self, schema):
        return GrowingFiles(self.options)


# Workers get this module with the plan and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedLines)
