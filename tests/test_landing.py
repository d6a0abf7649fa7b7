"""Lines by byte position: growing, rotated and cut files, ranges of any size."""

import json
import os

from pyspark.sql import functions as F

from costlens.sources import landing, otlp
from costlens.streaming import ingest

BODY = [f"line {i} " + "é" * (i % 7) + "x" * (i * 13 % 90) for i in range(400)]


def write(path, data, mode="wb"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def read_all(spark, root, **options):
    landing.register(spark)
    rows = spark.read.format(landing.FORMAT).option("path", root).options(**options).load().collect()
    return sorted((r.file, r.mark, r.offset, r.value) for r in rows)


def test_ranges_of_any_size_give_the_same_rows(spark, tmp_path):
    text = "\n".join(BODY) + "\n"
    write(f"{tmp_path}/logs/a.jsonl", text)
    write(f"{tmp_path}/logs/b.jsonl", "first\r\n\r\n\nlast without end")
    write(f"{tmp_path}/logs/empty.jsonl", "")
    write(f"{tmp_path}/logs/_hidden", "no\n")
    whole = read_all(spark, str(tmp_path))
    assert [v for f, _, _, v in whole if f.endswith("a.jsonl")] == BODY
    assert [(o, v) for f, _, o, v in whole if f.endswith("b.jsonl")] == [(0, "first"), (7, ""), (9, ""), (10, "last without end")]
    for _, _, offset, value in [r for r in whole if r[0].endswith("a.jsonl")][::50]:
        assert text.encode()[offset:].decode().startswith(value)
    assert read_all(spark, str(tmp_path), rangeBytes=4096) == whole
    size = os.path.getsize(f"{tmp_path}/logs/a.jsonl")
    for width in (1, 7, 100):  # without a task for each
        parts = landing._ranges(str(tmp_path), "logs/a.jsonl", None, 0, size, width, True)
        assert [v for p in parts for b in landing.read_range(p) for v in b.column("value").to_pylist()] == BODY
    assert read_all(spark, f"{tmp_path}/missing") == []


def test_pieces_smaller_than_lines(tmp_path, monkeypatch):
    write(f"{tmp_path}/a", "\n".join(BODY) + "\n")
    size = os.path.getsize(f"{tmp_path}/a")
    monkeypatch.setattr(landing, "PIECE", 11)
    monkeypatch.setattr(landing, "BATCH_ROWS", 3)
    got = []
    for r in landing._ranges(str(tmp_path), "a", None, 0, size, 257, True):
        got += [v for b in landing.read_range(r) for v in b.column("value").to_pylist()]
    assert got == BODY


class Stream:
    """A stream over a folder, run one batch at a time into a list."""

    def __init__(self, spark, root, checkpoint):
        self.spark, self.root, self.checkpoint, self.rows = spark, root, checkpoint, []

    def run(self):
        lines = ingest.landed_lines(self.spark, self.root, stream=True)

        def keep(df, n):
            self.rows += [(r.file.rsplit("/", 1)[1], r.mark, r.offset, r.value) for r in df.collect()]

        before = len(self.rows)
        q = lines.writeStream.foreachBatch(keep).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(self.rows[before:])


def test_appended_cut_and_rotated_files(spark, tmp_path):
    root, path = f"{tmp_path}/in", f"{tmp_path}/in/logs/traces.jsonl"
    data = ("\n".join(BODY) + "\n").encode()
    stream = Stream(spark, root, f"{tmp_path}/checkpoint")
    cuts = [data.index(b"\n", 900) + 1, data.index(b"\n", 5000) + 20, 9000]
    write(path, data[: cuts[0]])
    stream.run()
    write(path, data[cuts[0] : cuts[1]], "ab")  # ends in the middle of a line
    second = stream.run()
    assert second and data[: cuts[1]].endswith(data[max(o for *_, o, _ in second) : cuts[1]].split(b"\n")[-1])
    held = len(stream.rows)
    assert stream.run() == [] and len(stream.rows) == held  # nothing new: the cut line still waits
    write(path, data[cuts[1] : cuts[2]], "ab")
    stream.run()
    os.rename(path, f"{path}.1")  # rotated while the end has not been read
    write(f"{path}.1", data[cuts[2] :], "ab")
    write(path, "a new file\nwith two lines\n")
    last = stream.run()
    assert [v for f, _, _, v in last if f == "traces.jsonl"] == ["a new file", "with two lines"]
    old = sorted((o, v) for _, _, o, v in stream.rows if v.startswith("line "))
    closed = sorted((o, v) for _, _, o, v in read_all(spark, root) if v.startswith("line "))
    assert old == closed and [v for _, v in old] == BODY  # each line once, at the byte it begins
    assert len({m for _, m, _, v in stream.rows if v.startswith("line ")}) == 1
    write(path, "short\n")  # cut off and written anew
    assert [v for *_, v in stream.run()] == ["short"]


def test_a_batch_repeated_after_a_rotation_reads_the_moved_file(tmp_path):
    write(f"{tmp_path}/a.jsonl", "one\ntwo\nthree\n")
    reader = landing.GrowingFiles({"path": str(tmp_path)})
    planned = reader.partitions(reader.initialOffset(), reader.latestOffset())
    os.rename(f"{tmp_path}/a.jsonl", f"{tmp_path}/a.1.jsonl")
    write(f"{tmp_path}/a.jsonl", "other, much longer than before\n")
    assert [v for p in planned for b in reader.read(p) for v in b.column("value").to_pylist()] == ["one", "two", "three"]
    os.remove(f"{tmp_path}/a.jsonl")
    assert [v for p in planned for b in reader.read(p) for v in b.column("value").to_pylist()] == ["one", "two", "three"]


def test_event_ids_do_not_depend_on_splits(spark, cfg, tmp_path):
    record = lambda i: {"timeUnixNano": str(1704067200000000000 + i * 10**9), "attributes": []}
    lines = [json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record(i), record(i)]}]}]}) for i in range(300)]
    write(f"{tmp_path}/logs/a.jsonl", "\n".join(lines) + "\n")
    landing.register(spark)

    def ids(size):
        read = spark.read.format(landing.FORMAT).option("path", str(tmp_path)).option("rangeBytes", size).load()
        good = otlp.parse_logs(read.select("value", F.struct("file", "mark", "offset").alias("seq")), cfg).good
        return sorted(r.event_id for r in good.select("event_id").collect())

    whole = ids(1 << 26)
    assert len(set(whole)) == 600 and ids(9_000) == whole
