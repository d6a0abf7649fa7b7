"""Parquet tables under one root folder (shared storage on a cluster).

Plain Parquet has no MERGE, so two write modes cover the merge semantics,
both keyed by the batch that writes and safe to replay for it:

* append tables (raw spans/events, signals, quarantine, developers) are
  partitioned by ``batch`` (raw spans/events by ``day`` of event time, then
  ``batch``); a batch overwrites only its own partitions, and reads that
  only need some days or buckets open only those folders.
* keyed tables (commits, issues, CI runs, slice state, session rollups) are
  partitioned by ``bucket = pmod(xxhash64(key), buckets)`` and then by
  ``version``, the batch that wrote it. A batch copies the buckets that hold
  its keys, with its changes, into a new version; untouched buckets keep
  their files. Readers take the newest version a bucket has. Once the batch
  is committed, versions older than the one it replaced are removed; that one
  stays for readers that began before.

A batch is visible once the ledger says so: ``allot`` gives it a number that
no other batch has (the number's file is created exclusively), ``commit``
marks it done. What an open batch has written is seen by no reader but that
batch itself, so a driver that dies in the middle leaves the tables as they
were, and the repeated batch overwrites its own output. Batches are written
one after another, in the order of their numbers (``begin``); one that will
never be finished is given up by ``abandon`` and stays hidden.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.config import checkpoint_dir

LEDGER = "batch_ledger"
#: How tables are written that are removed at the end of their batch.
PASSING_FILES = {"parquet.enable.dictionary": "false", "compression": "zstd"}


class BatchOpen(RuntimeError):
    """An earlier batch is neither committed nor abandoned."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str, rollup_buckets: int = 64):
        """``rollup_buckets`` is the number of buckets of every keyed table, for
        good: take the bytes of the largest one divided by some 128 MB. The
        store remembers it, and opening it with another number raises."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.rollup_buckets = rollup_buckets
        self._schemas: dict[str, T.StructType] = {}
        self._replaced: dict[str, set[int]] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # ---- files -------------------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hpath

    def _paths(self, statuses) -> list[str]:
        """Paths of a listing, fetched from the JVM as one text."""
        text = self.spark.sparkContext._jvm.org.apache.commons.lang3.ArrayUtils.toString(statuses) if statuses is not None else ""
        return re.findall(r"\{path=(.*?); isDirectory=", text)

    def _names(self, path: str) -> list[str]:
        """Visible entries of a folder; none where it does not exist."""
        fs, hpath = self._fs(path)
        if not fs.exists(hpath):
            return []
        names = [p.rsplit("/", 1)[1] for p in self._paths(fs.listStatus(hpath))]
        return [n for n in names if not n.startswith(("_", "."))]

    def _glob(self, pattern: str) -> list[str]:
        fs, hpath = self._fs(pattern)
        return self._paths(fs.globStatus(hpath))

    def _text(self, path: str) -> str:
        fs, hpath = self._fs(path)
        stream = fs.open(hpath)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _remove(self, path: str) -> None:
        fs, hpath = self._fs(path)
        fs.delete(hpath, True)

    def _put(self, path: str, text: str, exclusive: bool) -> bool:
        """Write a small file; False where an exclusive one exists already. The
        store has to create files atomically, as HDFS does; on a local disk,
        where Hadoop looks first and creates then, the driver does it itself."""
        fs, hpath = self._fs(path)
        if exclusive and fs.getScheme() == "file":
            local = hpath.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                with open(local, "x") as out:
                    out.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = fs.create(hpath, not exclusive)
        except Exception as e:
            if exclusive and "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, path: str) -> DataFrame | None:
        """A table that was never written (or got no row yet) reads as
        missing; one that cannot be read raises."""
        return self.spark.read.parquet(path) if self._names(path) else None

    def _read_folders(self, name: str, folders: list[str]) -> DataFrame | None:
        """Rows of some partition folders of a table. The schema is that of the
        table's first folders read, so that later reads open no footer for it."""
        if not folders:
            return None
        reader = self.spark.read.option("basePath", self.path(name))
        if name in self._schemas:
            reader = reader.schema(self._schemas[name])
        df = reader.parquet(*folders)
        self._schemas[name] = df.schema
        return df

    def is_empty(self) -> bool:
        return not self._names(self.root)

    # ---- batch ledger ------------------------------------------------------------
    # One small file a batch, named by its number, says which stream it is for;
    # "<number>.done.<stream>.<stream batch>" and "<number>.abandoned" close it.
    # "floor.<number>" stands for the files of batches up to that number, which
    # are folded away but for the last done batch of every stream.

    def _ledger(self) -> tuple[set[int], dict[int, str], set[int], int]:
        """Claimed batches, done ones with their owner, abandoned ones, and the floor."""
        claimed, done, abandoned, floor = set(), {}, set(), -1
        for name in self._names(self.path(LEDGER)):
            head, _, state = name.partition(".")
            if head == "floor":
                floor = max(floor, int(state))
            elif head.isdigit() and not state:
                claimed.add(int(head))
            elif head.isdigit() and state.startswith("done."):
                done[int(head)] = state[5:]
            elif head.isdigit() and state == "abandoned":
                abandoned.add(int(head))
        return claimed, done, abandoned, floor

    @staticmethod
    def _owner(stream: str, stream_batch: int) -> str:
        return f"{hashlib.sha256(stream.encode()).hexdigest()[:16]}.{stream_batch}"

    def _claim(self, batch: int) -> dict:
        text = self._text(f"{self.path(LEDGER)}/{batch}")
        return json.loads(text) if text else {}  # empty: its driver died while writing it

    def open_batches(self) -> list[int]:
        claimed, done, abandoned, _ = self._ledger()
        return sorted(claimed - set(done) - abandoned)

    def allot(self, stream: str, stream_batch: int) -> int:
        """The store's batch id for a stream's batch: the same one on every
        replay, a new one for every other stream (a checkpoint that was lost
        and made anew is another stream, though it counts from 0 again)."""
        self._check_buckets()
        owner, row = self._owner(stream, stream_batch), {"stream": stream, "stream_batch": stream_batch}
        while True:
            claimed, done, abandoned, floor = self._ledger()
            for number, who in done.items():
                if who == owner:
                    return number
            for number in sorted(claimed - set(done) - abandoned):
                if self._claim(number) == row:
                    return number
            number = max(claimed | set(done) | abandoned | {floor}) + 1
            if self._put(f"{self.path(LEDGER)}/{number}", json.dumps(row), exclusive=True):
                return number

    def _check_buckets(self) -> None:
        path = f"{self.path(LEDGER)}/buckets"
        if not self._put(path, str(self.rollup_buckets), exclusive=True):
            made_with = self._text(path)
            if made_with and made_with != str(self.rollup_buckets):
                raise ValueError(f"{self.root} was made with {made_with} buckets, not {self.rollup_buckets}")

    def is_only(self, stream: str, stream_batch: int) -> bool:
        """Is all that the store holds one open batch of that stream?"""
        claimed, done, abandoned, floor = self._ledger()
        return claimed == {0} and not done and not abandoned and floor < 0 and self._claim(0) == {"stream": stream, "stream_batch": stream_batch}

    def is_committed(self, batch: int) -> bool:
        return batch in self._ledger()[1]

    def committed(self) -> list[int]:
        """Numbers of the visible batches."""
        claimed, done, abandoned, floor = self._ledger()
        return sorted(set(done) | (set(range(floor + 1)) - abandoned - claimed))

    def hidden(self) -> list[int]:
        """Batches that readers must not see: open and abandoned ones."""
        claimed, done, _, _ = self._ledger()
        return sorted(claimed - set(done))

    def begin(self, batch: int, wait_seconds: float = 0) -> None:
        """Wait until every earlier batch is committed or abandoned, so that
        batches see all that came before them and none replaces another's
        version; raises ``BatchOpen`` after ``wait_seconds``."""
        until = time.monotonic() + wait_seconds
        while True:
            before = [b for b in self.open_batches() if b < batch]
            if not before:
                return
            if time.monotonic() >= until:
                raise BatchOpen(f"batch {batch} has to wait for {before}: commit or abandon them")
            time.sleep(min(1.0, wait_seconds))

    def commit(self, batch: int) -> None:
        """Make the batch visible, then remove the versions that no reader takes
        any more."""
        claim = self._claim(batch) if batch in self._ledger()[0] else {"stream": f"batch {batch}", "stream_batch": 0}
        self._put(f"{self.path(LEDGER)}/{batch}.done.{self._owner(**claim)}", "", exclusive=False)
        for name, buckets in self._replaced.items():
            self._sweep(name, buckets)
        self._replaced.clear()
        self._fold()

    def _fold(self, keep: int = 256) -> None:
        """Bound the ledger: one floor for the oldest closed batches, once there
        are ``keep`` of them. A stream only ever repeats its last batch."""
        claimed, done, abandoned, floor = self._ledger()
        closed = [n for n in sorted(done) if n < min(claimed - set(done) - abandoned, default=max(done) + 1)]
        if len(closed) < keep + len({who.split(".")[0] for who in done.values()}):
            return
        last = {done[n].split(".")[0]: n for n in closed}
        self._put(f"{self.path(LEDGER)}/floor.{closed[-1]}", "", exclusive=False)
        for n in closed:
            if n not in last.values():
                self._remove(f"{self.path(LEDGER)}/{n}")
                self._remove(f"{self.path(LEDGER)}/{n}.done.{done[n]}")
        if floor >= 0:
            self._remove(f"{self.path(LEDGER)}/floor.{floor}")

    def abandon(self, batch: int) -> None:
        """Give an open batch up: its rows stay hidden, later batches go on."""
        if self.is_committed(batch):
            raise ValueError(f"batch {batch} is committed")
        self._put(f"{self.path(LEDGER)}/{batch}.abandoned", "", exclusive=False)

    def _visible(self, df: DataFrame, column: str, before_batch: int | None, own: int | None = None) -> DataFrame:
        if before_batch is not None:
            df = df.filter(F.col(column) < F.lit(before_batch))
        hidden = [b for b in self.hidden() if b != own and (before_batch is None or b < before_batch)]
        return df.filter(~F.col(column).isin(hidden)) if hidden else df

    # ---- append tables ---------------------------------------------------------
    def read(self, name: str, before_batch: int | None = None) -> DataFrame | None:
        df = self._read(self.path(name))
        return None if df is None else self._visible(df, "batch", before_batch)

    def read_or_empty(self, name: str, schema, before_batch: int | None = None) -> DataFrame:
        """Like ``read``; a table never written reads as an empty frame."""
        df = self.read(name, before_batch)
        if df is None:
            df = self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
        return df

    def read_parts(self, name: str, column: str, values: list, before_batch: int | None = None, own: int | None = None) -> DataFrame | None:
        """Rows of an append table in some folders of its outer partition
        ``column`` (day, bucket). Only those folders are listed and opened; no
        file's names are gathered for the rest of the history. ``own`` is an
        open batch that reads its own rows too."""
        if not values:
            return None
        folders = self._glob(f"{self.path(name)}/{column}={{{','.join(str(v) for v in sorted(values))}}}")
        df = self._read_folders(name, folders)
        return None if df is None else self._visible(df, "batch", before_batch, own)

    def holds_only(self, name: str, column: str, values: list, batch_id: int) -> bool:
        """Are all rows in those folders of an append table one batch's?"""
        folders = self._glob(f"{self.path(name)}/{column}={{{','.join(str(v) for v in sorted(values))}}}/batch=*")
        return all(folder.endswith(f"/batch={batch_id}") for folder in folders)

    def read_batch(self, name: str, batch_id: int) -> DataFrame | None:
        """The rows that one batch wrote, committed or not."""
        return self.read_batches(name, [batch_id])

    def read_batches(self, name: str, batches: list[int]) -> DataFrame | None:
        """The rows that some batches wrote; no other folder is opened."""
        if not batches:
            return None
        some = f"batch={{{','.join(map(str, batches))}}}"
        return self._read_folders(name, self._glob(f"{self.path(name)}/{some}") or self._glob(f"{self.path(name)}/*/{some}"))

    def drop_batch(self, name: str, batch_id: int) -> None:
        """Remove what a batch wrote to a table of intermediate rows."""
        for folder in self._glob(f"{self.path(name)}/batch={batch_id}") + self._glob(f"{self.path(name)}/*/batch={batch_id}"):
            self._remove(folder)

    def write_batch(self, name: str, df: DataFrame, batch_id: int, day_of: str | None = None,
                    by: list[str] | None = None, deal: bool = True, passing: bool = False) -> None:
        """Write ``df`` as batch ``batch_id``; with ``day_of`` the table is also
        partitioned by the UTC day of that timestamp column, with ``by`` by
        those columns of ``df``. Rows are dealt by the outer partition first,
        a large one to several tasks (unless ``deal`` is off): not every task
        writes to every folder. A ``passing`` table is read once or twice and
        removed: its files take no time for dictionaries."""
        parts = [*(by or []), "batch"]
        if day_of is not None:
            df = df.withColumn("day", F.to_date(F.col(day_of)))
            parts = ["day", "batch"]
        if deal and len(parts) > 1:
            df = df.hint("rebalance", *[F.col(p) for p in parts[:-1]])
        (df.withColumn("batch", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").options(partitionOverwriteMode="dynamic", **(PASSING_FILES if passing else {}))
         .partitionBy(*parts).parquet(self.path(name)))

    # ---- keyed tables --------------------------------------------------------------
    def bucket_of(self, *key: Column | str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.rollup_buckets)).cast("int")

    def buckets_of(self, df: DataFrame, *key: str) -> list[int]:
        """The buckets that hold the keys of ``df``: at most all buckets."""
        return sorted(r[0] for r in df.select(self.bucket_of(*key).alias("b")).distinct().collect())

    def _versions(self, name: str, buckets: list[int] | None = None) -> dict[int, dict[int, str]]:
        """bucket → version → folder, hidden versions among them. A version
        without files is damaged and raises."""
        some = "*" if buckets is None else "{" + ",".join(map(str, buckets)) + "}"
        found: dict[int, dict[int, str]] = {}
        if buckets is None or buckets:
            folders = f"{self.path(name)}/bucket={some}/version=*"
            full = {path.rsplit("/", 1)[0] for path in self._glob(f"{folders}/part-*")}
            for folder in self._glob(folders):
                bucket, version = (int(part.split("=")[1]) for part in folder.rsplit("/", 2)[1:])
                found.setdefault(bucket, {})[version] = folder
                if folder not in full:
                    raise FileNotFoundError(f"{folder} holds no files")
        return found

    def read_keyed(self, name: str, buckets: list[int] | None = None, before_batch: int | None = None,
                   own: int | None = None) -> DataFrame | None:
        """The newest visible version of every bucket (of ``buckets``), older
        than ``before_batch`` where given; ``own`` is an open batch that reads
        what it wrote itself."""
        hidden = set(self.hidden()) - {own}
        folders = []
        for versions in self._versions(name, buckets).values():
            seen = [v for v in versions if v not in hidden and (before_batch is None or v < before_batch)]
            if seen:
                folders.append(versions[max(seen)])
        df = self._read_folders(name, sorted(folders))
        return None if df is None else df.drop("bucket", "version")

    def write_keyed(self, name: str, df: DataFrame, key: list[str], batch_id: int, buckets: list[int],
                    bucket: Column | None = None) -> None:
        """Write ``df``, the whole content of ``buckets``, as their version
        ``batch_id``. A bucket's rows are dealt to one task, so that it is one
        file; it grows with the table divided by the number of buckets.
        ``bucket`` stands in for the hash of the key."""
        of_key = bucket if bucket is not None else self.bucket_of(*key)
        rows = df.withColumn("bucket", of_key).withColumn("version", F.lit(batch_id).cast("long"))
        (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "version").parquet(self.path(name)))
        self._replaced.setdefault(name, set()).update(buckets)

    def upsert(self, name: str, batch: DataFrame, key: list[str], batch_id: int,
               merged: Callable[[DataFrame | None, DataFrame], DataFrame], written: bool = False) -> None:
        """Replace the buckets that ``batch`` has keys of by ``merged(old rows or
        None, batch)``. A batch without rows writes nothing.

        The batch is used twice, for its buckets and its rows. It is written once
        in between, so that its rows are not parsed again, unless they are
        ``written`` already."""
        staged = f"{name}_batch"
        if not written:
            self.write_batch(staged, batch, batch_id, passing=True)
            self._schemas.pop(staged, None)  # the order's type may differ from batch to batch
            rows = self.read_batch(staged, batch_id)
            if rows is None:
                return
            batch = rows.drop("batch")
        buckets = self.buckets_of(batch, *key)
        if buckets:
            self.write_keyed(name, merged(self.read_keyed(name, buckets, batch_id), batch), key, batch_id, buckets)
        if not written:
            self.drop_batch(staged, batch_id)

    def _sweep(self, name: str, buckets: set[int]) -> None:
        """Remove versions older than the last one before the newest."""
        hidden = set(self.hidden())
        for versions in self._versions(name, sorted(buckets)).values():
            for version in sorted(v for v in versions if v not in hidden)[:-2]:
                self._remove(versions[version])

    def read_version(self, name: str, before_batch: int | None = None) -> DataFrame | None:
        """A keyed table, as it was before a batch where one is given."""
        return self.read_keyed(name, before_batch=before_batch)

    def freeze(self, df: DataFrame, scratch: str | None = None) -> DataFrame:
        """Cut lineage: checkpoint into ``spark.checkpoint.dir`` (shared storage)."""
        checkpoint_dir(self.spark, scratch)
        return df.checkpoint(eager=True)

    def read_rollups(self, buckets: list[int] | None = None, before_batch: int | None = None) -> DataFrame | None:
        return self.read_keyed("session_rollups", buckets, before_batch)


def local_scratch(root: str) -> str:
    """Checkpoint folder for single-machine runs (tests); clusters set
    ``spark.checkpoint.dir`` to a shared folder instead."""
    path = os.path.join(root, "_checkpoints")
    os.makedirs(path, exist_ok=True)
    return path
