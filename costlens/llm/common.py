"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words of most contracts: runs of anything but these six characters.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share: ``spark.checkpoint.dir``.

    Where the session names none (a test on one machine) a local folder is
    set for it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    fallback = "file://" + tempfile.mkdtemp(prefix="costlens-llm-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts the lineage: what follows survives the loss of executors without
    computing ``df`` again, and several jobs can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` of the whole text, in order."""
    # Splitting on one plain character is about three times as fast as on a
    # class; most texts hold no other separators than blanks and line feeds.
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    parts = F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.split(text, SPACE_RUN)).otherwise(plain)
    return F.filter(parts, lambda w: w != "")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this subpackage to the executors once per application, as
    ``--py-files`` would, so that tasks can import it where it is not
    installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="costlens-py-")) / "costlens_llm.zip"
    with zipfile.ZipFile(target, "w") as archive:
        archive.writestr("costlens/__init__.py", "")
        for source in sorted(here.glob("*.py")):
            archive.write(source, f"costlens/llm/{source.name}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows for tasks that hold whole texts; a smaller
    setting of the session stays. Also ships the code of those tasks."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def default_tokenizer() -> str:
    """Path of the vocabulary that the queries use; operators take a path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
