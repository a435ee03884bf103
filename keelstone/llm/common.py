"""What the corpus operators share: scratch tables, words and row streams."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK, _WRITERS, _BEFORE = threading.Lock(), [], []

#: Bytes of rows that go to a Python worker at once, about, after ``small_batches``.
BATCH_BYTES = 4 << 20

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
#: One or more of them, for Java and DuckDB expressions alike.
SPACE_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Where that is unset, a local
    master gets a temporary folder and any other master a folder below the
    warehouse, and the setting is filled in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith(("local[", "local")) and "cluster" not in spark.sparkContext.master
        found = tempfile.mkdtemp(prefix="keelstone-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their query; the setting is put back by the last of several threads that write."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _LOCK:
        if not _WRITERS:
            _BEFORE[:] = [spark.conf.get(key)]
            spark.conf.set(key, "true")
        _WRITERS.append(key)
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS.pop()
            if not _WRITERS:
                spark.conf.set(key, _BEFORE[0])


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here.

    A lost executor costs only the tasks that it ran, and later steps reread
    the files. The shuffle files behind df are given up once it is written, and
    the table itself goes with the application.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/keelstone/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python workers at most BATCH_BYTES at a time; a smaller setting stays.

    10,000 rows of text are one batch otherwise, of up to 64 MB, and an
    executor's allocator keeps much of what such buffers took. The setting
    stays, as a frame is planned when it is run. A longer row is a batch of its
    own; no result depends on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return a worker's free memory to the machine: workers live on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it has


def map_batches(df: DataFrame, f: Callable[[pa.Table], Iterator[pa.Table] | pa.Table], schema: str, rows: int = 2048, done: Callable[[], None] = lambda: None) -> DataFrame:
    """mapInArrow with f applied to slices of at most ``rows`` rows; ``done`` is called at a task's end."""

    def run(batches):
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    out = f(pa.Table.from_batches([batch.slice(at, rows)]))
                    for t in [out] if isinstance(out, pa.Table) else out:
                        yield from t.to_batches()
        finally:
            done()
            give_back()

    return df.mapInArrow(run, schema)


def utf8(column: Column | str) -> Column:
    """A text's bytes, so that Python gets no invalid strings to decode."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def word_list(text: Column) -> Column:
    """The words of a text as an array, in Spark's own functions; null: none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
