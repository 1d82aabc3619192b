"""What the corpus operators share: written intermediate tables, size estimates, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many (narrow) rows may be broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 20_000
#: Rows with texts in an Arrow batch.
TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is only made here in local mode where the session names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagelens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pagelens-{spark.sparkContext.applicationId}"


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lowers the session's rows in an Arrow batch, which with whole texts would take tens of MB a task in the JVM and again in
    Python. It stays lower, since plans run later than they are made; no result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pl_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def done_with(*made: DataFrame) -> None:
    """Deletes what materialize has written for these; nothing that is still to be computed may read them."""
    for df in made:
        _delete(df.sparkSession, df._pl_path)


def drop_intermediates(spark: SparkSession) -> None:
    """Deletes all that materialize has written for this application. For the end of a run: results must be written by then."""
    _delete(spark, own_dir(spark))


def named(columns: list[str]) -> list[Column]:
    """Columns by their whole names, which may have dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of the input, from file sizes, so no job runs; where it knows none, the texts are measured."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        size = df.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    return size


def buckets_for(df: DataFrame, each: int = 4 << 20, least: int = 64) -> int:
    """How many buckets to deal a table into, so that each stays small whatever the size of the table."""
    return int(min(max(least, input_bytes(df) // each), 1 << 20))


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcasting if it has few rows (checked by counting), else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_M_MMAP_THRESHOLD = -3
_lean: list[bool] = []


def give_back() -> None:
    """Returns this Python worker's freed memory to the system, since the worker waits for tasks of any stage. Needs glibc."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tune() -> None:
    """Has this Python worker map arrays of some MB, so that they go when freed."""
    if not _lean:
        _lean.append(True)
        if set_option := getattr(ctypes.CDLL(None), "mallopt", None):
            set_option(_M_MMAP_THRESHOLD, 4 << 20)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, in a worker that maps arrays of some MB, so that they go when freed, and gives back the rest at
    the end of a task: workers of several stages share an executor's memory."""

    def wrapped(batches: Iterator) -> Iterator:
        tune()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def safe_names(columns: list[str]) -> dict[str, str]:
    """A plain name for each column: mapInArrow can't take names with dots."""
    return {c: f"_pl_c{i}" for i, c in enumerate(columns)}
