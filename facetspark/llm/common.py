"""What the operators of this subpackage share: staging, checked broadcasts and Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a table of a few numbers (or bytes of texts, by 64) that may be broadcast: about 64 MB.
BROADCAST_ROWS = 1_000_000
#: Rows of a batch that a Python worker is sent, and its bytes: texts have no bounded length.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = os.path.join(tempfile.gettempdir(), f"facetspark-{os.getpid()}")
    os.makedirs(at, exist_ok=True)
    return f"file://{at}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/facetspark/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting key has this value within the block, and its own again after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends, lost executors take nothing along."""
    path = new_path(df.sparkSession, name)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)  # its shuffle files go as soon as it is written
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Deletes what stage() wrote, once nothing needs it."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; as it is (a shuffled join) otherwise.

    The caller passes narrow rows; the count stops early.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def releasing(run: Callable) -> Callable:
    """run, a function of a task's batches, and then memory that the task doesn't need goes back to the system: workers
    stay for later tasks, of later stages too."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped


def release_memory() -> None:
    """Gives memory that this process doesn't need back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Has the driver collect what nothing refers to, upon which Spark deletes the shuffle files of finished jobs."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers batches of BATCH at most."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not 0 < int(str(now).rstrip("bB")) <= most:
            spark.conf.set(key, most)


def parts(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most rows rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_rows(df: DataFrame, schema: str, rows: Callable[..., Iterable[tuple]], size: int = 2000) -> DataFrame:
    """rows(*values of a row of df) gives output tuples; batches hold at most size tuples."""
    spark = df.sparkSession
    target = to_arrow_schema(spark.createDataFrame([], schema).schema)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in parts(batches):
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                out += rows(*values)
                if len(out) >= size:
                    yield table(out)
                    out = []
        if out:
            yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), target.types)], schema=target)

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    return df[f"`{name.replace('`', '``')}`"]


def once(expression: Column) -> Column:
    """expression, to be evaluated where it stands: the condition, always true, isn't deterministic, so that no filter
    that a caller puts on what is made of it takes a copy along into its own condition, to be evaluated per element."""
    return F.when(F.monotonically_increasing_id() >= 0, expression)


def as_documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns: whatever else the input carries, under whatever name, plays no part."""
    small_batches(df.sparkSession)
    return df.select(*[column(df, c) for c in columns])
