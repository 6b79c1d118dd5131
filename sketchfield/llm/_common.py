"""What the operators share: intermediate tables, free column names and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sketchfield-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: No marker of success: a table is read once its write has returned, and by nobody else.
_WRITE = {"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    This cuts the lineage at a table that outlives any executor.  ``release``: after large shuffles,
    let their files go.
    """
    return _stored(df, name, release)[0]


def _stored(df: DataFrame, name: str, release: bool) -> tuple[DataFrame, str]:
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**_WRITE).parquet(path)
    if release:  # Spark's cleaner deletes shuffle files when the driver collects the objects that stand for them
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that an operator stores on its way, which go when it ends: ``with Scratch() as scratch``."""

    def __init__(self) -> None:
        self._paths: list[tuple[SparkSession, str]] = []

    def stored(self, df: DataFrame, name: str, release: bool = False) -> DataFrame:
        table, path = _stored(df, name, release)
        self._paths.append((df.sparkSession, path))
        return table

    def drop(self, keep: int = 0) -> None:
        """Delete the tables but for the last ``keep``."""
        for _ in range(len(self._paths) - keep):
            spark, path = self._paths.pop(0)
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def take(self, other: Scratch) -> None:
        """Answer for another's tables."""
        self._paths += other._paths
        other._paths = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop()


def apart(column: Column, kind: str = "long") -> Column:
    """The same value, in an expression that hides how an aggregation has dealt it.

    A join on it shuffles the aggregated side by itself, and only then can Spark split the other side's busy keys.
    """
    return F.concat(column, F.lit("")) if kind == "string" else F.bitwise_not(F.bitwise_not(column))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def give_back() -> None:
    """Return what this process has freed to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function that ``make`` builds once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            out = each(batch)
            del batch
            if out is not None and out.num_rows:
                yield out
            del out
        give_back()

    return df.mapInArrow(run, schema)


@contextmanager
def without_cycle_search() -> Iterator[None]:
    """Python's search for garbage cycles is off inside: it would walk large tables that hold none again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The column's strings, null as the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]


def runs(texts: list[str], chars: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 50
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def record_batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) if not isinstance(v, pa.Array) else v for v, t in columns.values()], names=list(columns))
