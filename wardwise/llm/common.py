"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardwise.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read through Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder path below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage, survives lost executors)."""
    path = shared_path(df.sparkSession, name)
    for scope in _SCOPES[-1:]:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCOPES: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``stored`` inside are deleted at the end: for work whose result has been written by then."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            remove(spark, path)


SLICE_ROWS = 1000  # rows that a task turns into Python objects at once


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` with a function of one record batch of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(start, rows))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def with_arrow_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], list], inputs: list[str], new: list[T.StructField]) -> DataFrame:
    """``df`` plus new columns that ``fn`` computes from the input columns of each record batch.

    Every other column passes through unchanged. A column of ``df`` that has
    the name of a new one is replaced.
    """
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names or f.name in inputs]
    keep_out = [f for f in kept if f.name.lower() not in names]
    schema = T.StructType(keep_out + new)
    src = df.select(*[F.col(f"`{f.name}`") for f in kept])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(f.name) for f in keep_out]
        return pa.RecordBatch.from_arrays(cols + fn(batch), names=[f.name for f in schema.fields])

    return map_batches(src, run, schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


class Memory(dict):
    """Bounded memory of a function: a new generation of entries, and the last one for what is asked again."""

    def __init__(self, fn: Callable, entries: int, size: int):
        super().__init__()
        self.fn, self.entries, self.size, self.last = fn, entries, size, {}

    def __missing__(self, key):
        value = self.last.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= self.size:  # longer keys are not remembered
            if len(self) >= self.entries:
                self.last = dict(self)
                self.clear()
            self[key] = value
        return value
