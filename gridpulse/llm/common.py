"""Helpers shared by the operators: scratch tables, text slices, whole groups from a sorted stream, 64-bit mixing."""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridpulse.session import fresh_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """While a table is being written, let Spark delete the shuffle files of the finished write."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Written intermediate tables below the shared folder of the session; each can be dropped when it is used up."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_dir(self.spark, f"{self.label}-{name}")
        with shuffle_files_dropped(self.spark):
            df.write.parquet(path, compression="zstd")
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, text: str = "text", chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds a bounded number of rows and, but for a single long text, of bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(size):
            if i > start and (i - start >= rows or held + n > chars):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def key_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of neighbouring rows with equal keys from a stream that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns)):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo `modulus`; NULL where the id is NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; callers use it to turn sums of products into well spread names."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bits_for(rows: int, target: int) -> int:
    """Smallest b with rows / 2**b at most target."""
    return max(0, int(np.ceil(np.log2(max(1, rows) / target))))
