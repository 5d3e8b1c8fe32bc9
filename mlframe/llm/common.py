"""What several operators share: written intermediate tables, words and their hashes, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from mlframe.plans.workers import let_workers_import

#: A-Z to a-z; every other byte, and so every non-ASCII character, stays.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = np.frombuffer(LOWER_ASCII, np.uint8)
_WORD_BYTE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a new local one in local mode; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="mlframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def output_files(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """In how many tasks to write a result: one for every ``bytes_each`` of the tables that it reads, and two a core at least. Tasks grow in number and not in size with the input, and small results do not become thousands of files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()) if leaves.apply(k).getClass().getSimpleName().startswith("LogicalRelation"))
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-read // bytes_each))


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as compressed Parquet into the shared folder and goes on from there: cuts the lineage, survives lost executors.

    Adaptive execution merges small shuffle partitions; :func:`output_files` bounds the number of files. Shuffle files that the written rows replace are freed at once. The table goes by :func:`discard`, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/mlframe-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.coalesce(output_files(df)).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that :func:`materialize` wrote and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if place.getName().startswith("mlframe-"):
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads all bits (the SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a string or binary column in a row, and where each begins and the last ends; null texts are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    kind = "<i8" if pa.types.is_large_string(column.type) else "<i4"
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words (runs without ASCII white space) of several texts in a row: their bytes, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray  # of each word
    stop: np.ndarray
    first: np.ndarray  # word number at which each text begins; the last entry is the number of words

    @classmethod
    def of(cls, column: pa.Array, lower: bool = False) -> Words:
        data, at = text_bytes(column)
        if lower:
            data = _LOWER[data]
        inside, n = _WORD_BYTE[data], len(data)
        border = at[1:-1]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[border[border < n]] = False
        after[border[border > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        return cls(data, start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, at))

    def hashes(self, longest: int = 256) -> np.ndarray:
        """64-bit hash of each word's bytes, eight bytes at a time; words beyond ``longest`` bytes are hashed one by one."""
        wide = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        size = self.stop - self.start
        out = mix64(size.astype(np.uint64) * SPREAD ^ wide[self.start] & _FIRST_BYTES[np.minimum(size, 8)])
        some, at = np.flatnonzero(size > 8), 8
        while len(some) and at < longest:
            out[some] = mix64(out[some] * SPREAD ^ wide[self.start[some] + at] & _FIRST_BYTES[np.minimum(size[some] - at, 8)])
            at += 8
            some = some[size[some] > at]
        for k in some.tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.start[k] : self.stop[k]])
        return out


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of about ``max_bytes`` (one row at least), so that memory does not follow Arrow's row count."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def map_arrow(df: DataFrame, run, schema, rows: int = 1000) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in record batches of at most ``rows`` rows: texts can be long, and both sides of the pipe hold whole batches.

    Lowers the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` where it is higher.
    """
    let_workers_import(df.sparkSession)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df.mapInArrow(run, schema)
