"""What the operators of this folder share: working tables and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch is worked off in slices of about so many bytes of text (one longer text is a slice).
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a temporary one, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meterlark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Working tables of the innermost open scratch(): those that go when it ends, and those that go with the block around it.
_OPEN: ContextVar[tuple[list[str], list[str]] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables settled inside go when the block ends without an error; kept ones go with the block around it, if any."""
    around, own = _OPEN.get(), ([], [])
    token = _OPEN.set(own)
    try:
        yield
    finally:
        _OPEN.reset(token)
    gone, kept = own
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if around is not None:
        around[0].extend(kept)


def settled(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df written once as a table in the shared folder and read back: lineage ends there, lost executors cost nothing.

    keep: the result of the scratch() block around it reads the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/meterlark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (own := _OPEN.get()) is not None:
        own[keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a side may take, counted, to be sent to every executor; and those of a row of keys in a broadcast table.
BROADCAST_BYTES, KEY_BYTES = 32 << 20, 64


def sent_if_few(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if a count of its rows shows that they are few; else it is joined by shuffle."""
    return F.broadcast(keys) if keys.count() * KEY_BYTES <= BROADCAST_BYTES else keys


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array, whatever Arrow hands over."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets of each text); a null text is empty."""
    column = flat(column).cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks and stages, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded text (of all named columns), so that memory doesn't follow the batch size; given back after each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = sum(text_bytes(batch.column(c))[1] for c in texts)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        del batch
        give_back()
