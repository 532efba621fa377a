"""Shared-folder tables, counters and session settings for the operators of this subpackage.

Intermediate results are cut from their lineage by writing them as Parquet below ``spark.checkpoint.dir``, the one
folder that driver and executors share; a lost executor then costs a re-read, never a recomputation of earlier stages.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch (whole texts travel, so far fewer than the default of 10000), and bytes of text in one.
ARROW_ROWS = 512
BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts stays within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _small(batches):
    for b in batches:
        text = b.column(b.num_columns - 1)
        if not pa.types.is_string(text.type) or text.nbytes <= BATCH_BYTES:
            yield b
            continue
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < len(text):
            to = max(int(np.searchsorted(ends, ends[at] + BATCH_BYTES, "right")) - 1, at + 1)
            yield b.slice(at, to - at)
            at = to


def lean(kernel):
    """A mapInArrow kernel with bounded memory: it gets at most BATCH_BYTES of text at a time (or one longer text), and
    hands freed memory back to the system at the end of a task.

    The text is the last column. Workers are reused, so what one stage's kernel has left in the allocator would count
    against the next one's room.
    """

    def run(batches):
        yield from kernel(_small(batches))
        hand_back()

    return run


def lean_group(kernel, least: int = 1 << 20):
    """An applyInArrow kernel that hands freed memory back after every group of at least that many bytes."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        size = t.nbytes
        out = kernel(key, t)
        if size >= least:
            del t
            hand_back()
        return out

    return run


def hand_back() -> None:
    """Gives memory that the allocators hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def quoted(name: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """df with the columns c0, c1, ...: mapInArrow takes no names with dots or backticks."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def free_name(base: str, columns: list[str]) -> str:
    """base, or base with underscores, so that it differs from all columns in any case of letters."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only where the cluster names none and is one machine (as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.oddlight.workdir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="oddlight-")
            spark.conf.set("spark.oddlight.workdir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/oddlight/{name}-{uuid.uuid4().hex}"


_listeners: list[list[str]] = []


@contextmanager
def staged_paths():
    """Collects the paths of the tables that are staged meanwhile."""
    _listeners.append(paths := [])
    try:
        yield paths
    finally:
        del _listeners[next(i for i, p in enumerate(_listeners) if p is paths)]


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and return the table read back: lineage ends here."""
    path = work_path(df.sparkSession, name)
    for paths in _listeners:
        paths.append(path)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_at = path  # for drop_table; a plain attribute, never shipped
    return back


def drop_table(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    drop_path(df.sparkSession, df.staged_at)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_keys(df: DataFrame, name: str) -> DataFrame:
    """Add a unique long; it is only stable once the frame has been written, so callers stage the result."""
    return df.withColumn(name, F.monotonically_increasing_id())


def prefix_offsets(counts: dict, order: list) -> dict:
    """Exclusive prefix sums of counts in the given order of keys."""
    at, out = 0, {}
    for k in order:
        out[k] = at
        at += counts[k]
    return out
