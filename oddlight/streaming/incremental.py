"""Incremental fit state: micro-batches merge into an accumulator table by an associative rule.

State rows: key, n, low, high, mean, m2. Each batch writes a new version of the table beside the old one and the last
version wins, so a batch that is retried after a lost executor or driver gives the same state.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import InvalidArgument


def batch_state(df: DataFrame, key: str, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    n = F.count(v)
    return df.groupBy(key).agg(n.alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2"))


def merge_states(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Moments of the union, by the pairwise rule; keys of either side stay."""
    both = a.unionByName(b)
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.coalesce("mean", F.lit(0.0))) / n
    one = both.groupBy(key).agg(n.alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), mean.alias("mean"), F.sum("m2").alias("inner"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("square"))
    return one.select(key, "n", "low", "high", "mean", (F.col("inner") + F.greatest(F.col("square") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))).alias("m2"))


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that driver and executors share, or name one")
        root = "file://" + tempfile.mkdtemp(prefix="oddlight-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def last_version(spark: SparkSession, folder: str) -> int:
    """The highest version in the folder that was written completely, or -1."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [-1]
    if fs.exists(path(folder)):
        for entry in fs.listStatus(path(folder)):
            name = entry.getPath().getName()
            if re.fullmatch(r"v\d+", name) and fs.exists(path(entry.getPath(), "_SUCCESS")):
                done.append(int(name[1:]))
    return max(done)


class IncrementalFit:
    """foreachBatch sink that keeps the state of a stream: versions of a small table, one row for each key."""

    def __init__(self, spark: SparkSession, key: str, value: str, folder: str | None = None) -> None:
        self.spark, self.key, self.value = spark, key, value
        self.folder = folder or _folder(spark)
        self.version = last_version(spark, self.folder) if folder else -1

    def add_batch(self, df: DataFrame, batch_id: int) -> None:
        if batch_id <= self.version:
            return  # already in the state
        state = batch_state(df, self.key, self.value)
        if self.version >= 0:
            state = merge_states(self.state(), state, self.key)
        state.write.mode("overwrite").parquet(f"{self.folder}/v{batch_id}")
        self.version = batch_id

    def state(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version}")


def fit_stream(spark: SparkSession, schema: StructType, path: str, key: str, value: str, state_folder: str | None = None) -> DataFrame:
    """Runs the stream over all files available now and returns (key, n, low, high, mean, variance).

    State and progress lie in one folder: with the state_folder of an earlier run only files that it has not read count anew.
    """
    fit = IncrementalFit(spark, key, value, state_folder)
    folder, name = os.path.split(path.rstrip("/"))
    # a stream source reads folders; a glob picks the one table out of its folder
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*" if not name.endswith("*") else path)
    done = stream.writeStream.foreachBatch(fit.add_batch).option("checkpointLocation", f"{fit.folder}/progress").trigger(availableNow=True).start()
    done.awaitTermination()
    s = fit.state()
    return s.select(key, "n", "low", "high", "mean", (F.col("m2") / F.col("n")).alias("variance"))
