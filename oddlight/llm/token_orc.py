"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id, encoded, and written in ascending id order, one file for each range. ORC stores
the ids of a stripe run-length encoded, with minima and maxima for every row group and a Bloom filter on doc_id; readers
take stripes in parallel, and a filter on doc_id skips stripes and row groups by metadata alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import lean, prefix_offsets, shuffle_parts, stage_table, tune


def _encode(path: str, end: int, plain_specials: bool):
    def run(batches):
        from .tokens import encoder, with_end

        encode, part, pos = encoder(path, plain_specials).encode, TaskContext.get().partitionId(), 0
        for b in batches:
            ids, offsets = with_end(*encode(b.column(1)), end)
            n = b.num_rows
            yield pa.record_batch([b.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")))], ["doc_id", "part", "pos", "ids"])
            pos += n

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", plain_specials: bool = False) -> None:
    """Encode whole texts (null: empty), append end_id to each, and write ORC files in ascending doc_id order.

    Columns: doc_id, part (number of the range), pos (place in it), ids. Equal ids stay neighbours; null ids come first.
    The string of a special token in a text gives that token, as the library does by default; with plain_specials it is
    ordinary text.
    """
    spark = docs.sparkSession
    tune(spark)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = cols.repartitionByRange(parts or shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id")
    coded = ordered.mapInArrow(lean(_encode(tokenizer, end_id, plain_specials)), "doc_id long, part int, pos long, ids array<int>")
    coded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20)).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; doc_ids are pushed down to stripe statistics, row indexes and Bloom filters."""
    out = spark.read.schema("doc_id long, part int, pos long, ids array<int>").orc(path)
    return out if doc_ids is None else out.where(F.col("doc_id").isin(doc_ids))


def _summary(batches):
    for b in batches:
        ids = b.column(3)
        offsets = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8))
        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "pos", "n_tokens", "ids_crc32"])


def token_summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    tune(spark)
    rows = stage_table(read_tokens(spark, path).mapInArrow(lean(_summary), "doc_id long, part int, pos long, n_tokens long, ids_crc32 long"), "token-summary")
    totals = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one number for each file
    offsets = spark.createDataFrame(list(prefix_offsets(totals, sorted(totals)).items()), "part int, first long")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0)))
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
