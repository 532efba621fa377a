"""Packing by power-of-two decomposition: a document's tokens are cut into binary-length pieces.

A document of T tokens gives T div L pieces of the full length L and one piece for each set bit of T mod L, longest
first. Each piece is a sequence of its own whose length is a power of two, so nothing is padded, no sequence crosses
documents, and sequences of one length form a bucket from which batches of equal shape are drawn. The plan has no
shuffle: pieces are written once with their running number in the task, and the offsets of tasks and buckets are a
prefix sum over at most (tasks x 13) counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, prefix_offsets, stage_table, tune


def binary_pieces(tokens: int, longest: int) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    full, rest = divmod(tokens, longest)
    return [longest] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(path: str, end: int, longest: int, plain_specials: bool):
    def run(batches):
        from .tokens import encoder, with_end

        encode, task, seen = encoder(path, plain_specials).encode, TaskContext.get().partitionId(), {}
        for b in batches:
            ids, offsets = with_end(*encode(b.column(1)), end)
            src, length, local = [], [], []
            for i, n in enumerate(np.diff(offsets).tolist()):
                for size in binary_pieces(n, longest):
                    src.append(i)
                    length.append(size)
                    local.append(seen.get(size, 0))
                    seen[size] = local[-1] + 1
            cuts = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])  # pieces follow each other without gaps
            raw = pa.Array.from_buffers(pa.large_binary(), len(src), [None, pa.py_buffer(4 * cuts), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
            at = np.array(src, np.int64)
            yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array(cuts[:-1] - offsets[at]), pa.array(length, pa.int64()), raw, pa.array(np.diff(offsets)[at]), pa.array(np.full(len(src), task)), pa.array(local, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens", "task", "local"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = 4096, id_col: str = "doc_id", text_col: str = "text", plain_specials: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null text counts as empty: such a document is its end id alone. longest must be a power of two. Sequence ids are
    gapless, longest bucket first. The string of a special token in a text gives that token, as the library does by
    default; with plain_specials it is ordinary text. Repeated rows are packed each on their own; an empty table gives no piece.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    spark = docs.sparkSession
    tune(spark)
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = cols.schema["doc_id"].dataType.simpleString()
    pieces = stage_table(cols.mapInArrow(lean(_pieces(tokenizer, end_id, longest, plain_specials)), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, task long, local long"), "pieces")
    counts = {(-r["length"], r["task"]): r["n"] for r in pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = prefix_offsets(counts, sorted(counts))
    offsets = spark.createDataFrame([(-n, t, first) for (n, t), first in at.items()], "length long, task long, first long")
    return pieces.join(F.broadcast(offsets), ["length", "task"]).select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("first") + F.col("local")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
