"""Exact nearest neighbours by squared Euclidean distance.

The bank is a table (bank_id, feat). While its measured size is within ``broadcast_bytes`` it is shipped to the workers
and queries are scored where they are, without a shuffle. Beyond, bank and queries meet in a grid of blocks: every
block pair yields the k best of each query, and a window keeps the best k overall. Distances accumulate one dimension at
a time, so that both ways, and SQL, give the same bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument

BROADCAST_BYTES = 256 << 20
QUERY_ROWS, BANK_ROWS = 8192, 32_768


def top_k(q: np.ndarray, bank_ids: np.ndarray, bank_t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances), both len(q) x min(k, bank); ties go to the lower id. bank_ids must ascend.

    A matrix product bounds all distances; those that rounding can't tell from the k-th best are computed exactly.
    """
    k = min(k, len(bank_ids))
    ids, dist = np.zeros((len(q), k), np.int64), np.zeros((len(q), k))
    bank_norm = (bank_t * bank_t).sum(axis=0)
    for at in range(0, len(q), 512):
        x = q[at : at + 512]
        norm = (x * x).sum(axis=1)
        rough = x @ bank_t
        rough *= -2
        rough += norm[:, None]
        rough += bank_norm
        kth = rough.min(axis=1) if k == 1 else np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = 4e-16 * (len(bank_t) + 8) * (norm + bank_norm.max() + 1e-300) * 2
        row, col = np.nonzero(rough <= (kth + 2 * slack)[:, None])
        exact = np.zeros(len(row))
        for d in range(len(bank_t)):
            diff = x[row, d] - bank_t[d, col]
            exact += diff * diff
        order = np.lexsort((col, exact, row))
        first = np.searchsorted(row, np.arange(len(x)))
        best = order[first[:, None] + np.arange(k)]
        ids[at : at + 512], dist[at : at + 512] = bank_ids[col[best]], exact[best]
    return ids, dist


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = np.asarray(col.flatten(), float)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def bank_matrix(bank: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors), by ascending id; callers check the size first."""
    t = bank.select("bank_id", F.col("feat").cast("array<double>")).toArrow()
    ids = np.asarray(t["bank_id"], np.int64)
    order = np.argsort(ids)
    return ids[order], matrix(t["feat"])[order]


def _rows(b: pa.RecordBatch, keys: list[str], ids: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    n, k = ids.shape
    take = pa.array(np.repeat(np.arange(n), k))
    cols = [b.column(b.schema.get_field_index(c)).take(take) for c in keys]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(ids.ravel()), pa.array(dist.ravel())], [*keys, "rank", "bank_id", "d2"])


def knn(queries: DataFrame, bank: DataFrame, k: int, keys: list[str], strategy: str = "auto", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(keys, rank, bank_id, d2) of the k nearest bank vectors of every query, fewer where the bank is smaller.

    strategy: ``broadcast``, ``blocks``, or ``auto`` by the measured size of the bank. An empty bank gives no rows.
    """
    if k < 1:
        raise InvalidArgument("k must be positive")
    queries = queries.select(*keys, F.col("feat").cast("array<double>").alias("feat"))
    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{kinds}, rank int, bank_id long, d2 double"
    if strategy == "auto":
        size = bank.agg(F.coalesce(F.sum(F.size("feat")), F.lit(0))).first()[0] * 8
        strategy = "broadcast" if size <= broadcast_bytes else "blocks"
    if strategy == "broadcast":
        ids, vectors = bank_matrix(bank)
        shared = bank.sparkSession.sparkContext.broadcast((ids, np.ascontiguousarray(vectors.T)))

        def run(batches):
            own, bank_t = shared.value
            for b in batches:
                q = matrix(b.column(b.num_columns - 1))
                if len(q) and len(own):
                    yield _rows(b, keys, *top_k(q, own, bank_t, k))

        return queries.mapInArrow(run, schema)
    return _blocks(queries, bank, k, keys, schema)


def _blocks(queries: DataFrame, bank: DataFrame, k: int, keys: list[str], schema: str) -> DataFrame:
    """The query set in blocks against the bank in blocks; sizes come from counts, so a block fits a worker."""
    nq, nb = (max(1, math.ceil(df.count() / rows)) for df, rows in ((queries, QUERY_ROWS), (bank, BANK_ROWS)))
    q = queries.withColumn("i", F.pmod(F.xxhash64(*keys), F.lit(nq))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    v = bank.select("bank_id", F.col("feat").cast("array<double>").alias("feat")).withColumn("j", F.pmod(F.xxhash64("bank_id"), F.lit(nb)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*keys, "rank", "bank_id", "d2"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], left.schema.field(c).type if c in keys else {"rank": pa.int32(), "bank_id": pa.int64(), "d2": pa.float64()}[c]) for c in names})
        ids = np.asarray(right["bank_id"], np.int64)
        order = np.argsort(ids)
        found = top_k(matrix(left["feat"]), ids[order], np.ascontiguousarray(matrix(right["feat"])[order].T), k)
        return pa.Table.from_batches([_rows(left.combine_chunks().to_batches()[0], keys, *found)])

    near = q.withColumn("i", F.col("i").cast("int")).groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("d2", "bank_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_scores(queries: DataFrame, bank: DataFrame, keys: list[str], sqrt: bool = True, **how) -> DataFrame:
    """(keys, v, bank_id): distance to the nearest bank vector."""
    d = knn(queries, bank, 1, keys, **how)
    return d.select(*keys, (F.sqrt("d2") if sqrt else F.col("d2")).alias("v"), "bank_id")
