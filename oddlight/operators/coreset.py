"""Coreset selection: farthest-first traversal on randomly projected features, with the documented random fallback."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, NotInitialized
from ..functions.vectors import float32
from .calibrate import least_hashed, ordered_value
from .knn import matrix

MAX_EVALUATIONS = 50_000_000
#: Bytes of projected features that the driver may hold; beyond, every pick is a pass over the executors.
GATHER_BYTES = 1 << 30


def coreset_size(n: int, ratio: float) -> int:
    """max(1, ceil(n * ratio)) with the ratio in single precision."""
    if not 0 < ratio <= 1:
        raise InvalidArgument("the coreset ratio must be in (0, 1]")
    return max(1, math.ceil(n * float32(ratio)))


def projection(dimension: int, rank: int, seed: int) -> np.ndarray | None:
    """Gaussian matrix scaled by 1/sqrt(rank); None where it would not reduce."""
    if rank >= dimension:
        return None
    return np.random.default_rng(seed).normal(0, 1 / math.sqrt(rank), (dimension, rank)).astype(np.float32)


def farthest_first(x: np.ndarray, k: int, first: int) -> list[int]:
    """k row numbers: from first on, always the row farthest from those chosen; ties go to the lower number."""
    chosen = [first]
    least = ((x - x[first]) ** 2).sum(axis=1)
    least[first] = -1
    while len(chosen) < min(k, len(x)):
        best = int(np.argmax(least))
        chosen.append(best)
        least = np.minimum(least, ((x - x[best]) ** 2).sum(axis=1))
        least[chosen] = -1
    return chosen


def _projected(features: DataFrame, matrix_: np.ndarray | None) -> DataFrame:
    """(bank_id, feat): features times the matrix, in single precision; without a matrix as they are."""
    rows = features.select(F.col("bank_id").cast("long").alias("bank_id"), F.col("feat").cast("array<double>").alias("feat"))
    if matrix_ is None:
        return rows

    def run(batches):
        for b in batches:
            x = matrix(b.column(1)).astype(np.float32) @ matrix_ if b.num_rows else []
            yield pa.record_batch([b.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["bank_id", "feat"])

    return rows.mapInArrow(run, "bank_id long, feat array<float>")


def farthest_scan(rows: DataFrame, k: int, first: int) -> list[int]:
    """farthest_first by ids over a table (bank_id, feat) that is not gathered: each pick is one pass over it."""
    chosen, centres = [first], [rows.where(F.col("bank_id") == first).first()["feat"]]
    for _ in range(k - 1):
        picked, x = np.array(chosen), np.array(centres, float)

        def run(batches, picked=picked, x=x):
            best = None
            for b in batches:
                ids = np.asarray(b.column(0), np.int64)
                open_ = ~np.isin(ids, picked)
                if not open_.any():
                    continue
                ids, y = ids[open_], np.asarray(matrix(b.column(1)), float)[open_]
                least = np.min([((y - c) ** 2).sum(axis=1) for c in x], axis=0)
                i = np.lexsort((ids, -least))[0]
                if best is None or (-least[i], ids[i]) < best[:2]:
                    best = (-least[i], ids[i], y[i])
            if best:
                yield pa.record_batch([pa.array([best[1]], pa.int64()), pa.array([-best[0]]), pa.array([best[2]], pa.list_(pa.float64()))], ["bank_id", "least", "feat"])

        r = rows.mapInArrow(run, "bank_id long, least double, feat array<double>").orderBy(F.desc("least"), "bank_id").first()
        if r is None:
            break
        chosen.append(r["bank_id"])
        centres.append(r["feat"])
    return chosen


def coreset(features: DataFrame, ratio: float = 0.1, project: int = 128, max_evaluations: int = MAX_EVALUATIONS, seed: int = 42, first: int | None = None) -> tuple[DataFrame, str]:
    """(bank, branch taken) from rows (bank_id, feat): ``all``, ``farthest`` or ``random``.

    All rows stay, in order, where the size reaches their number. Beyond max_evaluations distance evaluations (rows x
    size) a random subset by seeded hash is taken instead, without gathering anything. Within it, executors project
    and only the projected matrix is gathered; where that exceeds GATHER_BYTES nothing is, and each of the then few
    picks (max_evaluations / rows) is a pass over the table. The original vectors never leave the executors.
    """
    n = features.count()
    if n == 0:
        raise NotInitialized("no training features")
    k = coreset_size(n, ratio)
    if k >= n:
        return features, "all"
    if k > max_evaluations // n:
        return random_subset(features, k, seed), "random"
    dimension = features.select(F.size("feat")).first()[0]
    matrix_ = projection(dimension, project, seed)
    rows = _projected(features, matrix_)
    start = int(np.random.default_rng(seed).integers(n)) if first is None else first
    if n * 8 * (dimension if matrix_ is None else project) > GATHER_BYTES:
        chosen = farthest_scan(rows, k, int(ordered_value(rows, F.col("bank_id"), start)))
    else:
        table = rows.toArrow()
        ids = np.asarray(table["bank_id"], np.int64)
        order = np.argsort(ids)
        chosen = ids[order][farthest_first(matrix(table["feat"])[order], k, start)]
    picks = features.sparkSession.createDataFrame([(int(i), r) for r, i in enumerate(chosen)], "bank_id long, pick int")
    return features.join(F.broadcast(picks), "bank_id"), "farthest"  # k rows within the evaluation limit


def random_subset(features: DataFrame, k: int, seed: int) -> DataFrame:
    """The k rows of least seeded hash."""
    return least_hashed(features, ["bank_id"], k, seed)


def streaming_bank(rows: np.ndarray, budget: int, chunk: int) -> np.ndarray:
    """Merge-reduce bank over rows in order: append a chunk, reduce to the budget by farthest-first from row 0."""
    bank = rows[:0]
    for at in range(0, len(rows), chunk):
        bank = np.concatenate([bank, rows[at : at + chunk]])
        if len(bank) > budget:
            bank = bank[farthest_first(bank, budget, 0)]
    return bank
