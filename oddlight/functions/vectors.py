"""Column expressions on array<double> vectors; they stay in generated code and sum from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def pick(v: Column, indices: list[int]) -> Column:
    """Elements by zero-based index, in the order given; only these leave the scan's projection."""
    return F.array(*[F.get(v, F.lit(i)) for i in indices])


def clamp01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def float32(value: float) -> float:
    """A ratio parameter as it is after storage in single precision."""
    import numpy as np

    return float(np.float32(value))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes given as columns x1, y1, x2, y2."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)
