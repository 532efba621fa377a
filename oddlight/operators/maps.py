"""Anomaly maps: one row for each image (image_id, h, w, values), so every operator here is a map over rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import linear, planes

MAP = "image_id long, h int, w int, values array<double>"


def each_map(maps: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel over every plane; rows with null values pass with null."""

    def run(batches):
        for b in batches:
            h, w = b.column(1).to_pylist(), b.column(2).to_pylist()
            out = [kernel(np.asarray(v.values, float).reshape(i, j)) if v.is_valid else None for v, i, j in zip(b.column(3), h, w, strict=True)]
            shape = [pa.array([h[n] if x is None else x.shape[0] for n, x in enumerate(out)], pa.int32()), pa.array([w[n] if x is None else x.shape[1] for n, x in enumerate(out)], pa.int32())]
            yield pa.record_batch([b.column(0), *shape, pa.array([None if x is None else x.ravel() for x in out], pa.list_(pa.float64()))], ["image_id", "h", "w", "values"])

    return maps.select("image_id", "h", "w", F.col("values").cast("array<double>")).mapInArrow(run, MAP)


def maps_from_pixels(pixels: DataFrame, h: int, w: int, value: str = "v") -> DataFrame:
    """Pixel rows (image_id, loc, value) as maps; h * w entries are gathered for each image."""
    one = pixels.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("loc", F.col(value).alias("v")))).alias("p"))
    return one.select("image_id", F.lit(h).alias("h"), F.lit(w).alias("w"), F.transform("p", lambda q: q["v"].cast("double")).alias("values"))


def pixels_of(maps: DataFrame) -> DataFrame:
    """(image_id, y, x, v) rows."""
    return maps.select("image_id", "w", F.posexplode("values").alias("i", "v")).select("image_id", F.expr("i div w").cast("int").alias("y"), F.expr("i % w").alias("x"), "v")


def resize_map(maps: DataFrame, h: int, w: int) -> DataFrame:
    return each_map(maps, lambda p: linear.apply(linear.resize_matrix(h, p.shape[0]), p, linear.resize_matrix(w, p.shape[1])))


def blur_map(maps: DataFrame, sigma: float) -> DataFrame:
    """Gaussian blur of a map, mirrored at the border; sigma 0 leaves it."""
    if sigma < 0:
        raise InvalidArgument("sigma must not be negative")
    if sigma == 0:
        return maps
    k = linear.blur_size(sigma)
    return each_map(maps, lambda p: linear.apply(linear.blur_matrix(p.shape[0], k, sigma, "mirror"), p, linear.blur_matrix(p.shape[1], k, sigma, "mirror")))


def smooth_map(maps: DataFrame, kernel: int, sigma: float = 0.0) -> DataFrame:
    """Smoothing of a normalised map with an odd kernel, edge values repeated."""
    if kernel % 2 == 0:
        raise InvalidArgument("the smoothing kernel must be odd")
    return each_map(maps, lambda p: linear.apply(linear.blur_matrix(p.shape[0], kernel, sigma, "repeat"), p, linear.blur_matrix(p.shape[1], kernel, sigma, "repeat")))


def anomaly_map(scores: DataFrame, h: int, w: int, out_h: int, out_w: int, sigma: float) -> DataFrame:
    """Patch scores (image_id, loc, v) as blurred maps of the output size."""
    return blur_map(resize_map(maps_from_pixels(scores, h, w), out_h, out_w), sigma)


def minmax_map(maps: DataFrame) -> DataFrame:
    """Every map scaled to 0..1 by its own range; a constant map becomes zeros."""
    lo, hi = F.array_min("values"), F.array_max("values")
    return maps.select("image_id", "h", "w", F.transform("values", lambda v: F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0)).alias("values"))


def blend_maps(a: DataFrame, b: DataFrame, weight_a: float, weight_b: float) -> DataFrame:
    """Weighted mean of two maps of each image."""
    if weight_a < 0 or weight_b < 0 or weight_a + weight_b <= 0:
        raise InvalidArgument("weights must not be negative nor both zero")
    total = weight_a + weight_b
    other = b.select("image_id", F.col("values").alias("other"))
    return a.join(other, "image_id").select("image_id", "h", "w", F.zip_with("values", "other", lambda x, y: (x * weight_a + y * weight_b) / total).alias("values"))


def map_score(maps: DataFrame) -> DataFrame:
    """(image_id, score): the largest value of each map."""
    return maps.select("image_id", F.array_max("values").alias("score"))


def morph(masks: DataFrame, kernel: int, iterations: int = 1, mode: str = "open") -> DataFrame:
    """Opening or closing of 0/255 masks."""
    if mode not in ("open", "close"):
        raise InvalidArgument("morphology is open or close")
    if kernel % 2 == 0:
        raise InvalidArgument("the morphology kernel must be odd")
    return each_map(masks, lambda p: planes.morphology(p, kernel, iterations, mode))


def label_map(masks: DataFrame) -> DataFrame:
    """Eight-neighbour components, numbered in raster order; 0 is background."""
    return each_map(masks, planes.label)
