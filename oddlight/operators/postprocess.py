"""From raw scores and maps to decisions, masks and regions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import linear, planes
from ..functions.vectors import clamp01
from .maps import morph, smooth_map

REGION = "struct<x:int,y:int,width:int,height:int,max_x:int,max_y:int,area:double,mean_score:double,max_score:double>"


@dataclass(frozen=True)
class Config:
    normalize: bool = True
    threshold: bool = True
    image_threshold: float = 0.5
    pixel_threshold: float = 0.5
    image_min: float = 0.0
    image_max: float = 1.0
    pixel_min: float = 0.0
    pixel_max: float = 1.0
    image_sensitivity: float = 0.5
    pixel_sensitivity: float = 0.5
    smooth: bool = False
    smooth_kernel: int = 3
    smooth_sigma: float = 0.0
    morphology: bool = False
    morphology_kernel: int = 5
    morphology_iterations: int = 1
    morphology_mode: str = "open"
    analyze: bool = False
    min_region_area: int = 16
    max_regions: int = 0

    def validate(self) -> "Config":
        if self.smooth_kernel % 2 == 0 or self.morphology_kernel % 2 == 0:
            raise InvalidArgument("kernels must be odd")
        if not (0 <= self.image_sensitivity <= 1 and 0 <= self.pixel_sensitivity <= 1):
            raise InvalidArgument("sensitivities must be in [0, 1]")
        if self.normalize and not (self.image_max > self.image_min and self.pixel_max > self.pixel_min):
            raise InvalidArgument("ranges must not be empty")
        return self

    @property
    def image_decision(self) -> float:
        return 1 - self.image_sensitivity if self.normalize else self.image_threshold

    @property
    def pixel_decision(self) -> float:
        return 1 - self.pixel_sensitivity if self.normalize else self.pixel_threshold


def normalize(value: Column, threshold: float, low: float, high: float) -> Column:
    """clamp((v - threshold) / (max - min) + 0.5) to 0..1: the threshold becomes the middle."""
    return clamp01((value - threshold) / (high - low) + 0.5)


def normalize_map(maps: DataFrame, threshold: float, low: float, high: float) -> DataFrame:
    return maps.select("image_id", "h", "w", F.transform("values", lambda v: normalize(v, threshold, low, high)).alias("values"))


def threshold_mask(maps: DataFrame, decision: float) -> DataFrame:
    """255 from the decision up, else 0."""
    return maps.select("image_id", "h", "w", F.transform("values", lambda v: F.when(v >= decision, 255.0).otherwise(0.0)).alias("values"))


def restore_geometry(maps: DataFrame, geometry: DataFrame) -> DataFrame:
    """Map to crop size, pasted into a zero canvas of the resized size, resized to the original."""
    cols = ["original_w", "original_h", "resized_w", "resized_h", "crop_x", "crop_y", "crop_w", "crop_h"]
    joined = maps.select("image_id", "h", "w", "values").join(geometry.select("image_id", *cols), "image_id").select("image_id", "h", "w", "values", *cols)

    def run(batches):
        for b in batches:
            h, w = b.column(1).to_pylist(), b.column(2).to_pylist()
            out, heights, widths = [], [], []
            for i, v in enumerate(b.column(3)):
                ow, oh, rw, rh, cx, cy, cw, ch = (b.column(4 + j)[i].as_py() for j in range(8))
                heights.append(oh)
                widths.append(ow)
                if not v.is_valid:
                    out.append(None)
                    continue
                plane = np.asarray(v.values, float).reshape(h[i], w[i])
                canvas = np.zeros((rh, rw))
                canvas[cy : cy + ch, cx : cx + cw] = linear.apply(linear.resize_matrix(ch, h[i]), plane, linear.resize_matrix(cw, w[i]))
                out.append(linear.apply(linear.resize_matrix(oh, rh), canvas, linear.resize_matrix(ow, rw)).ravel())
            yield pa.record_batch([b.column(0), pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["image_id", "h", "w", "values"])

    return joined.mapInArrow(run, "image_id long, h int, w int, values array<double>")


def regions(maps: DataFrame, masks: DataFrame, min_area: int = 16, max_regions: int = 0) -> DataFrame:
    """(image_id, area_ratio, region_count, mean_score, max_score, has_map, regions).

    The ratio counts all masked pixels; regions are filtered by area, sorted by area and cut before they are counted,
    and mean_score is the unweighted mean of the regions' means. An image without a map has none.
    """
    joined = maps.select("image_id", "h", "w", "values").join(masks.select("image_id", F.col("values").alias("mask")), "image_id", "left").select("image_id", "h", "w", "values", "mask")

    def run(batches):
        for b in batches:
            rows = []
            for i, (v, m) in enumerate(zip(b.column(3), b.column(4), strict=True)):
                if not v.is_valid or not m.is_valid:
                    rows.append((0.0, 0, 0.0, 0.0, False, []))
                    continue
                h, w = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                ratio, found = planes.regions(np.asarray(v.values, float).reshape(h, w), np.asarray(m.values, float).reshape(h, w), min_area, max_regions)
                for r in found:
                    del r["first"]
                mean = float(np.mean([r["mean_score"] for r in found])) if found else 0.0
                rows.append((ratio, len(found), mean, max((r["max_score"] for r in found), default=0.0), True, found))
            kinds = [pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.struct([*[(c, pa.int32()) for c in ("x", "y", "width", "height", "max_x", "max_y")], *[(c, pa.float64()) for c in ("area", "mean_score", "max_score")]]))]
            cols = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["image_id", "area_ratio", "region_count", "mean_score", "max_score", "has_map", "regions"])

    return joined.mapInArrow(run, f"image_id long, area_ratio double, region_count int, mean_score double, max_score double, has_map boolean, regions array<{REGION}>")


def postprocess(raw: DataFrame, geometry: DataFrame | None, cfg: Config) -> DataFrame:
    """Predictions from raw rows (image_id, score, h, w, values; null values: no spatial output)."""
    cfg.validate()
    maps = raw.select("image_id", "h", "w", "values")
    if geometry is not None:
        maps = restore_geometry(maps, geometry)
    if cfg.normalize:
        maps = normalize_map(maps, cfg.pixel_threshold, cfg.pixel_min, cfg.pixel_max)
        if cfg.smooth:
            maps = smooth_map(maps, cfg.smooth_kernel, cfg.smooth_sigma)
    score = normalize(F.col("raw_score"), cfg.image_threshold, cfg.image_min, cfg.image_max) if cfg.normalize else F.col("raw_score")
    decided = (F.col("score") >= cfg.image_decision) if cfg.threshold else F.lit(False)
    images = raw.select("image_id", F.col("score").cast("double").alias("raw_score")).withColumn("score", score).withColumn("is_anomalous", decided)
    out = images.join(maps.withColumnRenamed("values", "anomaly_map"), "image_id", "left")
    if not cfg.threshold:
        return out
    masks = threshold_mask(maps, cfg.pixel_decision)
    if cfg.morphology:
        masks = morph(masks, cfg.morphology_kernel, cfg.morphology_iterations, cfg.morphology_mode)
    out = out.join(masks.select("image_id", F.transform("values", lambda v: v.cast("int")).alias("mask")), "image_id", "left")
    if not cfg.analyze:
        return out
    return out.join(regions(maps, masks, cfg.min_region_area, cfg.max_regions), "image_id", "left")


def region_rows(predictions: DataFrame) -> DataFrame:
    """The flattened regions of predictions, one row each."""
    return predictions.select("image_id", F.inline("regions"))
