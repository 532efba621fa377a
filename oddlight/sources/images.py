"""Images: decoding of raw pixel rows and preprocessing into tensors, one row for each image, without a shuffle."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidImage
from ..functions import linear
from ..operators.features import TENSOR
from .manifest import Input

#: Channels by pixel format.
CHANNELS = {"GRAY8": 1, "BGR8": 3, "RGB8": 3, "BGRA8": 4, "RGBA8": 4}
_MATRIX = {"linear": linear.resize_matrix, "nearest": linear.nearest_matrix, "area": linear.area_matrix, "cubic": linear.cubic_matrix}


def decode(data: bytes, width: int, height: int, stride: int, format_: str) -> np.ndarray:
    """Pixels as (h, w, 3) in blue-green-red order; stride 0 means packed rows."""
    if format_ not in CHANNELS:
        raise InvalidImage(f"unknown pixel format {format_}")
    if width <= 0 or height <= 0 or not data:
        raise InvalidImage("an image needs a size and data")
    row = width * CHANNELS[format_]
    stride = stride or row
    if stride < row or len(data) < stride * (height - 1) + row:
        raise InvalidImage("stride or data too small")
    flat = np.frombuffer(data, np.uint8)
    lines = np.stack([flat[y * stride : y * stride + row] for y in range(height)]).reshape(height, width, -1)
    if format_ == "GRAY8":
        return np.repeat(lines, 3, axis=2)
    return lines[:, :, :3] if format_[0] == "B" else lines[:, :, 2::-1]


def preprocess_one(image: np.ndarray, cfg: Input) -> np.ndarray:
    """(3, h, w): resize, centre crop, 1/255, (x - mean) / std, in the colour order asked for."""
    h, w = cfg.resize
    make = _MATRIX[cfg.interpolation]
    planes = np.moveaxis(image.astype(float), 2, 0)
    out = linear.apply(make(h, planes.shape[1]), planes, make(w, planes.shape[2]))
    out = np.clip(np.floor(out + 0.5), 0, 255)  # eight bits after the resize
    if cfg.crop:
        y, x = (h - cfg.crop[0]) // 2, (w - cfg.crop[1]) // 2
        out = out[:, y : y + cfg.crop[0], x : x + cfg.crop[1]]
    if cfg.color == "RGB":
        out = out[::-1]
    return (out / 255 - np.array(cfg.mean)[:, None, None]) / np.array(cfg.std)[:, None, None]


def geometry(images: DataFrame, cfg: Input) -> DataFrame:
    """The geometry row of each image; the crop is centred."""
    from pyspark.sql import functions as F

    h, w = cfg.resize
    ch, cw = cfg.crop or cfg.resize
    return images.select("image_id", F.col("width").cast("int").alias("original_w"), F.col("height").cast("int").alias("original_h"), *[F.lit(v).alias(k) for k, v in (("resized_w", w), ("resized_h", h), ("crop_x", (w - cw) // 2), ("crop_y", (h - ch) // 2), ("crop_w", cw), ("crop_h", ch))])


def preprocess(images: DataFrame, cfg: Input, timer=None) -> DataFrame:
    """Tensor rows from image rows (image_id, width, height, stride, format, data); NHWC data is pixel-major.

    timer is an accumulator of milliseconds spent in the kernel.
    """

    def run(batches):
        for b in batches:
            began = time.perf_counter()
            ids, width, height, stride, kind, data = (b.column(i).to_pylist() for i in range(6))
            out = [preprocess_one(decode(d, w, h, s or 0, f), cfg) for d, w, h, s, f in zip(data, width, height, stride, kind, strict=True)]
            n = len(ids)
            flat = [(np.moveaxis(x, 0, 2) if cfg.layout == "NHWC" else x).ravel() for x in out]
            shape = [pa.array([x.shape[i] for x in out], pa.int32()) for i in range(3)]
            if timer is not None:
                timer.add(1000 * (time.perf_counter() - began))
            yield pa.record_batch([b.column(0), pa.array([cfg.tensor] * n), *shape, pa.array(flat, pa.list_(pa.float64()))], ["image_id", "name", "c", "h", "w", "data"])

    return images.select("image_id", "width", "height", "stride", "format", "data").mapInArrow(run, TENSOR)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw files (path, content) through Spark's own reader, so from any store that Spark reaches."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
