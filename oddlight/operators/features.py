"""Feature tensors and patches.

tensor rows: image_id, name, c, h, w, data array<double> (planes one after the other); one row for each image and layer,
so plane operators are maps over rows and never shuffle. patch rows: image_id, loc, y, x, feat array<double>.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import linear
from ..functions.vectors import pick, squared_distance, squared_norm

TENSOR = "image_id long, name string, c int, h int, w int, data array<double>"


def tensors_from_patches(patches: DataFrame, h: int, w: int, name: str, first: int = 0, channels: int | None = None, step: int = 1) -> DataFrame:
    """One tensor for each image from its patches; channels picks a run of elements, step subsamples the grid."""
    if step > 1:
        patches = patches.where((F.col("y") % step == 0) & (F.col("x") % step == 0))
    feat = F.slice("feat", first + 1, channels) if channels else F.col("feat")
    one = patches.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("loc", feat.alias("f")))).alias("p"))  # h * w entries
    planes = F.flatten(F.transform(F.sequence(F.lit(0), F.size(F.col("p")[0]["f"]) - 1), lambda c: F.transform("p", lambda q: F.get(q["f"], c))))
    return one.select("image_id", F.lit(name).alias("name"), F.size(F.col("p")[0]["f"]).alias("c"), F.lit(h).alias("h"), F.lit(w).alias("w"), planes.alias("data"))


def to_patches(tensors: DataFrame) -> DataFrame:
    """Patch-major rows: one for each location, its channels in order."""
    size = F.col("h") * F.col("w")
    loc = F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda ch: F.get("data", ch * size + i))))
    return tensors.select("image_id", "w", loc.alias("loc", "feat")).select("image_id", "loc", F.expr("loc div w").cast("int").alias("y"), F.expr("loc % w").alias("x"), "feat")


def map_planes(tensors: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel over each tensor as an array (c, h, w); a map over rows."""

    def run(batches):
        for b in batches:
            c, h, w = (b.column(b.schema.get_field_index(x)).to_pylist() for x in "chw")
            out = [kernel(np.asarray(d.values, float).reshape(i, j, k)) for d, i, j, k in zip(b.column(b.schema.get_field_index("data")), c, h, w, strict=True)]
            shapes = [pa.array([x.shape[i] for x in out], pa.int32()) for i in range(3)]
            data = pa.array([x.ravel() for x in out], pa.list_(pa.float64()))
            yield pa.record_batch([b.column(0), b.column(1), *shapes, data], ["image_id", "name", "c", "h", "w", "data"])

    return tensors.select("image_id", "name", "c", "h", "w", "data").mapInArrow(run, TENSOR)


def avg_pool(tensors: DataFrame, kernel: int, stride: int, padding: int) -> DataFrame:
    """Average pooling with zero padding; the divisor is always kernel * kernel."""
    if kernel < 1 or stride < 1 or padding < 0:
        raise InvalidArgument("pooling needs a positive kernel and stride and a padding of 0 or more")

    def pool(x: np.ndarray) -> np.ndarray:
        return linear.apply(linear.pool_matrix(x.shape[1], kernel, stride, padding), x, linear.pool_matrix(x.shape[2], kernel, stride, padding))

    return map_planes(tensors, pool)


def resize(tensors: DataFrame, h: int, w: int) -> DataFrame:
    """Bilinear resize, half-pixel centres."""
    return map_planes(tensors, lambda x: linear.apply(linear.resize_matrix(h, x.shape[1]), x, linear.resize_matrix(w, x.shape[2])))


def _joined(tensors: list[DataFrame]) -> tuple[DataFrame, list[Column]]:
    out = tensors[0].select("image_id", "c", "h", "w", F.col("data").alias("d0"))
    for i, t in enumerate(tensors[1:], 1):
        out = out.join(t.select("image_id", F.col("c").alias(f"c{i}"), F.col("h").alias(f"h{i}"), F.col("w").alias(f"w{i}"), F.col("data").alias(f"d{i}")), "image_id")
        same = (F.col("h") == F.col(f"h{i}")) & (F.col("w") == F.col(f"w{i}"))
        out = out.withColumn(f"d{i}", F.when(same, F.col(f"d{i}")).otherwise(F.raise_error(F.lit("TensorShapeMismatch: layers differ in size"))))
    return out, [F.col(f"d{i}") for i in range(len(tensors))]


def concat_layers(tensors: list[DataFrame], name: str = "concat") -> DataFrame:
    """Channels of several layers, in the order given; an equi-join on image_id."""
    out, data = _joined(tensors)
    channels = functools.reduce(lambda a, b: a + b, [F.col("c"), *[F.col(f"c{i}") for i in range(1, len(tensors))]])
    return out.select("image_id", F.lit(name).alias("name"), channels.cast("int").alias("c"), "h", "w", F.concat(*data).alias("data"))


def mean_layers(tensors: list[DataFrame], name: str = "mean") -> DataFrame:
    """Element-wise mean of layers of equal shape."""
    out, data = _joined(tensors)
    added = functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), data)
    return out.select("image_id", F.lit(name).alias("name"), "c", "h", "w", F.transform(added, lambda x: x / len(tensors)).alias("data"))


def select_channels(patches: DataFrame, indices: list[int]) -> DataFrame:
    """Elements of each patch by index, order kept; indices must be unique."""
    if len(set(indices)) != len(indices) or min(indices, default=0) < 0:
        raise InvalidArgument("channel indices must be unique and not negative")
    return patches.withColumn("feat", pick(F.col("feat"), indices))


def bind(tensors: DataFrame, outputs: dict[str, str]) -> DataFrame:
    """Rename tensors to their semantic names; names are never guessed, and others are dropped."""
    back = F.create_map(*[x for k, v in outputs.items() for x in (F.lit(v), F.lit(k))])
    return tensors.withColumn("name", back[F.col("name")]).where(F.col("name").isNotNull())


def channel_l2(patches: DataFrame) -> DataFrame:
    return patches.select("image_id", "loc", "y", "x", F.sqrt(squared_norm(F.col("feat"))).alias("v"))


def channel_l2_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """L2 distance of the two patches of one location."""
    other = right.select("image_id", "loc", F.col("feat").alias("feat2"))
    return left.join(other, ["image_id", "loc"]).select("image_id", "loc", "y", "x", F.sqrt(squared_distance(F.col("feat"), F.col("feat2"))).alias("v"))


def pass_or_l2(patches: DataFrame) -> DataFrame:
    """A single channel as it is, sign kept; several by their L2 norm."""
    v = F.when(F.size("feat") == 1, F.col("feat")[0]).otherwise(F.sqrt(squared_norm(F.col("feat"))))
    return patches.select("image_id", "loc", "y", "x", v.alias("v"))


def finite(df: DataFrame, column: str) -> DataFrame:
    """Raises on a value that is not finite."""
    bad = F.isnan(column) | (F.abs(F.col(column)) == float("inf"))
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit(f"AdapterFailure: {column} is not finite"))).otherwise(F.col(column)))
