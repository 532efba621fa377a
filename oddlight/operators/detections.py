"""Detections: candidate decoding, suppression for each image and class, and painting of boxes.

detection rows: image_id, anchor, cx, cy, w, h, class_scores array<double>. candidate rows: image_id, anchor, class_id,
score, x1, y1, x2, y2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import planes
from .maps import MAP

#: Maps that a worker holds at a time.
PLANE_BYTES = 4 << 20
CANDIDATE = "image_id long, anchor long, class_id int, score double, x1 double, y1 double, x2 double, y2 double"


def candidates(detections: DataFrame, confidence: float = 0.25) -> DataFrame:
    """Best class of each anchor (ties: the first), kept from the confidence up, corners instead of centres."""
    if not 0 <= confidence <= 1:
        raise InvalidArgument("the confidence must be in [0, 1]")
    best = F.array_max("class_scores")
    half = {"x": F.col("w") / 2, "y": F.col("h") / 2}
    return (
        detections.withColumn("score", best)
        .where(F.col("score") >= confidence)
        .select(
            "image_id",
            F.col("anchor").cast("long").alias("anchor"),
            (F.array_position("class_scores", F.col("score")) - 1).cast("int").alias("class_id"),
            "score",
            *[(F.col(f"c{a}") - half[a]).alias(f"{a}1") for a in "xy"],
            *[(F.col(f"c{a}") + half[a]).alias(f"{a}2") for a in "xy"],
        )
    )


def suppress(boxes: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Kept candidates: greedy by (score descending, anchor), a box goes if a kept one of its class overlaps it more.

    One shuffle by image brings a picture's boxes together, sorted; the kernel walks the groups as they stream by. A group
    is what a detector emits for one picture and class, so it is bounded by its anchors.
    """
    if not 0 <= threshold <= 1:
        raise InvalidArgument("the overlap threshold must be in [0, 1]")

    cols = ["image_id", "anchor", "class_id", "score", "x1", "y1", "x2", "y2"]
    near = boxes.select(*cols).repartition("image_id").sortWithinPartitions("image_id", "class_id", F.desc("score"), "anchor")

    def run(batches):
        held = None  # rows of the last group so far: it may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if t.num_rows:
                cut = _last_group(t)
                yield from _kept(t.slice(0, cut), threshold).to_batches()
                held = t.slice(cut)
        if held is not None:
            yield from _kept(held, threshold).to_batches()

    return near.mapInArrow(run, CANDIDATE)


def _groups(t: pa.Table) -> np.ndarray:
    image, kind = np.asarray(t["image_id"]), np.asarray(t["class_id"])
    return np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (kind[1:] != kind[:-1])]))


def _last_group(t: pa.Table) -> int:
    return int(_groups(t)[-1])


def _kept(t: pa.Table, threshold: float) -> pa.Table:
    """Greedy suppression in every group of consecutive rows."""
    if not t.num_rows:
        return t
    starts = _groups(t)
    ends = np.append(starts[1:], t.num_rows)
    corners = np.stack([np.asarray(t[c]) for c in ("x1", "y1", "x2", "y2")], axis=1)
    keep = np.ones(t.num_rows, bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            keep[a:b] = planes.suppress(corners[a:b], threshold)
    return t.filter(pa.array(keep))


def _planes(boxes: pa.Array, h: int, w: int):
    """(first row, highest scores, maps as rows) for a few pictures at a time, whose lists of boxes are given."""
    if isinstance(boxes, pa.ChunkedArray):
        boxes = boxes.combine_chunks()
    step = max(1, PLANE_BYTES // (8 * h * w))
    for at in range(0, len(boxes), step):
        part = boxes.slice(at, step)
        size = part.value_lengths().fill_null(0).to_numpy()
        flat = part.flatten()
        score, *corners = (np.asarray(flat.field(c), float) for c in ("score", "x1", "y1", "x2", "y2"))
        corners, ends = np.stack(corners, axis=1), np.cumsum(size)
        best, out = np.zeros(len(size)), np.zeros((len(size), h * w))
        for i in np.flatnonzero(size).tolist():
            mine = slice(ends[i] - size[i], ends[i])
            best[i] = score[mine].max()
            out[i] = planes.paint(corners[mine], score[mine], h, w).ravel()
        yield at, best, out


def _boxes(kept: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, boxes): the kept boxes of every row of images, null without any. The join is on image_id alone."""
    boxes = kept.groupBy("image_id").agg(F.collect_list(F.struct("score", "x1", "y1", "x2", "y2")).alias("boxes"))
    return images.select("image_id").join(boxes, "image_id", "left")


def painted(kept: DataFrame, images: DataFrame, h: int, w: int) -> DataFrame:
    """Score (the highest kept one, 0 without a box) and map for every row of images, made together.

    An overlapped pixel has the lowest score, an uncovered one 0. At most PLANE_BYTES of maps are held at a time.
    """

    def run(batches):
        for b in batches:
            for at, best, out in _planes(b.column(1), h, w):
                n = len(best)
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (h * w)), pa.array(out.ravel()))
                yield pa.record_batch([b.column(0).slice(at, n), pa.array(best), pa.array([h] * n, pa.int32()), pa.array([w] * n, pa.int32()), values], ["image_id", "score", "h", "w", "values"])

    return _boxes(kept, images).mapInArrow(run, f"image_id long, score double, {MAP.removeprefix('image_id long, ')}")


def paint(kept: DataFrame, images: DataFrame, h: int, w: int) -> DataFrame:
    """The maps of ``painted``."""
    return painted(kept, images, h, w).select("image_id", "h", "w", "values")


def paint_totals(kept: DataFrame, images: DataFrame, h: int, w: int) -> DataFrame:
    """(image_id, score, painted, total): pixels above 0 and sum of each map of ``painted``; maps stay in the workers."""

    def run(batches):
        for b in batches:
            for at, best, out in _planes(b.column(1), h, w):
                yield pa.record_batch([b.column(0).slice(at, len(best)), pa.array(best), pa.array((out > 0).sum(axis=1)), pa.array(out.sum(axis=1))], ["image_id", "score", "painted", "total"])

    return _boxes(kept, images).mapInArrow(run, "image_id long, score double, painted long, total double")


def image_scores(kept: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, score): the highest kept score, 0 without a box."""
    best = kept.groupBy("image_id").agg(F.max("score").alias("score"))
    return images.select("image_id").join(best, "image_id", "left").select("image_id", F.coalesce("score", F.lit(0.0)).alias("score"))
