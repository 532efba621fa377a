"""Calibration: ranges and thresholds from raw scores of normal images."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument, NotInitialized
from ..functions.vectors import float32

FPR, MAX_PIXELS, SEED = 0.01, 1_000_000, 42
#: Rows that a top-k may gather in one task.
TOP = 65_536


def widened(low: float, high: float) -> tuple[float, float]:
    """A range that is not empty: a degenerate one grows by max(1e-6, |low| * 1e-6) on either side."""
    if high > low:
        return low, high
    d = max(1e-6, abs(low) * 1e-6)
    return low - d, high + d


def quantile_index(n: int, fpr: float) -> int:
    """floor((1 - fpr) * (n - 1)), the rate in single precision."""
    if not 0 < fpr < 1:
        raise InvalidArgument("the false-positive rate must be in (0, 1)")
    return math.floor((1 - float32(fpr)) * (n - 1))


def select_ranks(df: DataFrame, by: list[str], value: str, rank: Callable[[Column], Column], bins: int = 4096) -> DataFrame:
    """(by, n, lo, hi, chosen): for each group its count, range, and the value of the given rank (from 0), exactly.

    The range of a group is cut into bins, their counts are summed before the shuffle, and the bin that holds the rank
    becomes the next range, until one value is left. Nothing is sorted, a hot group costs its bins, and each pass reads
    the data once; two to four passes do. One row for each group is held on the driver between passes.
    """
    if not by:
        return select_ranks(df.withColumn("_all", F.lit(0)), ["_all"], value, rank, bins).drop("_all")
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    first = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = first.withColumn("at", rank(F.col("n")).cast("long")).withColumn("a", F.col("lo")).withColumn("b", F.col("hi")).where("n > 0")
    schema = state.schema
    held = state.collect()
    while any(r["a"] < r["b"] for r in held):
        todo = F.broadcast(spark.createDataFrame([r for r in held if r["a"] < r["b"]], schema))
        x = rows.join(todo, by).where("v BETWEEN a AND b")
        x = x.withColumn("bin", F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)))
        counts = x.groupBy(*by, "n", "lo", "hi", "at", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy(*by).orderBy("bin"))
        found = counts.withColumn("upto", upto).where("upto > at AND upto - c <= at").withColumn("at", F.expr("at - (upto - c)"))
        held = [r for r in held if not r["a"] < r["b"]] + found.select(*schema.names).collect()
    return spark.createDataFrame(held, schema).select(*by, "n", "lo", "hi", F.col("a").alias("chosen"))


def ordered_value(df: DataFrame, value: Column, index: int) -> float:
    """The index-th smallest value that is not null."""
    row = select_ranks(df.select(value.alias("v")), [], "v", lambda n: F.least(F.lit(index), n - 1)).first()
    if row is None or index >= row["n"]:
        raise NotInitialized("no scores to calibrate on")
    return row["chosen"]


def least_hashed(df: DataFrame, keys: list[str], k: int, seed: int) -> DataFrame:
    """The k rows of least seeded hash of their keys (ties by key): the same on any partitioning.

    Up to TOP rows are taken by one top-k. Beyond, the k-th hash is found by rank selection and a filter takes the rows
    below it, so no task ever holds k rows; only rows that share the first 53 bits of that hash are ordered.
    """
    h = F.xxhash64(*keys, F.lit(seed))
    if k <= TOP:
        return df.orderBy(h, *keys).limit(k)
    head = F.shiftright(h, 11).cast("double")  # exact, and in the order of the hashes
    cut = select_ranks(df.select(head.alias("v")), [], "v", lambda n: F.least(F.lit(k), n) - 1).first()
    if cut is None:
        return df
    below = df.where(head < cut["chosen"])
    return below.unionByName(df.where(head == cut["chosen"]).orderBy(h, *keys).limit(k - below.count()))


def sampled_pixels(pixels: DataFrame, keys: list[str], cap: int = MAX_PIXELS, seed: int = SEED) -> DataFrame:
    """All pixels up to the cap; beyond, the cap rows of least seeded hash (deterministic, any partitioning)."""
    return pixels if pixels.count() <= cap else least_hashed(pixels, keys, cap, seed)


def _rank(fpr: float) -> Callable[[Column], Column]:
    if not 0 < fpr < 1:
        raise InvalidArgument("the false-positive rate must be in (0, 1)")
    return lambda n: F.floor(F.lit(1 - float32(fpr)) * (n - 1))


def _range(df: DataFrame, value: str, fpr: float) -> tuple[int, float, float, float]:
    r = select_ranks(df, [], value, _rank(fpr)).first()
    if r is None:
        raise NotInitialized("no scores to calibrate on")
    return r["n"], *widened(r["lo"], r["hi"]), r["chosen"]


def calibrate(raw: DataFrame, fpr: float = FPR, max_pixels: int = MAX_PIXELS, seed: int = SEED) -> Row:
    """One row: sample_count, image_min/max/threshold, pixel_min/max/threshold, has_pixel_statistics.

    raw rows: image_id, score, values (null: no map). Without any map the pixel range is 0, 1 and the threshold 0.5.
    """
    n, low, high, threshold = _range(raw, "score", fpr)
    pixels = raw.where("values is not null").select("image_id", F.posexplode("values").alias("i", "v"))
    has = pixels.limit(1).count() > 0
    pixel = (0.0, 1.0, 0.5)
    if has:
        pixel = _range(sampled_pixels(pixels, ["image_id", "i"], max_pixels, seed), "v", fpr)[1:]
    return Row(sample_count=n, image_min=low, image_max=high, image_threshold=threshold, pixel_min=pixel[0], pixel_max=pixel[1], pixel_threshold=pixel[2], has_pixel_statistics=has)


def calibrate_groups(df: DataFrame, by: list[str], value: str, fpr: float = FPR) -> DataFrame:
    """(by, n, low, high, threshold) for each group."""
    out = select_ranks(df, by, value, _rank(fpr))
    d = F.greatest(F.lit(1e-6), F.abs("lo") * 1e-6)
    flat = F.col("hi") <= F.col("lo")
    return out.select(*by, "n", F.when(flat, F.col("lo") - d).otherwise(F.col("lo")).alias("low"), F.when(flat, F.col("hi") + d).otherwise(F.col("hi")).alias("high"), F.col("chosen").alias("threshold"))
