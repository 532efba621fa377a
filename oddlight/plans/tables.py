"""Engine tables derived from the driver's tables, by fixed integer formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 4 x 4 grids of 64 channels, 16 rows for each image; an incomplete last image is left out."""
    e = read(spark, sf_dir, "embeddings")
    n = e.count() // 16 * 16
    i = F.col("vec_id")
    return e.where(i < n).select(F.expr("vec_id div 16").alias("image_id"), (i % 16).cast("int").alias("loc"), F.expr("(vec_id % 16) div 4").cast("int").alias("y"), (i % 4).cast("int").alias("x"), F.col("embedding").cast("array<double>").alias("feat"))


def normal(p: DataFrame) -> DataFrame:
    return p.where(F.col("image_id") % 4 != 3)


def test(p: DataFrame) -> DataFrame:
    return p.where(F.col("image_id") % 4 == 3)


def part(p: DataFrame, first: int, count: int) -> DataFrame:
    """A run of channels."""
    return p.withColumn("feat", F.slice("feat", first + 1, count))


def bank_rows(p: DataFrame, size: int = 16) -> DataFrame:
    return p.select((F.col("image_id") * size + F.col("loc")).alias("bank_id"), "feat")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples: seven locations, four features; rows are not unique and need no key."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") - 1).cast("int").alias("loc"), F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("feat"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as detections of one picture for each order; the anchor numbers an order's rows by a total order."""
    from pyspark.sql import Window

    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_tax"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    side = F.col("l_quantity") / 2 + 1
    scores = F.array(*[F.when(F.col("l_linenumber") % 2 == c, F.col("l_tax") * 10).otherwise(0.0) for c in (0, 1)])
    return li.select(F.col("l_orderkey").alias("image_id"), F.row_number().over(order).cast("long").alias("anchor"), (F.col("l_partkey") % 48 + 8).cast("double").alias("cx"), (F.col("l_suppkey") % 48 + 8).cast("double").alias("cy"), side.alias("w"), side.alias("h"), scores.alias("class_scores"))


def grids(spark: SparkSession, sf_dir: str, size: int = 12) -> DataFrame:
    """Maps by formula, one for each supplier: v(y, x) = ((id * 7 + y * y * 3 + x * x * 5 + x * y * 2) % 101) / 100."""
    k = F.col("s_suppkey").cast("long")
    cell = F.sequence(F.lit(0), F.lit(size * size - 1))
    v = F.transform(cell, lambda i: ((k * 7 + F.floor(i / size) * F.floor(i / size) * 3 + (i % size) * (i % size) * 5 + (i % size) * F.floor(i / size) * 2) % 101) / F.lit(100.0))
    return read(spark, sf_dir, "supplier").select(k.alias("image_id"), F.lit(size).alias("h"), F.lit(size).alias("w"), v.alias("values"))
