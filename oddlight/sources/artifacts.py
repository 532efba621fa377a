"""Model artifacts as Parquet tables: banks, galleries, statistics, fit checkpoints. Readers check what they read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactCorrupt
from ..operators.stats import Pca
from ..plans.algorithms import validate_gauss

_PCA = "mode string, mean array<double>, basis array<array<double>>, scales array<double>"
_DENSITY = "mean array<float>, basis array<array<float>>, gallery array<array<float>>"


def save_bank(bank: DataFrame, path: str) -> None:
    """bank_id and single-precision vectors, in id order within files."""
    bank.select("bank_id", F.col("feat").cast("array<float>").alias("feat")).sortWithinPartitions("bank_id").write.mode("errorifexists").parquet(path)


def load_bank(spark: SparkSession, path: str, dimension: int, least: int = 1) -> DataFrame:
    """The bank, if all vectors have the dimension, are finite, and are at least so many."""
    bank = spark.read.schema("bank_id long, feat array<float>").parquet(path)
    bad = F.col("feat").isNull() | (F.size("feat") != dimension) | F.exists("feat", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    n, wrong, ids = bank.agg(F.count(F.lit(1)), F.sum(bad.cast("int")), F.count_distinct("bank_id")).first()
    if wrong or n < least or ids != n:
        raise ArtifactCorrupt(f"bank {path}: {n} rows, {wrong or 0} malformed, {n - ids} repeated ids")
    return bank


def save_layers(layers: dict[str, DataFrame], path: str) -> None:
    """One gallery for each layer, partitioned by layer."""
    out = None
    for name, bank in layers.items():
        one = bank.select(F.lit(name).alias("layer"), "bank_id", F.col("feat").cast("array<float>").alias("feat"))
        out = one if out is None else out.unionByName(one)
    out.write.partitionBy("layer").parquet(path)


def load_layers(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    all_ = spark.read.parquet(path)
    found = {r["layer"] for r in all_.select("layer").distinct().collect()}
    if set(names) != found:
        raise ArtifactCorrupt(f"galleries hold {sorted(found)}, not {sorted(names)}")
    return {n: all_.where(F.col("layer") == n).select("bank_id", "feat") for n in names}


def save_pca(spark: SparkSession, pca: Pca, mode: str, path: str) -> None:
    spark.createDataFrame([(mode, pca.mean.tolist(), pca.basis.tolist(), pca.scales.tolist())], _PCA).coalesce(1).write.parquet(path)


def load_pca(spark: SparkSession, path: str, mode: str, dimension: int) -> Pca:
    rows = spark.read.schema(_PCA).parquet(path).limit(2).collect()
    if len(rows) != 1 or rows[0]["mode"] != mode or len(rows[0]["mean"]) != dimension:
        raise ArtifactCorrupt(f"statistics {path} are not one {mode} row of dimension {dimension}")
    r = rows[0]
    return Pca(np.array(r["mean"]), np.array(r["basis"]), np.array(r["scales"])).validate()


def save_gauss(gauss: DataFrame, channels: list[int], path: str) -> None:
    gauss.select("loc", "mean", "precision", F.array(*map(F.lit, channels)).alias("channels")).write.parquet(path)


def load_gauss(spark: SparkSession, path: str, locations: int, dimension: int) -> tuple[DataFrame, list[int]]:
    out = spark.read.schema("loc int, mean array<float>, precision array<float>, channels array<int>").parquet(path)
    n, widths, lists = out.agg(F.count_distinct("loc"), F.collect_set(F.size("mean")), F.collect_set("channels")).first()
    if n != locations or widths != [dimension] or len(lists) != 1 or len(set(lists[0])) != dimension:
        raise ArtifactCorrupt(f"statistics {path} do not fit {locations} locations of dimension {dimension}")
    gauss = out.drop("channels")
    validate_gauss(gauss)
    return gauss, list(lists[0])


def save_density(spark: SparkSession, pca: Pca, gallery: np.ndarray, path: str) -> None:
    spark.createDataFrame([(pca.mean.tolist(), pca.basis.tolist(), gallery.tolist())], _DENSITY).coalesce(1).write.parquet(path)


def load_density(spark: SparkSession, path: str) -> tuple[Pca, np.ndarray]:
    r = spark.read.schema(_DENSITY).parquet(path).first()
    mean, basis, gallery = (np.array(r[c], np.float32) for c in ("mean", "basis", "gallery"))
    if basis.ndim != 2 or basis.shape[1] != len(mean) or gallery.ndim != 2 or gallery.shape[1] != len(basis) or not all(np.isfinite(a).all() for a in (mean, basis, gallery)):
        raise ArtifactCorrupt(f"density statistics {path} are malformed")
    return Pca(mean, basis, np.ones(len(basis))), gallery


def save_range(ranges: DataFrame, path: str) -> None:
    ranges.coalesce(1).write.parquet(path)
