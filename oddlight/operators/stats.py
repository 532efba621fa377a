"""Statistics of normal features: mergeable moments, precisions, principal components, whitening, residuals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArtifactCorrupt, InvalidArgument, NotInitialized
from ..functions.vectors import float32
from .knn import matrix


def location_moments(patches: DataFrame, dimension: int) -> DataFrame:
    """Per location: n, sums (D) and products (upper triangle of the sum of outer products).

    Built-in partial aggregation: what moves is one row for each location and task, however many samples there are.
    """
    f = [F.col("feat")[i] for i in range(dimension)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(f)]
    products = [F.sum(f[i] * f[j]).alias(f"p{i}_{j}") for i in range(dimension) for j in range(i, dimension)]
    one = patches.groupBy("loc").agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    names = [f"p{i}_{j}" for i in range(dimension) for j in range(i, dimension)]
    return one.select("loc", "n", F.array(*[f"s{i}" for i in range(dimension)]).alias("sums"), F.array(*names).alias("products"))


def merge_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Moments of the union of two sample sets; counts and sums add up."""

    def add(x: str) -> Column:
        return F.when(F.col(x).isNull(), F.col(f"{x}2")).when(F.col(f"{x}2").isNull(), F.col(x)).otherwise(F.zip_with(x, f"{x}2", lambda u, v: u + v))

    other = b.select("loc", F.col("n").alias("n2"), F.col("sums").alias("sums2"), F.col("products").alias("products2"))
    return a.join(other, "loc", "full").select("loc", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), add("sums").alias("sums"), add("products").alias("products"))


def wide_moments(patches: DataFrame, dimension: int) -> DataFrame:
    """location_moments for wide features: a kernel sums outer products of its batches, Spark adds the partial sums."""
    upper = np.triu_indices(dimension)

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            loc, x = np.asarray(b.column(0)), matrix(b.column(1))
            for key in np.unique(loc).tolist():
                mine = x[loc == key]
                old = held.setdefault(key, [0, np.zeros(dimension), np.zeros(len(upper[0]))])
                old[0] += len(mine)
                old[1] += mine.sum(axis=0)
                old[2] += (mine.T @ mine)[upper]
        rows = list(held.items())
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.list_(pa.float64())), pa.array([v[2] for _, v in rows], pa.list_(pa.float64()))], ["loc", "n", "sums", "products"])

    parts = patches.select(F.col("loc").cast("int").alias("loc"), F.col("feat").cast("array<double>").alias("feat")).mapInArrow(run, "loc int, n long, sums array<double>, products array<double>")

    def add(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"loc": [t["loc"].iloc[0]], "n": [t["n"].sum()], "sums": [np.sum(t["sums"].tolist(), axis=0)], "products": [np.sum(t["products"].tolist(), axis=0)]})

    return parts.groupBy("loc").applyInPandas(add, "loc int, n long, sums array<double>, products array<double>")


def gaussians(moments: DataFrame, regularisation: float = 0.01) -> DataFrame:
    """(loc, n, mean, covariance, precision): population covariance plus regularisation * I, inverted by Cholesky.

    Mean and precision are stored in single precision. A covariance that is not positive definite raises.
    """
    if not regularisation > 0:
        raise InvalidArgument("the covariance regularisation must be positive")

    def run(batches):
        for b in batches:
            mean, cov, prec = [], [], []
            for n, s, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                d = len(s)
                c = np.zeros((d, d))
                c[np.triu_indices(d)] = p
                c = c + np.triu(c, 1).T
                m = np.array(s) / n
                c = c / n - np.outer(m, m) + regularisation * np.eye(d)
                try:
                    low = np.linalg.inv(np.linalg.cholesky(c))
                except np.linalg.LinAlgError as e:
                    raise ArtifactCorrupt("a covariance is not positive definite") from e
                mean.append(m.astype(np.float32))
                cov.append(c.ravel())
                prec.append((low.T @ low).astype(np.float32).ravel())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(mean, pa.list_(pa.float32())), pa.array(cov, pa.list_(pa.float64())), pa.array(prec, pa.list_(pa.float32()))], ["loc", "n", "mean", "covariance", "precision"])

    return moments.select(F.col("loc").cast("int").alias("loc"), "n", "sums", "products").mapInArrow(run, "loc int, n long, mean array<float>, covariance array<double>, precision array<float>")


def mahalanobis(patches: DataFrame, gauss: DataFrame, keys: list[str], strategy: str = "expr") -> DataFrame:
    """(keys, v): distance of each patch to its location's Gaussian; a quadratic form below -1e-4 raises.

    ``expr`` stays in generated code and suits small dimensions; ``kernel`` handles wide features in Arrow batches.
    """
    stats = gauss.select("loc", "mean", "precision")
    rows = patches.select(*keys, *([] if "loc" in keys else ["loc"]), "feat").join(stats, "loc")
    if strategy == "expr":
        diff = F.zip_with("feat", "mean", lambda x, m: x.cast("float") - m)
        d = F.size("mean")
        wide = F.transform(diff, lambda x: x.cast("double"))
        row = F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.get("diff", i) * F.aggregate(F.zip_with(F.slice("precision", i * d + 1, d), "diff", lambda p, x: p.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
        q = F.aggregate(row, F.lit(0.0), lambda s, x: s + x)
        checked = F.when((F.col("q") < -1e-4) | F.isnan("q"), F.raise_error(F.lit("AdapterFailure: invalid Mahalanobis distance"))).otherwise(F.sqrt(F.greatest(F.col("q"), F.lit(0.0))))
        return rows.withColumn("diff", wide).withColumn("q", q).select(*keys, checked.alias("v"))

    def run(batches):
        for b in batches:
            x, m, p = (matrix(b.column(b.schema.get_field_index(c))) for c in ("feat", "mean", "precision"))
            n, d = x.shape if x.size else (0, 0)
            diff = x.astype(np.float32).astype(float) - m if n else np.zeros((0, 0))
            q = ((diff[:, None, :] @ p.reshape(n, d, d))[:, 0] * diff).sum(axis=1) if n else np.zeros(0)
            if (q < -1e-4).any() or not np.isfinite(q).all():
                raise ValueError("AdapterFailure: invalid Mahalanobis distance")
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keys], pa.array(np.sqrt(np.maximum(q, 0)))], [*keys, "v"])

    kinds = ", ".join(f"{c} {patches.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, f"{kinds}, v double")


@dataclass
class Moments:
    """Count, mean and sum of squared deviations; merges pairwise."""

    n: int
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "Moments":
        m = x.mean(axis=0)
        return cls(len(x), m, (x - m).T @ (x - m))

    def merge(self, other: "Moments") -> "Moments":
        if not self.n or not other.n:
            return other if not self.n else self
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.m2 + other.m2 + np.outer(d, d) * (self.n * other.n / n))


def pooled_moments(patches: DataFrame, dimension: int, chunk: int = 256) -> Moments:
    """Moments over all patches: chunks in the kernel, one partial result for each task, merged in two levels.

    All tasks run at once; about the square root of their number of partial results meets in a merging task, one at a
    time, and the driver gets one row. Merging follows task numbers, so that a result does not depend on timing.
    """
    kind = "task int, n long, mean array<double>, m2 array<double>"

    def row(total: Moments) -> pa.RecordBatch:
        return pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.n]), pa.array([total.mean], pa.list_(pa.float64())), pa.array([total.m2.ravel()], pa.list_(pa.float64()))], ["task", "n", "mean", "m2"])

    def partial(batches):
        total = Moments(0, np.zeros(dimension), np.zeros((dimension, dimension)))
        for b in batches:
            x = matrix(b.column(0))
            for at in range(0, len(x), chunk):
                total = total.merge(Moments.of(x[at : at + chunk]))
        if total.n:
            yield row(total)

    def merged(batches):
        total = Moments(0, np.zeros(dimension), np.zeros((dimension, dimension)))
        for b in batches:
            means, squares = matrix(b.column(2)), matrix(b.column(3))
            for n, mean, m2 in zip(b.column(1).to_pylist(), means, squares, strict=True):
                total = total.merge(Moments(n, mean, m2.reshape(dimension, dimension)))
        if total.n:
            yield row(total)

    spark = patches.sparkSession
    fan = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = patches.select(F.col("feat").cast("array<double>").alias("feat")).mapInArrow(partial, kind)
    rows = rows.repartition(fan, "task").sortWithinPartitions("task").mapInArrow(merged, kind)
    r = rows.repartition(1).sortWithinPartitions("task").mapInArrow(merged, kind).first()
    if r is None:
        return Moments(0, np.zeros(dimension), np.zeros((dimension, dimension)))
    return Moments(r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(dimension, dimension))


@dataclass
class Pca:
    """Mean, orthonormal basis (R x D) and scales (R)."""

    mean: np.ndarray
    basis: np.ndarray
    scales: np.ndarray

    def validate(self) -> "Pca":
        if self.basis.ndim != 2 or self.basis.shape[1] != len(self.mean) or len(self.scales) != len(self.basis):
            raise ArtifactCorrupt("principal components differ in shape")
        if not all(np.isfinite(a).all() for a in (self.mean, self.basis, self.scales)) or (self.scales <= 0).any():
            raise ArtifactCorrupt("principal components must be finite and scales positive")
        if (np.abs(np.linalg.norm(self.basis, axis=1) - 1) > 1e-5).any():
            raise ArtifactCorrupt("principal components must have unit length")
        return self


def principal(m: Moments, mode: str, components: int = 0, explained: float = 0.99, shrinkage: float = 0.01, regularisation: float = 1e-6) -> Pca:
    """Components of the sample covariance by descending eigenvalue.

    Rank: components if given; else min(128, D) for ``mh``; else for ``subad`` the least rank that reaches the explained
    share. Scales (``mh``) are 1 / sqrt((1 - s) * max(0, l) + s * mean(l of the rank) + reg), else 1.
    """
    if m.n < 2:
        raise NotInitialized("statistics need at least two patches")
    values, vectors = np.linalg.eigh(m.m2 / (m.n - 1))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    d = len(values)
    if components:
        rank = min(components, d)
    elif mode == "mh":
        rank = min(128, d)
    else:
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        rank = min(int(np.searchsorted(share, float32(explained), "left")) + 1, d)
    scales = np.ones(rank)
    if mode == "mh":
        s = float32(shrinkage)
        scales = 1 / np.sqrt((1 - s) * values[:rank] + s * values[:rank].mean() + float32(regularisation))
    return Pca(m.mean, np.ascontiguousarray(vectors[:rank]), scales).validate()


def _rowwise(patches: DataFrame, keys: list[str], kernel, result: str, kind: str) -> DataFrame:
    def run(batches):
        for b in batches:
            x = matrix(b.column(b.num_columns - 1))
            out = kernel(x) if len(x) else []
            col = pa.array(list(out), pa.list_(pa.float64())) if kind.startswith("array") else pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], col], [*keys, result])

    kinds = ", ".join(f"{c} {patches.schema[c].dataType.simpleString()}" for c in keys)
    return patches.select(*keys, F.col("feat").cast("array<double>").alias("feat")).mapInArrow(run, f"{kinds}, {result} {kind}")


def whiten(patches: DataFrame, pca: Pca, keys: list[str]) -> DataFrame:
    """(keys, feat): centred features projected on the components and scaled."""
    return _rowwise(patches, keys, lambda x: ((x - pca.mean) @ pca.basis.T) * pca.scales, "feat", "array<double>")


def residual(patches: DataFrame, pca: Pca, keys: list[str]) -> DataFrame:
    """(keys, v): squared norm of what the components leave of the centred features."""

    def kernel(x: np.ndarray) -> np.ndarray:
        c = x - pca.mean
        return ((c - (c @ pca.basis.T) @ pca.basis) ** 2).sum(axis=1)

    return _rowwise(patches, keys, kernel, "v", "double")


def top_fraction_mean(scores: DataFrame, fraction: float) -> DataFrame:
    """(image_id, score): mean of the ceil(fraction * n) highest values of each image, at least one."""
    if not 0 < fraction <= 1:
        raise InvalidArgument("the fraction must be in (0, 1]")
    f = float32(fraction)
    ranked = scores.groupBy("image_id").agg(F.sort_array(F.collect_list("v"), asc=False).alias("v"))  # an image's locations
    n = F.greatest(F.lit(1), F.ceil(F.size("v") * F.lit(f)).cast("int"))
    return ranked.select("image_id", (F.aggregate(F.slice("v", F.lit(1), n), F.lit(0.0), lambda s, x: s + x) / n).alias("score"))


#: Rows of a block of queries and of gallery that meet in a task, and the least number of such meetings.
DENSITY_ROWS, DENSITY_TASKS = 65_536, 32


def _exponents(x: np.ndarray, gallery_t: np.ndarray, norms: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """By query: the least squared distance to the gallery and the sum of exp(-(d2 - least) / scale)."""
    low, total = np.zeros(len(x)), np.zeros(len(x))
    for at in range(0, len(x), 256):
        block = x[at : at + 256]
        d = np.maximum((block * block).sum(axis=1)[:, None] + norms - 2 * (block @ gallery_t), 0)
        low[at : at + 256] = least = d.min(axis=1)
        total[at : at + 256] = np.exp(-(d - least[:, None]) / scale).sum(axis=1)
    return low, total


def log_density(patches: DataFrame, gallery: np.ndarray, sigma: float, keys: list[str]) -> DataFrame:
    """(keys, v): min(d2) / 2s^2 - log(sum(exp(-(d2 - min) / 2s^2))) over a gallery, in blocks of queries."""
    scale = 2 * sigma * sigma
    gallery_t = np.ascontiguousarray(gallery.T)

    norms = (gallery_t * gallery_t).sum(axis=0)

    def kernel(x: np.ndarray) -> np.ndarray:
        low, total = _exponents(x, gallery_t, norms, scale)
        return low / scale - np.log(total)

    return _rowwise(patches, keys, kernel, "v", "double")


def log_density_blocks(patches: DataFrame, gallery: DataFrame, sigma: float, keys: list[str], rows: int = DENSITY_ROWS) -> DataFrame:
    """``log_density`` over a gallery table (feat array<float>) of any size: no row of it goes to the driver.

    Blocks of queries meet blocks of gallery in tasks, in single precision as they are stored; a query's sums over the
    blocks then join at the least distance of all. Each row of patches gives one row, also where keys repeat.
    """
    scale = 2 * sigma * sigma
    nq = max(1, math.ceil(patches.count() / rows))
    nb = max(math.ceil(gallery.count() / rows), math.ceil(DENSITY_TASKS / nq))
    feat = F.col("feat").cast("array<float>").alias("feat")
    row = F.monotonically_increasing_id()
    q = patches.select(*keys, row.alias("row"), feat).withColumn("i", F.pmod(F.xxhash64("row"), F.lit(nq)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    g = gallery.select(feat, row.alias("row")).withColumn("j", F.pmod(F.xxhash64("row"), F.lit(nb)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    kinds = ", ".join(f"{c} {patches.schema[c].dataType.simpleString()}" for c in keys)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            left = left.slice(0, 0)
        low = total = np.zeros(0)
        if left.num_rows:
            gallery_t = np.ascontiguousarray(matrix(right["feat"]).T)
            # a few gallery rows at a time: 256 x 8192 distances
            cuts = range(0, gallery_t.shape[1], 8192)
            x = matrix(left["feat"])
            parts = [_exponents(x, t, (t * t).sum(axis=0), scale) for t in (gallery_t[:, at : at + 8192] for at in cuts)]
            low = np.min([a for a, _ in parts], axis=0)
            total = np.sum([b * np.exp(-(a - low) / scale) for a, b in parts], axis=0)
        return pa.table([*(left[c] for c in [*keys, "row", "j"]), pa.array(low), pa.array(total)], [*keys, "row", "j", "low", "total"])

    met = q.groupBy("i", "j").cogroup(g.groupBy("i", "j")).applyInArrow(run, f"{kinds}, row long, j int, low double, total double")
    parts = met.groupBy("row").agg(*[F.first(c).alias(c) for c in keys], F.min("low").alias("low"), F.array_sort(F.collect_list(F.struct("j", "low", "total"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["total"] * F.exp(-(p["low"] - F.col("low")) / scale))
    return parts.select(*keys, (F.col("low") / scale - F.log(total)).alias("v"))


def density_components(m: Moments, components: int) -> Pca:
    """Components for the density model (at most D and the number of samples), in single precision."""
    pca = principal(m, "density", components=min(components, len(m.mean), m.n)) if m.n > 1 else Pca(m.mean, np.eye(len(m.mean))[: min(components, len(m.mean))], np.ones(min(components, len(m.mean))))
    return Pca(pca.mean.astype(np.float32), pca.basis.astype(np.float32), np.ones(len(pca.basis)))


def fit_density(m: Moments, sample: np.ndarray, components: int) -> tuple[Pca, np.ndarray]:
    """Components for the density model and the projected gallery, in single precision."""
    pca = density_components(m, components)
    return pca, density_project(sample, pca)


def density_project(x: np.ndarray, pca: Pca) -> np.ndarray:
    """Single-precision difference, double accumulation, single-precision result."""
    diff = (x.astype(np.float32) - pca.mean.astype(np.float32)).astype(float)
    return (diff @ pca.basis.astype(float).T).astype(np.float32)


