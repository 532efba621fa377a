"""The seven algorithms. All score DataFrames of patches, streams or detections into raw rows.

raw rows: image_id, score, h, w, values (a map, or null where an algorithm has none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArtifactCorrupt, NotInitialized, TensorSignatureMismatch
from ..operators import coreset as core
from ..operators import detections as det
from ..operators import features, knn, maps, stats

KEYS = ["image_id", "loc"]


@dataclass(frozen=True)
class Grid:
    """Feature grid and output size of the maps."""

    h: int
    w: int
    out_h: int
    out_w: int
    sigma: float = 4.0

    def raw(self, patch_scores: DataFrame, image_scores: DataFrame | None = None) -> DataFrame:
        """Maps from patch scores; the image score is the map's maximum unless given."""
        m = maps.anomaly_map(patch_scores, self.h, self.w, self.out_h, self.out_w, self.sigma)
        s = maps.map_score(m) if image_scores is None else image_scores
        return s.join(m, "image_id").select("image_id", "score", "h", "w", "values")


class Algorithm:
    """fit(df) makes a model, validate(df) checks a feature table against it, score(df) gives raw rows."""

    name = ""
    dimension = 0

    def validate(self, patches: DataFrame) -> None:
        """Checks columns and dimension (of one row: a schema does not hold it)."""
        missing = {"image_id", "loc", "feat"} - set(patches.columns)
        if missing:
            raise TensorSignatureMismatch(f"patches lack {sorted(missing)}")
        row = patches.select(F.size("feat").alias("d")).first()
        if row and row["d"] != self.dimension:
            raise TensorSignatureMismatch(f"features have {row['d']} channels, the model {self.dimension}")


@dataclass
class PatchCore(Algorithm):
    """Nearest-neighbour memory bank; variants original, mh (whitened) and subad (subspace residual, no bank)."""

    grid: Grid
    bank: DataFrame | None = None
    variant: str = "original"
    pca: stats.Pca | None = None
    num_neighbors: int = 1
    sqrt_distances: bool = True
    weighted_image_score: bool = True
    top_score_fraction: float = 0.01
    dimension: int = 0
    branch: str = ""
    name = "patchcore"

    @classmethod
    def fit(cls, patches: DataFrame, grid: Grid, variant: str = "original", ratio: float = 0.1, project: int = 128, seed: int = 42, first: int | None = None, max_evaluations: int = core.MAX_EVALUATIONS, bank_size: int = 1000, chunk: int = 1024, components: int = 0, explained: float = 0.99, shrinkage: float = 0.01, regularisation: float = 1e-6, **score) -> "PatchCore":
        row = patches.select(F.size("feat").alias("d")).first()
        if row is None:
            raise NotInitialized("no training features")
        d = row["d"]
        if variant == "original":
            rows = patches.select((F.col("image_id") * (grid.h * grid.w) + F.col("loc")).alias("bank_id"), "feat")
            bank, branch = core.coreset(rows, ratio, project, max_evaluations, seed, first)
            return cls(grid, bank, variant, None, dimension=d, branch=branch, **score)
        pca = stats.principal(stats.pooled_moments(patches, d), variant, components, explained, shrinkage, regularisation)
        if variant == "subad":
            return cls(grid, None, variant, pca, dimension=d, **score)
        # the merge-reduce bank depends on the order of rows: whitened rows stream through in (image, location) order
        white = stats.whiten(patches.orderBy("image_id", "loc"), pca, KEYS)
        held = np.zeros((0, len(pca.basis)))
        part: list[list[float]] = []
        for r in white.toLocalIterator():
            part.append(r["feat"])
            if len(part) == chunk:
                held = core.streaming_bank(np.concatenate([held, np.array(part)]), bank_size, len(held) + chunk)
                part = []
        if part:
            held = core.streaming_bank(np.concatenate([held, np.array(part)]), bank_size, len(held) + len(part))
        if len(held) < score.get("num_neighbors", 1):
            raise NotInitialized("the bank is smaller than the number of neighbours")
        bank = patches.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "bank_id long, feat array<double>")
        return cls(grid, bank, variant, pca, dimension=d, **score)

    def patch_scores(self, patches: DataFrame) -> DataFrame:
        """(image_id, loc, v[, bank_id]): the nearest distance only, or the residual of the subspace variant."""
        if self.variant == "subad":
            return stats.residual(patches, self.pca, KEYS)
        rows = stats.whiten(patches, self.pca, KEYS) if self.variant == "mh" else patches
        return knn.nearest_scores(rows, self.bank, KEYS, self.sqrt_distances)

    def image_scores(self, scores: DataFrame) -> DataFrame:
        if self.variant == "subad":
            return stats.top_fraction_mean(scores, self.top_score_fraction)
        top = scores.groupBy("image_id").agg(F.max_by(F.struct("v", "bank_id"), F.struct("v", (-F.col("loc")).alias("l"))).alias("m")).select("image_id", "m.v", "m.bank_id")
        if not self.weighted_image_score or self.num_neighbors < 2:
            return top.select("image_id", F.col("v").alias("score"))
        return self._weighted(top)

    def _weighted(self, top: DataFrame) -> DataFrame:
        """(1 - softmax of the support's own nearest distances at the first) * the largest score."""
        support = top.select("bank_id").distinct().join(self.bank, "bank_id").select(F.col("bank_id").alias("support"), "feat")
        near = knn.knn(support, self.bank, self.num_neighbors, ["support"])
        near = near.select("support", "rank", (F.sqrt("d2") if self.sqrt_distances else F.col("d2")).alias("d"))
        lists = near.groupBy(F.col("support").alias("bank_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "d"))).alias("n"))
        most = F.array_max(F.transform("n", lambda x: x["d"]))
        total = F.aggregate("n", F.lit(0.0), lambda s, x: s + F.exp(x["d"] - most))
        first = F.exp(F.col("n")[0]["d"] - most) / total
        return top.join(lists, "bank_id").select("image_id", ((1 - first) * F.col("v")).alias("score"))

    def score(self, patches: DataFrame) -> DataFrame:
        scores = self.patch_scores(patches)
        return self.grid.raw(scores.select("image_id", "loc", "v"), self.image_scores(scores))


@dataclass
class PaDiM(Algorithm):
    """A Gaussian for each location; patches meet it by an equi-join on loc."""

    grid: Grid
    gauss: DataFrame
    channels: list[int]
    dimension: int = 0
    strategy: str = "expr"
    name = "padim"

    @classmethod
    def moments(cls, patches: DataFrame, channels: list[int]) -> DataFrame:
        rows = features.select_channels(patches, channels)
        return stats.location_moments(rows, len(channels)) if len(channels) <= 12 else stats.wide_moments(rows, len(channels))

    @classmethod
    def fit(cls, patches: DataFrame, grid: Grid, channels: list[int], regularisation: float = 0.01) -> "PaDiM":
        return cls.finalize(cls.moments(patches, channels), grid, channels, regularisation)

    @classmethod
    def finalize(cls, moments: DataFrame, grid: Grid, channels: list[int], regularisation: float = 0.01) -> "PaDiM":
        return cls(grid, stats.gaussians(moments, regularisation), channels, strategy="expr" if len(channels) <= 12 else "kernel")

    def patch_scores(self, patches: DataFrame) -> DataFrame:
        return stats.mahalanobis(features.select_channels(patches, self.channels), self.gauss, KEYS, self.strategy)

    def score(self, patches: DataFrame) -> DataFrame:
        return self.grid.raw(self.patch_scores(patches))


def validate_gauss(gauss: DataFrame) -> None:
    """Stored statistics must be finite, with positive diagonals and symmetric precisions."""
    for r in gauss.select("loc", "mean", "precision").toLocalIterator():
        d = len(r["mean"])
        p = np.array(r["precision"]).reshape(d, -1)
        if p.shape != (d, d) or not np.isfinite(p).all() or not np.isfinite(r["mean"]).all():
            raise ArtifactCorrupt(f"statistics of location {r['loc']} are malformed")
        if (np.diag(p) <= 0).any() or (np.abs(p - p.T) > 1e-4 * np.maximum(1, np.abs(p))).any():
            raise ArtifactCorrupt(f"the precision of location {r['loc']} is not symmetric with a positive diagonal")


@dataclass
class Dfkde(Algorithm):
    """Kernel density over projected features."""

    grid: Grid
    pca: stats.Pca
    gallery: np.ndarray | DataFrame
    kernel_sigma: float = 10.0
    dimension: int = 0
    name = "dfkde"

    @classmethod
    def fit(cls, patches: DataFrame, grid: Grid, components: int = 16, kernel_sigma: float = 10.0, gallery_rows: int = 65_536) -> "Dfkde":
        """The gallery is all projected training rows, as the density sums over them: an array of at most gallery_rows
        rows, beyond that a table which stays on the executors."""
        first = patches.select(F.size("feat")).first()
        if first is None:
            raise NotInitialized("no training features")
        d = first[0]
        m = stats.pooled_moments(patches, d)
        if m.n > gallery_rows:
            pca = stats.density_components(m, components)
            return cls(grid, pca, cls._project(patches, pca, KEYS).select("feat"), kernel_sigma, d)
        t = patches.orderBy("image_id", "loc").select(F.col("feat").cast("array<double>").alias("feat")).toArrow()
        pca, gallery = stats.fit_density(m, knn.matrix(t["feat"]), components)
        return cls(grid, pca, gallery, kernel_sigma, d)

    @staticmethod
    def _project(patches: DataFrame, pca: stats.Pca, keys: list[str]) -> DataFrame:
        return stats._rowwise(patches, keys, lambda x: stats.density_project(x, pca).astype(float), "feat", "array<double>")

    def patch_scores(self, patches: DataFrame) -> DataFrame:
        z = self._project(patches, self.pca, KEYS)
        if isinstance(self.gallery, DataFrame):
            return stats.log_density_blocks(z, self.gallery, self.kernel_sigma, KEYS)
        return stats.log_density(z, self.gallery.astype(float), self.kernel_sigma, KEYS)

    def score(self, patches: DataFrame) -> DataFrame:
        return self.grid.raw(self.patch_scores(patches))


@dataclass
class Spade(Algorithm):
    """Mean distance to the k nearest gallery vectors, layer by layer; layers are fused as maps."""

    banks: dict[str, DataFrame]
    grids: dict[str, Grid]
    num_neighbors: int = 5
    name = "spade"

    @classmethod
    def fit(cls, layers: dict[str, DataFrame], grids: dict[str, Grid], num_neighbors: int = 5) -> "Spade":
        """Banks of all training patches; layers keep the order in which they were first seen."""
        banks = {n: p.select((F.col("image_id") * (grids[n].h * grids[n].w) + F.col("loc")).alias("bank_id"), "feat") for n, p in layers.items()}
        return cls(banks, grids, num_neighbors)

    def layer_scores(self, name: str, patches: DataFrame) -> DataFrame:
        d = knn.knn(patches, self.banks[name], self.num_neighbors, KEYS)
        return d.groupBy(*KEYS).agg(F.avg(F.sqrt("d2")).alias("v"))

    def score(self, layers: dict[str, DataFrame]) -> DataFrame:
        one = next(iter(self.grids.values()))
        resized = [maps.resize_map(maps.maps_from_pixels(self.layer_scores(n, p), self.grids[n].h, self.grids[n].w), one.out_h, one.out_w) for n, p in layers.items()]
        out = resized[0]
        for r in resized[1:]:
            out = out.join(r.select("image_id", F.col("values").alias("more")), "image_id").select("image_id", "h", "w", F.zip_with("values", "more", lambda a, b: a + b).alias("values"))
        n = float(len(resized))
        fused = maps.blur_map(out.select("image_id", "h", "w", F.transform("values", lambda v: v / n).alias("values")), one.sigma)
        return maps.map_score(fused).join(fused, "image_id").select("image_id", "score", "h", "w", "values")


@dataclass
class EfficientAd(Algorithm):
    """Teacher-student difference blended with reconstruction error, each scaled by its own range."""

    grid: Grid
    hard_weight: float = 1.0
    soft_weight: float = 1.0
    name = "efficientad"

    def score(self, teacher: DataFrame, student: DataFrame, reconstruction: DataFrame) -> DataFrame:
        g = self.grid

        def scaled(pixels: DataFrame) -> DataFrame:
            return maps.minmax_map(maps.resize_map(maps.maps_from_pixels(pixels, g.h, g.w), g.out_h, g.out_w))

        hard = scaled(features.channel_l2_diff(teacher, student))
        soft = scaled(features.pass_or_l2(reconstruction))
        m = maps.blur_map(maps.blend_maps(hard, soft, self.hard_weight, self.soft_weight), g.sigma)
        return maps.map_score(m).join(m, "image_id").select("image_id", "score", "h", "w", "values")

    @staticmethod
    def fit_range(raw: DataFrame) -> DataFrame:
        """One row: sample_count, image_min, image_max, pixel_min, pixel_max."""
        return raw.agg(F.count(F.lit(1)).alias("sample_count"), F.min("score").alias("image_min"), F.max("score").alias("image_max"), F.min(F.array_min("values")).alias("pixel_min"), F.max(F.array_max("values")).alias("pixel_max"))


class Direct(Algorithm):
    """Scores and maps that a network predicts itself."""

    name = "direct"

    @staticmethod
    def score(scores: DataFrame, maps_: DataFrame | None = None) -> DataFrame:
        one = scores.select("image_id", F.col("score").cast("double").alias("score"))
        if maps_ is None:
            return one.select("image_id", "score", F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("array<double>").alias("values"))
        return one.join(maps_, "image_id", "left").select("image_id", "score", "h", "w", "values")


@dataclass
class Yolo(Algorithm):
    """Boxes: best class, confidence, suppression within classes, painted maps."""

    h: int
    w: int
    classes: int = 1
    confidence: float = 0.25
    overlap: float = 0.45
    name = "yolo"

    def validate(self, detections: DataFrame) -> None:
        row = detections.select(F.size("class_scores").alias("n")).first()
        if row and row["n"] != self.classes:
            raise TensorSignatureMismatch(f"detections have {row['n']} classes, the model {self.classes}")

    def score(self, detections: DataFrame, images: DataFrame) -> DataFrame:
        return det.painted(self._kept(detections), images, self.h, self.w)

    def totals(self, detections: DataFrame, images: DataFrame) -> DataFrame:
        """(image_id, score, painted, total): what ``score`` gives, with each map counted and summed where it is painted."""
        return det.paint_totals(self._kept(detections), images, self.h, self.w)

    def _kept(self, detections: DataFrame) -> DataFrame:
        return det.suppress(det.candidates(detections, self.confidence), self.overlap)


#: The capability catalogue: algorithm, graph contract, public fit, map output.
CATALOGUE = [
    ("patchcore", "feature_pyramid", True, True),
    ("padim", "feature_pyramid", True, True),
    ("dfkde", "feature_pyramid", False, True),
    ("spade", "feature_pyramid", False, True),
    ("efficientad", "prediction", False, True),
    ("direct", "prediction", False, True),
    ("yolo", "prediction", False, True),
]

