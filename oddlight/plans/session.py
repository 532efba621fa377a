"""Sessions: a package loaded once, then images or feature tensors scored into predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlgorithmMismatch, NotInitialized, TensorSignatureMismatch
from ..operators import calibrate as cal
from ..operators import features
from ..operators.postprocess import postprocess
from ..sources import artifacts, images, network
from ..sources.package import Package
from .algorithms import Algorithm, Dfkde, Direct, EfficientAd, Grid, PaDiM, PatchCore, Spade, Yolo

#: Loaders by algorithm name; ``register`` adds others.
LOADERS: dict = {}


def register(name: str):
    def add(f):
        LOADERS[name] = f
        return f

    return add


def pyramid(tensors: DataFrame, layers: list[str], aggregation: str = "concat", pool: tuple[int, int, int] | None = None) -> DataFrame:
    """Patches of a feature pyramid: every layer pooled, resized to the first layer's grid, then joined or averaged."""
    planes = []
    for name in layers:
        one = tensors.where(F.col("name") == name)
        planes.append(features.avg_pool(one, *pool) if pool else one)
    row = planes[0].select("h", "w").first()
    if row is None:
        raise TensorSignatureMismatch(f"no tensor is named {layers[0]}")
    planes = [planes[0], *[features.resize(p, row["h"], row["w"]) for p in planes[1:]]]
    if len(planes) == 1:
        joined = planes[0]
    else:
        joined = features.mean_layers(planes) if aggregation == "mean" else features.concat_layers(planes)
    return features.to_patches(joined)


def grid_of(tensors: DataFrame, layer: str, pool: tuple[int, int, int] | None, out: tuple[int, int], sigma: float) -> Grid:
    row = tensors.where(F.col("name") == layer).select("h", "w").first()
    if row is None:
        raise TensorSignatureMismatch(f"no tensor is named {layer}")
    h, w = (features.linear.pool_size(row[c], *pool) if pool else row[c] for c in ("h", "w"))
    return Grid(h, w, *out, sigma)


class Session:
    """A loaded package. ``release`` ends it; everything after that is refused."""

    def __init__(self, spark: SparkSession, package: Package) -> None:
        self.spark, self.package, self.m = spark, package, package.manifest
        self.open, self._net = True, None
        self.timers = {k: spark.sparkContext.accumulator(0.0) for k in ("preprocess_ms", "network_ms")}

    @classmethod
    def load(cls, spark: SparkSession, path: str, algorithm: str | None = None) -> Session:
        package = Package.load(path)
        if algorithm and package.manifest.algorithm != algorithm:
            raise AlgorithmMismatch(f"the package holds {package.manifest.algorithm}, not {algorithm}")
        if package.manifest.algorithm not in LOADERS:
            raise AlgorithmMismatch(f"no loader for {package.manifest.algorithm}")
        return cls(spark, package)

    def model_info(self) -> dict:
        return self.package.info()

    def execution_info(self) -> dict:
        return network.execution_info(self.m.runtime)

    def timings(self) -> dict[str, float]:
        """Milliseconds spent in the kernels of this session's actions so far; a task that is run again counts again."""
        return {k: v.value for k, v in self.timers.items()}

    def release(self) -> None:
        self.open = False

    def _check(self) -> None:
        if not self.open:
            raise NotInitialized("the session was released")

    def _model(self) -> bytes:
        if self._net is None:
            self._net = (self.package.root / (self.m.runtime.onnx or "")).read_bytes()
        return self._net

    @property
    def out_size(self) -> tuple[int, int]:
        return self.m.input.crop or self.m.input.resize

    def warm_up(self) -> int:
        self._check()
        return network.warm_up(self.spark, self._model(), self.m.input.tensor, (3, *self.out_size), self.m.outputs, self.m.runtime)

    def extract(self, image_rows: DataFrame) -> DataFrame:
        """Semantic tensors of images: preprocessing and network in two map stages, no shuffle."""
        self._check()
        return network.infer(self.spark, images.preprocess(image_rows, self.m.input, self.timers["preprocess_ms"]), self._model(), self.m.input.tensor, self.m.outputs, self.m.runtime, self.timers["network_ms"])

    def score_tensors(self, tensors: DataFrame) -> DataFrame:
        """Raw rows from semantic tensors."""
        self._check()
        return LOADERS[self.m.algorithm](self, tensors)

    def predict(self, image_rows: DataFrame) -> DataFrame:
        raw = self.score_tensors(self.extract(image_rows))
        return postprocess(raw, images.geometry(image_rows, self.m.input), self.m.postprocess)

    def calibrate(self, image_rows: DataFrame, fpr: float = cal.FPR, max_pixels: int = cal.MAX_PIXELS, seed: int = cal.SEED):
        """Calibration row from normal images; maps are restored to image geometry first, as they are judged."""
        from ..operators.postprocess import restore_geometry

        raw = self.score_tensors(self.extract(image_rows))
        restored = restore_geometry(raw.select("image_id", "h", "w", "values"), images.geometry(image_rows, self.m.input))
        return cal.calibrate(raw.select("image_id", "score").join(restored, "image_id"), fpr, max_pixels, seed)


def _path(s: Session, key: str) -> str:
    return (s.package.root / s.m.config[key]).resolve().as_uri()


@register("patchcore")
def _patchcore(s: Session, tensors: DataFrame) -> DataFrame:
    c = s.m.config
    pool = (c["pooling_kernel"], c["pooling_stride"], c["pooling_padding"])
    grid = grid_of(tensors, c["feature_layers"][0], pool, s.out_size, c["gaussian_sigma"])
    patches = pyramid(tensors, c["feature_layers"], c["feature_aggregation"], pool)
    d, variant = c["embedding_dimension"], c["variant"]
    pca = artifacts.load_pca(s.spark, _path(s, "statistics"), variant, d) if variant != "original" else None
    width = len(pca.basis) if variant == "mh" else d
    bank = artifacts.load_bank(s.spark, _path(s, "index"), width, c["num_neighbors"]) if variant != "subad" else None
    model = PatchCore(grid, bank, variant, pca, c["num_neighbors"], c["sqrt_distances"], c["weighted_image_score"], c["top_score_fraction"], d)
    model.validate(patches)
    return model.score(patches)


@register("padim")
def _padim(s: Session, tensors: DataFrame) -> DataFrame:
    c = s.m.config
    h, w = c["feature_map_size"]
    grid = grid_of(tensors, c["feature_layers"][0], None, s.out_size, c["gaussian_sigma"])
    if (grid.h, grid.w) != (h, w):
        raise TensorSignatureMismatch(f"features are {grid.h} x {grid.w}, the statistics {h} x {w}")
    gauss, channels = artifacts.load_gauss(s.spark, _path(s, "statistics"), h * w, c["embedding_dimension"])
    return PaDiM(grid, gauss, channels, strategy="expr" if len(channels) <= 12 else "kernel").score(pyramid(tensors, c["feature_layers"]))


@register("dfkde")
def _dfkde(s: Session, tensors: DataFrame) -> DataFrame:
    c = s.m.config
    grid = grid_of(tensors, c["feature_layers"][0], None, s.out_size, c["gaussian_sigma"])
    pca, gallery = artifacts.load_density(s.spark, _path(s, "statistics"))
    return Dfkde(grid, pca, np.asarray(gallery), c["kernel_sigma"], c["embedding_dimension"]).score(pyramid(tensors, c["feature_layers"]))


@register("spade")
def _spade(s: Session, tensors: DataFrame) -> DataFrame:
    c = s.m.config
    banks = {n: s.spark.read.schema("bank_id long, feat array<float>").parquet((s.package.root / p).resolve().as_uri()) for n, p in zip(c["feature_layers"], c["indexes"], strict=True)}
    grids = {n: grid_of(tensors, n, None, s.out_size, c["gaussian_sigma"]) for n in c["feature_layers"]}
    return Spade(banks, grids, c["num_neighbors"]).score({n: features.to_patches(tensors.where(F.col("name") == n)) for n in c["feature_layers"]})


@register("efficientad")
def _efficientad(s: Session, tensors: DataFrame) -> DataFrame:
    c = s.m.config
    parts = [features.to_patches(tensors.where(F.col("name") == c[k])) for k in ("teacher_semantic", "student_semantic", "reconstruction_error_semantic")]
    grid = grid_of(tensors, c["teacher_semantic"], None, s.out_size, c["gaussian_sigma"])
    return EfficientAd(grid, c["hard_weight"], c["soft_weight"]).score(*parts)


@register("direct")
def _direct(s: Session, tensors: DataFrame) -> DataFrame:
    c = s.m.config
    scores = tensors.where(F.col("name") == c["score_semantic"]).select("image_id", F.col("data")[0].alias("score"))
    if c["map_semantic"] not in s.m.outputs:
        return Direct.score(scores)
    return Direct.score(scores, tensors.where(F.col("name") == c["map_semantic"]).select("image_id", "h", "w", F.col("data").alias("values")))


@register("yolo")
def _yolo(s: Session, tensors: DataFrame) -> DataFrame:
    """Detection tensors are (4 + classes) rows by anchors."""
    c = s.m.config
    t = tensors.where(F.col("name") == c["detection_semantic"])
    wrong = t.where(F.col("h") != 4 + c["num_classes"]).limit(1).count()
    if wrong:
        raise TensorSignatureMismatch(f"detections need {4 + c['num_classes']} channels")
    at = F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("anchor")
    rows = t.select("image_id", "w", "data", at)

    def value(i: int):
        return F.get("data", F.lit(i) * F.col("w") + F.col("anchor"))

    detections = rows.select("image_id", F.col("anchor").cast("long").alias("anchor"), *[value(i).alias(n) for i, n in enumerate(("cx", "cy", "_w", "h"))], F.array(*[value(4 + i) for i in range(c["num_classes"])]).alias("class_scores")).withColumnRenamed("_w", "w")
    h, w = s.out_size
    model: Algorithm = Yolo(h, w, c["num_classes"], c["conf_threshold"], c["nms_threshold"])
    return model.score(detections, t.select("image_id").distinct())
