"""Model manifests: parsing with defaults and bounds; every error carries the JSON path of the field."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..errors import InvalidArgument, InvalidManifest, UnsupportedAlgorithm, UnsupportedSchema
from ..operators.postprocess import Config as Postprocess
from . import jsontext

#: Fixed values of the format.
ALGORITHMS = ("patchcore", "padim", "direct", "efficientad", "dfkde", "spade", "yolo")
PYRAMID = ("patchcore", "padim", "dfkde", "spade")
VARIANTS = ("original", "mh", "subad")
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


class Node:
    """A JSON object with typed access; ``path`` names it in errors."""

    def __init__(self, value: Any, path: str) -> None:
        if not isinstance(value, dict):
            raise InvalidManifest("expected an object", path)
        self.value, self.path = value, path

    def fail(self, key: str, message: str):
        raise InvalidManifest(message, f"{self.path}.{key}")

    def raw(self, key: str, default: Any = ...) -> Any:
        if key not in self.value:
            if default is ...:
                self.fail(key, "missing field")
            return default
        return self.value[key]

    def child(self, key: str, optional: bool = False) -> Node:
        return Node(self.raw(key, {} if optional else ...), f"{self.path}.{key}")

    def text(self, key: str, default: Any = ..., allowed: tuple = ()) -> Any:
        v = self.raw(key, default)
        if v is not default and (not isinstance(v, str) or not v):
            self.fail(key, "expected a string")
        if allowed and v not in allowed:
            self.fail(key, f"must be one of {', '.join(allowed)}")
        return v

    def flag(self, key: str, default: bool) -> bool:
        v = self.raw(key, default)
        if not isinstance(v, bool):
            self.fail(key, "expected true or false")
        return v

    def integer(self, key: str, default: Any = ..., low: int | None = None) -> int:
        v = self.raw(key, default)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v):
            self.fail(key, "expected an integer")
        if low is not None and v < low:
            self.fail(key, f"must be at least {low}")
        return int(v)

    def real(self, key: str, default: float, check=None, expected: str = "") -> float:
        """A number as it is in single precision."""
        v = self.raw(key, default)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
            self.fail(key, "expected a finite number")
        v = float(np.float32(v))
        if check and not check(v):
            self.fail(key, f"must be {expected}")
        return v

    def texts(self, key: str) -> list[str]:
        v = self.raw(key)
        if not isinstance(v, list) or not v or not all(isinstance(x, str) for x in v):
            self.fail(key, "expected a list of strings that is not empty")
        return v

    def pair(self, key: str) -> tuple[int, int] | None:
        v = self.raw(key, None)
        if v is None:
            return None
        if not isinstance(v, list) or len(v) != 2 or not all(isinstance(x, int) and not isinstance(x, bool) and x > 0 for x in v):
            self.fail(key, "expected [height, width]")
        return v[0], v[1]

    def triple(self, key: str, default: tuple, positive: bool = False) -> tuple[float, ...]:
        v = self.raw(key, list(default))
        if not isinstance(v, list) or len(v) != 3 or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v) or (positive and min(v) <= 0):
            self.fail(key, "expected three positive numbers" if positive else "expected three numbers")
        return tuple(float(x) for x in v)


def _unit(v: float) -> bool:
    return 0 <= v <= 1


def _not_negative(v: float) -> bool:
    return v >= 0


@dataclass(frozen=True)
class Input:
    tensor: str
    layout: str
    color: str
    resize: tuple[int, int]
    crop: tuple[int, int] | None
    interpolation: str
    mean: tuple
    std: tuple

    @classmethod
    def read(cls, n: Node) -> Input:
        resize = n.pair("resize") or n.pair("size")
        if resize is None:
            n.fail("size", "missing field")
        crop = n.pair("center_crop")
        if crop and (crop[0] > resize[0] or crop[1] > resize[1]):
            n.fail("center_crop", "must lie inside the resized image")
        return cls(n.text("tensor"), n.text("layout", "NCHW", ("NCHW", "NHWC")), n.text("color", "RGB", ("RGB", "BGR")), resize, crop, n.text("interpolation", "linear", ("nearest", "linear", "cubic", "area")), n.triple("mean", MEAN), n.triple("std", STD, positive=True))


@dataclass(frozen=True)
class Runtime:
    backend: str
    onnx: str | None
    engine: str | None
    load_policy: str
    fp16: bool
    max_batch_size: int
    workspace_mb: int
    device_id: int
    graph_optimization: str
    execution_mode: str
    intra_op_threads: int
    inter_op_threads: int

    @classmethod
    def read(cls, n: Node) -> Runtime:
        out = cls(
            n.text("backend", "tensorrt", ("tensorrt", "onnxruntime")),
            n.text("onnx", None),
            n.text("engine", None),
            n.text("load_policy", "prefer_engine", ("engine_only", "prefer_engine", "build_if_missing")),
            n.flag("fp16", False),
            n.integer("max_batch_size", 1, 1),
            n.integer("workspace_mb", 2048, 1),
            n.integer("device_id", 0, 0),
            n.text("graph_optimization", "all", ("disabled", "basic", "extended", "all")),
            n.text("execution_mode", "sequential", ("sequential", "parallel")),
            n.integer("intra_op_threads", 0, 0),
            n.integer("inter_op_threads", 0, 0),
        )
        if not out.onnx and not out.engine:
            n.fail("onnx", "a runtime needs an onnx or engine artifact")
        return out


def _patchcore(n: Node, schema: int) -> dict:
    variant = n.text("variant", "original", VARIANTS)
    if variant != "original" and schema < 2:
        raise InvalidManifest("statistical variants require schema_version 2", "$.schema_version")
    d = n.integer("embedding_dimension", low=1)
    out = {
        "variant": variant,
        "index": n.text("index", None) if variant == "subad" else n.text("index"),
        "statistics": n.text("statistics") if variant != "original" else n.text("statistics", None),
        "feature_aggregation": n.text("feature_aggregation", "concat", ("concat", "mean")),
        "feature_layers": n.texts("feature_layers"),
        "embedding_dimension": d,
        "num_neighbors": n.integer("num_neighbors", 1, 1),
        "pooling_kernel": n.integer("pooling_kernel", 3, 1),
        "pooling_stride": n.integer("pooling_stride", 1, 1),
        "pooling_padding": n.integer("pooling_padding", 1, 0),
        "gaussian_sigma": n.real("gaussian_sigma", 4.0, _not_negative, "0 or more"),
        "sqrt_distances": n.flag("sqrt_distances", True),
        "weighted_image_score": n.flag("weighted_image_score", True),
        "pca_components": n.integer("pca_components", 0, 0),
        "explained_variance": n.real("explained_variance", 0.99, lambda v: 0 < v < 1, "in (0, 1)"),
        "covariance_shrinkage": n.real("covariance_shrinkage", 0.01, _unit, "in [0, 1]"),
        "covariance_regularization": n.real("covariance_regularization", 1e-6, lambda v: v > 0, "positive"),
        "memory_bank_size": n.integer("memory_bank_size", 1000, 1),
        "streaming_chunk_size": n.integer("streaming_chunk_size", 1024, 1),
        "top_score_fraction": n.real("top_score_fraction", 0.01, lambda v: 0 < v <= 1, "in (0, 1]"),
    }
    if out["pca_components"] > d:
        n.fail("pca_components", "must not exceed the embedding dimension")
    return out


def _padim(n: Node, schema: int) -> dict:
    size = n.pair("feature_map_size")
    if size is None:
        n.fail("feature_map_size", "missing field")
    return {"statistics": n.text("statistics"), "channel_indices": n.text("channel_indices"), "feature_layers": n.texts("feature_layers"), "embedding_dimension": n.integer("embedding_dimension", low=1), "feature_map_size": size, "gaussian_sigma": n.real("gaussian_sigma", 4.0, _not_negative, "0 or more")}


def _efficientad(n: Node, schema: int) -> dict:
    out = {k: n.text(k, v) for k, v in (("teacher_semantic", "teacher"), ("student_semantic", "student"), ("reconstruction_error_semantic", "reconstruction_error"))}
    out |= {k: n.real(k, v, _not_negative, "0 or more") for k, v in (("hard_weight", 1.0), ("soft_weight", 1.0), ("gaussian_sigma", 4.0))}
    if out["hard_weight"] + out["soft_weight"] <= 0:
        n.fail("hard_weight", "weights must not both be zero")
    return out


def _dfkde(n: Node, schema: int) -> dict:
    out = {"statistics": n.text("statistics"), "feature_layers": n.texts("feature_layers"), "embedding_dimension": n.integer("embedding_dimension", low=1), "n_components": n.integer("n_components", 16, 1), "kernel_sigma": n.real("kernel_sigma", 10.0, lambda v: v > 0, "positive"), "gaussian_sigma": n.real("gaussian_sigma", 4.0, _not_negative, "0 or more")}
    if out["n_components"] > out["embedding_dimension"]:
        n.fail("n_components", "must not exceed the embedding dimension")
    return out


def _spade(n: Node, schema: int) -> dict:
    out = {"feature_layers": n.texts("feature_layers"), "indexes": n.texts("indexes"), "num_neighbors": n.integer("num_neighbors", 5, 1), "gaussian_sigma": n.real("gaussian_sigma", 4.0, _not_negative, "0 or more")}
    if len(out["indexes"]) != len(out["feature_layers"]):
        n.fail("indexes", "must match feature_layers one to one")
    return out


def _yolo(n: Node, schema: int) -> dict:
    return {"detection_semantic": n.text("detection_semantic", "output"), "num_classes": n.integer("num_classes", low=1), "conf_threshold": n.real("conf_threshold", 0.25, _unit, "in [0, 1]"), "nms_threshold": n.real("nms_threshold", 0.45, _unit, "in [0, 1]")}


def _direct(n: Node, schema: int) -> dict:
    return {"score_semantic": n.text("score_semantic", "pred_score"), "map_semantic": n.text("map_semantic", "anomaly_map")}


_READERS = {"patchcore": _patchcore, "padim": _padim, "efficientad": _efficientad, "dfkde": _dfkde, "spade": _spade, "yolo": _yolo, "direct": _direct}


def _postprocess(n: Node) -> Postprocess:
    values = {}
    for f in dataclasses.fields(Postprocess):
        if f.name not in n.value:
            continue
        values[f.name] = n.flag(f.name, True) if f.type == "bool" else n.text(f.name, allowed=("open", "close")) if f.type == "str" else n.integer(f.name, low=0) if f.type == "int" else n.real(f.name, 0.0)
    try:
        return Postprocess(**values).validate()
    except InvalidArgument as e:
        raise InvalidManifest(str(e), n.path) from e


@dataclass(frozen=True)
class Manifest:
    schema_version: int
    id: str
    version: str
    algorithm: str
    graph_contract: str
    input: Input
    runtime: Runtime
    outputs: dict[str, str]
    checksums: dict[str, str]
    postprocess: Postprocess
    config: dict = field(default_factory=dict)

    def artifacts(self) -> list[str]:
        """Paths of all artifacts that the manifest names."""
        names = [self.runtime.onnx, self.runtime.engine, *[self.config.get(k) for k in ("index", "statistics", "channel_indices")], *self.config.get("indexes", [])]
        return [n for n in names if n]


def parse(text: str) -> Manifest:
    root = Node(jsontext.parse(text), "$")
    schema = root.integer("schema_version")
    if schema not in (1, 2):
        raise UnsupportedSchema(f"schema version {schema} is not supported", "$.schema_version")
    model = root.child("model")
    algorithm = model.text("algorithm")
    if algorithm not in ALGORITHMS:
        raise UnsupportedAlgorithm(f"unknown algorithm {algorithm}", "$.model.algorithm")
    contract = root.text("graph_contract", allowed=("feature_pyramid", "prediction"))
    if (algorithm in PYRAMID) != (contract == "feature_pyramid"):
        raise InvalidManifest(f"{algorithm} does not go with {contract}", "$.graph_contract")
    node = root.child("algorithm")
    if node.text("type") != algorithm:
        node.fail("type", "must match $.model.algorithm")
    outputs = {k: v for k, v in root.child("outputs").value.items() if isinstance(v, str) and v}
    if not outputs:
        raise InvalidManifest("expected at least one output binding", "$.outputs")
    sums = root.child("checksums", optional=True)
    for k, v in sums.value.items():
        if not isinstance(v, str) or len(v) != 64 or set(v) - set("0123456789abcdef"):
            sums.fail(k, "expected 64 lower-case hexadecimal digits")
    return Manifest(schema, model.text("id"), model.text("version"), algorithm, contract, Input.read(root.child("input")), Runtime.read(root.child("runtime")), outputs, dict(sums.value), _postprocess(root.child("postprocess", optional=True)), _READERS[algorithm](node, schema))
