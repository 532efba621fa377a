"""Packages end to end: a hand-encoded identity network, every algorithm's loader, calibration and rebuild."""

import json

import numpy as np
import pytest

from oddlight import errors
from oddlight.plans.algorithms import Grid, PaDiM, PatchCore
from oddlight.plans.session import Session, pyramid
from oddlight.sources import artifacts
from oddlight.sources.package import PackageBuilder

IMAGE = "image_id long, width int, height int, stride int, format string, data binary"


def _field(number, payload):
    if isinstance(payload, int):
        out, v = bytes([number << 3]), payload
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])
    payload = payload.encode() if isinstance(payload, str) else payload
    size, head = len(payload), bytes([number << 3 | 2])
    while size > 127:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    return head + bytes([size]) + payload


def identity_network(dims=("N", 3, 2, 2)):
    """An ONNX model whose output ``feat`` equals its input ``input``."""

    def value(name):
        shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))

    node = _field(1, "input") + _field(2, "feat") + _field(4, "Identity")
    graph = _field(1, node) + _field(2, "g") + _field(11, value("input")) + _field(12, value("feat"))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def manifest(algorithm, config, outputs, contract):
    return {
        "schema_version": 2,
        "model": {"id": "t", "version": "1", "algorithm": algorithm},
        "graph_contract": contract,
        "input": {"tensor": "input", "size": [2, 2], "mean": [0, 0, 0], "std": [1, 1, 1]},
        "runtime": {"backend": "onnxruntime", "onnx": "net.onnx", "max_batch_size": 2},
        "outputs": outputs,
        "algorithm": {"type": algorithm} | config,
        "postprocess": {"normalize": False, "threshold": True, "image_threshold": 0.5},
    }


def package(tmp_path, *args):
    root = tmp_path / "pkg"
    root.mkdir()
    (root / "manifest.json").write_text(json.dumps(manifest(*args)))
    (root / "net.onnx").write_bytes(identity_network())
    return root


def pictures(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(i, 2, 2, 0, "BGR8", bytearray(rng.integers(0, 40, 12, dtype=np.uint8).tobytes())) for i in range(5)] + [(9, 2, 2, 0, "BGR8", bytearray([250] * 12))], IMAGE)


def test_patchcore_package(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    cfg = {"index": "bank", "feature_layers": ["layer"], "embedding_dimension": 3, "pooling_kernel": 1, "pooling_padding": 0, "gaussian_sigma": 0}
    root = package(tmp_path, "patchcore", cfg, {"layer": "feat"}, "feature_pyramid")
    s = Session.load(spark, root, "patchcore")
    assert s.warm_up() == 1 and s.execution_info()["device"] == "cpu" and not s.execution_info()["fallback"]
    normal = pictures(spark).where("image_id < 5")
    tensors = s.extract(normal)
    assert tensors.count() == 5  # batches of two
    assert all(v > 0 for v in s.timings().values())
    model = PatchCore.fit(pyramid(tensors, ["layer"]), Grid(2, 2, 2, 2, 0.0), ratio=1.0)
    artifacts.save_bank(model.bank, (root / "bank").as_uri())
    got = {r["image_id"]: r for r in s.predict(pictures(spark)).collect()}
    assert got[9]["is_anomalous"] and not got[0]["is_anomalous"] and len(got[0]["anomaly_map"]) == 4
    row = s.calibrate(normal.union(pictures(spark).where("image_id = 9")), 0.1)
    out = PackageBuilder(root).apply_calibration(row).commit(tmp_path / "ready")
    assert out.manifest.postprocess.normalize and "bank" in out.manifest.checksums
    assert Session.load(spark, tmp_path / "ready").predict(pictures(spark)).where("image_id = 9").first()["score"] > 0.4
    with pytest.raises(errors.AlgorithmMismatch):
        Session.load(spark, root, "yolo")
    s.release()
    with pytest.raises(errors.NotInitialized):
        s.predict(normal)


def test_padim_package(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    cfg = {"statistics": "gauss", "channel_indices": "gauss", "feature_layers": ["layer"], "embedding_dimension": 2, "feature_map_size": [2, 2], "gaussian_sigma": 0}
    root = package(tmp_path, "padim", cfg, {"layer": "feat"}, "feature_pyramid")
    s = Session.load(spark, root)
    model = PaDiM.fit(pyramid(s.extract(pictures(spark).where("image_id < 5")), ["layer"]), Grid(2, 2, 2, 2, 0.0), [0, 2])
    artifacts.save_gauss(model.gauss, [0, 2], (root / "gauss").as_uri())
    got = {r["image_id"]: r["raw_score"] for r in s.predict(pictures(spark)).collect()}
    assert max(got, key=got.get) == 9


def test_direct_and_efficientad_packages(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    root = package(tmp_path, "direct", {}, {"pred_score": "feat", "anomaly_map": "feat"}, "prediction")
    tensors = spark.createDataFrame([(0, "pred_score", 1, 1, 1, [0.4]), (0, "anomaly_map", 1, 2, 2, [0.4] * 4)], "image_id long, name string, c int, h int, w int, data array<double>")
    r = Session.load(spark, root).score_tensors(tensors).first()
    assert r["score"] == 0.4 and r["values"] == [0.4] * 4
    (tmp_path / "two").mkdir()
    root = package(tmp_path / "two", "efficientad", {"gaussian_sigma": 0}, {"teacher": "feat", "student": "feat", "reconstruction_error": "feat"}, "prediction")
    parts = [(0, n, 1, 2, 2, v) for n, v in (("teacher", [1.0, 2.0, 3.0, 4.0]), ("student", [0.0] * 4), ("reconstruction_error", [0.0] * 4))]
    assert Session.load(spark, root).score_tensors(spark.createDataFrame(parts, tensors.schema)).first()["score"] == 0.5


def test_yolo_package(spark, tmp_path):
    root = package(tmp_path, "yolo", {"num_classes": 1}, {"output": "feat"}, "prediction")
    s = Session.load(spark, root)
    rows = [1, 30, 1, 30, 1, 1, 1, 1, 0.9, 0.1]
    t = spark.createDataFrame([(0, "output", 1, 5, 2, [float(v) for v in rows])], "image_id long, name string, c int, h int, w int, data array<double>")
    assert s.score_tensors(t).first()["score"] == 0.9
    with pytest.raises(errors.TensorSignatureMismatch):
        s.score_tensors(t.selectExpr("image_id", "name", "c", "4 AS h", "w", "data"))


def test_network_errors(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    root = package(tmp_path, "direct", {}, {"pred_score": "none"}, "prediction")
    with pytest.raises(Exception, match="no output"):
        Session.load(spark, root).extract(pictures(spark)).count()


def test_unknown_layer(spark):
    t = spark.createDataFrame([], "image_id long, name string, c int, h int, w int, data array<double>")
    with pytest.raises(errors.TensorSignatureMismatch):
        pyramid(t, ["a"])
