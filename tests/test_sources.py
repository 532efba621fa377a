"""Manifests, packages, images, streams."""

import hashlib
import json

import numpy as np
import pytest

from oddlight import errors
from oddlight.plans.algorithms import CATALOGUE
from oddlight.sources import images, jsontext, package
from oddlight.sources.manifest import parse
from oddlight.streaming.incremental import IncrementalFit, batch_state, merge_states

DIRECT = {
    "schema_version": 1,
    "model": {"id": "m", "version": "1", "algorithm": "direct"},
    "graph_contract": "prediction",
    "input": {"tensor": "input", "size": [4, 4]},
    "runtime": {"backend": "onnxruntime", "onnx": "net.onnx"},
    "outputs": {"pred_score": "score"},
    "algorithm": {"type": "direct"},
}


def changed(path, value):
    doc = json.loads(json.dumps(DIRECT))
    node = doc
    *way, last = path.split(".")
    for k in way:
        node = node.setdefault(k, {})
    if value is ...:
        del node[last]
    else:
        node[last] = value
    return json.dumps(doc)


def test_defaults():
    m = parse(json.dumps(DIRECT))
    assert m.input.mean == (0.485, 0.456, 0.406) and m.runtime.max_batch_size == 1 and m.postprocess.min_region_area == 16
    assert m.config["map_semantic"] == "anomaly_map" and m.artifacts() == ["net.onnx"]
    assert [c[0] for c in CATALOGUE if c[2]] == ["patchcore", "padim"]


@pytest.mark.parametrize(
    ("path", "value", "where", "kind"),
    [
        ("schema_version", 3, "$.schema_version", errors.UnsupportedSchema),
        ("model.algorithm", "other", "$.model.algorithm", errors.UnsupportedAlgorithm),
        ("graph_contract", "feature_pyramid", "$.graph_contract", errors.InvalidManifest),
        ("algorithm.type", "yolo", "$.algorithm.type", errors.InvalidManifest),
        ("input.size", ..., "$.input.size", errors.InvalidManifest),
        ("input.center_crop", [8, 8], "$.input.center_crop", errors.InvalidManifest),
        ("input.std", [1, 0, 1], "$.input.std", errors.InvalidManifest),
        ("runtime.onnx", ..., "$.runtime.onnx", errors.InvalidManifest),
        ("postprocess.smooth_kernel", 4, "$.postprocess", errors.InvalidManifest),
        ("checksums.net", "abc", "$.checksums.net", errors.InvalidManifest),
    ],
)
def test_errors_have_paths(path, value, where, kind):
    with pytest.raises(kind) as e:
        parse(changed(path, value))
    assert e.value.path == where and e.value.status == 4 or kind is errors.UnsupportedAlgorithm


def test_statistical_variants_need_schema_2():
    doc = DIRECT | {"model": {"id": "m", "version": "1", "algorithm": "patchcore"}, "graph_contract": "feature_pyramid", "algorithm": {"type": "patchcore", "variant": "subad", "statistics": "s", "feature_layers": ["a"], "embedding_dimension": 4}}
    with pytest.raises(errors.InvalidManifest):
        parse(json.dumps(doc))
    assert parse(json.dumps(doc | {"schema_version": 2})).config["top_score_fraction"] == pytest.approx(0.01)


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', '{"a": 01}', '{"a": NaN}', '{"a": 1e999}', '{"a": "\\ud800"}', '{"a": 1} x', '{"a": "\n"}'])
def test_strict_json(text):
    with pytest.raises(errors.InvalidManifest):
        jsontext.parse(text)


def test_package_build_and_tampering(tmp_path):
    template = tmp_path / "t"
    template.mkdir()
    (template / "manifest.json").write_text(json.dumps(DIRECT))
    (template / "net.onnx").write_bytes(b"abc")
    row = {"image_min": 0.0, "image_max": 2.0, "image_threshold": 1.0, "has_pixel_statistics": False}
    out = package.PackageBuilder(template).apply_calibration(row).commit(tmp_path / "out")
    assert out.manifest.checksums["net.onnx"] == hashlib.sha256(b"abc").hexdigest() == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert out.manifest.postprocess.image_max == 2 and out.info()["algorithm"] == "direct"
    out.validate()
    with pytest.raises(errors.InvalidArgument):
        package.PackageBuilder(template).commit(tmp_path / "out")
    with pytest.raises(errors.InvalidArgument):
        package.PackageBuilder(template).commit(template / "inner")
    (tmp_path / "out" / "net.onnx").write_bytes(b"abd")
    with pytest.raises(errors.ArtifactCorrupt):
        package.Package.load(tmp_path / "out")


@pytest.mark.parametrize("name", ["", "/etc/x", "../outside.bin", "a/../../x"])
def test_paths_stay_inside(tmp_path, name):
    with pytest.raises(errors.ArtifactPathEscape):
        package.resolve(tmp_path, name)


def test_missing_artifact(tmp_path):
    with pytest.raises(errors.ArtifactMissing):
        package.resolve(tmp_path, "none.bin")


def test_preprocess_geometry(spark):
    cfg = parse(changed("input", {"tensor": "input", "resize": [4, 4], "center_crop": [2, 2], "mean": [0, 0, 0], "std": [1, 1, 1]})).input
    data = bytes([0, 128, 255] * 48)
    rows = spark.createDataFrame([(0, 6, 8, 0, "BGR8", bytearray(data))], "image_id long, width int, height int, stride int, format string, data binary")
    t = images.preprocess(rows, cfg).first()
    assert (t["c"], t["h"], t["w"]) == (3, 2, 2)
    assert t["data"][:4] == pytest.approx([1.0] * 4) and t["data"][4:8] == pytest.approx([128 / 255] * 4)
    g = images.geometry(rows, cfg).first()
    assert (g["crop_x"], g["crop_y"], g["crop_w"], g["crop_h"]) == (1, 1, 2, 2)


def test_decode_formats():
    assert images.decode(bytes([1, 2, 3]), 1, 1, 0, "RGB8").ravel().tolist() == [3, 2, 1]
    assert images.decode(bytes([1, 2, 3, 4]), 1, 1, 0, "RGBA8").ravel().tolist() == [3, 2, 1]
    assert images.decode(bytes([7, 0, 9, 0]), 1, 2, 2, "GRAY8")[:, 0, 0].tolist() == [7, 9]
    for bad in ((b"", 1, 1, 0, "BGR8"), (b"ab", 1, 1, 0, "BGR8"), (b"abc", 1, 1, 2, "BGR8"), (b"abc", 1, 1, 0, "XYZ")):
        with pytest.raises(errors.InvalidImage):
            images.decode(*bad)


def test_incremental_state_is_exact_and_idempotent(spark):
    rows = [("a", float(v)) for v in (1, 2, 5)] + [("b", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    fit = IncrementalFit(spark, "k", "v")
    fit.add_batch(df.where("v < 3"), 0)
    fit.add_batch(df.where("v >= 3"), 1)
    fit.add_batch(df.where("v >= 3"), 1)  # a retry changes nothing
    got = {r["k"]: r for r in fit.state().collect()}
    assert got["a"]["n"] == 3 and got["b"]["n"] == 1 and got["a"]["high"] == 5
    assert got["a"]["m2"] / 3 == pytest.approx(np.var([1, 2, 5]))
    one = merge_states(batch_state(df, "k", "v"), batch_state(df.limit(0), "k", "v"), "k")
    assert one.count() == 2
