"""Fit objects and artifacts."""

import numpy as np
import pytest

from oddlight import errors
from oddlight.operators import stats
from oddlight.plans.algorithms import Grid, PatchCore
from oddlight.plans.fitters import CANCELLED, COMPLETE, PaDimFitter, PatchCoreFitter
from oddlight.sources import artifacts

PATCH = "image_id long, loc int, y int, x int, feat array<double>"
GRID = Grid(1, 1, 1, 1, 0.0)


def rows(spark, values, start=0):
    return spark.createDataFrame([(start + i, 0, 0, 0, [float(v)]) for i, v in enumerate(values)], PATCH)


def test_bank_fit_checkpoint_and_import(spark, tmp_path):
    f = PatchCoreFitter(spark, GRID, str(tmp_path), ratio=0.5, project=1, first=0)
    with pytest.raises(errors.NotInitialized):
        f.finalize()
    assert f.add_batch(rows(spark, [0, 1])).processed_samples == 2
    f.save_checkpoint(f"{tmp_path}/ckpt")
    again = PatchCoreFitter(spark, GRID, str(tmp_path), ratio=0.5, project=1, first=0)
    again.load_checkpoint(f"{tmp_path}/ckpt")
    again.add_batch(rows(spark, [5, 6], 2))
    model = again.finalize()
    assert again.progress().collected_vectors == 4 and again.progress().stage == COMPLETE and model.bank.count() == 2
    with pytest.raises(errors.InvalidArgument):
        again.add_batch(rows(spark, [1]))
    seeded = PatchCoreFitter(spark, GRID, str(tmp_path), ratio=1.0)
    seeded.import_bank(model.bank)
    assert seeded.finalize().bank.count() == 2
    with pytest.raises(errors.InvalidArgument):
        PatchCoreFitter(spark, GRID, str(tmp_path), variant="mh").import_bank(model.bank)


def test_cancel_is_final(spark, tmp_path):
    f = PatchCoreFitter(spark, GRID, str(tmp_path))
    f.cancel()
    assert f.progress().stage == CANCELLED
    with pytest.raises(errors.Cancelled) as e:
        f.add_batch(rows(spark, [1]))
    assert e.value.status == 10


def test_gaussians_over_batches_equal_one_fit(spark, tmp_path):
    f = PaDimFitter(spark, GRID, str(tmp_path), [0], 1.0)
    f.add_batch(rows(spark, [1]))
    f.add_batch(rows(spark, [3], 1))
    model = f.finalize()
    assert model.patch_scores(rows(spark, [4])).first()["v"] == pytest.approx(np.sqrt(2), abs=1e-5)
    artifacts.save_gauss(model.gauss, [0], f"{tmp_path}/gauss")
    gauss, channels = artifacts.load_gauss(spark, f"{tmp_path}/gauss", 1, 1)
    assert channels == [0] and gauss.count() == 1
    with pytest.raises(errors.ArtifactCorrupt):
        artifacts.load_gauss(spark, f"{tmp_path}/gauss", 2, 1)


def test_bank_and_statistics_files(spark, tmp_path):
    bank = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "bank_id long, feat array<double>")
    artifacts.save_bank(bank, f"{tmp_path}/bank")
    assert artifacts.load_bank(spark, f"{tmp_path}/bank", 2, 2).count() == 2
    for dimension, least in ((3, 1), (2, 3)):
        with pytest.raises(errors.ArtifactCorrupt):
            artifacts.load_bank(spark, f"{tmp_path}/bank", dimension, least)
    artifacts.save_layers({"a": bank, "b": bank.limit(1)}, f"{tmp_path}/layers")
    assert {k: v.count() for k, v in artifacts.load_layers(spark, f"{tmp_path}/layers", ["a", "b"]).items()} == {"a": 2, "b": 1}
    with pytest.raises(errors.ArtifactCorrupt):
        artifacts.load_layers(spark, f"{tmp_path}/layers", ["a"])
    pca = stats.principal(stats.Moments(11, np.zeros(2), np.diag([8.0, 1]) * 10), "mh")
    artifacts.save_pca(spark, pca, "mh", f"{tmp_path}/pca")
    assert np.allclose(artifacts.load_pca(spark, f"{tmp_path}/pca", "mh", 2).scales, pca.scales)
    with pytest.raises(errors.ArtifactCorrupt):
        artifacts.load_pca(spark, f"{tmp_path}/pca", "subad", 2)
    artifacts.save_density(spark, pca, np.ones((3, 2), np.float32), f"{tmp_path}/density")
    assert artifacts.load_density(spark, f"{tmp_path}/density")[1].shape == (3, 2)


def test_statistical_variants(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, [3, 1, 0.1], (200, 3))
    train = spark.createDataFrame([(i, 0, 0, 0, v.tolist()) for i, v in enumerate(x)], PATCH)
    odd = spark.createDataFrame([(0, 0, 0, 0, [0.0, 0.0, 5.0]), (1, 0, 0, 0, [3.0, 0.0, 0.0])], PATCH)
    for variant in ("mh", "subad"):
        model = PatchCore.fit(train, GRID, variant, components=3 if variant == "mh" else 2, bank_size=50, chunk=30)
        s = {r["image_id"]: r["v"] for r in model.patch_scores(odd).collect()}
        assert s[0] > s[1]
    assert model.score(odd).count() == 2
