"""Hand-computed cases."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from oddlight import errors
from oddlight.functions import linear, planes
from oddlight.functions.vectors import float32
from oddlight.operators import calibrate, coreset, detections, features, knn, maps, postprocess, stats
from oddlight.plans.algorithms import Dfkde, Direct, EfficientAd, Grid, PaDiM, PatchCore, Spade, Yolo, validate_gauss

PATCH = "image_id long, loc int, y int, x int, feat array<double>"
TENSOR = features.TENSOR
GRID = Grid(1, 1, 2, 2, 0.0)


def patch_rows(spark, values):
    return spark.createDataFrame([(i, 0, 0, 0, [float(v)] if not isinstance(v, list) else v) for i, v in enumerate(values)], PATCH)


def plane(spark, values, h, w):
    return spark.createDataFrame([(0, h, w, [float(v) for v in values])], maps.MAP)


def test_average_pool(spark):
    t = spark.createDataFrame([(0, "a", 1, 2, 2, [1.0, 2.0, 3.0, 4.0])], TENSOR)
    assert features.avg_pool(t, 2, 2, 0).first()["data"] == [2.5]


def test_pool_counts_padding(spark):
    t = spark.createDataFrame([(0, "a", 1, 1, 1, [9.0])], TENSOR)
    assert features.avg_pool(t, 3, 1, 1).first()["data"] == pytest.approx([1.0])


def test_patchcore_scores_and_map(spark):
    model = PatchCore(GRID, patch_rows(spark, [0]).selectExpr("image_id AS bank_id", "feat"), dimension=1)
    out = {r["image_id"]: r for r in model.score(patch_rows(spark, [3, 4])).collect()}
    assert out[0]["score"] == pytest.approx(3) and out[1]["score"] == pytest.approx(4)
    assert out[1]["values"] == pytest.approx([4.0] * 4)


def test_dimension_mismatch(spark):
    model = PatchCore(GRID, None, dimension=1)
    with pytest.raises(errors.TensorSignatureMismatch):
        model.validate(patch_rows(spark, [[1.0, 2.0]]))


def test_weighted_image_score(spark):
    bank = patch_rows(spark, [0, 1, 5]).selectExpr("image_id AS bank_id", "feat")
    model = PatchCore(GRID, bank, num_neighbors=2, dimension=1)
    score = model.image_scores(model.patch_scores(patch_rows(spark, [3.5]))).first()["score"]
    p = math.exp(-4) / (math.exp(-4) + 1)
    assert score == pytest.approx((1 - p) * 1.5, abs=1e-9)


def test_knn_strategies_agree_and_support_is_first(spark):
    bank = spark.createDataFrame([(i, [3.0 * i, 3.0 * i + 1]) for i in range(4)], "bank_id long, feat array<double>")
    q = spark.createDataFrame([(0, [0.2, 1.0]), (1, [8.9, 10.1])], "q long, feat array<double>")
    for how in ("broadcast", "blocks"):
        got = {r["q"]: r["bank_id"] for r in knn.knn(q, bank, 2, ["q"], strategy=how).where("rank = 1").collect()}
        assert got == {0: 0, 1: 3}
    again = knn.knn(bank.selectExpr("bank_id AS q", "feat"), bank, 1, ["q"]).where("q = 0").first()
    assert again["bank_id"] == 0 and again["d2"] == 0


def test_coreset_sizes_in_single_precision(spark):
    assert coreset.coreset_size(10, 0.1) == 2
    rows = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate((0, 1, 5, 6))], "bank_id long, feat array<double>")
    bank, branch = coreset.coreset(rows, 0.5, project=1)
    assert branch == "farthest" and bank.count() == 2
    assert coreset.coreset(rows, 1.0)[1] == "all"
    assert coreset.coreset(rows, 0.5, max_evaluations=3)[1] == "random"


def test_padim_fit_and_score(spark):
    model = PaDiM.fit(patch_rows(spark, [1, 3]), GRID, [0], regularisation=1.0)
    assert model.gauss.first()["mean"] == [2.0]
    assert model.patch_scores(patch_rows(spark, [4])).first()["v"] == pytest.approx(math.sqrt(2), abs=1e-5)


def test_padim_moments_merge(spark):
    one, two = (stats.location_moments(patch_rows(spark, v), 1) for v in ([1, 3], [4]))
    got = stats.merge_moments(one, two).first()
    assert (got["n"], got["sums"], got["products"]) == (3, [8.0], [26.0])


def test_padim_corrupt(spark):
    bad = spark.createDataFrame([(0, [0.0, 0.0], [1.0, 1.0, 0.0, 1.0])], "loc int, mean array<float>, precision array<float>")
    with pytest.raises(errors.ArtifactCorrupt):
        validate_gauss(bad)


def test_normalise_and_decide(spark):
    raw = spark.createDataFrame([(0, 2.0, 2, 2, [2.0] * 4)], "image_id long, score double, h int, w int, values array<double>")
    cfg = postprocess.Config(image_threshold=2, pixel_threshold=2, image_max=4, pixel_max=4)
    geo = spark.createDataFrame([(0, 4, 4, 4, 4, 0, 0, 4, 4)], "image_id long, original_w int, original_h int, resized_w int, resized_h int, crop_x int, crop_y int, crop_w int, crop_h int")
    r = postprocess.postprocess(raw, geo, cfg).first()
    assert r["score"] == 0.5 and r["is_anomalous"] and r["mask"] == [255] * 16


def test_crop_leaves_zeros_outside(spark):
    geo = spark.createDataFrame([(0, 4, 4, 4, 4, 1, 1, 2, 2)], "image_id long, original_w int, original_h int, resized_w int, resized_h int, crop_x int, crop_y int, crop_w int, crop_h int")
    v = np.array(postprocess.restore_geometry(plane(spark, [1] * 4, 2, 2), geo).first()["values"]).reshape(4, 4)
    assert v[1:3, 1:3].tolist() == [[1, 1], [1, 1]] and v.sum() == 4


def test_regions(spark):
    v = np.full((10, 10), 0.5)
    v[1:3, 1:3] = v[8, 8] = 0.9
    m = np.where(v > 0.8, 255, 0)
    ratio, found = planes.regions(v, m, 1, 0)
    assert ratio == 0.05 and len(found) == 2
    assert (found[0]["area"], found[0]["x"], found[0]["y"], found[0]["width"], found[0]["height"]) == (4, 1, 1, 2, 2)
    ratio, found = planes.regions(v, m, 1, 1)
    assert ratio == 0.05 and len(found) == 1


def test_equal_areas_order_by_first_pixel():
    m = np.zeros((4, 4))
    m[0, 0] = m[2, 2] = 1
    assert [r["first"] for r in planes.regions(m, m, 1, 0)[1]] == [0, 10]


def test_efficientad(spark):
    g = Grid(2, 2, 2, 2, 0.0)
    rows = [spark.createDataFrame([(0, i, i // 2, i % 2, [float(v)]) for i, v in enumerate(vs)], PATCH) for vs in ((1, 2, 3, 4), (0, 0, 0, 0), (0, 0, 0, 0))]
    raw = EfficientAd(g).score(*rows)
    assert raw.first()["score"] == 0.5
    assert EfficientAd.fit_range(raw).first()["sample_count"] == 1


def test_dfkde_orders_scores(spark):
    model = Dfkde.fit(patch_rows(spark, [1, 3]), GRID, 1, 1.0)
    s = [r["score"] for r in model.score(patch_rows(spark, [1, 10])).orderBy("image_id").collect()]
    assert s[0] < s[1]


def test_dfkde_gallery_beyond_the_driver(spark):
    rng = np.random.default_rng(3)
    train, seen = (spark.createDataFrame([(i // 4, i % 4, i % 4 // 2, i % 2, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 5)))], PATCH) for n in (400, 40))
    grid = Grid(2, 2, 2, 2, 0.0)
    held, spread = Dfkde.fit(train, grid, 3, 0.5), Dfkde.fit(train, grid, 3, 0.5, gallery_rows=399)
    assert len(held.gallery) == spread.gallery.count() == 400
    want, got = ({r["image_id"]: r["score"] for r in m.score(seen).collect()} for m in (held, spread))
    assert len(got) == 10 and got == pytest.approx(want, rel=1e-9)
    z = Dfkde._project(seen.union(seen), spread.pca, ["image_id", "loc"])
    want, got = (sorted(map(tuple, df.collect())) for df in (stats.log_density(z, held.gallery.astype(float), 0.5, ["image_id", "loc"]), stats.log_density_blocks(z, spread.gallery, 0.5, ["image_id", "loc"], rows=30)))
    assert len(got) == 80 and np.allclose(got, want, rtol=1e-9)


def test_spade_two_layers(spark):
    train = {"a": patch_rows(spark, [0, 0]), "b": patch_rows(spark, [0, 0])}
    model = Spade.fit(train, {"a": GRID, "b": GRID}, 1)
    s = [r["score"] for r in model.score({"a": patch_rows(spark, [1, 10]), "b": patch_rows(spark, [1, 10])}).orderBy("image_id").collect()]
    assert s == pytest.approx([1, 10])


def detection_rows(spark, boxes):
    return spark.createDataFrame([(0, i, *map(float, b[:4]), [float(s) for s in b[4]]) for i, b in enumerate(boxes)], "image_id long, anchor long, cx double, cy double, w double, h double, class_scores array<double>")


def images(spark):
    return spark.createDataFrame([(0,), (1,)], "image_id long")


def test_yolo(spark):
    raw = Yolo(64, 64).score(detection_rows(spark, [(10, 10, 4, 4, [0.9]), (20, 20, 4, 4, [0.5]), (30, 30, 4, 4, [0.1])]), images(spark))
    got = {r["image_id"]: r for r in raw.collect()}
    m = np.array(got[0]["values"]).reshape(64, 64)
    assert got[0]["score"] == 0.9 and got[1]["score"] == 0 and (m[10, 10], m[20, 20], m[30, 30]) == (0.9, 0.5, 0)


def test_yolo_suppression_and_overlap(spark):
    one = Yolo(64, 64).score(detection_rows(spark, [(10, 10, 10, 10, [0.9]), (12, 12, 10, 10, [0.5])]), images(spark)).where("image_id = 0").first()
    assert one["score"] == 0.9 and np.array(one["values"]).reshape(64, 64)[16, 16] == 0
    two = Yolo(64, 64, 2).score(detection_rows(spark, [(10, 10, 10, 10, [0.9, 0]), (12, 12, 10, 10, [0, 0.5])]), images(spark)).where("image_id = 0").first()
    assert np.array(two["values"]).reshape(64, 64)[11, 11] == 0.5  # the lower score shows
    with pytest.raises(errors.TensorSignatureMismatch):
        Yolo(64, 64, 1).validate(detection_rows(spark, [(1, 1, 1, 1, [0.5, 0.5])]))


def test_painting_holds_few_maps_and_one_row_for_each_picture(spark):
    rng = np.random.default_rng(4)
    boxes = [[{"score": float(s), "x1": x, "y1": y, "x2": x + 9.5, "y2": y + 7.0} for s, (x, y) in zip(rng.random(k), rng.uniform(-5, 64, (k, 2)), strict=True)] or None for k in rng.integers(0, 4, 1000)]
    at = 0
    for start, best, out in detections._planes(pa.array(boxes), 64, 64):
        assert start == at and out.nbytes <= detections.PLANE_BYTES
        at += len(out)
        for b, s, m in zip(boxes[start:at], best, out, strict=True):
            b = b or []
            want = planes.paint(np.array([[x[c] for c in ("x1", "y1", "x2", "y2")] for x in b]).reshape(-1, 4), np.array([x["score"] for x in b]), 64, 64)
            assert s == max((x["score"] for x in b), default=0) and (m == want.ravel()).all()
    assert at == 1000
    model, found = Yolo(64, 64), detection_rows(spark, [(10, 10, 4, 4, [0.9])])
    twice = images(spark).union(images(spark))
    maps_, sums = model.score(found, twice).collect(), model.totals(found, twice).collect()
    assert sorted((r["image_id"], r["score"], sum(v > 0 for v in r["values"]), round(sum(r["values"]), 9)) for r in maps_) == sorted((*r[:3], round(r["total"], 9)) for r in sums)
    assert len(maps_) == 4 and sum(r["painted"] for r in sums) == 32


def test_suppression_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    boxes = [(10, 10, 10, 10, [0.9 - 0.01 * i]) for i in range(7)]
    assert detections.suppress(detections.candidates(detection_rows(spark, boxes)), 0.45).count() == 1
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_direct_without_map(spark):
    r = Direct.score(spark.createDataFrame([(0, 0.4)], "image_id long, score float")).first()
    assert r["score"] == pytest.approx(0.4) and r["values"] is None


def test_calibration(spark):
    assert calibrate.quantile_index(11, 0.1) == 8
    assert calibrate.widened(5, 5) == pytest.approx((4.999995, 5.000005))
    raw = spark.createDataFrame([(i, float(i), [float(i), 0.0]) for i in range(11)], "image_id long, score double, values array<double>")
    c = calibrate.calibrate(raw, 0.1)
    assert c["sample_count"] == 11 and c["image_threshold"] == 8 and c["has_pixel_statistics"]
    none = calibrate.calibrate(raw.selectExpr("image_id", "score", "cast(null AS array<double>) AS values"), 0.1)
    assert (none["pixel_min"], none["pixel_max"], none["pixel_threshold"], none["has_pixel_statistics"]) == (0, 1, 0.5, False)
    with pytest.raises(errors.NotInitialized):
        calibrate.calibrate(raw.limit(0))


def test_principal_components():
    rng = np.random.default_rng(1)
    x = rng.normal(0, np.sqrt([8, 1, 1]), (20000, 3))
    m = stats.Moments.of(x[:7000]).merge(stats.Moments.of(x[7000:]))
    assert np.allclose(m.m2 / (m.n - 1), np.cov(x.T), atol=1e-9)
    m = stats.Moments(11, np.zeros(3), np.diag([8.0, 1, 1]) * 10)
    assert len(stats.principal(m, "subad", explained=0.75).basis) == 1
    assert len(stats.principal(m, "subad", explained=0.85).basis) == 2
    p = stats.principal(m, "mh", components=2, shrinkage=0.5, regularisation=1e-6)
    assert p.scales == pytest.approx(1 / np.sqrt(0.5 * np.array([8, 1]) + 0.5 * 4.5 + float32(1e-6)))


def test_wide_moments_equal_expressions(spark):
    rows = patch_rows(spark, [[1.0, 2.0], [3.0, 5.0], [4.0, 1.0]])
    a, b = stats.location_moments(rows, 2).first(), stats.wide_moments(rows, 2).first()
    assert a["n"] == b["n"] and a["sums"] == b["sums"] and a["products"] == b["products"]


def test_streaming_bank_keeps_extremes():
    x = np.arange(10.0)[:, None]
    assert sorted(coreset.streaming_bank(x, 2, 4).ravel()) == [0, 9]


def test_blur_is_normalised_and_morphology_ignores_outside():
    assert linear.blur_size(4) == 33
    assert np.allclose(linear.blur_matrix(8, 9, 1.0, "mirror").sum(axis=1), 1)
    full = np.full((3, 3), 255)
    assert (planes.morphology(full, 3, 1, "open") == 255).all() and (planes.morphology(np.zeros((3, 3)), 3, 1, "close") == 0).all()


def test_bad_numbers_raise(spark):
    with pytest.raises(Exception, match="AdapterFailure"):
        features.finite(spark.createDataFrame([Row(v=float("nan"))]), "v").collect()


def test_null_map_and_empty_tables(spark):
    empty = spark.createDataFrame([], maps.MAP)
    assert maps.blur_map(empty, 1.0).count() == 0 and maps.label_map(empty).count() == 0
    null = spark.createDataFrame([(0, 2, 2, None)], maps.MAP)
    assert maps.blur_map(null, 1.0).first()["values"] is None
    assert postprocess.regions(null, null).first()["has_map"] is False


def test_selection_by_rank_equals_sorting(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 3000), np.full(2000, 0.25), rng.lognormal(0, 6, 500)])
    df = spark.createDataFrame([(i % 3, float(x)) for i, x in enumerate(v)] + [(0, None)], "k int, v double").repartition(5)
    for index in (0, 1, 2700, 5498, 5499):
        assert calibrate.ordered_value(df, df["v"], index) == np.sort(v)[index]
    got = {r["k"]: r for r in calibrate.calibrate_groups(df, ["k"], "v", 0.25).collect()}
    for k in range(3):
        mine = np.sort(v[k::3])
        assert got[k]["threshold"] == mine[calibrate.quantile_index(len(mine), 0.25)] and got[k]["n"] == len(mine)


def test_binding_renames_and_drops(spark):
    t = spark.createDataFrame([(0, "x", 1, 1, 1, [1.0]), (0, "other", 1, 1, 1, [2.0])], TENSOR)
    assert [r["name"] for r in features.bind(t, {"layer": "x"}).collect()] == ["layer"]
