"""Plans for large tables give what the plain ones give, and streams go on where they stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlight.operators import calibrate, coreset, stats
from oddlight.streaming.incremental import IncrementalFit, fit_stream, last_version


def vectors(spark, n, d, seed=3, parts=5):
    x = np.random.default_rng(seed).normal(2, 3, (n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "bank_id long, feat array<double>").repartition(parts)


def test_pooled_moments_equal_numpy(spark):
    x, df = vectors(spark, 700, 6)
    m = stats.pooled_moments(df, 6, chunk=64)
    assert m.n == 700
    np.testing.assert_allclose(m.mean, x.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(m.m2, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), rtol=1e-10, atol=1e-9)
    assert stats.pooled_moments(df.limit(0), 6).n == 0
    assert stats.pooled_moments(df.limit(1), 6).n == 1


@pytest.mark.parametrize("k", [1, 37, 500, 600])
def test_least_hashed_by_rank_equals_top_k(spark, monkeypatch, k):
    _, df = vectors(spark, 500, 1)
    df = df.unionByName(df.where("bank_id < 20")).select("bank_id")  # repeated rows
    want = sorted(r[0] for r in df.orderBy(F.xxhash64("bank_id", F.lit(9)), "bank_id").limit(k).collect())
    monkeypatch.setattr(calibrate, "TOP", 0)
    assert sorted(r[0] for r in calibrate.least_hashed(df, ["bank_id"], k, 9).collect()) == want
    assert calibrate.least_hashed(df.limit(0), ["bank_id"], k, 9).count() == 0


@pytest.mark.parametrize("project", [2, 128])
def test_coreset_by_passes_equals_gathered(spark, monkeypatch, project):
    _, df = vectors(spark, 60, 4)
    df = df.unionByName(df.where("bank_id < 3").withColumn("bank_id", F.col("bank_id") + 100))  # ties
    gathered, branch = coreset.coreset(df, 0.1, project)
    want = sorted((r["bank_id"], r["pick"]) for r in gathered.collect())
    monkeypatch.setattr(coreset, "GATHER_BYTES", 0)
    scanned, again = coreset.coreset(df, 0.1, project)
    assert branch == again == "farthest" and len(want) == 7
    assert sorted((r["bank_id"], r["pick"]) for r in scanned.collect()) == want


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    first, second = ([("a", 1.0), ("b", 5.0)], [("a", 3.0), ("a", 8.0)])
    schema = "k string, v double"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(source)
    rows = spark.read.parquet(source)
    fit_stream(spark, rows.schema, source, "k", "v", state)
    assert last_version(spark, state) == 0
    fit_stream(spark, rows.schema, source, "k", "v", state)  # nothing new
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(source)
    got = {r["k"]: r for r in fit_stream(spark, rows.schema, source, "k", "v", state).collect()}
    assert (got["a"]["n"], got["a"]["low"], got["a"]["high"], got["a"]["mean"]) == (3, 1.0, 8.0, 4.0)
    assert abs(got["a"]["variance"] - np.var([1, 3, 8])) < 1e-12 and got["b"]["n"] == 1


def test_new_fit_on_an_old_folder_skips_known_batches(spark, tmp_path):
    folder, df = f"file://{tmp_path}/fit", spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    IncrementalFit(spark, "k", "v", folder).add_batch(df, 0)
    again = IncrementalFit(spark, "k", "v", folder)
    again.add_batch(df, 0)
    again.add_batch(df, 1)
    assert again.state().first()["n"] == 4
    (tmp_path / "fit" / "v7").mkdir()  # a version that was not finished
    assert last_version(spark, folder) == 1
