"""The thin queries and the pipeline over the smallest driver tables."""

import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from oddlight.llm import decontamination, near_dedup
from oddlight.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (d[cols].astype(object).where(d[cols].notna(), None).map(lambda v: int(v) if isinstance(v, (float, np.integer)) else v).map(str).sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_one_row_for_each_row(spark, name):
    table = "pages" if name.startswith("op8") else "documents"
    out, n = QUERIES[name](spark, DATA), spark.read.parquet(f"{DATA}/{table}.parquet").count()
    key = "page_id" if table == "pages" else "doc_id"
    assert out.select(key).distinct().count() == n
    if not name.startswith("op2"):
        assert out.count() == n


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = ["_pipeline_row", "score", "lang_pred", "_text", "_cut", "row", "kept", "a.b", "a`b"]
    now = docs.selectExpr("*", *[f"concat('v', doc_id) as `{n.replace('`', '``')}`" for n in names])
    columns = now.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, DATA).write.parquet(path := f"{tmp_path}/{n}")
        now = spark.read.parquet(path)
        assert now.columns == columns
    rows = now.toArrow()
    for name in names:
        assert rows[name].to_pylist() == [f"v{i}" for i in rows["doc_id"].to_pylist()]
    assert corpus_pipeline.STAGES[-1][1](spark, now, DATA).select("doc_id").distinct().count() == rows.num_rows > 0


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 !", None), (3, None, None), (4, "", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in corpus_pipeline.language_id(spark, docs, DATA).collect()] == [(1, "some text", None)]


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "x", 0), (9002, "", "en", "x", 0), (9003, "12 34", "en", None, 5), (9004, docs.first()["text"] + " ", "en", "x", 1), (9004, docs.first()["text"] + " ", "en", "x", 1)], docs.schema)
    now, columns = docs.unionByName(extra), docs.columns
    counts = [now.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, DATA)
        assert out.columns == columns
        out.write.parquet(path := f"{tmp_path}/{n}")
        now = spark.read.parquet(path)
        counts.append(now.count())
    assert counts[1] == counts[0] - 3 and counts[2] <= counts[1] - 2 and counts[3] < counts[2]
    left = near_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/2"))
    assert left.where("not first_row").count() == 0
    hits = decontamination.contamination(now, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert hits.where("size(starts) > 0").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, DATA).select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
