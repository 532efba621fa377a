"""Corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Every stage works on all rows that its predecessor kept, and every stage but the last returns the columns it was given.
Rows are told apart by a key of their own, so null or repeated doc_ids do no harm; further columns of any name stay.
"""

from __future__ import annotations

from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlight.llm.decontamination import decontaminate
from oddlight.llm.exact_dedup import exact_dedup
from oddlight.llm.language_id import fit_profiles, identify
from oddlight.llm.near_dedup import near_duplicates
from oddlight.llm.packing import pack
from oddlight.llm.shared import drop_path, free_name, quoted, row_keys, stage_table, staged_paths

_left: dict[tuple[str, int], list[str]] = {}  # what the stage before has staged, by data folder and thread


def _after(stage):
    """A stage that first drops what the stage before staged for the same data, unless docs still reads from it.

    The result of the stage before has been written by then, as STAGES demands.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if paths := _left.pop((sf_dir, get_ident()), []):
            names = [p.rsplit("/", 1)[1] for p in paths]
            if not any(f"/{n}/" in file for file in docs.inputFiles() for n in names):
                for path in paths:
                    drop_path(spark, path)
        return _noted(stage)(spark, docs, sf_dir)

    return run


def _noted(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with staged_paths() as paths:
            out = stage(spark, docs, sf_dir)
        _left[sf_dir, get_ident()] = paths
        return out

    return run


def _kept(docs: DataFrame, columns: list[str], row: str, rows: DataFrame) -> DataFrame:
    return docs.join(rows.select(F.col("row").alias(row)), row, "left_semi").select(*map(quoted, columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; null texts and texts without a letter go. A null lang takes the prediction.

    Where no row has both a text and a lang nothing can be learned: texts with a letter stay and lang stays null.
    """
    if not (profiles := fit_profiles(docs)):
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    out = identify(docs, profiles, docs.columns, pred_col=pred, score_col=score).where(F.col(pred) != "und")
    return out.withColumn("lang", F.coalesce("lang", pred)).select(*map(quoted, docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space."""
    row = free_name("_pipeline_row", docs.columns)
    keyed = stage_table(row_keys(docs, row), "keyed")
    return _kept(keyed, docs.columns, row, exact_dedup(keyed, row_col=row).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8 or more)."""
    row = free_name("_pipeline_row", docs.columns)
    keyed = stage_table(row_keys(docs, row), "keyed")
    return _kept(keyed, docs.columns, row, near_duplicates(keyed, row_col=row).where("first_row"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that consists of them for the most part goes."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces with their token ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", _noted(language_id)),
    ("exact_dedup", _after(exact)),
    ("near_dedup", _after(near)),
    ("decontamination", _after(benchmark_free)),
    ("packing", _after(packed)),
]

#: The stages learn language profiles, follow components and tokenise; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
