"""Language identification by rank-order profiles of byte n-grams.

A profile is the list of a language's most frequent n-grams (one to three bytes of lower-cased text, with runs of
anything that is not a letter read as one space). A document's own most frequent n-grams are ranked the same way and
compared with every profile by the out-of-place distance: the sum of rank differences, an n-gram that the profile lacks
counting as the full profile length. The nearest profile wins. Counts for the profiles cover every training document
and are summed by Spark; a profile has a fixed length, so the broadcast is bounded by the number of languages.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .shared import lean, numbered, quoted, tune
from .textbytes import text_bytes

#: N-grams in a profile, and how many of a document's own are compared.
PROFILE, DOCUMENT = 400, 200
#: Bytes of a text counted at a time, and n-grams that a task holds before it counts them.
PIECE, HELD = 1 << 20, 1 << 24
GRAMS = 3
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _folded(data: np.ndarray, before: int = 0) -> np.ndarray:
    """Letters lower-cased in A-Z and among the accented Latin letters of bytes C3 80-9E; all other ASCII becomes space.

    before is the byte in front of data.
    """
    folded = _FOLD[data]
    lead = np.zeros(len(data), bool)
    lead[1:] = data[:-1] == 0xC3
    lead[:1] = before == 0xC3
    upper = lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    folded[upper] += 32
    return folded


def _grams(raw: np.ndarray):
    """The n-grams of a text, PIECE bytes at a time: each piece gives those that end in it, so cuts leave no trace.

    Spaces are collapsed, and the text has a space at either end.
    """
    tail = np.full(1, 32, np.uint8)  # the last two bytes before the piece, collapsed
    for at in range(0, max(len(raw), 1), PIECE):
        t = _folded(raw[at : at + PIECE], int(raw[at - 1]) if at else 0)
        if at + PIECE >= len(raw):
            t = np.append(t, np.uint8(32))
        space = t == 32
        keep = np.ones(len(t), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        keep[:1] &= ~(space[:1] & (tail[-1] == 32))
        t = t[keep]
        one = t[t != 32].astype(np.uint32)
        t = np.concatenate([tail, t]).astype(np.uint32)
        last = t[len(tail) - 1 :]  # with the byte in front, for pairs
        two = (last[:-1] << np.uint32(8)) | last[1:] | np.uint32(1 << 24)
        three = (t[:-2] << np.uint32(16)) | (t[1:-1] << np.uint32(8)) | t[2:] | np.uint32(2 << 24)
        tail = t[-2:].astype(np.uint8)
        yield np.concatenate([one, two, three])


def _count(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.diff(np.append(first, len(g)))


def _sum(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([a[1], b[1]])).astype(np.int64)


def gram_counts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the 1- to GRAMS-byte n-grams of one text, the same for any PIECE."""
    return reduce(_sum, map(_count, _grams(raw)))


def ranked(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent codes, ties by code."""
    if len(codes) > 4 * n:
        floor = np.partition(counts, len(counts) - n)[len(counts) - n]
        top = counts >= floor
        codes, counts = codes[top], counts[top]
    return codes[np.lexsort((codes, -counts))[:n]]


def _profile_counts(batches):
    """(lang, gram, n) sums of a task; the table of a task is bounded by the 3 * 2**24 possible n-grams."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for lang in sorted(set(langs)):
            rows = pa.array([i for i, x in enumerate(langs) if x == lang], pa.int64())
            data, offsets = text_bytes(b.column(1).take(rows))
            grams, size = [], 0
            for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for g in _grams(data[a:z]):
                    grams.append(g)
                    size += len(g)
                    if size > HELD:
                        held[lang] = _merged(held.get(lang), grams)
                        grams, size = [], 0
            held[lang] = _merged(held.get(lang), grams)
    for lang, (codes, counts) in held.items():
        yield pa.record_batch([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def _merged(sums: tuple[np.ndarray, np.ndarray] | None, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    counted = _count(np.concatenate(grams) if grams else np.zeros(0, np.uint32))
    return _sum(sums, counted) if sums else counted


def fit_profiles(training: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """{language: its most frequent n-grams in order} over all training rows; rows with null text or language do not count."""
    tune(training.sparkSession)
    rows = training.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(lean(_profile_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in sums.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():  # size rows for each language
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """Rank lookup for all languages at once: a row of ranks for every n-gram that some profile holds."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.langs = sorted(profiles)
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], np.uint32))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(profiles[lang], np.uint32)), j] = np.arange(len(profiles[lang]))
        self.size = size

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to every language, scaled to 0..1."""
        at = np.searchsorted(self.codes, own)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == own[known]
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        # a document's own ranks are spread over the profile's length
        place = (np.arange(len(own)) * (self.size / max(len(own), DOCUMENT)))[:, None]
        off = np.where(ranks < 0, self.size, np.abs(ranks - place))
        return off.sum(axis=0) / (self.size * max(len(own), 1))


def _predict(shared):
    def run(batches):
        p = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            letters = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_pylist()
            data, offsets = text_bytes(texts)
            pred, score = [], []
            for has, a, z in zip(letters, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if not has or not p.langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                d = p.distances(ranked(*gram_counts(data[a:z]), DOCUMENT))
                best = int(np.argmin(d))
                pred.append(p.langs[best])
                score.append(float(1 - d[best]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str], text_col: str = "text", size: int = PROFILE, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The ``keep`` columns with lang_pred and score (1 minus the scaled distance, 0 to 1), or these two as named.

    A null text, a text without a letter, or no profile at all gives ``und`` with score 0. Ties go to the first
    language in order. Texts count whole, however long; repeated rows are judged each; an empty table gives no rows.
    A kept column with the name of a result is left out.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(Profiles(profiles, size))
    keep = [c for c in keep if c.lower() not in (pred_col.lower(), score_col.lower())]
    cols = numbered(docs.select(*[quoted(c) for c in keep], quoted(text_col).cast("string")))
    kinds = StructType(cols.schema.fields[:-1]).add("lang_pred", StringType()).add("score", DoubleType())
    return cols.mapInArrow(lean(_predict(shared)), kinds).toDF(*keep, pred_col, score_col)
