"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their first four and five bytes. The terms of the examples that mark toxic texts beyond chance, by
their counts over all labelled rows, form the vocabulary, and every example becomes a TF-IDF vector of unit length over
it. For labels of a given balance the number of toxic rows that makes a term a mark is the same at any size of the data. The index keeps, for each
term, its postings in blocks of neighbouring examples with the block's largest weight. A query bounds every block by
these maxima, scores blocks from the highest bound down, and stops where no block can reach the k-th best cosine, so
the neighbours are exact. Votes weighted by cosine are turned into probabilities by an isotonic map fitted on
leave-one-out votes of the examples; the neighbours are returned as evidence.

The examples are a bounded sample of labelled rows (``max_examples`` of each label, by hash order, re-weighted to the
label's share over all rows); all terms are theirs, so vocabulary and index are of bounded size and can be broadcast. Every document is
scored over its whole text by a map over the scan.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .near_dedup import shingle_sets
from .shared import drop_table, lean, numbered, quoted, stage_table, tune
from .textbytes import alnum_words

#: Labelled rows of each label that examples are drawn from, neighbours that vote, and terms counted by a task before it
#: passes them on.
MAX_EXAMPLES, NEIGHBOURS, HELD = 8192, 25, 1 << 18
#: A term counts as a mark if its log odds over all labelled rows are so many standard errors above zero, so large, and
#: in so many rows.
MIN_Z, MIN_LIFT, MIN_DF = 3.0, 1.0, 3
BLOCK = 64
#: Ids of labelled rows that are broadcast (64 MB).
MAX_IDS = 1 << 23


def terms_of(text: str | None) -> Counter:
    """Counts of a text's terms: words as they are, beginnings with a byte that no word has."""
    out: Counter = Counter()
    for w, n in Counter(alnum_words(text)).items():
        out[w] += n
        if len(w) >= 4:
            out[b"\x04" + w[:4]] += n
            if len(w) >= 5:
                out[b"\x05" + w[:5]] += n
    return out


def _signatures(batches):
    """(id, signature): the two least hashes of a text's three-word shingles, which near copies mostly share."""
    for b in batches:
        sig = [s[:2].tobytes() for s in shingle_sets(b.column(1), 3)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.binary())], ["id", "sig"])


def _term_rows(batches):
    """(term, rows, toxic rows) of a task, passed on whenever HELD distinct terms are held."""
    clean, toxic = Counter(), Counter()
    for b in batches:
        for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            (toxic if y else clean).update(terms_of(t).keys())
            if len(clean) + len(toxic) > HELD:
                yield from _term_batches(clean, toxic)
                clean, toxic = Counter(), Counter()
    yield from _term_batches(clean, toxic)


def _labelled_rows(shared):
    """The rows (id, label, text) of a scan of (id, text) whose id is in the label's ascending ids; a row may have both."""

    def run(batches):
        for b in batches:
            at = np.asarray(b.column(0), np.int64)
            for y, ids in enumerate(shared.value):
                hit = np.flatnonzero(ids[np.minimum(np.searchsorted(ids, at), len(ids) - 1)] == at) if len(ids) else ()
                if len(hit):
                    hit = pa.array(hit)
                    yield pa.record_batch([b.column(0).take(hit), pa.array([y] * len(hit), pa.int32()), b.column(1).take(hit)], ["id", "label", "text"])

    return run


def _with_labels(texts: DataFrame, single: DataFrame, rows: int) -> DataFrame:
    """texts (id, text) joined with single (id, label) by id. Up to MAX_IDS rows of single go to the texts as two sorted
    arrays, 8 bytes a row, so that no text is shuffled; beyond, Spark joins them."""
    if rows > MAX_IDS:
        return texts.join(single, "id").select("id", "label", "text")
    t = single.toArrow()
    ids, label = np.asarray(t["id"], np.int64), np.asarray(t["label"])
    shared = texts.sparkSession.sparkContext.broadcast([np.sort(ids[label == y]) for y in (0, 1)])
    return texts.where("id is not null").mapInArrow(lean(_labelled_rows(shared)), "id long, label int, text string")


def _term_batches(clean: Counter, toxic: Counter):
    terms = list(clean.keys() | toxic.keys())
    for at in range(0, len(terms), 65_536):
        part = terms[at : at + 65_536]
        n1 = [toxic[t] for t in part]
        yield pa.record_batch([pa.array(part, pa.binary()), pa.array([clean[t] + n for t, n in zip(part, n1, strict=True)], pa.int64()), pa.array(n1, pa.int64())], ["term", "n", "n1"])


def _example_terms(batches):
    for b in batches:
        node, label, term, tf = [], [], [], []
        for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            counts = terms_of(t)
            node += [i] * len(counts)
            label += [y] * len(counts)
            term += counts.keys()
            tf += counts.values()
        yield pa.record_batch([pa.array(node, pa.int64()), pa.array(label, pa.int32()), pa.array(term, pa.binary()), pa.array(tf, pa.int64())], ["id", "label", "term", "tf"])


class BlockMaxIndex:
    """Exact top-k cosine search over unit vectors, sparse on both sides."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> None:
        self.n = len(vectors)
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((owner, term))
        self.doc, self.weight, term = owner[order], weight[order], term[order]
        block = self.doc // BLOCK
        head = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.begin, self.end = head, np.append(head[1:], len(term)).astype(np.int64)
        self.block = block[head]
        self.best = np.maximum.reduceat(self.weight, head) if len(head) else np.zeros(0)
        self.at = np.searchsorted(term[head], np.arange(terms + 1))  # a term's segments
        self.blocks = -(-self.n // BLOCK)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, cosines) of the k nearest with a cosine above zero; ties go to the lower number."""
        lo, hi = self.at[terms], self.at[terms + 1]
        segments = _ranges(lo, hi)
        if not len(segments):
            return np.zeros(0, np.int64), np.zeros(0)
        q = np.repeat(weights, hi - lo)
        bound = np.bincount(self.block[segments], self.best[segments] * q, minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound)]
        found, cosine = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 16
        while at < len(order):
            now = order[at : at + step]
            if len(found) >= k:
                now = now[bound[now] >= cosine[k - 1] - 1e-12]
                if not len(now):
                    break
            chosen = np.zeros(self.blocks, bool)
            chosen[now] = True
            mine = chosen[self.block[segments]]
            s = segments[mine]
            p = _ranges(self.begin[s], self.end[s])
            score = np.bincount(self.doc[p], self.weight[p] * np.repeat(q[mine], self.end[s] - self.begin[s]), minlength=self.n)
            docs = np.flatnonzero(score)
            found, cosine = np.concatenate([found, docs]), np.concatenate([cosine, score[docs]])
            keep = np.lexsort((found, -cosine))[:k]
            found, cosine = found[keep], cosine[keep]
            at, step = at + step, 2 * step
        return found, cosine


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing weighted fit (pool adjacent violators): block means of x and fitted values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == a:
            blocks[-1] = [blocks[-1][0] + a * c, blocks[-1][1] + b * c, blocks[-1][2] + c, a]
        else:
            blocks.append([a * c, b * c, c, a])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2], last[3]]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class NeighbourModel:
    """Vocabulary, index and calibration; plain arrays, so that it can be broadcast."""

    def __init__(self, terms: list[bytes], df: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weight: tuple[float, float], k: int) -> None:
        """examples: (id, label, term numbers, term counts), the last two empty where no term of the vocabulary occurs."""
        self.place = {t: i for i, t in enumerate(terms)}
        self.idf = np.log((1 + len(examples)) / (1 + df)) + 1
        self.k = k
        filled = [(i, y, self.vector(t, n)) for i, y, t, n in examples if len(t)]
        # neighbours share their heaviest term, so that block maxima are tight
        filled.sort(key=lambda e: (int(e[2][0][np.argmax(e[2][1])]), e[0]))
        self.ids = np.array([i for i, _, _ in filled], np.int64)
        self.labels = np.array([y for _, y, _ in filled], np.int64)
        self.weight = np.array(weight)
        self.index = BlockMaxIndex([v for _, _, v in filled], len(terms))
        empty = np.array([y for _, y, t, _ in examples if not len(t)], np.int64)
        mass = self.weight[empty].sum()
        self.blank = float((self.weight[empty] * empty).sum() + 0.5) / float(mass + 1)
        every = np.array([y for _, y, _, _ in examples], np.int64)
        self.prior = float((self.weight[every] * every).sum() / max(self.weight[every].sum(), 1e-9)) if len(every) else 0.0
        raw = np.array([self.vote(*self._without(j, *self.index.search(*v, k + 1))) for j, (_, _, v) in enumerate(filled)])
        self.x, self.y = isotonic(raw, self.labels.astype(float), self.weight[self.labels]) if filled else (np.zeros(1), np.full(1, self.prior))

    @staticmethod
    def _without(j: int, found: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = found != j
        return found[other], cosine[other]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(terms)
        terms = terms[order].astype(np.int64)
        w = (1 + np.log(counts[order])) * self.idf[terms]
        return terms, w / math.sqrt(float((w * w).sum()))

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic votes, each weighted by squared cosine and label weight, with one vote of the prior."""
        w = cosine[: self.k] ** 2 * self.weight[self.labels[found[: self.k]]]
        return float(((w * self.labels[found[: self.k]]).sum() + self.prior) / (w.sum() + 1))

    def counts(self, text: str | None) -> dict[int, int]:
        get, out = self.place.get, {}
        for w, n in Counter(alnum_words(text)).items():
            if (i := get(w)) is not None:
                out[i] = out.get(i, 0) + n
            if len(w) >= 4:
                if (i := get(b"\x04" + w[:4])) is not None:
                    out[i] = out.get(i, 0) + n
                if len(w) >= 5 and (i := get(b"\x05" + w[:5])) is not None:
                    out[i] = out.get(i, 0) + n
        return out

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        tf = self.counts(text)
        if not tf or not len(self.ids):
            return (self.blank if len(self.ids) else self.prior), []
        found, cosine = self.index.search(*self.vector(np.array(list(tf)), np.array(list(tf.values()))), self.k)
        value = float(np.interp(self.vote(found, cosine), self.x, self.y))
        return value, [{"doc_id": int(self.ids[i]), "cosine": float(c), "toxic": int(self.labels[i])} for i, c in zip(found[:5], cosine[:5], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> NeighbourModel:
    """Fit on at most max_examples rows of either label; ``labels`` must hold training rows only.

    Rows with a null id or label do not count; an id that is labelled or occurs several times gives several examples.
    """
    spark = docs.sparkSession
    tune(spark)
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [clean.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(max_examples) for y in (0, 1)]
    sample = stage_table(chosen[0].unionByName(chosen[1]), "examples")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # of near copies with one label a single row counts, or one much-copied text would set the vocabulary
    signed = texts.where("id is not null").mapInArrow(lean(_signatures), "id long, sig binary").join(clean.distinct(), "id")
    signed = stage_table(signed, "signatures")
    single = stage_table(signed.groupBy("label", "sig").agg(F.min("id").alias("id")).select("id", "label"), "single-rows")
    n = {r["label"]: r["n"] for r in single.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = max(n.get(0, 0), 1), max(n.get(1, 0), 1)
    counted = _with_labels(texts, single, sum(n.values())).mapInArrow(lean(_term_rows), "term binary, n long, n1 long")
    # at most 2 * max_examples rows are broadcast
    sample = signed.join(F.broadcast(sample.distinct()), ["id", "label"]).groupBy("label", "sig").agg(F.min("id").alias("id"))
    sample = stage_table(sample.select("id", "label"), "single-examples")
    long = stage_table(texts.join(F.broadcast(sample), "id").select("id", "label", "text").mapInArrow(lean(_example_terms), "id long, label int, term binary, tf long"), "example-terms")
    a, b = F.col("n1") + 0.5, F.col("n") - F.col("n1") + 0.5
    odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
    error = F.sqrt(1 / a + 1 / b + 1 / (n1 + 1 - a) + 1 / (n0 + 1 - b))
    terms = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= MIN_DF)
    terms = terms.where((odds / error >= MIN_Z) & (odds >= MIN_LIFT))
    marks = long.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(terms, "term").select("term", "df").orderBy("term").toArrow()  # terms of the examples
    vocabulary = marks["term"].to_pylist()
    place = spark.createDataFrame([(t, i) for i, t in enumerate(vocabulary)], "term binary, place int")
    hits = long.join(F.broadcast(place), "term").groupBy("id", "label").agg(F.collect_list(F.struct("place", "tf")).alias("x"))
    # the vocabulary's terms of the examples, no more; as Arrow columns, which stay compact on the driver
    found = hits.select("id", "label", "x.place", "x.tf").toArrow()
    rows = [(i, y, np.asarray(t.values), np.asarray(n.values)) for i, y, t, n in zip(found["id"].to_pylist(), found["label"].to_pylist(), found["place"], found["tf"], strict=True)]
    have = {(i, y) for i, y, _, _ in rows}
    none = np.zeros(0, np.int64)
    rows += [(r["id"], r["label"], none, none) for r in sample.collect() if (r["id"], r["label"]) not in have]
    rows.sort(key=lambda r: r[:2])
    drop_table(long)
    drop_table(signed)
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = (total.get(0, 0) / max(n.get(0, 0), 1), total.get(1, 0) / max(n.get(1, 0), 1))
    return NeighbourModel(vocabulary, np.asarray(marks["df"], float), rows, weight, k)


_EVIDENCE = ArrayType(StructType().add("doc_id", "long").add("cosine", "double").add("toxic", "integer"))


def score(docs: DataFrame, model: NeighbourModel, keep: list[str], text_col: str = "text", score_col: str = "score", evidence_col: str = "evidence") -> DataFrame:
    """The ``keep`` columns with score (0 to 1) and evidence (up to five nearest examples), or these two as named.

    A text without any vocabulary term, so every null or empty one, gets the toxic share of such examples and no
    evidence. Without examples every score is 0. Repeated rows are scored each; an empty table gives no rows. A kept
    column with the name of a result is left out.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in keep if c.lower() not in (score_col.lower(), evidence_col.lower())]
    cols = numbered(docs.select(*[quoted(c) for c in keep], quoted(text_col).cast("string")))
    kinds = StructType(cols.schema.fields[:-1]).add("score", "double").add("evidence", _EVIDENCE)

    def run(batches):
        m = shared.value
        for b in batches:
            out = [m.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            evidence = pa.array([e for _, e in out], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([s for s, _ in out], pa.float64()), evidence], [*b.schema.names[:-1], "score", "evidence"])

    return cols.mapInArrow(lean(run), kinds).toDF(*keep, score_col, evidence_col)
