"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton holds every run of words of every item. A document's words stream through it, and the state tracks the
longest suffix read so far that some item contains. A suffix of at least ``window`` words is a hit, as is a whole item
of fewer words; the words covered are merged into spans. Items are read in blocks of bounded size, one automaton and
one pass for each block, so the broadcast stays bounded however many items there are. Documents never move: every
pass is a map over the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, numbered, stage_table, tune
from .textbytes import alnum_words

#: Item words in one automaton (about 150 MB in a worker at most).
BLOCK_WORDS = 200_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.step: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]
        whole: list[tuple[int, int]] = []  # (state, item) of items shorter than the window
        for n, (_, words) in enumerate(items):
            at = 0
            for w in words:
                at = self._extend(at, w, ends)
                ends[at].add(n)
            if 0 < len(words) < window:
                whole.append((len(words), n))
        self.names = [name for name, _ in items]
        # items containing a state's strings: those of all states whose suffix links lead to it
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                ends[self.link[v]] |= ends[v]
        self.at_window = [-1] * len(self.link)  # the state of a state's suffix of window words
        self.short: list[tuple] = [()] * len(self.link)  # (length, items) of whole short items that are suffixes
        own: dict[int, list] = {}
        for size, n in whole:
            at = 0
            for w in items[n][1]:
                at = self.step[at][w]
            own.setdefault(at, []).append((size, n))
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[v]
            self.short[v] = self.short[up] + tuple(own.get(v, ()))
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[up] < window else self.at_window[up]
        self.items_at = {v: frozenset(ends[v]) for v in set(self.at_window) if v >= 0}

    def _state(self, length: int, step: dict, link: int, ends: list) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int, ends: list) -> int:
        """The state of p's strings followed by w: q itself, or a clone of the right length."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes, ends: list) -> int:
        if (q := self.step[last].get(w)) is not None:
            return self._split(last, w, q, ends)
        new = self._state(self.length[last] + 1, {}, 0, ends)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.step[p][w], ends)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged spans of hit words, names of items hit)."""
        step, link, length, window = self.step, self.link, self.length, self.window
        v = size = 0
        spans, hit = [], set()
        for i, w in enumerate(words):
            to = step[v].get(w)
            while to is None and v:
                v = link[v]
                size = length[v]
                to = step[v].get(w)
            if to is None:
                continue
            v = to
            size += 1
            if size >= window:
                spans.append((i - window + 1, i + 1))
                hit.add(self.at_window[v])
            if self.short[v]:
                for n, item in self.short[v]:
                    if n <= size:
                        spans.append((i - n + 1, i + 1))
                        hit.add(-2 - item)
        if not spans:
            return [], set()
        names = set()
        for h in hit:
            names.update([self.names[-2 - h]] if h < -1 else (self.names[n] for n in self.items_at[h]))
        return merge_spans(spans), names


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, words = [], 0
    for name, text in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string")).toLocalIterator():
        block.append((name, alnum_words(text)))
        words += len(block[-1][1])
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    yield block


_HITS = "n_words long, starts array<long>, ends array<long>, items array<string>"


def _scan(shared):
    def run(batches):
        automaton = shared.value
        for b in batches:
            n_words, starts, ends, items = [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                words = alnum_words(t)
                spans, names = automaton.scan(words)
                n_words.append(len(words))
                starts.append([a for a, _ in spans])
                ends.append([z for _, z in spans])
                items.append(sorted(names))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], [*b.schema.names, "n_words", "starts", "ends", "items"])

    return run


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the bytes from the first to the last word of each span."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for a, z in spans:
        out.append(raw[last : at[a][0]])
        last = at[z - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, starts and ends of hit spans (in words, merged), items (sorted names).

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z; a null or empty text has none. An
    item with fewer words than the window counts as one window, an item without words as none. Items equal in text are
    all named. Repeated rows are judged each on their own; empty tables on either side give no hits.
    """
    spark = docs.sparkSession
    tune(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(items, item_col, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(SuffixAutomaton(first, window))
        return base.mapInArrow(lean(_scan(shared)), f"doc_id {kind}, text string, {_HITS}").drop("text")
    # every pass reads the same written rows, so that row numbers agree whatever the input's plan
    texts = stage_table(base.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text"), "rows")
    rows = None
    for block in chain([first, second], blocks):
        shared = spark.sparkContext.broadcast(SuffixAutomaton(block, window))
        found = stage_table(texts.mapInArrow(lean(_scan(shared)), f"row long, doc_id {kind}, text string, {_HITS}").drop("text"), "hits")
        rows = found if rows is None else rows.unionByName(found)
        shared.unpersist()
    return _merged(rows, kind)


def _merged(rows: DataFrame, kind: str) -> DataFrame:
    """The union of the spans of several passes, by row."""
    one = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches):
        for b in batches:
            cols = b.to_pydict()
            spans = [merge_spans(list(zip(a, z, strict=True))) for a, z in zip(cols["starts"], cols["ends"], strict=True)]
            cols |= {"starts": [[a for a, _ in s] for s in spans], "ends": [[z for _, z in s] for s in spans]}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(cols[c], pa.list_(pa.int64())) for c in ("starts", "ends")], b.column(4)], ["doc_id", "n_words", "starts", "ends", "items"])

    return one.select("doc_id", "n_words", "starts", "ends", "items").mapInArrow(lean(run), f"doc_id {kind}, {_HITS}")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, min_span: int = 1, max_coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs without benchmark passages, with the same columns, whatever their names.

    Spans of at least min_span hit words are cut out of the text (and length_col, where it exists, is set to the new
    number of characters); a document of whose words more than max_coverage are hit goes altogether. Documents without
    hits, null and empty texts included, pass unchanged.
    """
    spark = docs.sparkSession
    tune(spark)
    columns = docs.columns
    plain = numbered(docs)
    text = plain.columns[columns.index(text_col)]
    blocks = _blocks(items, item_col, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        marked = plain.withColumn("_cut", F.lit(False))
        shared = spark.sparkContext.broadcast(SuffixAutomaton(first, window))
        out = marked.mapInArrow(lean(_clean(shared, columns.index(text_col), min_span, max_coverage)), marked.schema)
    else:
        out = _clean_by_blocks(plain, lambda: _blocks(items, item_col, item_text), window, min_span, max_coverage, text)
    if length_col in columns:
        length = plain.columns[columns.index(length_col)]
        fresh = F.char_length(F.col(text)).cast(plain.schema[length].dataType)
        out = out.withColumn(length, F.when(F.col("_cut"), fresh).otherwise(F.col(length)))
    return out.select(*plain.columns).toDF(*columns)


def _clean(shared, at: int, min_span: int, max_coverage: float):
    def run(batches):
        automaton = shared.value
        for b in batches:
            texts, keep = b.column(at).to_pylist(), []
            cut = b.column(b.num_columns - 1).to_pylist()
            for i, t in enumerate(texts):
                words = alnum_words(t)
                spans, _ = automaton.scan(words)
                if spans and sum(z - a for a, z in spans) > max_coverage * len(words):
                    continue
                keep.append(i)
                while spans := [s for s in spans if s[1] - s[0] >= min_span]:  # a cut may join the ends of another passage
                    texts[i] = _without(texts[i], spans)
                    cut[i] = True
                    spans, _ = automaton.scan(alnum_words(texts[i]))
            cols = [pa.array(texts, b.schema.field(at).type) if j == at else c for j, c in enumerate(b.columns)]
            cols[-1] = pa.array(cut, pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names).take(pa.array(keep, pa.int64()))

    return run


def _clean_by_blocks(docs: DataFrame, blocks: Callable[[], Iterator], window: int, min_span: int, max_coverage: float, text_col: str) -> DataFrame:
    """docs with _cut as _clean leaves them, for items of several blocks: each round's spans are the union over all blocks."""
    spark = docs.sparkSession
    rows = stage_table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    texts = rows.select("_row", F.col(f"`{text_col}`").cast("string").alias("_text"))
    done, limit = None, max_coverage
    while True:
        hits = None
        for block in blocks():
            shared = spark.sparkContext.broadcast(SuffixAutomaton(block, window))
            found = texts.mapInArrow(lean(_scan(shared)), f"_row long, _text string, {_HITS}").where(F.size("starts") > 0).select("_row", "n_words", "starts", "ends")
            found = stage_table(found, "hits")
            hits = found if hits is None else hits.unionByName(found)
            shared.unpersist()
        hits = hits.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
        fresh = hits.join(texts, "_row").select("_row", "n_words", "starts", "ends", "_text").mapInArrow(lean(_cut_union(min_span, limit)), "_row long, _gone boolean, _text string")
        fresh = stage_table(fresh, "cut-texts")
        done = fresh if done is None else done.join(fresh.select("_row"), "_row", "left_anti").unionByName(fresh)
        texts, limit = fresh.where("not _gone").select("_row", "_text"), None  # a cut may join the ends of another passage
        if texts.isEmpty():
            break
    out = rows.join(done, "_row", "left").where("_gone is null or not _gone").withColumn("_cut", F.col("_gone").isNotNull())
    kind = docs.schema[text_col].dataType
    return out.withColumn(text_col, F.when(F.col("_cut"), F.col("_text").cast(kind)).otherwise(F.col(f"`{text_col}`")))


def _cut_union(min_span: int, max_coverage: float | None):
    """(row, gone, text) of the rows that go, by coverage where a limit is given, or that lose spans."""

    def run(batches):
        for b in batches:
            out = []
            for row, n, a, z, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = merge_spans(list(zip(a, z, strict=True)))
                if max_coverage is not None and sum(y - x for x, y in spans) > max_coverage * n:
                    out.append((row, True, None))
                elif spans := [s for s in spans if s[1] - s[0] >= min_span]:
                    out.append((row, False, _without(text, spans)))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.bool_(), pa.string()))], ["_row", "_gone", "_text"])

    return run
