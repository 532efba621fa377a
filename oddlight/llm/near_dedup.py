"""Near-duplicate classes: MinHash bands for candidates, Odd sketches to screen them, full shingle sets to confirm.

1. A kernel shingles every whole text and keeps, per document, the digest of its shingle set, 32 band keys of 4 MinHash
   values, and an Odd sketch: the 128 MinHash values folded into a parity bitmap, whose XOR population count between two
   documents estimates a high similarity closely.
2. Documents with the same set become one class, so copies cost one row each from here on.
3. Classes that share a band key are candidates. In rounds over sets of bands, the members of a bucket that still belong
   to several components meet in cells of bounded size: a bucket is dealt into blocks (each also sees the bucket's first
   member), which joins nearly everything at the cost of one copy of each row. A cell compares sketches, confirms passing
   pairs on the full sets, and returns a spanning forest of the links, never the pairs. In the last round the buckets of
   all bands are screened whole by sketches alone; components with likely pairs between them become a family, and within
   a family the members outside its largest component meet all the others once, with their sets: no link is lost.
4. After every round the forest is contracted by distributed connected components.

A pair at the threshold shares no band with probability (1 - 0.8^4)^32 < 1e-7. Full sets are only gathered for classes
in shared buckets, picked out in a second scan by a Bloom filter of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop_table, lean, lean_group, stage_table, tune
from .textbytes import fmix, hashed_words

BANDS, ROWS, SKETCH_BITS = 32, 4, 512
SAMPLES = BANDS * ROWS
#: Members in a block, where full sets are compared and where sketches are.
BLOCK, SCREEN_BLOCK = 256, 1024
#: Bands of the rounds before the last, which takes all.
ROUNDS = ((0, 2), (2, 10))
#: A sketch estimate this far below the threshold (4.5 standard deviations) still goes to the exact check.
SLACK = 0.16
BLOOM_MAX_BITS = 1 << 28
BLOOM_TASKS = 16
#: Pairs of a cell held at a time.
PAIRS = 1 << 18

_rng = np.random.default_rng(8131)
_MUL = (_rng.integers(1, 2**32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_ODD = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; a shorter text is one shingle."""
    h, at = hashed_words(texts)
    n = len(h)
    mixed = np.zeros(n, np.uint64)
    for i in range(k):
        mixed[: max(n - i, 0)] += fmix(h[i:] * _ODD[i])
    mixed = fmix(mixed)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(mixed[a : b - k + 1]))
        elif b > a:
            out.append(np.array([int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64))
        else:
            out.append(h[:0])
    return out


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def min_hashes(s: np.ndarray) -> np.ndarray:
    """SAMPLES minima of multiply-add permutations of the folded hashes."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        y = x[i : i + 4096, None] * _MUL
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x85EBCA6B)
        np.minimum(low, (y + _ADD).min(axis=0), out=low)
    return low


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = fmix(key ^ (rows[:, i] * _ODD[i] + _ODD[i + ROWS]))
    return key.view(np.int64)


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity of the number of (sample number, sample) pairs that fall on each bit, packed into 64-bit words."""
    cell = (fmix(m.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = (np.bincount(cell, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view("<u8")


def sketch_similarity(differing: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from the number of differing bits."""
    share = np.minimum(2 * differing / SKETCH_BITS, 0.999999)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log1p(-share)


def _signatures(k: int):
    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(b.num_columns - 1), k)
            digest, bands, sketch = [], [], []
            for s in sets:
                if len(s):
                    m = min_hashes(s)
                    digest.append(set_digest(s))
                    bands.append(band_keys(m))
                    sketch.append(odd_sketch(m).tobytes())
                else:
                    digest.append(None)
                    bands.append(np.zeros(0, np.int64))
                    sketch.append(None)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            values = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(sketch, pa.binary())], [*b.schema.names[:-1], "n_shingles", "digest", "bands", "sketch"])

    return run


def _bloom_cells(digests: list[bytes], bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return ((raw[:, :1] + raw[:, 1:] * np.arange(3, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _bloom(needed: DataFrame):
    """Broadcast bitmap of the needed digests: 10 bits for each, never more than BLOOM_MAX_BITS (32 MB)."""
    bits = 1 << 16
    while bits < min(10 * needed.count(), BLOOM_MAX_BITS):
        bits *= 2

    def fill(batches):
        on = np.zeros(bits // 8, np.uint8)
        for b in batches:
            if b.num_rows:
                c = _bloom_cells(b.column(0).to_pylist(), bits).ravel()
                np.bitwise_or.at(on, c >> 3, (128 >> (c & 7)).astype(np.uint8))
        yield pa.record_batch([pa.array([on.tobytes()], pa.binary())], ["bitmap"])

    def union(batches):
        on = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for raw in b.column(0):
                on |= np.frombuffer(raw.as_buffer(), np.uint8)
        yield pa.record_batch([pa.array([on.tobytes()], pa.binary())], ["bitmap"])

    # a bitmap for each task, filled in parallel; one task joins them and the driver gets one
    parts = needed.select("digest").coalesce(BLOOM_TASKS).mapInArrow(lean(fill), "bitmap binary")
    row = parts.repartition(1).mapInArrow(lean(union), "bitmap binary").first()
    return needed.sparkSession.sparkContext.broadcast((bits, bytes(row["bitmap"])))


def _needed_sets(k: int, shared):
    def run(batches):
        bits, raw = shared.value
        on = np.frombuffer(raw, np.uint8)
        sent: set[bytes] = set()  # copies within a task are sent once
        for b in batches:
            digests, sets = [], []
            for s in shingle_sets(b.column(0), k):
                if len(s):
                    d = set_digest(s)
                    if d in sent:
                        continue
                    c = _bloom_cells([d], bits)[0]
                    if (on[c >> 3] >> (7 - (c & 7)) & 1).all():
                        sent.add(d)
                        digests.append(d)
                        sets.append(s.tobytes())
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "hashes"])

    return run


def _intersections(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of many pairs at once, by products of 0/1 blocks of the cell's shingles."""
    vocabulary, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(vocabulary), 8192):
        a, b = np.searchsorted(place, [at, at + 8192])
        block = np.zeros((len(sets), 8192), np.float32)
        block[owner[a:b], place[a:b] - at] = 1
        total += block @ block.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def likely_chunks(comps: np.ndarray, sketches: np.ndarray, percent: int):
    """Pairs of members of different components whose sketches are close enough, at most about PAIRS at a time."""
    close = sketch_similarity(np.arange(SKETCH_BITS + 1)) >= percent / 100 - SLACK
    n = len(comps)
    step = max(1, PAIRS // max(n, 1))
    for at in range(0, n, step):
        mine = slice(at, min(at + step, n))
        diff = np.zeros((mine.stop - at, n - at), np.uint16)  # the members before have met all the others
        for w in range(sketches.shape[1]):
            diff += np.bitwise_count(sketches[mine, None, w] ^ sketches[None, at:, w])
        pairs = np.argwhere(np.triu(close[diff], 1) & (comps[mine, None] != comps[None, at:])) + at
        if len(pairs):
            yield pairs


def link_cell(nodes: np.ndarray, comps: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest, over components, of the confirmed links between members of different components."""
    size = np.array([len(s) for s in sets])
    found = []
    for pairs in likely_chunks(comps, sketches, percent):
        x, y = size[pairs[:, 0]], size[pairs[:, 1]]
        found.append(pairs[100 * np.minimum(x, y) >= percent * np.maximum(x, y)])  # sizes alone rule out the rest
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(pairs):
        return []
    if len(pairs) <= 64:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs.tolist()])
    else:
        used = np.unique(pairs)
        common = _intersections([sets[i] for i in used.tolist()], np.searchsorted(used, pairs))
    linked = pairs[100 * common >= percent * (size[pairs[:, 0]] + size[pairs[:, 1]] - common)]
    return _forest(comps, linked)


def _forest(comps: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Stars that span the components which pairs of members join."""
    names, ends = np.unique(comps[pairs], return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    low = np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    rest = np.flatnonzero(low != np.arange(len(names)))
    return list(zip(names[low[rest]].tolist(), names[rest].tolist(), strict=True))


def _sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sketch"].to_pylist()), "<u8").reshape(-1, SKETCH_BITS // 64)


def _edges(forest: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in forest], pa.int64()), "b": pa.array([b for _, b in forest], pa.int64())})


def _screen(percent: int):
    """Components in a cell that likely pairs join; only the sketches are needed."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        comps = t["comp"].to_numpy()
        edges: list[tuple[int, int]] = []
        for pairs in likely_chunks(comps, _sketches(t), percent):
            edges += _forest(comps, pairs)  # fewer links than members for each chunk of pairs
        return _edges(list(set(edges)))

    return run


def _link(percent: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.uint64) for s in t["hashes"].to_pylist()]
        return _edges(link_cell(t["node"].to_numpy(), t["comp"].to_numpy(), _sketches(t), sets, percent))

    return run


def _cells(members: DataFrame, whole: bool, size: int) -> DataFrame:
    """(band, i, j, node, comp): members of buckets with several components, dealt into cells of bounded size.

    Dealt, a bucket's members meet within their block and with its first member; whole, every pair of members of
    different components meets in some cell.
    """
    stats = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    open_ = members.join(stats.select("band", F.ceil(F.col("n") / size).cast("int").alias("blocks")), "band")
    block = F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")
    small = open_.where("blocks = 1").select("band", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "comp")
    large = open_.where("blocks > 1").withColumn("block", block)
    if not whole:
        first = large.groupBy("band").agg(F.max("blocks").alias("blocks"), F.min("node").alias("node"))
        first = first.join(members, ["band", "node"]).select("band", "comp", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
        dealt = large.select("band", F.col("block").alias("i"), F.lit(0).alias("j"), "node", "comp")
        return small.unionByName(dealt).unionByName(first.select("band", "i", F.lit(0).alias("j"), "node", "comp")).distinct()
    # members outside the bucket's largest component meet every block; (i, j) is (outsiders' block, other block)
    sizes = large.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    large = large.join(main, "band")
    outside = large.where("comp <> main").select("band", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "comp")
    rows = large.where("comp <> main").select("band", F.col("block").alias("i")).distinct()
    other = large.join(rows, "band").select("band", "i", F.col("block").alias("j"), "node", "comp")
    return small.unionByName(outside).unionByName(other).distinct()


def _with_roots(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _joined(forest: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Roots after more links between components; the stars of the components so far are links as well."""
    forest = stage_table(forest, "forest")
    stars = [] if roots is None else [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
    out = components(forest.unionByName(stars[0]) if stars else forest)
    drop_table(forest)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per document: row, doc_id, n_shingles, component_id, kept, first_row.

    Words are runs of non-white-space after lower-casing A-Z; a text's set holds its distinct shingles of ``shingle``
    words, or its whole word sequence if that is shorter. Documents with 100 * intersection >= percent * union are
    linked; component_id is the smallest doc_id reachable. A text without words, or null, is linked with nothing: its
    component is its own doc_id. row is row_col, a unique long, or else a number given here. kept is doc_id = component_id; first_row marks one row of each component even where
    doc_ids repeat (null ids rank last). Empty tables give no rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    text = docs.select(*([F.col(row_col).alias("row")] if row_col else []), *cols)
    signed = text.mapInArrow(lean(_signatures(shingle)), ("row long, " if row_col else "") + "id long, n_shingles long, digest binary, bands array<long>, sketch binary")
    signed = stage_table(signed if row_col else signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"))
    classes = stage_table(classes, "classes")
    rep = signed.select("row", "bands", "sketch").join(classes.select(F.col("node").alias("row"), "digest"), "row")
    rep = stage_table(rep.select(F.col("row").alias("node"), "digest", "sketch", "bands"), "representatives")

    banded = rep.select("node", F.posexplode("bands").alias("no", "band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    # written apart from its shuffle, so that adaptive execution may split a hot band in the join
    shared = stage_table(shared, "shared-bands")
    banded = stage_table(banded.join(shared, "band"), "buckets")  # only buckets with company
    drop_table(shared)
    needed = stage_table(banded.select("node").distinct().join(rep.select("node", "digest", "sketch"), "node"), "needed")
    bloom = _bloom(needed)
    sets = text.select("text").mapInArrow(lean(_needed_sets(shingle, bloom)), "digest binary, hashes binary")
    sets = stage_table(needed.join(sets.groupBy("digest").agg(F.first("hashes").alias("hashes")), "digest").select("node", "sketch", "hashes"), "sets")
    drop_table(needed)

    roots = None  # (node, root) so far
    for lo, hi in ROUNDS:
        members = stage_table(_with_roots(banded.where(F.col("no").between(lo, hi - 1)).select("band", "node").distinct(), roots), "members")
        forest = _cells(members, False, BLOCK).join(sets, "node").groupBy("band", "i", "j").applyInArrow(lean_group(_link(percent), 1 << 18), "a long, b long")
        roots = _joined(forest, roots)
        drop_table(members)
    # the last round: components that likely pairs of any band join are one family, and within a family no pair is left out
    members = stage_table(_with_roots(banded.select("band", "node").distinct(), roots), "members")
    likely = _cells(members, True, SCREEN_BLOCK).join(sets.select("node", "sketch"), "node").groupBy("band", "i", "j").applyInArrow(lean_group(_screen(percent), 1 << 15), "a long, b long")
    families = components(stage_table(likely, "likely"))
    heads = families.select(F.col("node").alias("comp"), F.col("root").alias("band")).unionByName(families.select(F.col("root").alias("comp"), F.col("root").alias("band")).distinct())
    kin = stage_table(_with_roots(sets.select("node"), roots).join(heads, "comp").select("band", "node", "comp"), "kin")
    forest = _cells(kin, True, BLOCK).join(sets, "node").groupBy("band", "i", "j").applyInArrow(lean_group(_link(percent), 1 << 18), "a long, b long")
    roots = _joined(forest, roots)
    drop_table(members)
    drop_table(kin)
    drop_table(banded)
    drop_table(sets)
    drop_table(rep)

    named = classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    rows = signed.select("row", F.col("id").alias("doc_id"), "n_shingles", "digest").join(named, "digest", "left")
    rows = stage_table(rows.withColumn("component", F.coalesce("component", F.col("row"))), "classified")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    out = rows.join(stage_table(best, "component-heads"), "component")  # hot components split likewise
    return out.select("row", "doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("best.doc_id"), F.lit(False)).alias("kept"), (F.col("row") == F.col("best.row")).alias("first_row"))
