"""Exact deduplication against a minimal perfect hash over historical distinct digests.

1. A kernel takes the SHA-256 of every whole text without white space; the digests are written once.
2. The distinct digests of the history become hash partitions of bounded size. In each, a minimal perfect hash of
   cascading bitmaps is built: a key goes to the first level where it is alone in its cell, and the rank of that cell
   is its slot. A slot holds the full digest, the winner's row locator and id, and the group's size.
3. Every document is looked up in its partition and its digest compared byte by byte with the slot's. A perfect hash
   sends nonmembers to some slot too; the comparison exposes them, and they are grouped among themselves.

A partition that many documents ask for is split by salt and its (small) index copied, so one text that makes up a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, lean, shuffle_parts, stage_table, tune

#: Distinct digests per index partition (about 2 MB), and bounds of the documents per lookup task.
SLOTS, LOOKUPS, LEAST_LOOKUPS = 32_768, 65_536, 1024
_LEVELS, _GAMMA = 48, 1.5
_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def _digests(batches):
    for b in batches:
        text = b.column(b.num_columns - 1).fill_null("")
        sha = [hashlib.sha256(t.translate(None, _WHITE)).digest() for t in text.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pc.cast(pc.utf8_length(text), pa.int64()), pa.array(sha, pa.binary())], [*b.schema.names[:-1], "chars", "digest"])


def digest_table(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """Staged (row, id, chars, digest); row is row_col, a unique long, or else made here."""
    tune(docs.sparkSession)
    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    if row_col:
        rows = docs.select(F.col(row_col).alias("row"), *cols).mapInArrow(lean(_digests), "row long, id long, chars long, digest binary")
    else:
        rows = docs.select(*cols).mapInArrow(lean(_digests), "id long, chars long, digest binary").withColumn("row", F.monotonically_increasing_id())
    return stage_table(rows, "digests")


def _winners(digests: DataFrame) -> DataFrame:
    """A row per distinct digest; partial aggregation runs before the shuffle, so copies are cheap."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "row"))
    return digests.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select("digest", F.col("best.row").alias("keep_row"), F.col("best.id").alias("keep_id"), "n")


def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = keys[:, 0] ^ (keys[:, 1] * np.uint64(2 * level + 1) + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def _keys(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)
    return raw, raw.view("<u8")[:, :2]


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests; nonmembers get an arbitrary slot or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray, extra: np.ndarray) -> None:
        self.sizes, self.bits, self.extra = sizes, bits, extra
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, bits, left = [], [], keys
        while len(left) and len(sizes) < _LEVELS:
            size = math.ceil(_GAMMA * len(left)) + 1
            cell = _cells(left, len(sizes), size)
            alone = np.bincount(cell, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[cell]]
        return cls(sizes, np.concatenate([*bits, np.zeros(0, bool)]), left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            cell = _cells(keys[open_], level, size) + at
            hit = self.bits[cell]
            out[open_[hit]] = self.rank[cell[hit]]
            open_, at = open_[~hit], at + size
        for i, k in enumerate(self.extra):  # keys that shared a cell on every level
            out[open_[(keys[open_] == k).all(axis=1)]] = int(self.rank[-1]) + i
        return out


def _build(key: tuple, table: pa.Table) -> pa.Table:
    raw, keys = _keys(table["digest"])
    mph = PerfectHash.build(keys)
    order = np.argsort(mph.slots(keys))
    cols = {c: table[c].take(pa.array(order)) for c in ("keep_row", "keep_id", "n")}
    one = {"p": [key[0].as_py()], "sizes": [mph.sizes], "bits": [np.packbits(mph.bits).tobytes()], "extra": [mph.extra.tobytes()], "digests": [raw[order].tobytes()]}
    return pa.table(one | {c: pa.array([v.to_pylist()], pa.list_(pa.int64())) for c, v in cols.items()}, _INDEX)


_INDEX = pa.schema([("p", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("extra", pa.binary()), ("digests", pa.binary()), ("keep_row", pa.list_(pa.int64())), ("keep_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
_INDEX_DDL = "p long, sizes array<long>, bits binary, extra binary, digests binary, keep_row array<long>, keep_id array<long>, n array<long>"
_FOUND = "row long, id long, chars long, digest binary, keep_row long, keep_id long, n long"


def _lookup(docs: pa.Table, index: pa.Table) -> pa.Table:
    cols = [docs[c] for c in ("row", "id", "chars", "digest")]
    names = ["row", "id", "chars", "digest", "keep_row", "keep_id", "n"]
    if not docs.num_rows or not index.num_rows:
        return pa.table([*cols, *[pa.nulls(docs.num_rows, pa.int64())] * 3], names)
    one = {c: index[c][0].as_py() for c in ("sizes", "bits", "extra", "digests")}
    bits = np.unpackbits(np.frombuffer(one["bits"], np.uint8), count=sum(one["sizes"])).astype(bool)
    mph = PerfectHash(one["sizes"], bits, np.frombuffer(one["extra"], "<u8").reshape(-1, 2))
    raw, keys = _keys(docs["digest"])
    held = np.frombuffer(one["digests"], np.uint8).reshape(-1, 32)
    slot = mph.slots(keys)
    member = slot >= 0
    member[member] = (held[slot[member]] == raw[member]).all(axis=1)  # byte check of the full digest
    at = pa.array(np.where(member, slot, 0), mask=~member)
    return pa.table([*cols, *[pa.array(index[c][0].as_py(), pa.int64()).take(at) for c in ("keep_row", "keep_id", "n")]], names)


def build_index(history: DataFrame) -> tuple[DataFrame, int]:
    """(staged index, partitions) over the distinct digests of a digest_table."""
    winners = stage_table(_winners(history), "winners")
    parts = max(shuffle_parts(history.sparkSession), math.ceil(winners.count() / SLOTS))
    index = stage_table(winners.withColumn("p", _partition(parts)).groupBy("p").applyInArrow(_build, _INDEX_DDL), "mph")
    drop_table(winners)
    return index, parts


def _partition(parts: int):
    return F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("long")


def lookup(digests: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """digests with the winner of each member's slot; null for nonmembers."""
    rows = digests.withColumn("p", _partition(parts))
    most = min(LOOKUPS, max(LEAST_LOOKUPS, 4 * digests.count() // parts))  # a few times the mean, so only hot partitions split
    load = rows.groupBy("p").count().select("p", F.ceil(F.col("count") / most).cast("int").alias("copies"))  # a row per index partition
    rows = rows.join(load, "p").withColumn("salt", F.pmod(F.col("row"), F.col("copies")).cast("int"))
    copies = index.join(load, "p").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return rows.drop("copies").groupBy("p", "salt").cogroup(copies.groupBy("p", "salt")).applyInArrow(_lookup, _FOUND)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per document: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after every white-space byte 0x20, 0x09-0x0D is deleted; null counts as empty. Of
    equal texts the one with the most code points in the original, then the smallest doc_id, then the first row stays
    (null ids rank last). Without ``history`` the documents are their own history. With it, a document whose text the
    history holds is a repeat of the history's winner (kept false; group_size counts history rows), and the remaining
    documents are grouped among themselves. row is row_col, or a number given here. Empty tables give empty results; other columns are ignored.
    """
    digests = digest_table(docs, id_col, text_col, row_col)
    own = history is None
    index, parts = build_index(digests if own else digest_table(history, id_col, text_col))
    found = stage_table(lookup(digests, index, parts), "found")
    fields = ["row", F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size")]
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    kept = (F.col("row") == F.col("keep_row")) if own else F.lit(False)
    members = found.where("n is not null").select(*fields, kept.alias("kept"), sha)
    fresh = found.where("n is null").drop("keep_row", "keep_id", "n")
    grouped = fresh.join(_winners(fresh), "digest").select(*fields, (F.col("row") == F.col("keep_row")).alias("kept"), sha)
    return members.unionByName(grouped)
