"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of k sums, one per shard, with the groups behind each. Differencing takes the two of
largest spread, joins the largest sum of one with the smallest of the other, and puts the result back, until one is
left. Executors do so for bounded chunks of groups, each of which ends as one partial partition; the driver then
differences those (k numbers for each chunk) in the same way. Only group totals move: equal texts are summed before
the shuffle, so a text that makes up a third of all rows is one group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, prefix_offsets, stage_table, tune

#: Groups differenced at a time by an executor.
CHUNK = 65_536


def difference(parts: list[list[int]]) -> list[list[int]]:
    """For partial partitions (k sums each): the shard of each one's slots, by Karmarkar-Karp differencing."""
    k = len(parts[0])
    nodes: list[tuple] = []  # (left, its slots' places, right, its slots' places); a leaf has no left
    heap: list[tuple] = []

    def push(sums: list[int], node: tuple) -> None:
        nodes.append(node)
        heapq.heappush(heap, (sums[-1] - sums[0], len(nodes) - 1, sums))

    for i, p in enumerate(parts):
        order = sorted(range(k), key=p.__getitem__, reverse=True)
        push([p[j] for j in order], (None, order, i))
    while len(heap) > 1:
        (_, a, x), (_, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        sums = [u + v for u, v in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        place = [0] * k
        for new, old in enumerate(order):
            place[old] = new
        push([sums[j] for j in order], (a, place, b, place[::-1]))
    shards: list[list[int]] = [[]] * len(parts)
    todo = [(len(nodes) - 1, list(range(k)))]
    while todo:
        n, to = todo.pop()
        if nodes[n][0] is None:
            _, order, i = nodes[n]
            shard = [0] * k
            for slot, j in enumerate(order):
                shard[j] = to[slot]
            shards[i] = shard
        else:
            a, pa_, b, pb = nodes[n]
            todo += [(a, [to[q] for q in pa_]), (b, [to[q] for q in pb])]
    return shards


def _local(k: int):
    def run(batches):
        task, chunk = TaskContext.get().partitionId(), 0
        tables: list[pa.RecordBatch] = []

        def flush():
            nonlocal chunk
            t = pa.Table.from_batches(tables).combine_chunks()
            tables.clear()
            sizes = t["bytes"].to_pylist()
            slots = [s[0] for s in difference([[n] + [0] * (k - 1) for n in sizes])]
            n = t.num_rows
            chunk += 1
            return pa.RecordBatch.from_arrays([t["gkey"].combine_chunks(), pa.array(slots, pa.int32()), pa.array(np.full(n, (task << 20) + chunk)), t["bytes"].combine_chunks()], ["gkey", "local", "chunk", "bytes"])

        for b in batches:
            if b.num_rows:
                tables.append(b)
            if sum(t.num_rows for t in tables) >= CHUNK:
                yield flush()
        if tables:
            yield flush()

    return run


def _number(batches):
    """Adds the running number of each row within its shard and task."""
    task, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        shards = b.column(b.schema.get_field_index("shard")).to_pylist()
        local = []
        for s in shards:
            local.append(seen.get(s, 0))
            seen[s] = local[-1] + 1
        yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, task)), pa.array(local, pa.int64())], [*b.schema.names, "task", "local"])


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length plus 1 (null text: 1); equal texts stay together (null equals empty). Sums of size over
    shards are near equal; a group larger than its share bounds what any assignment can reach. slot numbers the rows of
    a shard without gaps from 0. The law is ``bytes``, so grown_shard is null. Repeated rows and null ids are rows like
    any other; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("gkey"))
    rows = stage_table(rows, "sizes")
    groups = rows.groupBy("gkey").agg(F.sum("size").alias("bytes"))
    local = stage_table(groups.mapInArrow(_local(shards), "gkey binary, local int, chunk long, bytes long"), "differenced")
    sums: dict[int, list[int]] = {}
    for r in local.groupBy("chunk", "local").agg(F.sum("bytes").alias("b")).collect():  # k numbers for each chunk of 65,536 groups
        sums.setdefault(r["chunk"], [0] * shards)[r["local"]] = r["b"]
    chunks = sorted(sums)
    final = difference([sums[c] for c in chunks]) if chunks else []
    places = spark.createDataFrame([(c, j, s) for c, to in zip(chunks, final, strict=True) for j, s in enumerate(to)], "chunk long, local int, shard int")
    placed = local.join(F.broadcast(places), ["chunk", "local"]).select("gkey", "shard")
    out = rows.join(placed, "gkey").select("doc_id", "size", "text_crc32", "shard")
    out = stage_table(out.mapInArrow(_number, "doc_id {}, size long, text_crc32 long, shard int, task long, local long".format(rows.schema["doc_id"].dataType.simpleString())), "sharded")
    drop_table(local)
    counts = {(r["task"], r["shard"]): r["n"] for r in out.groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = {}
    for s in range(shards):
        at |= prefix_offsets(counts, sorted(k for k in counts if k[1] == s))
    offsets = spark.createDataFrame([(t, s, n) for (t, s), n in at.items()], "task long, shard int, first long")
    return out.join(F.broadcast(offsets), ["task", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
