"""Sharding whole groups of equal texts by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import scalar, ship, text_or_empty, totals_before, written

ship(__name__)


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item. Partial partitions start with one item each; the two with the largest
    spread are joined, the fullest part of one with the emptiest of the other, until one is left."""
    heap: list[tuple[int, int, list[int], tuple]] = []
    for i, size in enumerate(sizes):
        sums = [0] * (shards - 1) + [size]
        heap.append((-size, i, sums, (i,)))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        joined = sorted((a[i] + b[shards - 1 - i], i) for i in range(shards))
        low = joined[0][0]
        heapq.heappush(heap, (low - joined[-1][0], count, [s - low for s, _ in joined], (left, right, [i for _, i in joined])))
        count += 1
    place = [0] * len(sizes)
    todo = [(heap[0][3], list(range(shards)))] if heap else []
    while todo:  # at[i]: the final shard of part i of this partial partition
        tree, at = todo.pop()
        if len(tree) == 1:
            place[tree[0]] = at[shards - 1]
            continue
        left, right, order = tree
        back = [0] * shards
        for new, old in enumerate(order):
            back[old] = at[new]
        todo += [(left, back), (right, back[::-1])]
    return place


def shard_by_bytes(docs: DataFrame, shards: int = 8, items: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Put documents into shards of nearly equal bytes; equal texts stay together.

    Returns ``id_col, size, text_crc32, shard, slot``, one row per input row. The size is the UTF-8
    length plus one; a null text counts as the empty one. Groups above 1/``items`` of all bytes (fewer
    than ``items`` of them) are differenced one by one, all smaller groups in at most ``items`` bundles
    dealt by hash, so what the differencing holds is bounded for any input. Slots number each shard
    without gaps in hash order of id and text; repeated rows get a slot each. Other columns are not read.
    """
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text_or_empty().cast("binary"))).alias("digest"),
    )
    slim = written(slim, "shard-sizes")
    groups = slim.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total = scalar(groups.agg(F.sum("bytes"))) or 0
    bundle = F.pmod(F.xxhash64("digest"), F.lit(items)).cast("int")
    large = F.col("bytes") > F.lit(total / items)
    item = F.when(large, F.col("digest")).alias("digest"), F.when(~large, bundle).alias("bundle")
    parts = groups.select(*item, "bytes").groupBy("digest", "bundle").agg(F.sum("bytes").alias("bytes"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(pdf)), key=lambda i: (pdf["digest"][i] or b"", pdf["bundle"].fillna(-1)[i]))
        pdf = pdf.iloc[order].reset_index(drop=True)
        return pdf[["digest", "bundle"]].assign(shard=difference(pdf["bytes"].tolist(), shards))

    dealt = parts.groupBy().applyInPandas(deal, "digest binary, bundle int, shard int")
    dealt = written(dealt, "shard-items")
    own = dealt.filter("digest IS NOT NULL").select("digest", F.col("shard").alias("_own"))
    bundled = dealt.filter("bundle IS NOT NULL").select("bundle", F.col("shard").alias("_bundled"))
    rows = slim.withColumn("bundle", bundle)
    # both sides have at most `items` rows, whatever the input
    rows = rows.join(F.broadcast(own), "digest", "left").join(F.broadcast(bundled), "bundle", "left")
    rows = rows.select(
        "id",
        "size",
        "text_crc32",
        F.coalesce("_own", "_bundled").alias("shard"),
        F.xxhash64("id", "digest").alias("key"),
        F.lit(1).cast("long").alias("one"),
    )
    rows = totals_before(rows, "shard", "key", ["id", "size"], "one", "slot", slim.count())
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
