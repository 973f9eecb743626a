"""Exact top-k search by inner product with one KD-tree per shard."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queryproof.llm.common import ship, written

ship(__name__)


class Tree:
    """Median splits along the widest side of the box; every node keeps its tight bounding box."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int):
        order = np.arange(len(ids))
        self.low, self.high, self.children, self.span = [], [], [], []
        self.grow(points, order, 0, len(ids), leaf)
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def grow(self, points: np.ndarray, order: np.ndarray, a: int, b: int, leaf: int) -> int:
        node = len(self.span)
        box = points[order[a:b]]
        low, high = box.min(0), box.max(0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((a, b))
        self.children.append(())
        if b - a > leaf and (high > low).any():
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(box[:, np.argmax(high - low)], middle)]
            left = self.grow(points, order, a, a + middle, leaf)
            self.children[node] = (left, self.grow(points, order, a + middle, b, leaf))
        return node

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, best: list, k: int, floor: int | None) -> None:
        """Improve ``best``, a heap of distinct (score, -id) with the k-th on top. Nodes come by their bound, the
        largest first, and the walk ends where no bound reaches the k-th score, or ``floor``, a score that
        k others are known to reach."""
        queue = [(-int(bounds[0]), 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            kth = best[0][0] if len(best) == k else floor
            if kth is not None and -bound < (kth if floor is None else max(kth, floor)):
                return
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-int(bounds[child]), child))
                continue
            a, b = self.span[node]
            scores = self.points[a:b] @ query
            kth = best[0][0] if len(best) == k else floor
            near = np.flatnonzero(scores >= kth) if kth is not None else np.arange(b - a)
            for i in near:
                one = (int(scores[i]), -int(self.ids[a + i]))
                if -one[1] == query_id or one in best:  # repeated rows count once
                    continue
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)


def unpacked(data: bytes) -> Tree:
    tree = Tree.__new__(Tree)
    vars(tree).update(pickle.loads(data))
    return tree


def compact(points: np.ndarray) -> np.ndarray:
    """The narrowest of three integer types that holds the numbers."""
    top = int(np.abs(points).max(initial=0))
    return points.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def workable(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats, whose products are fast, where all sums are exact; else as 64-bit integers."""
    top = int(np.abs(points).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, points.shape[1])
    if top >= 1 << 63:
        raise OverflowError("components are too large for products in 64 bits")
    kind = np.float64 if top < 1 << 53 else np.int64
    return points.astype(kind), queries.astype(kind)


def packed(vectors: DataFrame, label: str, rows: int, scale: float) -> DataFrame:
    """``(dim, <label>)``: runs of at most ``rows`` vectors of one length as they lie in a task, pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def emit(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            count.pop(dim)
            ids, points = np.concatenate([i for i, _ in parts]), np.concatenate([p for _, p in parts])
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), label: [pickle.dumps((ids, compact(points)))]})

        for batch in batches:
            values = batch.column("v")
            sizes = np.diff(values.offsets.to_numpy())
            flat = np.floor(values.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
            if (np.abs(flat) >= 2.0**62).any():
                raise OverflowError("components are too large for 64 bits")
            flat = flat.astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                for some in np.array_split(own, -(-len(own) // rows)):
                    points = flat[starts[some][:, None] + np.arange(dim)]
                    held.setdefault(int(dim), []).append((ids[some], points))
                    count[int(dim)] = count.get(int(dim), 0) + len(some)
                    if count[int(dim)] >= rows:
                        yield emit(int(dim))
        for dim in list(held):
            yield emit(dim)

    return vectors.mapInArrow(run, f"dim int, {label} binary")


def shard_trees(shards: DataFrame, leaf: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                ids, points = pickle.loads(shard)
                tree = pickle.dumps(vars(Tree(ids, points, leaf)))
                yield pa.RecordBatch.from_arrays([batch.column("dim").slice(i, 1), pa.array([tree], pa.binary())], ["dim", "tree"])

    return shards.mapInArrow(run, "dim int, tree binary")


def searched(blocks: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the k best of each query over the trees of each group.

    ``blocks`` has ``dim, chunk, part, block, floor``, ``trees`` has ``dim, chunk, part, tree``; what agrees in the first
    three meets. The trees pass a block one by one, and the k-th score found so far goes along from tree to
    tree; ``floor`` holds scores to begin with. A block and a tree are moved once for each place
    where they meet, never as a pair.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict[int, list] = {}
        data = [pickle.loads(b) for b in left.column("block").to_pylist()]
        floors = left.column("floor").to_pylist()
        for tree_bytes in right.column("tree"):
            tree = unpacked(tree_bytes.as_py())
            for (ids, given), known in zip(data, floors, strict=True):
                points, queries = workable(tree.points, given)
                low, high = tree.low.astype(points.dtype), tree.high.astype(points.dtype)
                held, tree.points = tree.points, points
                # the largest product that a point of each box can have
                bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
                for n, q in enumerate(ids.tolist()):
                    floor = known[n] if known and known[n] is not None else None
                    tree.search(q, queries[n], bounds[n], best.setdefault(q, []), k, floor)
                tree.points = held
        rows = [(q, -i, s) for q, heap in best.items() for s, i in heap]
        return pa.table([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    keys = ["dim", "chunk", "part"]
    return blocks.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")


def first_floors(blocks: DataFrame, k: int) -> DataFrame:
    """Add ``floor``: for each query of a block the k-th score against one reference shard, if it has k.
    What has the same id and score counts once, as in the search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, data = batch.column("block")[row].as_py(), batch.column("tree")[row].as_py()
                ids, queries = pickle.loads(block)
                floors: list[int | None] = [None] * len(ids)
                if data is not None:
                    tree = unpacked(data)
                    points, queries = workable(tree.points, queries)
                    repeats = len(np.unique(tree.ids)) < len(tree.ids)
                    for n, q in enumerate(ids.tolist()):
                        others = tree.ids != q
                        scores = points[others] @ queries[n]
                        if repeats and len(scores):
                            order = np.lexsort((scores, tree.ids[others]))
                            scores, whose = scores[order], tree.ids[others][order]
                            scores = scores[np.append(True, (np.diff(scores) != 0) | (np.diff(whose) != 0))]
                        if len(scores) >= k:
                            floors[n] = int(np.partition(scores, len(scores) - k)[len(scores) - k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("dim").slice(row, 1), batch.column("block_no").slice(row, 1), pa.array([block], pa.binary()), pa.array([floors], pa.list_(pa.int64()))],
                    ["dim", "block_no", "block", "floor"],
                )

    return blocks.mapInArrow(run, "dim int, block_no long, block binary, floor array<long>")


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: float = 256.0,
    shard_rows: int = 2048,
    block_rows: int = 256,
    leaf: int = 64,
    most_trees: int = 256,
    most_blocks: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` highest inner products of every query with all other rows: ``query_id, rank, vec_id, score``.

    Components become floor(``scale`` * x). Queries are the rows whose id is divisible by ``every``.
    Ties go to the smaller id. Rows with a null id, a null vector, or null or non-finite components take no
    part; vectors of different lengths are not compared; a row with the query's id counts as its own. Repeated
    rows count once: a result has an id with the same score one time only. An id with several vectors is
    a candidate with each of them, and as a query it gets the best of them all.
    Fewer candidates give fewer rows, an empty table none. Components or sums that may not fit in a long are an error.

    Shards are runs of rows as they lie in a task, so no key can be hot. Queries are packed into blocks: the
    stated query set meets all rows in blocks. Trees are dealt to parts of about ``most_trees``, blocks to chunks
    of about ``most_blocks``, and every chunk meets every part in a task of its own, so their number grows with both
    and what one holds doesn't. A first pass against one shard, of bounded size, gives every query a score to
    start from; within a part the k-th score goes on from shard to shard. Each part returns k rows a query.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    slim = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(finite)
    slim = slim.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    trees = written(shard_trees(packed(slim, "shard", shard_rows, scale), leaf), "kd-trees")
    asked = packed(slim.filter(F.col("id") % every == 0), "block", block_rows, scale)
    asked = written(asked.withColumn("block_no", F.monotonically_increasing_id()), "kd-queries")
    reference = trees.groupBy("dim").agg(F.first("tree").alias("tree"))
    blocks = written(first_floors(asked.join(reference, "dim", "left"), k), "kd-floors")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_trees, n_blocks = trees.count(), blocks.count()
    parts = max(1, -(-n_trees // most_trees), min(cores, n_trees))
    chunks = max(1, -(-n_blocks // most_blocks))
    dealt = blocks.withColumn("chunk", F.pmod(F.xxhash64("block_no"), F.lit(chunks)).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sown = trees.withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(parts)).cast("int"))
    sown = sown.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    best = searched(dealt.select("dim", "chunk", "part", "block", "floor"), sown.select("dim", "chunk", "part", "tree"), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
