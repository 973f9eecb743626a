"""Near-duplicate documents by DartMinHash signatures and banded joining."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import map_batches, ship, unused, worker_memo, written
from queryproof.llm.components import components

ship(__name__)

WORD = re.compile(r"\w+")
U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Rank strips: from 0 in equal steps at first, then each as high as all before it.
FIRST_STRIP = 1 / 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: neighbouring inputs give unrelated outputs."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def poisson_table(area: float) -> np.ndarray:
    """Upper limits of a uniform 64-bit number for 0, 1, 2 ... darts in a rectangle of this area."""
    p = total = float(np.exp(-area))
    limits = []
    for n in range(1, 24):
        limits.append(total)
        p *= area / n
        total += p
    return np.minimum(np.array(limits) * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash signatures of weighted sets; two agree in a coordinate with the probability of their
    weighted Jaccard similarity.

    ``elements`` are 64-bit hashes, set ``i`` has those from ``starts[i]`` to ``starts[i + 1]``. Every
    element owns a plane of weight and rank, cut into rectangles: weights into unit columns, ranks into
    strips of doubling height, high strips into cells of height one. How many darts a rectangle holds and
    where they land is drawn from hashes of the element and the rectangle, so equal elements of different
    sets see the same darts. A set's darts are those below the element's weight. A dart also names one of
    ``k`` coordinates, which keeps its earliest dart: strips are thrown from the lowest rank up until every
    coordinate of a set is filled, about k log k darts however large the set is. Sets without elements get
    zeros.
    """
    sets = len(starts) - 1
    best = np.full(sets * k, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.diff(starts)
    best.reshape(sets, k)[sizes == 0] = 0
    columns = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(sets), sizes)
    element = np.repeat(elements, columns)
    column = np.arange(columns.sum()) - np.repeat(np.cumsum(columns) - columns, columns)
    room = np.minimum(np.repeat(weights, columns) - column, 1.0)
    owner = np.repeat(owner, columns)
    base = mixed(element + GOLD * (column + 1).astype(np.uint64))
    fractions = bool((room < 1.0).any())
    strip, low, height = 0, 0.0, FIRST_STRIP
    while len(base):
        cells = max(1, int(height))
        table = poisson_table(height / cells)
        strip_best = np.full(sets * k, np.iinfo(np.uint64).max, np.uint64)
        step = max(1, 300_000 // len(base))  # cells at a time
        for cell in range(0, cells, step):
            numbers = np.arange(cell, min(cell + step, cells), dtype=np.uint64)
            place = mixed((base[:, None] ^ mixed(numbers + U((strip << 32) + 1))[None, :]).ravel())
            darts = np.searchsorted(table, place, side="right")
            hit = np.flatnonzero(darts)
            if not len(hit):
                continue
            darts = darts[hit]
            nth = np.arange(darts.sum()) - np.repeat(np.cumsum(darts) - darts, darts)
            hit = np.repeat(hit, darts)
            dart = mixed(place[hit] + GOLD * (nth + 1).astype(np.uint64))
            of = hit // len(numbers)
            at = owner[of] * k + ((dart >> U(32)) * U(k) >> U(32)).astype(np.int64)
            rank = mixed(dart)
            if fractions:
                inside = (mixed(dart + U(2)) >> U(11)).astype(float) * 2.0**-53 < room[of]
                hit, at, rank = hit[inside], at[inside], rank[inside]
            if cells > 1:  # the rank: the cell, then a fraction of it
                rank = rank // U(cells) + (numbers[hit % len(numbers)]) * U((1 << 64) // cells)
            np.minimum.at(strip_best, at, rank)
        open_ = best == np.iinfo(np.uint64).max
        best[open_] = np.where(strip_best[open_] == np.iinfo(np.uint64).max, strip_best[open_], mixed(strip_best[open_] ^ U(strip + 1)) >> U(1))
        unfilled = (best == np.iinfo(np.uint64).max).reshape(sets, k).any(1)
        keep = unfilled[owner]
        owner, base, room = owner[keep], base[keep], room[keep]
        low += height
        height = FIRST_STRIP if strip == 0 else low
        strip += 1
    return best.reshape(sets, k)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """64-bit hashes of all lower-case words, where each text's words start, and the words."""
    memo: dict[str, int] = worker_memo("word-hashes", dict)
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    hashes = np.empty(sum(map(len, words)), np.uint64)
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, ws in enumerate(words):
        starts[i + 1] = starts[i] + len(ws)
        if len(memo) > 500_000:
            memo.clear()
        for w in set(ws):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        hashes[starts[i] : starts[i + 1]] = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
    return hashes, starts, words


def shingles(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``n`` words; a shorter text has one run of all its words."""
    sizes = np.diff(starts)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out_starts = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(out_starts[-1]) - np.repeat(out_starts[:-1], count) + np.repeat(starts[:-1], count)
    ends = np.repeat(starts[1:], count)
    out = np.zeros(len(first), np.uint64)
    for j in range(n):
        at = first + j
        word = np.where(at < ends, hashes[np.minimum(at, max(len(hashes) - 1, 0))] if len(hashes) else U(0), U(0))
        out = mixed(out * GOLD + word + U(j + 1))
    return out, out_starts


def weighted(elements: np.ndarray, starts: np.ndarray, weighting: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each set with their weights: 1, or how often they occur."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order]
    first = np.ones(len(elements), bool)
    first[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(elements)))
    out = np.searchsorted(owner[at], np.arange(len(starts)))
    return elements[at], (np.ones(len(at)) if weighting == "set" else count.astype(float)), out


def slices(texts: list, most: int = 1_500_000):
    """(from, to) of runs of texts of about ``most`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def signature_table(docs: DataFrame, n: int, bands: int, rows: int, weighting: str) -> DataFrame:
    """``(id, copy, keys)``: ``copy`` tells equal word sequences, ``keys`` has one value per band."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        copies, keys = [], []
        for a, b in slices(texts):
            hashes, starts, words = word_hashes(texts[a:b])
            copies += [
                xxhash.xxh3_128_digest(" ".join(w) if w else f" {t or ''}") for w, t in zip(words, texts[a:b], strict=True)
            ]
            sets, set_starts = shingles(hashes, starts, n)
            if weighting == "set":  # repeats throw the same darts again: no need to find them
                weights = np.ones(len(sets))
            else:
                sets, weights, set_starts = weighted(sets, set_starts, weighting)
            for i in range(0, b - a, 512):
                j = min(i + 512, b - a)
                some = slice(set_starts[i], set_starts[j])
                signs = dart_signatures(sets[some], weights[some], set_starts[i : j + 1] - set_starts[i], bands * rows)
                key = np.zeros((j - i, bands), np.uint64)
                for r in range(rows):
                    key = mixed(key * GOLD + signs.reshape(j - i, bands, rows)[:, :, r])
                key = mixed(key + np.arange(1, bands + 1, dtype=np.uint64) * GOLD).view(np.int64)
                empty = np.diff(set_starts[i : j + 1]) == 0
                keys += [[] if e else k for e, k in zip(empty, key, strict=True)]
        columns = [batch.column("id"), pa.array(copies, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "copy", "keys"])

    return map_batches(docs, run, "id long, copy binary, keys array<long>")


def shingle_table(docs: DataFrame, n: int, weighting: str) -> DataFrame:
    """``(id, items)``: the distinct shingles; of a weighted set the first, second ... time each occurs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = batch.column("text").to_pylist(), []
        for a, b in slices(texts):
            hashes, starts, _ = word_hashes(texts[a:b])
            sets, weights, at = weighted(*shingles(hashes, starts, n), weighting)
            if weighting != "set":
                times = weights.astype(np.int64)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                sets = mixed(np.repeat(sets, times) + nth.astype(np.uint64) * GOLD)
                at = np.concatenate([[0], np.cumsum(times)])[at]
            out += [sets[x:y].view(np.int64) for x, y in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], ["id", "items"])

    return map_batches(docs, run, "id long, items array<long>")


def verified(pairs: DataFrame, items: DataFrame, per_mille: int) -> DataFrame:
    """Of the pairs ``(a, b)`` those whose sets are at least so similar, with exact whole numbers."""
    left = items.select(F.col("id").alias("a"), F.col("items").alias("_x"))
    right = items.select(F.col("id").alias("b"), F.col("items").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    similar = both * 1000 >= (F.size("_x") + F.size("_y") - both) * per_mille
    return pairs.join(left, "a").join(right, "b").filter(similar).select("a", "b")


def open_pairs(rows: DataFrame, key: str, per_mille: int) -> DataFrame:
    """Members ``(key, node, root, size, most)`` of different classes that share a key and could be similar
    enough if at most ``most`` of their items can be shared."""
    a, b = rows.alias("a"), rows.alias("b")
    most = F.least("a.most", "b.most")
    could = most * 1000 >= (F.col("a.size") + F.col("b.size") - most) * per_mille
    near = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & could
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    bands: int = 32,
    rows: int = 5,
    weighting: str = "set",
    rare: int = 8,
    id_col: str = "doc_id",
) -> DataFrame:
    """Classes of near-duplicate documents: ``id_col, class_id, class_size, links``, one row per input row.

    Two documents are linked if the Jaccard similarity of their ``n``-word shingles (lower-case words;
    ``weighting="count"``: of shingles weighted by how often they occur) is at least ``threshold``; a class
    is what links connect, ``class_id`` its smallest id, ``links`` the links found between this text and
    others (0 for what is alone; copies share the count). Equal word sequences are copies. Texts without
    words are copies of equal texts only; null counts as empty. Rows that share an id are one document.
    Rows with a null id stand alone, with null class. An empty table gives no rows.

    Signatures (``bands`` of ``rows`` coordinates) propose pairs: a pair at 0.8 is missed with probability
    (1 - 0.8**5)**32, about 0.000003, one at 0.9 practically never. What is proposed is verified exactly.
    In a bucket of equal band keys members are not paired with each other at once: each is held against
    one centre, the member that shares most buckets with others (texts near an unedited original). Classes
    follow. Then buckets that still hold several classes are completed, with pairs between classes only,
    in two ways. Members that share a shingle which at most ``rare`` members have are paired by it. All
    others can share no more than their more frequent shingles, so they are paired by bucket if both have
    enough of those to be similar; edited texts have not. Both bounds are exact counts: no link between
    classes is lost, no pair inside a class is made, and nothing is capped.
    """
    per_mille = round(threshold * 1000)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text"))
    signs = written(signature_table(slim, n, bands, rows, weighting), "dart-signatures")
    known = signs.filter("id IS NOT NULL")
    # what is grouped is written before it is joined: only then can a hot key be split
    nodes = written(known.groupBy("copy").agg(F.min("id").alias("node")), "dart-nodes")
    members = written(
        known.select("id", "copy").join(nodes, "copy").groupBy("id").agg(F.min("node").alias("node")), "dart-members"
    )
    keyed = known.join(nodes.select(F.col("node").alias("id"), "copy"), ["id", "copy"], "left_semi")
    keyed = keyed.select(F.col("id").alias("node"), F.explode("keys").alias("bucket"))
    size = written(keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "dart-sizes")
    shared = written(keyed.join(size, "bucket").select("bucket", "node", "n"), "dart-buckets")
    fame = shared.groupBy("node").agg(F.sum("n").alias("fame"))
    known_fame = shared.join(fame, "node")
    centre = known_fame.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("node")).alias("least"))).alias("c"))
    centre = written(centre.select("bucket", (-F.col("c.least")).alias("b")), "dart-centres")
    stars = shared.join(centre, "bucket")
    stars = written(stars.filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), "dart-stars")
    candidates = slim.join(fame.select(F.col("node").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    items = written(shingle_table(candidates, n, weighting), "dart-items")
    links = written(verified(stars, items, per_mille), "dart-links")
    roots = components(links)

    # what buckets with several classes still hide
    classed = shared.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed_up = classed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    mixed_up = written(mixed_up.select("bucket"), "dart-mixed")
    rest = written(classed.join(mixed_up, "bucket", "left_semi"), "dart-rest")
    places = written(rest.select(F.col("node").alias("id"), "root").distinct(), "dart-places")
    each = items.join(places, "id").select("id", "root", F.size("items").alias("size"), F.explode("items").alias("item"))
    common = written(each.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1"), "dart-common")
    each = written(each.join(common, "item"), "dart-each")
    counts = each.groupBy(F.col("id").alias("node"), "size").agg(
        F.count("*").alias("may"), F.count_if(F.col("n") > rare).alias("core")
    )
    counts = written(counts.filter(F.col("may") * 1000 >= F.col("size") * per_mille), "dart-counts")
    by_core = counts.filter(F.col("core") * 1000 >= F.col("size") * per_mille).drop("may")
    by_core = written(rest.join(by_core.withColumnRenamed("core", "most"), "node"), "dart-core")
    by_rare = each.filter(F.col("n") <= rare).select(F.col("id").alias("node"), "root", "item")
    by_rare = written(by_rare.join(counts.withColumnRenamed("may", "most").drop("core"), "node"), "dart-rare")
    pairs = open_pairs(by_core, "bucket", per_mille).union(open_pairs(by_rare, "item", per_mille)).distinct()
    more = written(verified(pairs.join(stars, ["a", "b"], "left_anti"), items, per_mille), "dart-more")
    all_links = links.union(more)
    if more.limit(1).count():
        roots = components(all_links)
    ends = all_links.select(F.col("a").alias("node")).union(all_links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("links"))
    placed = members.join(roots.join(degree, "node", "left"), "node", "left")
    placed = placed.select("id", F.coalesce("root", "node").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    placed = written(placed, "dart-placed")
    sizes = written(placed.groupBy("class_id").agg(F.count("*").alias("class_size")), "dart-classes")
    placed = placed.join(sizes, "class_id")
    out = slim.select("id").join(placed, "id", "left")
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"))


def first_of_class(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest id, with all columns of ``docs``.

    Rows are told apart by a written number: rows that share an id with different texts are documents of
    their own, and of equal rows one stays. Rows with a null id stay.
    """
    row, class_id, least = unused(docs, "kept_row", "kept_class", "kept_least")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "dart-rows")
    known = numbered.filter("doc_id IS NOT NULL")
    classes = near_duplicates(known.select(row, "text"), id_col=row, **options).select(row, F.col("class_id").alias(class_id))
    firsts = known.select("doc_id", row).join(classes, row).groupBy(class_id)
    firsts = firsts.agg(F.min(F.struct("doc_id", row)).alias(least)).select(F.col(f"{least}.{row}").alias(row))
    kept = known.join(firsts, row, "left_semi").unionByName(numbered.filter("doc_id IS NULL"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
