"""Substring dedup by sliding runs of sentences that are hashed and joined over all documents."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import map_batches, ship, unused, with_fields, written

ship(__name__)

#: What ends a sentence; the white space after it belongs to it.
END = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+\s*|\n\s*")


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(from, to, normal form, words) of each sentence. Together they are the whole text; what has no
    words goes with the sentence before it, or after it at the start."""
    out: list[tuple[int, int, str, int]] = []
    start = 0
    for end in [*(m.end() for m in END.finditer(text)), len(text)]:
        words = text[start:end].lower().split()
        if words:
            out.append((start, end, " ".join(words), len(words)))
            start = end
    if out:
        out[0] = (0, *out[0][1:])
        out[-1] = (out[-1][0], len(text), *out[-1][2:])
    return [(s, out[i + 1][0] if i + 1 < len(out) else e, n, w) for i, (s, e, n, w) in enumerate(out)]


def runs(parts: list[tuple[int, int, str, int]], several: int, least: int, enough: int) -> list[tuple[bytes, int, int]]:
    """(hash, first, last) of the runs that start at each sentence.

    One of ``several`` sentences, longer until it has ``least`` words, where the text still has one. Besides, as
    a class of their own, the runs of fewer sentences that have ``enough`` words.
    """
    hashes = [xxhash.xxh3_128_digest(n) for _, _, n, _ in parts]
    out = []
    for i in range(len(parts)):
        words = 0
        for j in range(i, len(parts)):
            words += parts[j][3]
            whole = j - i + 1 >= several
            if words >= (least if whole else enough):
                out.append((xxhash.xxh3_128_digest(b"".join(hashes[i : j + 1])), i, j))
            if whole and words >= least:
                break
    return out


def own_repeats(found: list[tuple[bytes, int, int]]) -> tuple[dict[bytes, tuple[int, int]], list[tuple[int, int]]]:
    """The first place of each run within a text, and its later places."""
    first: dict[bytes, tuple[int, int]] = {}
    later: list[tuple[int, int]] = []
    for key, i, j in found:
        if key in first:
            later.append((i, j))
        else:
            first[key] = (i, j)
    return first, later


def drop_repeats(
    docs: DataFrame, several: int = 3, least: int = 12, enough: int = 40, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Remove every sentence covered by a run of sentences that occurs earlier.

    Every run of ``several`` consecutive sentences is hashed; one that has fewer than ``least`` words goes on until
    it has them. Long sentences are a class of their own: runs of fewer than ``several`` sentences with
    ``enough`` words count too, and what only they cover is listed apart.

    Adds ``n_sentences``, ``removed`` (positions from 0, in order) and ``removed_long`` (those of them that only the
    second class covers) to the columns of ``docs`` and cuts the removed sentences out of ``text``; the rest stays
    byte for byte. Runs compare by lower-case words between white space. Earlier means in a document with a
    smaller id, or further up in the same text: the first place of a run stays. Rows that share an id count as
    one document and don't cut each other; rows without an id lose only repeats within themselves. Null texts
    stay null with no sentences. Columns with the names of the added ones are replaced. An empty table gives no rows.

    A text sends each distinct run once, as 16 bytes, and is split twice: for its runs, which are written, and
    for the cut. Counting the runs is a map-side aggregation, and what repeats is written before it is
    joined, so that adaptive execution can split a frequent run. Nothing is collected but the repeats of one
    document.
    """
    added = ("n_sentences", "removed", "removed_long")
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, firsts, lasts, high, low = [], [], [], [], []
        for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for key, (i, j) in own_repeats(runs(sentences(body), several, least, enough))[0].items():
                ids.append(doc)
                firsts.append(i)
                lasts.append(j)
                high.append(int.from_bytes(key[:8], "little", signed=True))
                low.append(int.from_bytes(key[8:], "little", signed=True))
        columns = [pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(ids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "id", "i", "j"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    slim = slim.filter("id IS NOT NULL AND text IS NOT NULL")
    found = written(map_batches(slim, spans, "h1 long, h2 long, id long, i int, j int"), "span-runs")
    repeated = found.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    repeated = written(repeated.filter("first_id < last_id").drop("last_id"), "span-repeats")
    later = found.join(repeated, ["h1", "h2"]).filter("id > first_id")
    cover = later.groupBy("id").agg(F.collect_set(F.struct("i", "j")).alias("_cover"))
    own, spans_ = unused(docs, "span_id", "span_cover")
    cover = written(cover.select(F.col("id").alias(own), F.col("_cover").alias(spans_)), "span-covers")
    rows = docs.join(cover, F.col(id_col) == F.col(own), "left").drop(own)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies, counts, gone, only_long = [], [], [], []
        covers = batch.column(len(names)).to_pylist()
        for body, later_ in zip(batch.column(names.index(text)).to_pylist(), covers, strict=True):
            parts = sentences(body or "")
            places = own_repeats(runs(parts, several, least, enough))[1] + [(span["i"], span["j"]) for span in later_ or ()]
            covered = {k for i, j in places for k in range(i, j + 1)}
            whole = {k for i, j in places if j - i + 1 >= several for k in range(i, j + 1)}
            kept = "".join([body[s:e] for k, (s, e, _, _) in enumerate(parts) if k not in covered]) if covered else body
            bodies.append(kept)
            counts.append(len(parts))
            gone.append(sorted(covered))
            only_long.append(sorted(covered - whole))
        columns = [batch.column(k) for k in range(len(names))]
        columns[names.index(text)] = pa.array(bodies, pa.string())
        columns += [pa.array(counts, pa.int32()), pa.array(gone, pa.list_(pa.int32())), pa.array(only_long, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, [*names, *added])

    return map_batches(rows, cut, with_fields(docs.schema, "n_sentences int, removed array<int>, removed_long array<int>"))
