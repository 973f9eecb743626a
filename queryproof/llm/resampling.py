"""Importance resampling towards a target distribution: hashed word features from an Aho-Corasick dictionary."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import ranked, ship, text_or_empty, unused, with_fields, written

ship(__name__)

#: Bytes of a text as the dictionary reads them: A-Z in lower case, delimiters as blanks, the rest as it is.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Words too long for the dictionary; a name that no text can hold stands for each.
LONG = re.compile(r"[^ ]{200,}")
BLANK = zlib.crc32(b" ")


def packed(word: str) -> int:
    """The payload of a word: the CRC-32 of its bytes, and their number above it."""
    letters = word.encode("latin-1")
    return len(letters) << 32 | zlib.crc32(letters)


def payloads(folded: str) -> np.ndarray:
    """The payload of each word of a folded text, one byte a character.

    The distinct words, each between its two delimiters, make the dictionary; the automaton passes the
    text once and gives the payload of every word as it comes by. Neighbours share their delimiter.
    """
    held: dict[str, int] = {}

    def name(found: re.Match) -> str:
        short = f"\x01{len(held)}"
        held[short] = packed(found[0])
        return short

    if LONG.search(folded):
        folded = LONG.sub(name, folded)
    words = {*folded.split(" ")}
    words.discard("")
    if not words:
        return np.empty(0, np.int64)
    dictionary = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    carried = []  # the automaton's own values have 32 bits, so they are places in here
    for i, w in enumerate(words):
        dictionary.add_word(f" {w} ", i)
        carried.append(held[w] if w in held else packed(w))
    dictionary.make_automaton()
    return np.array(carried, np.int64)[[i for _, i in dictionary.iter(f" {folded} ")]]


def cut(folded: str, most: int) -> Iterator[str]:
    """Pieces of about ``most`` characters; no word is cut."""
    start = 0
    while len(folded) - start > most:
        end = folded.find(" ", start + most)
        if end < 0:
            break
        yield folded[start:end]
        start = end
    yield folded[start:]


@cache
def zeros_behind(count: int) -> tuple[int, ...]:
    """What a CRC register becomes when ``count`` bytes of zeros follow it, bit by bit (a matrix over two elements)."""
    if count == 0:
        return tuple(1 << i for i in range(32))
    if count == 1:
        out = []
        for i in range(32):
            crc = 1 << i
            for _ in range(8):
                crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
            out.append(crc)
        return tuple(out)
    half, rest = zeros_behind(count // 2), zeros_behind(count % 2)

    def times(matrix, crc):
        total = 0
        for i in range(32):
            total ^= matrix[i] if crc >> i & 1 else 0
        return total

    return tuple(times(rest, times(half, c)) for c in half)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Payloads of first and second with one blank between, composed from their payloads alone."""
    crc, other = first & 0xFFFFFFFF, second & 0xFFFFFFFF
    crc = behind(crc, np.ones(len(crc), np.int64)) ^ BLANK
    crc = behind(crc, second >> 32) ^ other
    return (first >> 32) + 1 + (second >> 32) << 32 | crc


def behind(crc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for count in np.unique(counts).tolist():
        here = counts == count
        some, total = crc[here], np.zeros(int(here.sum()), np.int64)
        for i, column in enumerate(zeros_behind(count)):
            total ^= np.where(some >> i & 1, column, 0)
        out[here] = total
    return out


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """Payloads of all runs of 1 to ``longest`` words."""
    out, latest = [words], words
    for n in range(2, longest + 1):
        latest = joined(latest[:-1], words[n - 1 :]) if len(words) >= n else words[:0]
        out.append(latest)
    return np.concatenate(out)


def word_payloads(texts: list[bytes], most: int) -> Iterator[np.ndarray]:
    """The payloads of each text's words. Texts are read together up to ``most`` bytes, so that one
    dictionary serves many; a longer one is read in pieces with a dictionary each."""
    held: list[str] = []
    size = 0

    def together() -> Iterator[np.ndarray]:
        # a mark of its own ends every text; it is a word that no text holds
        found = payloads(" \x02 ".join([*held, ""]))
        ends = np.flatnonzero(found == MARK)
        yield from (part[:-1] for part in np.split(found, ends + 1)[: len(held)])

    for text in texts:
        folded = text.translate(FOLDED).decode("latin-1")
        if held and size + len(folded) > most:
            yield from together()
            held, size = [], 0
        if len(folded) > most:
            yield np.concatenate([payloads(piece) for piece in cut(folded, most)])
        else:
            held.append(folded)
            size += len(folded) + 3
    if held:
        yield from together()


MARK = packed("\x02")


def features_of(
    docs: DataFrame, kept: list[str], label: str, buckets: int, longest: int, text_col: str = "text", most: int = 1 << 20
) -> tuple[DataFrame, dict[str, str]]:
    """A written table of the columns ``kept`` and, under the names in the second value, ``row`` (a number that tells
    rows apart), ``n_words``, ``n_features`` and ``features``: the bucket of every feature, as packed integers."""
    names = dict(zip(("row", "n_words", "n_features", "features"), unused(docs, "row", "n_words", "n_features", "features")))
    width = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    slim = docs.select(
        *(F.col(f"`{c}`") for c in kept), F.monotonically_increasing_id().alias(names["row"]), text_or_empty(text_col).cast("binary").alias("_text")
    )
    base = slim.drop("_text").schema
    schema = with_fields(base, f"`{names['n_words']}` long, `{names['n_features']}` long, `{names['features']}` binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                n_words, n_features, packs = [], [], []
                for words in word_payloads(batch.column(len(base)).to_pylist(), most):
                    found = (runs(words, longest) & 0xFFFFFFFF) % buckets
                    n_words.append(len(words))
                    n_features.append(len(found))
                    packs.append(found.astype(width).tobytes())
                columns = [*batch.columns[: len(base)], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(packs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return written(slim.mapInArrow(run, schema), label), names


def bucket_counts(features: DataFrame, column: str, buckets: int) -> DataFrame:
    """``(bucket, n)`` over all rows; a task adds up its rows first and sends one row a bucket at most."""
    width = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for pack in batch.column(0):
                total += np.bincount(np.frombuffer(pack.as_py(), width), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    return features.select(column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, gain)`` for every bucket: how much likelier the target is to give it, in thousandths of a
    natural logarithm, rounded down; each count is one more than it is."""
    sides = source.selectExpr("bucket", "n AS s", "0L AS t").unionAll(target.selectExpr("bucket", "0L AS s", "n AS t"))
    every = source.sparkSession.range(buckets).selectExpr("id AS bucket", "0L AS s", "0L AS t")
    counts = sides.unionAll(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_s, all_t = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = f"(double(t + 1) * {float(all_s + buckets)!r}D) / (double(s + 1) * {float(all_t + buckets)!r}D)"
    return counts.selectExpr("bucket", f"CAST(floor(1000 * ln({ratio})) AS BIGINT) AS gain")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least: int = 20,
    buckets: int = 10_000,
    longest: int = 1,
    seed: int = 2024,
    id_col: str = "doc_id",
) -> DataFrame:
    """Draw documents whose words look like the target's: ``id_col, n_features, weight, score, rank``, one row per row.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case; features are all runs of 1 to
    ``longest`` words joined by a blank, each in the bucket of its CRC-32. ``weight`` adds up the gains of a
    document's features; ``score`` adds Gumbel noise from the hash of the id, so that the highest scores
    are a draw without replacement. Of the N documents with ``least`` words, ``percent`` of them (rounded down) get
    a rank from 1, by score, then smaller id, null ids last; the others' rank is null. A null text has no
    words; a null id hashes as the empty one; rows that repeat are drawn each for itself; other columns are not
    read; an empty table gives no rows, an empty target gains by rarity alone.

    Texts are read once: their buckets are written, counted and scored. Only the gains, one number per bucket, go
    through the driver. Ranks come from ranges of the score.
    """
    found, names = features_of(docs.select(id_col, "text"), [id_col], "resample-features", buckets, longest)
    wanted, other = features_of(target.select("text"), [], "resample-target", buckets, longest)
    gains = gains_of(bucket_counts(found, names["features"], buckets), bucket_counts(wanted, other["features"], buckets), buckets)
    by_bucket = np.zeros(buckets, np.int64)
    for row in gains.collect():
        by_bucket[row["bucket"]] = row["gain"]
    shipped = docs.sparkSession.sparkContext.broadcast(by_bucket)
    width = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    slim = found.select(
        F.col(id_col).alias("id"), F.col(names["row"]).alias("row"), F.col(names["n_words"]).alias("n_words"),
        F.col(names["n_features"]).alias("n_features"), F.col(names["features"]).alias("features"),
    )
    schema = with_fields(slim.drop("features").schema, "weight long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        for batch in batches:
            weights = [int(gain[np.frombuffer(p.as_py(), width)].sum()) for p in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weights, pa.int64())], names=schema.names)

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    scored = slim.mapInArrow(weigh, schema).withColumn("h", F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"))
    scored = scored.withColumn("score", F.expr("weight + CAST(floor(-1000 * ln(-ln((h + 0.5D) / 4294967296D))) AS BIGINT)"))
    scored = written(scored.drop("h"), "resample-scores")
    enough = scored.filter(F.col("n_words") >= least)
    draws = percent * enough.count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row")]
    placed = ranked(enough, order, "rank", "resample-ranks").withColumn("rank", F.col("rank").cast("long") + 1)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    out = placed.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
