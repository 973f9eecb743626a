"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import ranked, scalar, text_or_empty, totals_before, unused, written

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it.
SPACED = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"


def with_targets(sources: DataFrame, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """Add ``target`` to ``(rank, source_size)``: a weighted share of all sizes, ``most_epochs`` times
    the source at most.

    What a stopped source leaves is shared by weight among the others. With a common level L the target
    is ``min(most_epochs * size, L * weight)``. Each round recomputes L for the sources not stopped so
    far; L only rises, so each round stops further sources until none is above. A round sends three sums
    to the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = written(
        sources.select("*", weight.cast("double").alias("weight"), (F.col("source_size") * most_epochs).alias("most")),
        "mix-sources",
    )
    total = scalar(sources.agg(F.sum("source_size"))) or 0
    level, stopped = 0.0, -1
    while total:
        above = F.col("most") < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(above, F.col("most")).otherwise(0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
            F.sum(above.cast("long")),
        ).first()
        if row[2] == stopped or not row[1]:
            break
        level, stopped = (total - row[0]) / row[1], row[2]
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target).drop("weight", "most")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most_epochs: int = 3,
    seed: int = 4,
    id_col: str = "doc_id",
    row_col: str | None = None,
) -> DataFrame:
    """How many words the mix takes from each document.

    Returns ``id_col, size, source, source_size, target, taken``, one row per input row. Sources in code
    point order, null last, take the weights in turn. Within a source documents stand in hash-random
    order (the hash of id and text); the budget, the target rounded to a whole number, takes as many
    whole epochs as fit and then cuts the order at the exact word, so the last document may be taken in
    part. Null texts and texts of white space have size 0 and nothing is taken from them. Rows that
    repeat count each for itself: they are interchangeable. Other columns are not read, but ``row_col``,
    which tells rows apart and comes last in the result, if it is given. An empty table gives no rows.
    """
    row = [F.col(row_col).alias("row")] if row_col else []
    slim = docs.select(
        *row,
        F.col(id_col).alias("id"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(id_col, text_or_empty(), F.lit(seed)).alias("key"),
    )
    slim = written(slim, "mix-sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    sources = with_targets(ranked(sums, order, "rank", "mix-ranks"), weights, most_epochs)
    rows = slim.join(sources, slim.source.eqNullSafe(sources.source)).drop(sources.source)
    ties = ["id", "size", "row"] if row_col else ["id", "size"]
    rows = totals_before(rows, "rank", "key", ties, "size", "before", slim.count())
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    last = [F.col("row").alias(row_col)] if row_col else []
    return rows.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", taken.alias("taken"), *last)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``.

    A document comes once for every whole time it is taken; a part is a further row whose ``text`` is
    cut after its last word taken and keeps its layout up to there, and with ``n_chars``, where there is one, set anew. The plan is
    joined by a written row number, so ids may be null or repeat.
    """
    row, own, size, taken, time = unused(docs, "mix_row", "mix_own", "mix_size", "mix_taken", "mix_time")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = mix(numbered, row_col=row, **options).filter("taken > 0")
    plan = plan.select(F.col(row).alias(own), F.col("size").alias(size), F.col("taken").alias(taken))
    rows = numbered.join(plan, F.col(row) == F.col(own))
    part = F.pmod(taken, size)
    times = F.floor(F.col(taken) / F.col(size)).cast("int") + F.when(part > 0, 1).otherwise(0)
    rows = rows.withColumn(time, F.explode(F.sequence(F.lit(1), times)))
    cut = F.col(time) * F.col(size) > F.col(taken)
    words = F.slice(F.regexp_extract_all("text", F.lit(SPACED), F.lit(1)), F.lit(1), part.cast("int"))
    rows = rows.withColumn("text", F.when(cut, F.array_join(words, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        chars = F.when(cut, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
