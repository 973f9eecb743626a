"""Fingerprints of ordered results that are put together from sorted parts.

A sequence of row hashes is a polynomial: the hash at position i counts B**i, modulo a prime. Two sequences
one behind the other give ``value + B**length * value``, so each sorted part is one small row, wherever the
borders of the parts lie, and no row needs a number in the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryproof.functions.canon import row_hash
from queryproof.operators.equivalence import aligned
from queryproof.operators.ranking import order_columns

#: Two primes below 2**31, whose products stay within a long, and a base for each.
MODULI = ((2**31 - 1, 1_000_003_921), (2**31 - 19, 740_189_507))
#: Bits of a position looked up at once; six small tables reach positions of 36 bits, more than a part can have.
STEP, TABLES = 6, 6


def _power_sql(position: str, prime: int, base: int) -> str:
    """``base**position`` modulo the prime, from tables of powers."""
    product = ""
    for level in range(TABLES):
        step = pow(base, 1 << STEP * level, prime)
        table = ", ".join(f"{pow(step, i, prime)}L" for i in range(1 << STEP))
        factor = f"array({table})[CAST(shiftright({position}, {STEP * level}) & {(1 << STEP) - 1}L AS INT)]"
        product = f"{product} * {factor} % {prime}" if product else factor
    return product


def sequence_parts(df: DataFrame, order: Sequence[tuple[str, str]], algorithm: str = "native") -> DataFrame:
    """``(part, n, v0, v1)``: one row for each sorted part of the result.

    Only the order columns and the row's hash are moved, once, into ranges of the order. Rows that the
    order leaves tied stand by their hash, so ties have one sequence on both sides.
    """
    names = [c for c, _ in order]
    slim = df.select(*(F.col(c).alias(f"o{i}") for i, c in enumerate(names)), row_hash(df, algorithm=algorithm).alias("h"))
    by = [*order_columns([(f"o{i}", d) for i, (_, d) in enumerate(order)]), F.col("h")]
    place = F.monotonically_increasing_id()
    sorted_rows = slim.repartitionByRange(*by).sortWithinPartitions(*by).select("h", place.alias("place"))
    parts = sorted_rows.select(F.expr("shiftright(place, 33)").alias("part"), F.expr(f"place & {(1 << 33) - 1}L").alias("i"), "h")
    values = [F.expr(f"sum(pmod(h, {p}) * ({_power_sql('i', p, b)}) % {p}) % {p} AS v{k}") for k, (p, b) in enumerate(MODULI)]
    return parts.groupBy("part").agg(F.count("*").alias("n"), *values)


def joined_parts(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., n_rows, fingerprint)`` from the parts in order; what meets for a key is one row a part."""
    columns = ["part", "n", "v0", "v1"]
    for k, (p, b) in enumerate(MODULI):
        parts = parts.withColumn(f"b{k}", F.expr(_power_sql("n", p, b)))
        columns.append(f"b{k}")
    every = F.expr(f"reverse(array_sort(collect_list(struct({', '.join(columns)}))))").alias("every")
    total = parts.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), every)
    folded = [f"aggregate(every, 0L, (later, x) -> (x.v{k} + x.b{k} * later % {p}) % {p})" for k, (p, _) in enumerate(MODULI)]
    return total.select(*keys, "n_rows", F.expr(f"concat_ws(':', n_rows, {folded[0]}, {folded[1]})").alias("fingerprint"))


def ordered_fingerprint(df: DataFrame, order: Sequence[tuple[str, str]], algorithm: str = "native") -> DataFrame:
    """``(n_rows, fingerprint)`` of the rows in order: one sort, one row a part, nothing written or numbered."""
    return joined_parts(sequence_parts(df, order, algorithm))


def compare_sequences(
    before: DataFrame,
    before_order: Sequence[tuple[str, str]],
    after: DataFrame,
    after_order: Sequence[tuple[str, str]],
    algorithm: str = "native",
) -> DataFrame:
    """One row: counts and ordered fingerprints of both sides, MATCH if they are the same rows in the same order.

    Each side is sorted by its own order, but for ties. Like ``compare_ordered_bags``, without writing; it
    does not say where they differ, as ``compare_ordered`` does.
    """
    before, after = aligned(before, after)
    left = sequence_parts(before, before_order, algorithm).withColumn("side", F.lit("before"))
    right = sequence_parts(after, after_order, algorithm).withColumn("side", F.lit("after"))
    sides = joined_parts(left.unionByName(right), ["side"])

    def of(side: str, value: str, empty: object) -> Column:
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col(value))), F.lit(empty))

    one = sides.agg(
        *(of(s, "n_rows", 0).alias(f"n_{s}") for s in ("before", "after")),
        *(of(s, "fingerprint", "0:0:0").alias(f"fp_{s}") for s in ("before", "after")),
    )
    same = F.when(F.col("fp_before") == F.col("fp_after"), "MATCH").otherwise("MISMATCH")
    return one.select("*", same.alias("ordered_status"))
