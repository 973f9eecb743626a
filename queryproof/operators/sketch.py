"""Differences of two bags of rows from a sketch of fixed size that can be subtracted.

The sketch is an invertible Bloom table: every row goes to three cells picked by its hash, and a cell keeps the
number of its rows, the sum of their hashes and the sum of a check. Equal rows of two sides cancel when
their tables are subtracted. A cell with one row left shows that row's hash; taking it out of its other
two cells shows further ones, until all differing hashes are listed, or there were too many of them.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.functions.canon import row_hash
from queryproof.operators.equivalence import aligned, diff_rows

#: A prime below 2**31, so that products stay within a long, and the factors of four maps into it.
PRIME = 2**31 - 1
FACTORS = [(1_103_515_245, 1_284_865_837, 12_345), (1_664_525, 1_013_904_223, 97), (134_775_813, 1_812_433_253, 7), (69_069, 1_566_083_941, 11)]

#: Bits of a hash above each border; sums of such slices stay exact for trillions of rows.
SLICES = ((40, 0xFFFFFF), (20, 0xFFFFF), (0, 0xFFFFF))
SUMS = ["n", *(f"k{shift}" for shift, _ in SLICES), "c"]


def _mapped_sql(h: str, which: int) -> str:
    a, b, c = FACTORS[which]
    low, high = f"({h} & 4294967295L)", f"shiftrightunsigned({h}, 32)"
    return f"(({low} % {PRIME} * {a % PRIME} % {PRIME} + {high} % {PRIME} * {b % PRIME} % {PRIME} + {c}) % {PRIME})"


def _mapped(h: int, which: int) -> int:
    a, b, c = FACTORS[which]
    low, high = h & 0xFFFFFFFF, h >> 32
    return (low % PRIME * (a % PRIME) % PRIME + high % PRIME * (b % PRIME) % PRIME + c) % PRIME


def _cells(h: int, width: int) -> list[int]:
    return [_mapped(h, j) % width + j * width for j in range(3)]


def _check(h: int) -> int:
    # not linear, so that a sum of several rows does not pass for one
    return _mapped(h, 3) ** 2 % PRIME


def difference_sketch(df: DataFrame, cells: int = 12_288, algorithm: str = "native") -> DataFrame:
    """``(cell, n, k40, k20, k0, c)``: the sketch of one side, at most ``cells`` rows whatever the input.

    One aggregation over one scan; a task sends one row per cell at most. Sketches of the same size can
    be stored, added up over parts of a table and subtracted.
    """
    width = cells // 3
    places = ", ".join(f"{_mapped_sql('h', j)} % {width} + {j * width}L" for j in range(3))
    squared = f"({_mapped_sql('h', 3)} * {_mapped_sql('h', 3)}) % {PRIME}"
    placed = df.select(row_hash(df, algorithm=algorithm).alias("h")).select("h", F.expr(f"{squared} AS c"), F.expr(f"explode(array({places})) AS cell"))
    sums = [F.expr(f"sum(shiftrightunsigned(h, {shift}) & {mask}L) AS k{shift}") for shift, mask in SLICES]
    return placed.groupBy("cell").agg(F.count("*").alias("n"), *sums, F.sum("c").alias("c"))


def subtracted(before: DataFrame, after: DataFrame) -> DataFrame:
    """The sketch of what ``before`` has more than ``after``; cells where nothing is left are gone."""
    minus = after.select("cell", *((-F.col(c)).alias(c) for c in SUMS))
    left = before.unionByName(minus).groupBy("cell").agg(*(F.sum(c).alias(c) for c in SUMS))
    return left.filter(" OR ".join(f"{c} <> 0" for c in SUMS))


def peeled(cells: dict[int, list[int]], width: int) -> dict[int, int] | None:
    """Hash and surplus of every row left in a subtracted sketch, or None if they can't be told apart."""
    cells = defaultdict(lambda: [0] * len(SUMS), {c: list(v) for c, v in cells.items()})
    found: dict[int, int] = defaultdict(int)
    todo = deque(cells)
    while todo:
        cell = todo.popleft()
        n, *slices, check = cells[cell]
        if n == 0 or any(s % n for s in slices) or check % n:
            continue
        parts = [s // n for s in slices]
        if any(not 0 <= p <= mask for p, (_, mask) in zip(parts, SLICES)):
            continue
        h = sum(p << shift for p, (shift, _) in zip(parts, SLICES))
        places = _cells(h, width)
        if check // n != _check(h) or cell not in places:
            continue
        found[h] += n
        for place in places:
            sums = cells[place]
            for i, value in enumerate((1, *parts, _check(h))):
                sums[i] -= n * value
            todo.append(place)
    if any(any(v) for v in cells.values()):
        return None
    return {h - (h >> 63 << 64): n for h, n in found.items() if n}


def listed(sketch: DataFrame, cells: int = 12_288) -> dict[int, int] | None:
    """``peeled`` of a subtracted sketch; its rows, ``cells`` at most, go through the driver."""
    return peeled({r["cell"]: [r[c] for c in SUMS] for r in sketch.collect()}, cells // 3)


def diff_rows_by_sketch(
    before: DataFrame, after: DataFrame, path: str, cells: int = 12_288, algorithm: str = "native"
) -> DataFrame:
    """``diff_rows`` with ``found_by``: from a sketch while the differences fit into it, else by digests.

    A table of ``cells`` cells lists some three quarters as many differing rows. One scan of each side
    builds the sketches; a second one looks the rows up by their listed hashes, a table of constants no larger
    than the sketch, and counts them by all columns. No row is shuffled but the differing ones. With more
    differences than that, ``diff_rows`` writes digests below ``path``.
    """
    before, after = aligned(before, after)
    sketch = subtracted(*(difference_sketch(df, cells, algorithm) for df in (before, after)))
    found = listed(sketch, cells)
    if found is None:
        return diff_rows(before, after, path).withColumn("found_by", F.lit("digests"))
    spark, names = before.sparkSession, before.columns
    hashes = spark.createDataFrame([(h,) for h in found], "_h long")

    def side(df: DataFrame, in_before: int) -> DataFrame:
        tagged = df.select(*names, row_hash(df, algorithm=algorithm).alias("_h"), F.lit(in_before).alias("_b"))
        return tagged.join(hashes, "_h", "left_semi")

    rows = side(before, 1).unionByName(side(after, 0))
    counted = rows.groupBy(*names).agg(F.sum("_b").alias("n_before"), F.sum(1 - F.col("_b")).alias("n_after"))
    return counted.filter("n_before <> n_after").withColumn("found_by", F.lit("sketch"))


def sketch_report(before: DataFrame, after: DataFrame, cells: int = 12_288, algorithm: str = "native") -> DataFrame:
    """``(cells, status, n_different, n_surplus, n_missing)``: how many different rows differ, and how many
    rows ``before`` has too many and too few; the counts are null if they are TOO_MANY for the sketch."""
    before, after = aligned(before, after)
    found = listed(subtracted(*(difference_sketch(df, cells, algorithm) for df in (before, after))), cells)
    status = "TOO_MANY" if found is None else "LISTED"
    counts = [None] * 3 if found is None else [len(found), sum(max(n, 0) for n in found.values()), sum(max(-n, 0) for n in found.values())]
    return before.sparkSession.createDataFrame([(cells, status, *counts)], "cells int, status string, n_different long, n_surplus long, n_missing long")
