"""Many comparisons over few scans: each table is read once for all the pairs that use it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryproof.functions.canon import quoted, row_hash
from queryproof.operators.equivalence import _judged, _report, common_sql, common_type


@dataclass(frozen=True)
class Side:
    """One side of a pair, or a branch of it: SQL expressions over the rows of a table that pass a condition."""

    table: str
    columns: tuple[str, ...]
    where: str = "true"


Pair = tuple[str, Sequence[Side], Sequence[Side]]


def compare_on_shared_scans(tables: Mapping[str, DataFrame], pairs: Sequence[Pair], algorithm: str = "native") -> DataFrame:
    """The reports of ``compare_batch`` for pairs whose sides filter and project one table, or are the UNION ALL
    of such branches.

    Every row of a table becomes one ``(pair, side, hash)`` entry for each branch that it passes, so a table is
    scanned once however many pairs use it; columns and conditions that branches share are worked out once.
    All entries meet in one aggregation, to which a task sends one row a pair.
    """
    found: dict[str, list[tuple[int, int, Side, list[tuple[T.DataType, T.DataType, T.DataType]]]]] = {}
    for number, (name, before, after) in enumerate(pairs):
        schemas = [[tables[s.table].selectExpr(*s.columns).schema for s in sides] for sides in (before, after)]
        own, other = ([f.dataType for f in schema[0].fields] for schema in schemas)
        if any([f.dataType for f in s.fields] != kinds for some, kinds in zip(schemas, (own, other)) for s in some):
            raise ValueError(f"{name}: branches of a side differ in their types")
        common = [common_type(a, b) for a, b in zip(own, other)] if len(own) == len(other) else [None]
        if None in common:
            raise ValueError(f"{name}: sides can't be compared")
        for which, (sides, mine, theirs) in enumerate(((before, own, other), (after, other, own))):
            for side in sides:
                found.setdefault(side.table, []).append((number, which, side, list(zip(mine, theirs, common))))
    entries = [_entries(tables[table], branches, algorithm) for table, branches in found.items()]
    none = F.lit(None).cast("bigint")
    spark = next(iter(tables.values())).sparkSession
    marks = spark.range(len(pairs)).select(F.col("id").cast("int").alias("pair"), F.lit(0).alias("side"), none.alias("h"))
    rows = reduce(DataFrame.unionByName, [*entries, marks])
    names = F.array(*(F.lit(name) for name, _, _ in pairs))
    tagged = rows.select(
        F.element_at(names, F.col("pair") + 1).alias("pair_id"),
        F.when(F.col("side") == 0, F.col("h")).alias("h_before"),
        F.when(F.col("side") == 1, F.col("h")).alias("h_after"),
    )
    return _report(_judged(tagged, ["pair_id"]))


def _entries(table: DataFrame, branches: list, algorithm: str) -> DataFrame:
    """``(pair, side, h)`` of one table."""
    columns: dict[str, str] = {}
    wanted: dict[tuple[str, str], str] = {}
    tests: dict[str, str] = {}
    for _, _, side, kinds in branches:
        tests.setdefault(side.where, f"w{len(tests)}")
        for expression, (mine, theirs, common) in zip(side.columns, kinds):
            plain = columns.setdefault(expression, f"p{len(columns)}")
            wanted.setdefault((expression, common_sql(quoted(plain), mine, theirs, common)), f"c{len(wanted)}")
    first = table.select(
        *(F.expr(e).alias(name) for e, name in columns.items()), *(F.expr(f"coalesce({test}, false)").alias(name) for test, name in tests.items())
    )
    second = first.select(*(F.expr(form).alias(name) for (_, form), name in wanted.items()), *tests.values())
    out = []
    for number, which, side, kinds in branches:
        names = [wanted[e, common_sql(quoted(columns[e]), m, t, c)] for e, (m, t, c) in zip(side.columns, kinds)]
        entry = F.struct(F.lit(number).alias("pair"), F.lit(which).alias("side"), row_hash(second, names, algorithm).alias("h"))
        out.append(F.when(F.col(tests[side.where]), entry))
    return second.select(F.inline(F.array(*out))).filter("pair IS NOT NULL")
