"""Filters driven by parameters: optional predicates, first-match branches, membership, updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryproof.operators.joins import exists_in


def is_given(value: Any) -> bool:
    """A parameter takes part when it is neither NULL nor an empty string."""
    return value is not None and value != ""


def holds(value: Any, test: str, literal: Any) -> bool:
    """A test of a parameter against a literal: ``==`` or ``!=``. Numbers compare as numbers."""
    if isinstance(value, (int, float)) and isinstance(literal, str):
        try:
            literal = float(literal)
        except ValueError:
            literal = str(literal)
    if test not in ("==", "!="):
        raise ValueError(f"unknown test: {test}")
    return (value == literal) == (test == "==")


def optional_filter(df: DataFrame, predicates: Sequence[tuple[Any, Column]]) -> DataFrame:
    """Apply each predicate whose parameter is given, or whose test, a truth value, holds.

    Tests such as ``holds(kind, "==", "A") and is_given(name)`` are plain Python on parameters.
    """
    return reduce(lambda d, p: d.filter(p[1]) if p[0] is not False and is_given(p[0]) else d, predicates, df)


def choose_filter(
    df: DataFrame, branches: Sequence[tuple[Any, Column]], otherwise: Column | None = None
) -> DataFrame:
    """Apply the first predicate whose parameter is given, else the fallback."""
    for value, predicate in branches:
        if is_given(value):
            return df.filter(predicate)
    return df if otherwise is None else df.filter(otherwise)


def branch_of(branches: Sequence[tuple[str, Column]], otherwise: str = "otherwise") -> Column:
    """Row-wise form of ``choose_filter``: the name of the first branch whose test holds."""
    col = F
    for name, test in branches:
        col = col.when(test, F.lit(name))
    return col.otherwise(F.lit(otherwise))


def member_filter(df: DataFrame, column: str, values: Sequence[Any] | DataFrame) -> DataFrame:
    """Keep rows whose column is in the collection, given as a list or as a one-column table.

    A table of ids is joined with a semi join; Spark broadcasts it only if its measured size is
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    if isinstance(values, DataFrame):
        return exists_in(df, column, values, values.columns[0])
    return df.filter(F.col(column).isin(list(values)))


def selective_update(df: DataFrame, where: Column, assignments: Mapping[str, Any]) -> DataFrame:
    """The table after ``UPDATE ... SET`` of the given (non-empty) assignments on matching rows."""
    given = {c: v for c, v in assignments.items() if isinstance(v, Column) or is_given(v)}
    return df.withColumns(
        {
            c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c))
            for c, v in given.items()
        }
    )
