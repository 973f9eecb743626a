"""Sort keys that order nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_constant_order(keys: Sequence[Column | str | int | None], columns: Sequence[str]) -> list[Column]:
    """Sort keys without the constant ones.

    Names of columns and column expressions are kept, ``None`` and other strings are constants.
    A whole number is the position of an output column in SQL, not a constant, so it is turned
    into that column.
    """
    kept = []
    for key in keys:
        if isinstance(key, int):
            kept.append(F.col(columns[key - 1]))
        elif isinstance(key, Column):
            kept.append(key)
        elif key in columns:
            kept.append(F.col(key))
    return kept
