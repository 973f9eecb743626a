"""Keyed lookups where the last row of a key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.operators.ranking import Order, best_per_key


def last_row_wins(df: DataFrame, keys: Sequence[str], latest_first: Order) -> DataFrame:
    """One row per key: the latest one in the given total order."""
    return best_per_key(df, keys, latest_first)


def enrich(
    df: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    latest_first: Order,
    columns: Sequence[str],
) -> DataFrame:
    """Left join with the latest right row of each key; the row count of ``df`` never changes."""
    one = last_row_wins(right, [right_key], latest_first).select(
        F.col(right_key).alias("_rk"), *[c for c in columns if c != right_key]
    )
    return df.join(one, F.col(left_key) == F.col("_rk"), "left").drop("_rk")
