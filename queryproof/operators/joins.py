"""Joins that keep working when one key holds a large share of a side.

Inner joins are left to Spark: adaptive execution splits a hot partition of either side. It cannot
split the inner side of an outer, semi or anti join:

* semi and anti joins meet the distinct keys of the other side, deduplicated in the map tasks;
* outer joins are Spark's own; where the side that can't be split is known to be hot, they are the
  inner join plus the unmatched rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("_key")).distinct()


def exists_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in the other table (EXISTS)."""
    return df.join(distinct_keys(other, other_key), F.col(key) == F.col("_key"), "left_semi")


def not_exists_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows of ``df`` whose key does not occur in the other table (NOT EXISTS); NULL keys stay."""
    return df.join(distinct_keys(other, other_key), F.col(key) == F.col("_key"), "left_anti")


def outer_join(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, how: str, hot: str | None = None
) -> DataFrame:
    """``left``, ``right`` or ``full`` outer join on one key; column names must not overlap.

    Spark's own join, unless ``hot`` names a side whose hot key it could not split: the side that is not
    kept whole, or any side of a full join. Then it is the inner join, whose both sides can be split, plus
    the unmatched rows, which reads the sides once more.
    """
    columns = left.columns + right.columns
    condition = F.col(left_key) == F.col(right_key)
    if hot is None or hot == how:
        return left.join(right, condition, how).select(*columns)
    out = left.join(right, condition).select(*columns)
    if how in ("left", "full"):
        unmatched = not_exists_in(left, left_key, right, right_key)
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
        out = out.unionByName(unmatched.select(*left.columns, *nulls))
    if how in ("right", "full"):
        unmatched = not_exists_in(right, right_key, left, left_key)
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields]
        out = out.unionByName(unmatched.select(*nulls, *right.columns))
    return out
