"""Precondition audits: ask the data whether a rewrite is safe. Each returns one row.

All of them aggregate before they shuffle and never build joined rows just to count them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_count(df: DataFrame, column: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if(column.isNull()).alias("n_null"))


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, keys with copies and the largest number of copies."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated_keys"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("max_copies"),
    ).withColumn("is_unique", F.col("n_duplicated_keys") == 0)


def conjunct_removal(df: DataFrame, kept: Column, removed: Column) -> DataFrame:
    """Rows let in by dropping one conjunct; the removal is blocked as soon as there is one."""
    extra = kept & ~F.coalesce(removed, F.lit(False))
    return df.agg(
        F.count_if(kept & removed).alias("n_before"),
        F.count_if(kept).alias("n_after"),
        F.count_if(extra).alias("n_let_in"),
    ).withColumn("decision", F.when(F.col("n_let_in") == 0, "REVIEW").otherwise("BLOCKED"))


def key_counts(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("_key")).agg(F.count("*").alias(out))


def join_fanout(outer: DataFrame, outer_key: str, inner: DataFrame, inner_key: str) -> DataFrame:
    """Semi-join rows against inner-join rows, from per-key counts of both sides."""
    left = key_counts(outer, outer_key, "_n_outer")
    right = key_counts(inner, inner_key, "_n_inner")
    return (
        left.join(right, "_key")
        .agg(
            F.coalesce(F.sum("_n_outer"), F.lit(0)).alias("n_semi"),
            F.coalesce(F.sum(F.col("_n_outer") * F.col("_n_inner")), F.lit(0)).alias("n_join"),
            F.coalesce(F.max("_n_inner"), F.lit(0)).alias("max_fanout"),
        )
        .withColumn("safe", F.col("n_semi") == F.col("n_join"))
    )


def join_elimination(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """May a joined table be dropped? LEFT needs a unique right key, INNER also no orphans.

    NULL keys match nothing: on the right they don't count, on the left they are orphans.
    """
    lk = key_counts(left, left_key, "_n_left")
    rk = key_counts(right.filter(F.col(right_key).isNotNull()), right_key, "_n_right")
    return (
        lk.join(rk, "_key", "full")
        .agg(
            F.count_if(F.col("_n_right") > 1).alias("n_duplicated_right_keys"),
            F.coalesce(
                F.sum(F.when(F.col("_n_right").isNull(), F.col("_n_left"))), F.lit(0)
            ).alias("n_orphan_rows"),
        )
        .withColumn("left_join_removable", F.col("n_duplicated_right_keys") == 0)
        .withColumn(
            "inner_join_removable",
            (F.col("n_duplicated_right_keys") == 0) & (F.col("n_orphan_rows") == 0),
        )
    )


def limit_removal(df: DataFrame, limit: int) -> DataFrame:
    """A LIMIT may go only when the result has no more rows than it allows."""
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(limit).cast("bigint").alias("row_limit"),
        (F.col("n_rows") <= limit).alias("removable"),
    )
