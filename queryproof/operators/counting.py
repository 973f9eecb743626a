"""Counts of codes, top-k reports and batch totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_counts(df: DataFrame, codes: str, once_per_row: bool = False) -> DataFrame:
    """``(code, n)`` over an array column; blank codes are dropped."""
    array = F.array_distinct(codes) if once_per_row else F.col(codes)
    return (
        df.select(F.explode(array).alias("code"))
        .filter(F.trim("code") != "")
        .groupBy("code")
        .agg(F.count("*").alias("n"))
    )


def top_codes(counts: DataFrame, k: int, code: str = "code", n: str = "n") -> DataFrame:
    """The k most frequent codes, ties by code."""
    return counts.orderBy(F.desc(n), F.asc(code)).limit(k)


def share(part: Column, total: Column, digits: int) -> Column:
    """``part / total`` rounded half up, 0 when there is nothing to divide by."""
    return F.when(total > 0, F.round(part / total, digits)).otherwise(F.lit(0.0))


def group_totals(
    df: DataFrame, batch: str, decision: str, auto: str, review: str, not_patchable: str
) -> DataFrame:
    """Decision counts and auto rate per batch and for all batches together."""
    total = F.count("*")
    n_auto = F.count_if(F.col(decision) == auto)
    return (
        df.rollup(batch)
        .agg(
            (F.grouping(batch) == 1).alias("is_total"),
            total.alias("n_statements"),
            n_auto.alias("n_auto"),
            F.count_if(F.col(decision) == review).alias("n_review"),
            F.count_if(F.col(decision) == not_patchable).alias("n_not_patchable"),
            (total - n_auto).alias("n_blocked"),
            share(n_auto, total, 4).alias("auto_rate"),
        )
        .withColumnRenamed(batch, "batch")
    )


def fixed_status_counts(df: DataFrame, status: str, statuses: Sequence[str]) -> DataFrame:
    """``(status, n)`` for a fixed list, zeros kept: one aggregate, then unpivoted."""
    counts = df.agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses])
    return counts.unpivot([], list(statuses), "status", "n")
