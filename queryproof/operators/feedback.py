"""Feedback reports: frequent issue patterns and overall counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feedback_patterns(issues: DataFrame, pattern: Sequence[str], key: str, order: Sequence[str]) -> DataFrame:
    """Frequency of each pattern and the key of its first record in the given order.

    One aggregation, so NULL in a pattern column is a value like others.
    """
    return issues.groupBy(*pattern).agg(
        F.count("*").alias("frequency"), F.min_by(key, F.struct(*order)).alias("first_key")
    )


def feedback_summary(records: DataFrame, issue: str, status: str) -> DataFrame:
    """Long table ``(metric, code, metric_value)``: totals, distributions and the issue rate.

    Each record becomes the metrics it counts for, so one aggregation serves them all.
    """
    has_issue = F.col(issue).isNotNull()

    def metric(name, code):
        return F.struct(F.lit(name).alias("metric"), code.alias("code"))

    metrics = F.array_compact(
        F.array(
            metric("records", F.lit("")),
            F.when(has_issue, metric("records_with_issues", F.lit(""))),
            F.when(has_issue, metric("issue_type", F.col(issue))),
            metric("status", F.col(status)),
        )
    )
    counts = records.select(F.inline(metrics)).groupBy("metric", "code").agg(
        F.count("*").cast("double").alias("metric_value")
    )
    rate = records.agg(
        F.round(F.count_if(has_issue) / F.greatest(F.count("*"), F.lit(1)), 4).alias("metric_value")
    ).select(F.lit("issue_rate").alias("metric"), F.lit("").alias("code"), "metric_value")
    return counts.unionByName(rate)
