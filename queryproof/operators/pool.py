"""Candidate pools: several sources in order of trust, first appearance of a text wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidate_pool(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of ``(key, position, text)`` tables without blank or repeated texts per key.

    Ids are ``key:source:cN`` with N the position in the source. Texts meet by SHA-256, so the
    shuffle carries digests and positions, never the texts, and copies collapse in the map tasks.
    """
    pool = None
    for rank, (name, df) in enumerate(sources):
        part = df.filter(F.col("text") != "").select(
            "key",
            F.sha2("text", 256).alias("digest"),
            F.lit(rank).alias("source_rank"),
            "position",
            F.lit(name).alias("origin"),
        )
        pool = part if pool is None else pool.unionByName(part)
    first = pool.groupBy("key", "digest").agg(F.min(F.struct("source_rank", "position", "origin")).alias("f"))
    return first.select(
        "key",
        F.col("f.origin").alias("origin"),
        F.concat("key", F.lit(":"), "f.origin", F.lit(":c"), F.col("f.position").cast("string")).alias(
            "candidate_id"
        ),
    )
