"""Candidate selection per key: best, fallback, runner-up, funnel and readiness.

A candidate table has ``key``, ``candidate_id``, the position columns that order the candidates of a
key, and the columns of ``RANK_COLUMNS`` plus ``semantic_match``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryproof.functions.rules import first_match
from queryproof.operators.ranking import pick_max, pick_min, top_per_key

RANK_COLUMNS = ("effective_change", "patchability", "canonical", "improved", "after_cost")


def _rank_values() -> list[Column]:
    """Larger is better: a change beats none, then scores, then improvement, then lower cost."""
    cost = F.coalesce(F.col("after_cost"), F.lit(float("inf")))
    return [
        F.col("effective_change").cast("int"),
        F.col("patchability"),
        F.col("canonical"),
        F.coalesce(F.col("improved"), F.lit(False)).cast("int"),
        -cost,
    ]


def _earlier_is_better(position: Sequence[str]) -> list[Column]:
    return [-F.col(p) for p in position]


def select_best(candidates: DataFrame, key: str, position: Sequence[str]) -> DataFrame:
    """The selected candidate of each key: best matching one, else best of all; earlier wins ties.

    All candidates take part.
    """
    rank = _rank_values() + _earlier_is_better(position)
    payload = ["candidate_id", "patchability", "tier"]
    picked = candidates.groupBy(key).agg(
        F.count("*").alias("n_candidates"),
        F.count_if("semantic_match").alias("n_matching"),
        pick_max(payload, rank, F.col("semantic_match")).alias("best"),
        pick_max(payload, rank).alias("fallback"),
    )
    chosen = F.coalesce("best", "fallback")
    return picked.select(
        key,
        "n_candidates",
        "n_matching",
        chosen["candidate_id"].alias("selected_id"),
        chosen["tier"].alias("tier"),
        F.when(F.col("n_matching") > 0, "MATCH").otherwise("FALLBACK").alias("selected_by"),
    )


def runner_up(candidates: DataFrame, key: str, position: Sequence[str]) -> DataFrame:
    """The second best matching candidate of each key."""
    ranked = candidates.filter("semantic_match").withColumns(
        {f"_r{i}": c for i, c in enumerate(_rank_values())}
    )
    order = [(f"_r{i}", "desc") for i in range(len(RANK_COLUMNS))] + [(p, "asc") for p in position]
    return top_per_key(ranked, [key], order, 2).filter("rn = 2").select(key, F.col("candidate_id").alias("runner_up_id"))


def runner_up_by_scan(candidates: DataFrame, key: str, position: Sequence[str]) -> DataFrame:
    """The runner-up a single scan in candidate order remembers.

    When the best candidate displaced an earlier leader, it is that leader; otherwise it is the
    first matching candidate after the best. Two aggregations instead of a scan per key.
    """
    matching = candidates.filter("semantic_match")
    pos = F.struct(*position)
    rank = _rank_values() + _earlier_is_better(position)
    best = matching.groupBy(F.col(key).alias("_key")).agg(pick_max(position, rank).alias("_best_pos"))
    around = matching.join(best, F.col(key) == F.col("_key"))
    before, after = pos < F.col("_best_pos"), pos > F.col("_best_pos")
    found = around.groupBy(key).agg(
        pick_max(["candidate_id"], rank, before).alias("leader"),
        pick_min(["candidate_id"], [F.col(p) for p in position], after).alias("next"),
    )
    runner = F.coalesce(F.col("leader.candidate_id"), F.col("next.candidate_id"))
    return found.select(key, runner.alias("runner_up_id")).filter(F.col("runner_up_id").isNotNull())


def funnel(candidates: DataFrame, key: str) -> DataFrame:
    """Raw, validated, accepted and pruned candidates per key, and how a key ran dry.

    Input columns: ``valid``, ``low_value`` and ``text_only`` flags.
    """
    accepted = F.col("valid") & ~F.col("low_value")
    counts = candidates.groupBy(key).agg(
        F.count("*").alias("n_raw"),
        F.count_if("valid").alias("n_validated"),
        F.count_if(accepted).alias("n_accepted"),
        F.count_if(F.col("valid") & F.col("low_value")).alias("n_pruned"),
        F.count_if("text_only").alias("_text_only"),
    )
    kind = first_match(
        [
            ((F.col("n_raw") > 0) & (F.col("_text_only") == F.col("n_raw")), "TEXT_ONLY_FALLBACK"),
            (F.col("n_validated") == 0, "EMPTY_CANDIDATES"),
            (F.col("n_accepted") == 0, "ONLY_LOW_VALUE_CANDIDATES"),
        ],
        F.lit(None).cast("string"),
    )
    return counts.withColumn("degradation", kind).drop("_text_only")


def readiness(tier: Column) -> Column:
    """READY for a good tier, NEEDS_TEMPLATE_REWRITE for a poor one, BLOCKED without a candidate."""
    return F.when(tier.isNull(), "BLOCKED").when(tier.isin("HIGH", "MEDIUM"), "READY").otherwise(
        "NEEDS_TEMPLATE_REWRITE"
    )


def primary_rule(rules: Sequence[tuple[Column, int, int, str]]) -> dict[str, Column]:
    """Primary rule and total score of a row from ``(condition, priority, delta, rule_id)``."""
    matched = F.array_compact(
        F.array(
            *[
                F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(d).alias("delta"), F.lit(r).alias("rule_id")))
                for c, p, d, r in rules
            ]
        )
    )
    total = F.aggregate(matched, F.lit(0), lambda acc, m: acc + m["delta"])
    return {"primary_rule": F.array_max(matched)["rule_id"], "canonical_score": total, "n_rules": F.size(matched)}
