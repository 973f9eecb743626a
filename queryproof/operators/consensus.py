"""Agreement between the variants of a statement.

Sets of families, surfaces and operations matter only as "none, exactly one, several". Minimum and
maximum answer that, combine in the map tasks and never collect a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryproof.functions.rules import first_match


# Shapes, a blocker and a tier that allow review only.
FRAGMENTS_SHAPE = "MULTI_FRAGMENT_INCLUDE"
FRAGMENTS_BLOCKER = "MULTI_FRAGMENT_INCLUDE_REVIEW_ONLY"
COLLECTION_SHAPE = "FOREACH_COLLECTION_PREDICATE"
REVIEW_TIER = "REVIEW_REQUIRED"


def _several(name: str) -> Column:
    return F.col(f"_min_{name}") != F.col(f"_max_{name}")


def consensus(variants: DataFrame, key: str, position: list[str]) -> DataFrame:
    """One decision row per statement.

    Input columns: ``status``, ``gate``, ``family``, ``surface``, ``ops``, ``candidate``,
    ``supported`` (shape), ``status_reason`` and ``gate_reason``; reasons count in row order. Optional ones hold
    back a statement whose variants agree: ``at_risk`` (of any variant), and ``shape``, ``blocker`` and
    ``tier``, which tell what may only be reviewed. NULL holds nothing back.
    """
    # NULL or blank is a value that nobody gave: a partial status, an uncertain gate, no family at all
    status, gate = (F.coalesce(F.col(c), F.lit("")) for c in ("status", "gate"))
    given = {c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in ("family", "surface", "ops")}
    passed = status == "PASS"
    failed = status.isin("FAIL", "FAILED")
    gate_open = gate == "PASS"
    held = {c: F.col(c) if c in variants.columns else F.lit(None) for c in ("at_risk", "shape", "blocker", "tier")}
    yes_or_no = {
        "pass": passed,
        "fail": failed,
        "gate_open": gate_open,
        "gate_blocked": gate == "BLOCKED",
        "supported": F.col("supported"),
        "candidate": F.col("candidate").isNotNull(),
        "at_risk": held["at_risk"].cast("boolean"),
        "fragments": F.coalesce(held["shape"] == FRAGMENTS_SHAPE, F.lit(False)) | F.coalesce(held["blocker"] == FRAGMENTS_BLOCKER, F.lit(False)),
        "collection": held["shape"] == COLLECTION_SHAPE,
        "review": held["tier"] == REVIEW_TIER,
    }
    bits = {name: 1 << i for i, name in enumerate(yes_or_no)}
    flags = reduce(Column.bitwiseOR, [F.when(test, F.lit(bits[name])).otherwise(F.lit(0)) for name, test in yes_or_no.items()])
    # rows are sorted and sent as they are where keys hardly repeat within a task: what is told by yes or no
    # is a bit, and places go along with the reasons that count only
    status_reason = F.col("status_reason")
    gate_reason = F.when(~gate_open, F.col("gate_reason"))
    place = F.when(status_reason.isNotNull() | gate_reason.isNotNull(), F.struct(*position))
    compact = variants.select(
        key,
        flags.alias("_flags"),
        *(given[c].alias(f"_{c}") for c in given),
        status_reason.alias("_sr"),
        gate_reason.alias("_gr"),
        place.alias("_place"),
    )

    def has(name: str, column: str = "_flags") -> Column:
        return F.col(column).bitwiseAND(F.lit(bits[name])) != 0

    aggregates = [
        F.count("*").alias("n_variants"),
        F.count_if(has("pass")).alias("n_pass"),
        F.count_if(has("fail")).alias("n_fail"),
        F.count_if(has("gate_open")).alias("n_gate_pass"),
        F.count_if(has("gate_blocked")).alias("n_gate_blocked"),
        F.bit_or("_flags").alias("_any"),
        F.bit_and("_flags").alias("_all"),
        F.min_by("_sr", F.when(F.col("_sr").isNotNull(), F.col("_place"))).alias("_status_reason"),
        F.min_by("_gr", F.when(F.col("_gr").isNotNull(), F.col("_place"))).alias("_gate_reason"),
    ]
    for name in given:
        aggregates += [F.min(f"_{name}").alias(f"_min_{name}"), F.max(f"_{name}").alias(f"_max_{name}")]
    g = compact.groupBy(key).agg(*aggregates).select(
        "*",
        (F.col("n_variants") - F.col("n_pass") - F.col("n_fail")).alias("n_partial"),
        (F.col("n_variants") - F.col("n_gate_pass") - F.col("n_gate_blocked")).alias("n_gate_uncertain"),
        has("supported", "_all").alias("_supported"),
        has("candidate", "_any").alias("_candidates"),
        has("at_risk", "_any").alias("_at_risk"),
        has("fragments", "_any").alias("_fragments"),
        (has("collection", "_any") & has("review", "_any")).alias("_collection"),
    )
    no_family = F.col("_min_family").isNull()
    reason = first_match(
        [
            (~F.col("_supported"), "SHAPE_FAMILY_NOT_TARGET"),
            (
                F.col("n_pass") < F.col("n_variants"),
                F.coalesce("_status_reason", F.lit("VALIDATE_STATUS_NOT_PASS")),
            ),
            (
                F.col("n_gate_pass") < F.col("n_variants"),
                F.coalesce("_gate_reason", F.lit("SEMANTIC_GATE_NOT_PASS")),
            ),
            (no_family & ~F.col("_candidates"), "NO_PATCHABLE_CANDIDATE_SELECTED"),
            (no_family, "NO_PATCHABLE_CANDIDATE_UNSUPPORTED_STRATEGY"),
            (_several("family"), "PATCH_FAMILY_CONFLICT_OR_MISSING"),
            (_several("surface"), "PATCH_SURFACE_CONFLICT"),
            (_several("ops"), "REWRITE_OPS_CONFLICT"),
            (F.col("_at_risk"), "SEMANTIC_RISK_TAIL_BLOCKED"),
            (F.col("_fragments"), "NO_SAFE_BASELINE_MULTI_FRAGMENT_INCLUDE"),
            (F.col("_collection"), "NO_SAFE_BASELINE_COLLECTION_GUARDED_PREDICATE"),
        ],
        F.lit(None).cast("string"),
    )
    g = g.withColumn("conflict_reason", reason)
    agreed = F.col("conflict_reason").isNull()
    return g.select(
        key,
        "n_variants",
        "n_pass",
        "n_partial",
        "n_fail",
        "n_gate_pass",
        "n_gate_blocked",
        "n_gate_uncertain",
        F.when(agreed, "AUTO_PATCHABLE").otherwise("MANUAL_REVIEW").alias("decision"),
        "conflict_reason",
        F.when(agreed, F.col("_min_family")).alias("family"),
        F.when(agreed, F.col("_min_surface")).alias("surface"),
        F.when(agreed, F.col("_min_ops")).alias("ops"),
    )


def ops_fingerprint(ops: Column) -> Column:
    """Sorted ``op:target`` pairs joined by ``|`` from an array of structs; NULL when there is none."""
    named = F.filter(ops, lambda o: F.trim(F.coalesce(o["op"], F.lit(""))) != "")
    pairs = F.transform(
        named,
        lambda o: F.concat(F.trim(o["op"]), F.lit(":"), F.trim(F.coalesce(o["target"], F.lit("")))),
    )
    return F.when(F.size(pairs) > 0, F.array_join(F.array_sort(pairs), "|"))


def conflict_of_row(hard_conflicts: Column, checks: list[tuple[Column, Column]], reasons: Column) -> Column:
    """First telling reason of one row: hard conflicts, then checks in order, then other reasons."""
    telling = [
        F.when(status.isin("FAIL", "UNCERTAIN") & (code != "") & ~code.endswith("_STABLE"), code)
        for status, code in checks
    ]
    other = F.filter(reasons, lambda r: (r != "") & ~r.endswith("_STABLE"))
    hard = F.filter(hard_conflicts, lambda r: r != "")
    return F.coalesce(F.try_element_at(hard, F.lit(1)), *telling, F.try_element_at(other, F.lit(1)))


def first_conflict(rows: DataFrame, key: str, position: list[str]) -> DataFrame:
    """First reason among the rows of a key whose ``gate`` is not PASS; input column ``reason``."""
    blocked = rows.filter(F.coalesce("gate", F.lit("")) != "PASS")
    order = F.when(F.col("reason").isNotNull(), F.struct(*position))
    return blocked.groupBy(key).agg(
        F.coalesce(F.min_by("reason", order), F.lit("SEMANTIC_GATE_NOT_PASS")).alias("conflict")
    )


def clear_winners(rows: DataFrame, statement: str, variant: str) -> DataFrame:
    """PASS counts per statement joined back: a variant wins when it is the only one that passed."""
    passed = F.col("status") == "PASS"
    counts = rows.groupBy(F.col(statement).alias("_statement")).agg(
        F.count_if(passed).alias("n_pass"), F.min(F.when(passed, F.col(variant))).alias("_winner")
    )
    joined = rows.join(counts, F.col(statement).eqNullSafe(F.col("_statement")))
    clear = (F.col("n_pass") == 1) & F.col("_winner").eqNullSafe(F.col(variant)) & F.coalesce(passed, F.lit(False))
    return joined.select(
        *rows.columns,
        "n_pass",
        F.when(clear, F.lit(None).cast("string")).otherwise("PATCH_CONFLICT_NO_CLEAR_WINNER").alias("gate_code"),
    )


def gate_code(decision: Column) -> Column:
    """Code that blocks a row whose statement was not decided AUTO_PATCHABLE."""
    return first_match(
        [
            (decision.isNull() | (decision == "AUTO_PATCHABLE"), F.lit(None).cast("string")),
            (decision == "MANUAL_REVIEW", "PATCH_CONVERGENCE_REVIEW_REQUIRED"),
            (decision == "NOT_PATCHABLE", "PATCH_CONVERGENCE_NOT_PATCHABLE"),
        ],
        "PATCH_CONVERGENCE_BLOCKED",
    )
