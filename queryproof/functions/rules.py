"""Rule ladders and code maps: rules are data, compiled to column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    col = F
    for condition, value in rules:
        col = col.when(condition, value if isinstance(value, Column) else F.lit(value))
    return col.otherwise(default if isinstance(default, Column) else F.lit(default))


def matching_codes(rules: Sequence[tuple[Column, str]]) -> Column:
    """Array of the codes of all rules that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in rules]))


@dataclass(frozen=True)
class CodeMap:
    """A fixed code-to-value map, looked up inside the expression (no join, no broadcast)."""

    values: Mapping[str, object]

    def lookup(self, code: Column) -> Column:
        pairs = [F.lit(x) for kv in self.values.items() for x in kv]
        return F.try_element_at(F.create_map(*pairs), code)


# Rank of a delivery tier, unknown tiers are -1.
DELIVERY_RANK = CodeMap(
    {
        "AUTO_PATCH": 4,
        "READY_TO_APPLY": 4,
        "PATCHABLE_WITH_REWRITE": 3,
        "REVIEW_ONLY": 2,
        "MANUAL_REVIEW": 2,
        "NEEDS_REVIEW": 1,
        "BLOCKED": 0,
    }
)

# Failure class of a reason code, for every phase and per phase.
GLOBAL_FAILURE_CLASS = CodeMap(
    {
        "RUNTIME_STAGE_TIMEOUT": "retryable",
        "RUNTIME_RETRY_EXHAUSTED": "retryable",
        "UNSUPPORTED_PLATFORM": "fatal",
    }
)
PHASE_FAILURE_CLASS = {
    "preflight": CodeMap(
        {
            "PREFLIGHT_CHECK_FAILED": "fatal",
            "PREFLIGHT_DB_UNREACHABLE": "fatal",
            "PREFLIGHT_LLM_UNREACHABLE": "fatal",
            "PREFLIGHT_SCANNER_MISSING": "fatal",
        }
    ),
    "scan": CodeMap(
        {
            "SCAN_CLASS_RESOLUTION_DEGRADED": "degradable",
            "SCAN_CLASS_NOT_FOUND": "degradable",
            "SCAN_TYPE_ATTR_SANITIZED": "degradable",
            "SCAN_STATEMENT_PARSE_DEGRADED": "degradable",
            "SCAN_PARTIAL_COVERAGE_BELOW_THRESHOLD": "fatal",
            "SCAN_MAPPER_NOT_FOUND": "fatal",
            "SCAN_XML_PARSE_FATAL": "fatal",
            "SCAN_UNKNOWN_EXIT": "fatal",
        }
    ),
    "validate": CodeMap(
        {
            "VALIDATE_DB_UNREACHABLE": "degradable",
            "VALIDATE_PARAM_INSUFFICIENT": "degradable",
            "VALIDATE_PERF_NOT_IMPROVED": "degradable",
            "VALIDATE_PERF_NOT_IMPROVED_WARN": "degradable",
            "VALIDATE_SEMANTIC_ERROR": "degradable",
            "VALIDATE_SEMANTIC_GATE_NOT_PASS": "degradable",
            "VALIDATE_SEMANTIC_CONFIDENCE_LOW": "degradable",
            "VALIDATE_SECURITY_DOLLAR_SUBSTITUTION": "degradable",
            "VALIDATE_EQUIVALENCE_MISMATCH": "fatal",
            "VALIDATE_TIMEOUT": "retryable",
        }
    ),
    "patch_generate": CodeMap(
        {
            "PATCH_CONFLICT_NO_CLEAR_WINNER": "degradable",
            "PATCH_FAMILY_SPEC_MISSING": "degradable",
            "PATCH_LOCATOR_AMBIGUOUS": "degradable",
            "PATCH_VALIDATION_BLOCKED_SECURITY": "degradable",
            "PATCH_SEMANTIC_EQUIVALENCE_NOT_PASS": "degradable",
            "PATCH_SEMANTIC_CONFIDENCE_LOW": "degradable",
            "PATCH_BLOCKED_BY_SEMANTIC_RISK": "fatal",
            "PATCH_GENERATION_ERROR": "retryable",
        }
    ),
    "runtime": CodeMap({"RUNTIME_SCHEMA_VALIDATION_FAILED": "fatal"}),
}


def failure_class(code: Column, phase: Column) -> Column:
    """Class of a reason code: by its phase, then globally, then by any phase, else ``fatal``."""
    phase_key = F.lower(F.trim(F.coalesce(phase, F.lit(""))))
    by_phase = [F.when(phase_key == p, m.lookup(code)) for p, m in PHASE_FAILURE_CLASS.items()]
    by_any = [m.lookup(code) for m in PHASE_FAILURE_CLASS.values()]
    return F.coalesce(*by_phase, GLOBAL_FAILURE_CLASS.lookup(code), *by_any, F.lit("fatal"))


# Blocker buckets in report order.
BLOCKER_BUCKETS = (
    "NO_PATCHABLE_CANDIDATE_SELECTED",
    "NO_SAFE_BASELINE_RECOVERY",
    "SEMANTIC_GATE_NOT_PASS",
    "VALIDATE_STATUS_NOT_PASS",
    "SHAPE_FAMILY_NOT_TARGET",
    "OTHER",
)


def blocker_bucket(reason: Column) -> Column:
    code = F.upper(F.trim(F.coalesce(reason, F.lit(""))))
    return first_match(
        [
            (code.startswith("NO_PATCHABLE_CANDIDATE"), "NO_PATCHABLE_CANDIDATE_SELECTED"),
            (code.startswith("NO_SAFE_BASELINE_"), "NO_SAFE_BASELINE_RECOVERY"),
            (code.startswith("SEMANTIC_"), "SEMANTIC_GATE_NOT_PASS"),
            (code.startswith("VALIDATE_"), "VALIDATE_STATUS_NOT_PASS"),
            (code.isin(*BLOCKER_BUCKETS[:-1]), code),
        ],
        "OTHER",
    )


# The step recommended for the bucket in focus.
NEXT_STEP = CodeMap(
    {
        "NO_PATCHABLE_CANDIDATE_SELECTED": "fix_shared_candidate_selection_gaps",
        "NO_SAFE_BASELINE_RECOVERY": "clarify_safe_baseline_recovery_paths",
        "SEMANTIC_GATE_NOT_PASS": "fix_semantic_comparison_weaknesses",
        "VALIDATE_STATUS_NOT_PASS": "fix_validation_status_propagation",
        "SHAPE_FAMILY_NOT_TARGET": "curate_family_boundary_candidates",
        "OTHER": "inspect_misc_blockers",
        "READY": "expand_generalization_coverage",
    }
)


def blocker_family(delivery: Column, code: Column, gate: Column) -> Column:
    """READY, SECURITY, SEMANTIC or TEMPLATE_UNSUPPORTED, tested in that order."""
    return first_match(
        [
            (delivery == "READY_TO_APPLY", "READY"),
            (code.isin("VALIDATE_SECURITY_DOLLAR_SUBSTITUTION"), "SECURITY"),
            ((gate == "FAIL") | code.isin(*SEMANTIC_BLOCKERS), "SEMANTIC"),
        ],
        "TEMPLATE_UNSUPPORTED",
    )


# Blocker codes that mean the rewrite is not proven equivalent.
SEMANTIC_BLOCKERS = (
    "SEMANTIC_GATE_FAIL",
    "VALIDATE_EQUIVALENCE_MISMATCH",
    "VALIDATE_SEMANTIC_ERROR",
    "VALIDATE_SEMANTIC_CONFIDENCE_LOW",
    "PATCH_SEMANTIC_EQUIVALENCE_NOT_PASS",
    "PATCH_SEMANTIC_CONFIDENCE_LOW",
)

# Codes that are out of scope for good, and codes that wait for a later capability.
FROZEN_CODES = (
    "NO_SAFE_BASELINE_MULTI_FRAGMENT_INCLUDE",
    "NO_SAFE_BASELINE_SPECULATIVE_LIMIT_ONLY",
    "NO_SAFE_BASELINE_GROUP_BY",
    "NO_PATCHABLE_CANDIDATE_CANONICAL_NOOP_HINT",
    "NO_PATCHABLE_CANDIDATE_LOW_VALUE_ONLY",
)
DEFERRED_CODES = ("NO_SAFE_BASELINE_COLLECTION_GUARDED_PREDICATE",)

# The action shown for a boundary category.
BOUNDARY_ACTION = CodeMap(
    {
        "SUPPORTED": "apply_patch",
        "PROVIDER_LIMITED": "consider_provider_investment",
        "DEFERRED_CAPABILITY": "wait_for_future_capability",
        "SEMANTIC_BOUNDARY": "review_candidate",
        "VALIDATE_SECURITY_BOUNDARY": "review_candidate",
        "FROZEN_NON_GOAL": "do_not_retry_current_scope",
        "OTHER": "review_candidate",
    }
)


def boundary_category(code: Column, decision: Column, provider_limited: Column) -> Column:
    """User-facing category of a blocker code; ``provider_limited`` marks keys known to be so."""
    code, decision = F.upper(F.trim(code)), F.upper(F.trim(decision))
    return first_match(
        [
            (decision.isin("AUTO_PATCHABLE", "READY_TO_APPLY"), "SUPPORTED"),
            (provider_limited & (code == "NO_PATCHABLE_CANDIDATE_LOW_VALUE_ONLY"), "PROVIDER_LIMITED"),
            (code.isin(*DEFERRED_CODES), "DEFERRED_CAPABILITY"),
            (code.startswith("SEMANTIC_"), "SEMANTIC_BOUNDARY"),
            (code.startswith("VALIDATE_"), "VALIDATE_SECURITY_BOUNDARY"),
            (code.startswith("NO_PATCHABLE_CANDIDATE_UNSUPPORTED_") | code.isin(*FROZEN_CODES), "FROZEN_NON_GOAL"),
        ],
        "OTHER",
    )


# Points a fact adds to the patchability of a candidate, on top of 60.
PATCHABILITY_DELTAS = {
    "RULE_SOURCE_CONSERVATIVE": 15,
    "PROJECTION_REWRITE_PATCHABLE": 15,
    "AGGREGATION_WRAPPER_FLATTEN_PATCHABLE": 20,
    "ORDERING_REWRITE_PATCHABLE": 5,
    "PLACEHOLDER_PRESERVED": 10,
    "JOIN_HEAVY_PATCH_SURFACE": -10,
    "AGGREGATION_SPECULATIVE_PENALTY": -25,
    "GENERIC_PLACEHOLDER_PENALTY": -20,
}


def patchability(facts: Mapping[str, Column]) -> dict[str, Column]:
    """Score clamped to 0..100 and tier of a candidate from its facts."""
    total = F.lit(60)
    for name, fact in facts.items():
        total = total + F.when(fact, PATCHABILITY_DELTAS[name]).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), total))
    return {"score": score, "tier": first_match([(score >= 80, "HIGH"), (score >= 60, "MEDIUM")], "LOW")}
