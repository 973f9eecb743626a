"""Report ladders: run verdict, next action, blockers, evidence states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from queryproof.functions.rules import first_match


def _null() -> Column:
    return F.lit(None).cast("string")


def run_verdict(n_units: Column, n_fatal: Column, n_fail: Column, n_need_params: Column) -> Column:
    return first_match(
        [
            (n_fatal > 0, "BLOCKED"),
            (n_fail > 0, "ATTENTION"),
            (n_need_params > 0, "PARTIAL"),
            (n_units == 0, "EMPTY"),
        ],
        "PASS",
    )


def next_action(n_incomplete: Column, report_done: Column, n_warnings: Column, n_ready: Column, n_blocked: Column) -> Column:
    return first_match(
        [
            ((n_incomplete > 0) & ~report_done, "resume"),
            (n_warnings > 0, "inspect"),
            ((n_ready > 0) & (n_blocked == 0), "apply"),
        ],
        "inspect",
    )


def gate_blocked_reason(gate: Column, confidence: Column, status: Column, feedback: Column) -> Column:
    """Why a row cannot be delivered, NULL when nothing stands in the way."""
    return first_match(
        [
            (gate != "PASS", F.concat(F.lit("SEMANTIC_GATE_"), gate)),
            (confidence == "LOW", "VALIDATE_SEMANTIC_CONFIDENCE_LOW"),
            (status != "PASS", F.coalesce(feedback, status)),
        ],
        _null(),
    )


def not_upgraded_reason(
    upgraded: Column, first_conflict: Column, confidence: Column, strength: Column, row_count: Column
) -> Column:
    """Why the confidence was not raised, NULL when it was."""
    return first_match(
        [
            (upgraded, _null()),
            (first_conflict.isNotNull(), F.concat(F.lit("HARD_CONFLICT:"), first_conflict)),
            (confidence.isin("MEDIUM", "HIGH"), "ALREADY_CONFIDENT"),
            (strength.isin("EXACT", "PARTIAL"), "UPGRADE_NOT_NEEDED"),
            (row_count.isin("", "SKIPPED", "ERROR"), "DB_EVIDENCE_MISSING"),
            (strength.isin("NONE", "MISMATCH", "MISMATCH_SAMPLE"), "FINGERPRINT_NOT_MATCHED"),
        ],
        "UPGRADE_CRITERIA_NOT_MET",
    )


def primary_blocker(
    evidence: Column, first_gap: Column, gate_reason: Column, acceptance: Column, selection: Column, delivery: Column
) -> Column:
    """Struct ``(code, phase)`` of the first blocker that applies."""

    def blocker(code: Column, phase: str) -> Column:
        return F.struct(F.upper(code).alias("code"), F.lit(phase).alias("phase"))

    nothing = F.struct(_null().alias("code"), _null().alias("phase"))
    gate_codes = ("VALIDATE_SEMANTIC_CONFIDENCE_LOW", "SEMANTIC_GATE_FAIL", "SEMANTIC_GATE_UNCERTAIN")
    return first_match(
        [
            (
                evidence == "CRITICAL_GAP",
                blocker(F.coalesce(first_gap, F.lit("VERIFICATION_CRITICAL_GAP")), "verification"),
            ),
            (gate_reason.isin(*gate_codes), blocker(gate_reason, "validate")),
            (acceptance.isNotNull(), blocker(acceptance, "validate")),
            (selection.isNotNull(), blocker(selection, "patch_generate")),
            (delivery == "BLOCKED", blocker(F.lit("DELIVERY_BLOCKED"), "patch_generate")),
        ],
        nothing,
    )


def evidence_availability(
    evidence: Column, blocker: Column, checked: Column, has_refs: Column, level: Column
) -> Column:
    """Struct ``(state, reason)``: READY, PARTIAL or MISSING."""

    def state(name: str, reason: str | None) -> Column:
        return F.struct(F.lit(name).alias("state"), (F.lit(reason) if reason else _null()).alias("reason"))

    return first_match(
        [
            (evidence == "CRITICAL_GAP", state("MISSING", "CRITICAL_GAP_UNVERIFIED_OUTPUT")),
            (blocker == "VALIDATE_SECURITY_DOLLAR_SUBSTITUTION", state("MISSING", "SKIPPED_BY_SECURITY_BLOCK")),
            (checked & has_refs, state("READY", None)),
            (checked & level.isin("DB_FINGERPRINT", "DB_COUNT"), state("READY", None)),
            (checked, state("PARTIAL", "STRUCTURE_ONLY_OR_REFERENCE_MISSING")),
        ],
        state("MISSING", "SEMANTIC_EVIDENCE_NOT_COLLECTED"),
    )


def evidence_state(n_rows: Column, has_gap: Column, is_degraded: Column) -> Column:
    return first_match(
        [
            (F.coalesce(has_gap, F.lit(False)), "CRITICAL_GAP"),
            (F.coalesce(is_degraded, F.lit(False)), "DEGRADED"),
            (F.coalesce(n_rows, F.lit(0)) > 0, "COMPLETE"),
        ],
        "NONE",
    )


# Prefixes of blocking reasons from most to least telling; others come at 50.
REASON_PRIORITY = (
    ("SEMANTIC_GATE_", 0),
    ("HARD_CONFLICT:", 1),
    ("AGGREGATION_CONSTRAINT:", 2),
    ("PATCH_NO_EFFECTIVE_CHANGE", 3),
    ("PATCH_SEMANTIC_CONFIDENCE_LOW", 4),
    ("PATCH_FINGERPRINT_NOT_EXACT", 5),
    ("WRAPPER_COLLAPSE_BLOCKED:", 6),
    ("WRAPPER_QUERY_ABSENT", 90),
    ("WRAPPER_COLLAPSE_CANDIDATE_MISMATCH", 91),
    ("PATCH_STRATEGY_UNAVAILABLE", 99),
)


def leading_reason(reasons: Column, priorities: tuple[tuple[str, int], ...] = REASON_PRIORITY) -> Column:
    """The reason with the smallest (priority, text) of an array."""

    def ranked(r: Column) -> Column:
        priority = first_match([(r.startswith(prefix), n) for prefix, n in priorities], 50)
        return F.struct(priority.alias("priority"), r.alias("reason"))

    return F.array_min(F.transform(reasons, ranked))["reason"]
