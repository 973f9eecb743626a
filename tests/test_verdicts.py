"""Verdict ladders over the full grid of evidence, against a plain statement of the rules."""

import itertools

import pytest
from pyspark.sql import functions as F

from queryproof.functions import reports, rules, verdicts

COUNTS = ["MATCH", "MISMATCH", "ERROR", "SKIPPED", ""]
PRINTS = ["MATCH", "MISMATCH", "SKIPPED", "ERROR", ""]
CHECKS = ["PASS", "UNCERTAIN", "FAIL"]


def expected_fingerprint(key_set, sample):
    if key_set in ("MATCH", "MISMATCH"):
        return key_set
    if sample in ("MATCH", "MISMATCH"):
        return {"MATCH": "SAMPLE_MATCH", "MISMATCH": "MISMATCH_SAMPLE"}[sample]
    if "ERROR" in (key_set, sample):
        return "ERROR"
    return key_set or sample or "SKIPPED"


def expected_gate(count, checks, fingerprint):
    if count == "MISMATCH" or fingerprint == "MISMATCH":
        return "FAIL"
    if count != "MATCH":
        return "UNCERTAIN"
    if "FAIL" in checks:
        return "FAIL"
    if "UNCERTAIN" in checks or fingerprint in ("MISMATCH_SAMPLE", "ERROR"):
        return "UNCERTAIN"
    return "PASS"


@pytest.fixture(scope="module")
def grid(spark):
    rows = list(itertools.product(COUNTS, PRINTS, PRINTS, CHECKS, CHECKS, CHECKS, CHECKS))
    return spark.createDataFrame(
        rows, "row_count string, key_set string, sample string, predicate string, projection string, ordering string, pagination string"
    )


def test_gate_and_confidence(grid):
    checks = {c: F.col(c) for c in verdicts.CHECKS}
    df = grid.withColumn("fp", verdicts.fingerprint_status(F.col("key_set"), F.col("sample")))
    df = df.withColumn("gate", verdicts.gate_status(F.col("row_count"), checks, F.col("fp")))
    df = df.withColumn("conflicts", verdicts.hard_conflicts(F.col("row_count"), checks, F.col("fp")))
    strength = verdicts.fingerprint_strength(F.col("fp"))
    df = df.withColumn(
        "confidence", verdicts.confidence(F.col("gate"), F.col("row_count"), strength, F.size("conflicts") > 0)
    )
    order = ["LOW", "MEDIUM", "HIGH"]
    for r in df.collect():
        states = [r[c] for c in verdicts.CHECKS]
        fp = expected_fingerprint(r["key_set"], r["sample"])
        assert r["fp"] == fp
        gate = expected_gate(r["row_count"], states, fp)
        assert r["gate"] == gate
        conflicted = "FAIL" in states or r["row_count"] == "MISMATCH" or fp == "MISMATCH"
        assert (len(r["conflicts"]) > 0) == conflicted
        counted = r["row_count"] in ("MATCH", "MISMATCH")
        level = {"PASS": 1 if counted else 0, "FAIL": 2 if counted else 1, "UNCERTAIN": 1 if counted else 0}[gate]
        if not conflicted:
            if fp == "MATCH":
                level = max(level, 2 if gate == "PASS" else 1)
            elif fp == "SAMPLE_MATCH":
                level = max(level, 1)
        assert r["confidence"] == order[level]


def test_exact_evidence_lifts_only_the_touched_check(spark):
    def lifted(family, gate, count, fp, sample="", **checks):
        states = {c: "PASS" for c in verdicts.CHECKS} | checks
        cols = {c: F.lit(v) for c, v in states.items()}
        rule = verdicts.override_rule(F.lit(family), F.lit(gate), F.lit(count), cols, F.lit(fp), F.lit(sample))
        return spark.range(1).select(rule.alias("r")).collect()[0]["r"]

    count_star = "SEMANTIC_KNOWN_EQUIVALENCE_COUNT_STAR_ONE"
    assert lifted(count_star, "UNCERTAIN", "MATCH", "MATCH", projection="UNCERTAIN") == count_star
    assert lifted(count_star, "UNCERTAIN", "MATCH", "SAMPLE_MATCH", projection="UNCERTAIN") is None
    assert lifted(count_star, "UNCERTAIN", "MATCH", "MATCH", predicate="UNCERTAIN") is None
    assert lifted(count_star, "FAIL", "MATCH", "MATCH", projection="FAIL") is None
    tautology = "SEMANTIC_KNOWN_EQUIVALENCE_BOOLEAN_TAUTOLOGY_REMOVAL"
    assert lifted(tautology, "FAIL", "MATCH", "MATCH", predicate="FAIL") == tautology
    assert lifted(tautology, "FAIL", "MATCH", "MATCH", predicate="FAIL", pagination="FAIL") is None
    assert lifted(tautology, "FAIL", "MISMATCH", "SKIPPED", predicate="FAIL") is None
    ordering = "SEMANTIC_KNOWN_EQUIVALENCE_ORDERING_QUALIFIER_ONLY"
    assert lifted(ordering, "UNCERTAIN", "MATCH", "MATCH", sample="MATCH", ordering="UNCERTAIN") == ordering
    assert lifted(ordering, "UNCERTAIN", "MATCH", "MATCH", ordering="UNCERTAIN") is None
    assert lifted(ordering, "UNCERTAIN", "MATCH", "MISMATCH", sample="MATCH", ordering="UNCERTAIN") is None
    wrapper = "SEMANTIC_SAFE_BASELINE_REDUNDANT_GROUP_BY_WRAPPER"
    assert lifted(wrapper, "UNCERTAIN", "ERROR", "SKIPPED") == wrapper
    assert lifted(wrapper, "UNCERTAIN", "MATCH", "SKIPPED") is None
    assert lifted(verdicts.CONJUNCT_REMOVED, "UNCERTAIN", "MATCH", "MATCH", predicate="UNCERTAIN") is None


def test_acceptance(spark):
    rows = list(
        itertools.product(COUNTS, [True, False, None], ["strict", "balanced", "relaxed"], CHECKS, ["LOW", "MEDIUM", "HIGH"])
    )
    df = spark.createDataFrame(rows, "rc string, improved boolean, profile string, gate string, conf string")
    judged = verdicts.acceptance(*[F.col(c) for c in ("rc", "improved", "profile", "gate", "conf")])
    for r in df.withColumns(judged).collect():
        if r["rc"] == "MISMATCH":
            status, code = "FAIL", "VALIDATE_EQUIVALENCE_MISMATCH"
        elif r["rc"] == "ERROR":
            status, code = "NEED_MORE_PARAMS", "VALIDATE_SEMANTIC_ERROR"
        elif r["improved"]:
            status, code = "PASS", None
        elif r["rc"] == "MATCH" and r["profile"] != "strict":
            status, code = "PASS", None
        else:
            status, code = "NEED_MORE_PARAMS", "VALIDATE_PERF_NOT_IMPROVED"
        if status != "PASS" and r["gate"] == "PASS" and r["conf"] != "LOW":
            status, code = "PASS", None
        assert (r["status"], r["feedback"]) == (status, code)


def test_clause_check_and_cost(spark):
    df = spark.createDataFrame([(None, None), ("a", None), ("a", "a"), ("a", "b")], "x string, y string")
    got = [r["c"] for r in df.select(verdicts.clause_check(F.col("x"), F.col("y")).alias("c")).collect()]
    assert got == ["PASS", "FAIL", "PASS", "UNCERTAIN"]
    costs = spark.createDataFrame([(100.0, 94.0), (100.0, 95.0), (None, 1.0)], "b double, a double")
    improved = costs.select(verdicts.cost_improved(F.col("b"), F.col("a"), 5).alias("i")).collect()
    assert [r["i"] for r in improved] == [True, False, None]


def test_failure_class(spark):
    cases = [
        ("VALIDATE_TIMEOUT", "validate", "retryable"),
        ("VALIDATE_TIMEOUT", "scan", "retryable"),
        ("RUNTIME_STAGE_TIMEOUT", "report", "retryable"),
        ("SCAN_CLASS_NOT_FOUND", " SCAN ", "degradable"),
        ("SOMETHING_NEW", None, "fatal"),
        (None, "scan", "fatal"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "code string, phase string")
    got = [r["c"] for r in df.select(rules.failure_class(F.col("code"), F.col("phase")).alias("c")).collect()]
    assert got == [c[2] for c in cases]


def test_boundary_and_bucket(spark):
    cases = [
        ("x", "READY_TO_APPLY", False, "SUPPORTED"),
        ("NO_PATCHABLE_CANDIDATE_LOW_VALUE_ONLY", "", True, "PROVIDER_LIMITED"),
        ("NO_PATCHABLE_CANDIDATE_LOW_VALUE_ONLY", "", False, "FROZEN_NON_GOAL"),
        ("NO_SAFE_BASELINE_COLLECTION_GUARDED_PREDICATE", "", False, "DEFERRED_CAPABILITY"),
        ("semantic_x", "", False, "SEMANTIC_BOUNDARY"),
        ("VALIDATE_X", "", False, "VALIDATE_SECURITY_BOUNDARY"),
        ("OTHER_CODE", "", False, "OTHER"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "code string, decision string, limited boolean")
    category = rules.boundary_category(F.col("code"), F.col("decision"), F.col("limited"))
    assert [r["c"] for r in df.select(category.alias("c")).collect()] == [c[3] for c in cases]
    buckets = spark.createDataFrame([("shape_family_not_target",), (None,), ("VALIDATE_A",)], "code string")
    got = [r["b"] for r in buckets.select(rules.blocker_bucket(F.col("code")).alias("b")).collect()]
    assert got == ["SHAPE_FAMILY_NOT_TARGET", "OTHER", "VALIDATE_STATUS_NOT_PASS"]


def test_report_ladders(spark):
    one = spark.range(1)

    def value(col):
        return one.select(col.alias("x")).collect()[0]["x"]

    n = F.lit
    assert value(reports.run_verdict(n(5), n(1), n(1), n(1))) == "BLOCKED"
    assert value(reports.run_verdict(n(5), n(0), n(1), n(1))) == "ATTENTION"
    assert value(reports.run_verdict(n(5), n(0), n(0), n(1))) == "PARTIAL"
    assert value(reports.run_verdict(n(0), n(0), n(0), n(0))) == "EMPTY"
    assert value(reports.run_verdict(n(5), n(0), n(0), n(0))) == "PASS"
    assert value(reports.next_action(n(1), n(False), n(0), n(1), n(0))) == "resume"
    assert value(reports.next_action(n(1), n(True), n(0), n(1), n(0))) == "apply"
    assert value(reports.next_action(n(0), n(True), n(1), n(1), n(0))) == "inspect"
    reasons = F.array(n("zzz"), n("PATCH_STRATEGY_UNAVAILABLE"), n("HARD_CONFLICT:x"), n("aaa"))
    assert value(reports.leading_reason(reasons)) == "HARD_CONFLICT:x"
    assert value(reports.leading_reason(F.array(n("zzz"), n("aaa")))) == "aaa"
