"""Candidate selection and feedback reports, bound to line items (candidates) of an order (statement)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryproof.functions import rules, statements as st
from queryproof.operators import selection
from queryproof.operators.feedback import feedback_patterns, feedback_summary
from queryproof.plans.corpus import list_sql
from queryproof.plans.registry import query
from queryproof.plans.textjobs import NOTES, patchability_flags, reason_of_turn, reason_sql

POSITION = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def candidates(t):
    scored = t.lineitem.withColumns(rules.patchability(patchability_flags()))
    return scored.select(
        "l_orderkey",
        *POSITION,
        F.concat_ws("-", *POSITION).alias("candidate_id"),
        (F.col("l_returnflag") == "N").alias("semantic_match"),
        (F.col("l_linestatus") == "O").alias("effective_change"),
        F.col("score").alias("patchability"),
        "tier",
        (F.col("l_linenumber") % 3 * 6).alias("canonical"),
        F.when(F.col("l_tax") > 0.01, F.col("l_discount") > 0.05).alias("improved"),
        F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("after_cost"),
    )


CANDIDATES_SQL = """
c AS (SELECT *, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS candidate_id, l_returnflag = 'N' AS semantic_match,
  (l_linestatus = 'O')::INT AS effective_change, l_linenumber % 3 * 6 AS canonical,
  CASE WHEN l_tax > 0.01 AND l_discount > 0.05 THEN 1 ELSE 0 END AS improved,
  CASE WHEN l_tax > 0.02 THEN l_extendedprice ELSE 'Infinity'::DOUBLE END AS after_cost,
  greatest(0, least(100, 60 + CASE WHEN l_returnflag = 'N' THEN 15 ELSE 0 END
  + CASE WHEN l_linenumber = 1 THEN 15 ELSE 0 END + CASE WHEN l_linenumber = 2 THEN 20 ELSE 0 END
  + CASE WHEN l_linenumber = 3 THEN 5 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 10 ELSE 0 END
  + CASE WHEN l_quantity > 25 THEN -10 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN -25 ELSE 0 END
  + CASE WHEN l_linestatus <> 'O' AND l_tax > 0.04 THEN -20 ELSE 0 END)) AS patchability
  FROM lineitem)"""
RANK_SQL = (
    "effective_change DESC, patchability DESC, canonical DESC, improved DESC, after_cost, "
    "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
)
TIER_SQL = "CASE WHEN patchability >= 80 THEN 'HIGH' WHEN patchability >= 60 THEN 'MEDIUM' ELSE 'LOW' END"


def _best_sql(source):
    return f"""
r AS (SELECT *, {TIER_SQL} AS tier,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY semantic_match DESC, {RANK_SQL}) AS rn,
  count(*) OVER (PARTITION BY l_orderkey) AS n_candidates,
  count(*) FILTER (semantic_match) OVER (PARTITION BY l_orderkey) AS n_matching FROM {source}),
best AS (SELECT l_orderkey, n_candidates, n_matching, candidate_id AS selected_id, tier,
  CASE WHEN n_matching > 0 THEN 'MATCH' ELSE 'FALLBACK' END AS selected_by FROM r WHERE rn = 1)"""


@query("cd_select_best", f"WITH {CANDIDATES_SQL}, {_best_sql('c')} SELECT * FROM best")
def cd_select_best(t):
    return selection.select_best(candidates(t), "l_orderkey", POSITION)


@query(
    "cd_runner_up",
    f"""
WITH {CANDIDATES_SQL} SELECT l_orderkey, candidate_id AS runner_up_id FROM (SELECT *, row_number() OVER
  (PARTITION BY l_orderkey ORDER BY {RANK_SQL}) AS rn FROM c WHERE semantic_match) WHERE rn = 2""",
)
def cd_runner_up(t):
    return selection.runner_up(candidates(t), "l_orderkey", POSITION)


@query(
    "cd_runner_up_by_scan",
    f"""
WITH {CANDIDATES_SQL},
m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {RANK_SQL}) AS quality,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM c WHERE semantic_match),
b AS (SELECT l_orderkey, pos AS best_pos FROM m WHERE quality = 1),
x AS (SELECT m.l_orderkey, candidate_id, row_number() OVER (PARTITION BY m.l_orderkey
  ORDER BY pos > best_pos, CASE WHEN pos < best_pos THEN quality ELSE pos END) AS rn
  FROM m JOIN b USING (l_orderkey) WHERE pos <> best_pos)
SELECT l_orderkey, candidate_id AS runner_up_id FROM x WHERE rn = 1""",
)
def cd_runner_up_by_scan(t):
    return selection.runner_up_by_scan(candidates(t), "l_orderkey", POSITION)


# Canonical rules as (rule, priority, points).
CANONICAL_RULES = (
    ("COUNT_CANONICAL_FORM", 300, 15),
    ("REDUNDANT_DISTINCT_WRAPPER_CANONICAL_FORM", 250, 14),
    ("REDUNDANT_GROUP_BY_WRAPPER_CANONICAL_FORM", 225, 13),
    ("REDUNDANT_HAVING_WRAPPER_CANONICAL_FORM", 220, 13),
    ("REDUNDANT_SUBQUERY_CANONICAL_FORM", 200, 12),
    ("ALIAS_ONLY_CANONICAL_FORM", 100, 6),
)


@query(
    "cd_primary_rule",
    f"""
WITH r AS (SELECT o_orderkey, i, ({list_sql(r[0] for r in CANONICAL_RULES)})[i] AS rule_id,
  ({[r[1] for r in CANONICAL_RULES]})[i] AS priority, ({[r[2] for r in CANONICAL_RULES]})[i] AS delta
  FROM orders, range(1, 7) x(i) WHERE o_orderstatus <> 'P' AND (o_custkey + o_orderkey) % (i + 1) = 0)
SELECT o.o_orderkey, arg_max(rule_id, priority) AS primary_rule, CAST(coalesce(sum(delta), 0) AS INTEGER) AS canonical_score,
  CAST(count(rule_id) AS INTEGER) AS n_rules FROM orders o LEFT JOIN r USING (o_orderkey) GROUP BY o.o_orderkey""",
)
def cd_primary_rule(t):
    counts_match = F.col("o_orderstatus") != "P"
    facts = [
        (counts_match & ((F.col("o_custkey") + F.col("o_orderkey")) % (i + 2) == 0), priority, delta, rule)
        for i, (rule, priority, delta) in enumerate(CANONICAL_RULES)
    ]
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in selection.primary_rule(facts).items()])


@query(
    "cd_funnel",
    """
WITH c AS (SELECT l_orderkey, l_returnflag <> 'R' AS valid, l_linestatus = 'F' AS low_value, l_tax > 0.055 AS text_only FROM lineitem),
f AS (SELECT l_orderkey, count(*) AS n_raw, count(*) FILTER (valid) AS n_validated,
  count(*) FILTER (valid AND NOT low_value) AS n_accepted, count(*) FILTER (valid AND low_value) AS n_pruned,
  bool_and(text_only) AS text_only FROM c GROUP BY l_orderkey)
SELECT l_orderkey, n_raw, n_validated, n_accepted, n_pruned, CASE WHEN text_only THEN 'TEXT_ONLY_FALLBACK'
  WHEN n_validated = 0 THEN 'EMPTY_CANDIDATES' WHEN n_accepted = 0 THEN 'ONLY_LOW_VALUE_CANDIDATES' END AS degradation
FROM f""",
)
def cd_funnel(t):
    c = t.lineitem.select(
        "l_orderkey",
        (F.col("l_returnflag") != "R").alias("valid"),
        (F.col("l_linestatus") == "F").alias("low_value"),
        (F.col("l_tax") > 0.055).alias("text_only"),
    )
    return selection.funnel(c, "l_orderkey")


@query(
    "cd_readiness",
    f"""
WITH {CANDIDATES_SQL}, {_best_sql('c')}
SELECT coalesce(tier, 'LOW') AS likelihood, CASE WHEN tier IS NULL THEN 'BLOCKED' WHEN tier IN ('HIGH', 'MEDIUM') THEN 'READY'
  ELSE 'NEEDS_TEMPLATE_REWRITE' END AS readiness, count(*) AS n FROM orders LEFT JOIN best ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def cd_readiness(t):
    best = selection.select_best(candidates(t), "l_orderkey", POSITION)
    joined = t.orders.select("o_orderkey").join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return (
        joined.select(
            F.coalesce("tier", F.lit("LOW")).alias("likelihood"), selection.readiness(F.col("tier")).alias("readiness")
        )
        .groupBy("likelihood", "readiness")
        .agg(F.count("*").alias("n"))
    )


_FEEDBACK_SQL = f"""
f AS (SELECT conv_id, turn, role, concat(text, ' ', {reason_sql('(conv_id + turn)', NOTES)}) AS note FROM conversations),
i AS (SELECT *, CASE
  WHEN contains(lower(note), 'performance') OR contains(lower(note), 'slow') OR contains(lower(note), 'full scan')
    OR contains(lower(note), 'index') THEN 'performance'
  WHEN contains(lower(note), 'sql injection') OR contains(lower(note), 'security') OR contains(lower(note), 'unsafe')
    THEN 'security'
  WHEN contains(lower(note), 'semantic') OR contains(lower(note), 'equivalent') OR contains(lower(note), 'logic')
    THEN 'semantic' END AS issue FROM f)"""


def _feedback(t):
    """The whole text of every turn, closed by one of a few notes that carry an issue."""
    note = F.concat(F.col("text"), F.lit(" "), reason_of_turn())
    return t.conversations.select(
        F.concat_ws(":", "conv_id", "turn").alias("sql_key"),
        "conv_id",
        "turn",
        F.col("role").alias("status"),
        note.alias("note"),
        st.issue_type(note).alias("issue"),
    )


@query(
    "cd_feedback_patterns",
    f"""
WITH {_FEEDBACK_SQL}
SELECT issue, md5(note) AS description, count(*) AS frequency,
  arg_min(concat(conv_id, ':', turn), conv_id * 1000000 + turn) AS first_key
FROM i WHERE issue IS NOT NULL GROUP BY ALL""",
)
def cd_feedback_patterns(t):
    """Patterns are whole texts, known by their digest."""
    issues = _feedback(t).filter(F.col("issue").isNotNull()).withColumn("description", F.md5("note"))
    return feedback_patterns(issues, ["issue", "description"], "sql_key", ["conv_id", "turn"])


@query(
    "cd_feedback_summary",
    f"""
WITH {_FEEDBACK_SQL}
SELECT 'records' AS metric, '' AS code, CAST(count(*) AS DOUBLE) AS metric_value FROM i
UNION ALL SELECT 'records_with_issues', '', count(*) FILTER (issue IS NOT NULL) FROM i
UNION ALL SELECT 'issue_type', issue, count(*) FROM i WHERE issue IS NOT NULL GROUP BY issue
UNION ALL SELECT 'status', role, count(*) FROM i GROUP BY role
UNION ALL SELECT 'issue_rate', '', round(count(*) FILTER (issue IS NOT NULL) / greatest(count(*), 1), 4) FROM i""",
)
def cd_feedback_summary(t):
    return feedback_summary(_feedback(t), "issue", "status")
