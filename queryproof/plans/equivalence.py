"""Result equivalence: fingerprints, differences, evidence and the verdict ladders.

The ladders run over an evidence table with one row per line item, whose status columns are
derived from its keys and amounts, so that every combination of evidence occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from queryproof.functions import verdicts
from queryproof.functions.canon import row_text
from queryproof.functions.rules import first_match
from queryproof.operators import equivalence as eq
from queryproof.operators.shared import Side, compare_on_shared_scans
from queryproof.operators.sketch import diff_rows_by_sketch, sketch_report
from queryproof.plans.registry import (
    CUSTOMER,
    LINEITEM,
    ORDERS,
    PAIR_SQL,
    PAIRS,
    bag_sql,
    hash_sql,
    query,
    text_sql,
)


def perturbed_lineitem(t):
    """Line items with one changed cell, one dropped and one repeated row per thousand or so."""
    li = t.lineitem
    changed = li.filter(F.col("l_orderkey") % 999 != 5).withColumn(
        "l_returnflag",
        F.when(F.col("l_orderkey") % 1000 == 7, "X").otherwise(F.col("l_returnflag")),
    )
    return changed.unionByName(li.filter(F.col("l_orderkey") % 1001 == 0))


PERTURBED_SQL = """
SELECT * REPLACE (CASE WHEN l_orderkey % 1000 = 7 THEN 'X' ELSE l_returnflag END AS l_returnflag)
FROM lineitem WHERE l_orderkey % 999 <> 5
UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 1001 = 0"""


@query(
    "eq_row_count",
    f"""
WITH c AS (SELECT (SELECT count(*) FROM lineitem) AS b, (SELECT count(*) FROM ({PERTURBED_SQL}) p) AS a)
SELECT 'same' AS compared, b AS n_before, b AS n_after, 'MATCH' AS status FROM c
UNION ALL SELECT 'perturbed', b, a, CASE WHEN a = b THEN 'MATCH' ELSE 'MISMATCH' END FROM c""",
)
def eq_row_count(t):
    same = eq.row_counts(t.lineitem, t.lineitem).select(F.lit("same").alias("compared"), "*")
    other = eq.row_counts(t.lineitem, perturbed_lineitem(t))
    return same.unionByName(other.select(F.lit("perturbed").alias("compared"), "*"))


@query(
    "eq_exact_fingerprint",
    f"SELECT n AS n_rows, fp AS fingerprint FROM ({bag_sql('SELECT * FROM lineitem', LINEITEM)}) x",
)
def eq_exact_fingerprint(t):
    return eq.bag_fingerprint(t.lineitem, algorithm="md5")


@query(
    "eq_perturbed_mismatch",
    f"""
WITH b AS ({bag_sql("SELECT * FROM lineitem", LINEITEM)}), a AS ({bag_sql(PERTURBED_SQL, LINEITEM)})
SELECT b.n AS n_before, a.n AS n_after, b.fp AS fp_before, a.fp AS fp_after,
       CASE WHEN b.fp = a.fp THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM a, b""",
)
def eq_perturbed_mismatch(t):
    return eq.pair_report("perturbed", t.lineitem, perturbed_lineitem(t), algorithm="md5").drop("pair_id", "vacuous")


_IN_SAMPLE = f"{hash_sql('l_orderkey:v')} % 100 < 5"


@query(
    "eq_sample_fingerprint",
    f"""
WITH b AS ({bag_sql(f"SELECT * FROM lineitem WHERE {_IN_SAMPLE}", LINEITEM)}),
a AS ({bag_sql(f"SELECT * FROM ({PERTURBED_SQL}) p WHERE {_IN_SAMPLE}", LINEITEM)})
SELECT b.n AS n_before, a.n AS n_after, b.fp AS fp_before, a.fp AS fp_after FROM a, b""",
)
def eq_sample_fingerprint(t):
    """The same keys on both sides: a sample that gives the same answer every time."""
    sample = eq.compare_sample(t.lineitem, perturbed_lineitem(t), ["l_orderkey"], 100, 5, algorithm="md5")
    return sample.select("n_before", "n_after", "fp_before", "fp_after")


@query(
    "eq_value_canon",
    f"""
WITH o AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority, CAST(o_totalprice AS DECIMAL(12, 2)) AS price, CAST(o_orderdate AS DATE) AS day,
  o_totalprice > 250000 AS expensive FROM orders)
SELECT o_orderkey, {text_sql(ORDERS + " price:v day:v expensive:v")}
  || '|[' || coalesce('S' || length(o_orderstatus) || ':' || o_orderstatus, 'N') || '|S' || length(o_orderpriority)
  || ':' || o_orderpriority || ']|{{S1:k=V' || CAST(o_custkey AS VARCHAR) || '}}|V' || hex(o_orderpriority)
  || '|(V' || CAST(o_custkey AS VARCHAR) || '|S' || length(o_orderpriority) || ':' || o_orderpriority || ')' AS canon
FROM o""",
)
def eq_value_canon(t):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    mixed = t.orders.withColumn("o_orderstatus", status).select(
        *t.orders.columns,
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.col("o_orderdate").cast("date").alias("day"),
        (F.col("o_totalprice") > 250000).alias("expensive"),
        F.array("o_orderstatus", "o_orderpriority").alias("codes"),
        F.create_map(F.lit("k"), "o_custkey").alias("entries"),
        F.col("o_orderpriority").cast("binary").alias("raw"),
        F.struct("o_custkey", "o_orderpriority").alias("pair"),
    )
    return mixed.select("o_orderkey", row_text(mixed).alias("canon"))


@query(
    "eq_diff_rows",
    f"""
WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice, 1 AS b, 0 AS a FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice, 0, 1 FROM ({PERTURBED_SQL}) p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice,
  CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after
FROM u GROUP BY ALL HAVING sum(b) <> sum(a)""",
)
def eq_diff_rows(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice"]
    before, after = t.lineitem.select(*cols), perturbed_lineitem(t).select(*cols)
    return eq.diff_rows(before, after, t.scratch("eq_diff_rows"))


_DIFF_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice"]
_DIFF_SQL = f"""
SELECT {", ".join(_DIFF_COLUMNS)}, CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after
FROM (SELECT *, 1 AS b, 0 AS a FROM lineitem UNION ALL SELECT *, 0, 1 FROM ({PERTURBED_SQL}) p)
GROUP BY {", ".join(_DIFF_COLUMNS)} HAVING sum(b) <> sum(a)"""


@query(
    "eq_diff_sketch",
    f"""
WITH d AS ({_DIFF_SQL})
SELECT *, 'sketch' AS found_by FROM d UNION ALL SELECT *, 'digests' FROM d""",
)
def eq_diff_sketch(t):
    """Differing rows from a subtractable sketch, and again from one too small for them, which falls back to digests."""
    before, after = t.lineitem.select(*_DIFF_COLUMNS), perturbed_lineitem(t).select(*_DIFF_COLUMNS)
    # the planted differences grow with the table, so the sketch is sized by its count
    cells = max(12_288, before.count() // 100)
    large = diff_rows_by_sketch(before, after, t.scratch("sketch"), cells)
    return large.unionByName(diff_rows_by_sketch(before, after, t.scratch("sketch"), cells=6))


@query(
    "eq_sketch_report",
    f"""
WITH d AS ({_DIFF_SQL})
SELECT 'roomy' AS size, 'LISTED' AS status, count(*) AS n_different, CAST(sum(greatest(n_before - n_after, 0)) AS BIGINT) AS n_surplus,
  CAST(sum(greatest(n_after - n_before, 0)) AS BIGINT) AS n_missing FROM d
UNION ALL SELECT 'tiny', 'TOO_MANY', NULL, NULL, NULL
UNION ALL SELECT 'equal sides', 'LISTED', 0, 0, 0""",
)
def eq_sketch_report(t):
    before, after = t.lineitem.select(*_DIFF_COLUMNS), perturbed_lineitem(t).select(*_DIFF_COLUMNS)
    cells = max(12_288, before.count() // 100)
    cases = [("roomy", before, after, cells), ("tiny", before, after, 6), ("equal sides", before, before, 6)]
    rows = [sketch_report(b, a, c).select(F.lit(name).alias("size"), "*").drop("cells") for name, b, a, c in cases]
    return reduce(lambda a, b: a.unionByName(b), rows)


def _grouped_bag_sql(rows):
    return (
        f"SELECT l_suppkey, count(*) AS n, concat(count(*), ':', sum(h), ':', bit_xor(h)) AS fp FROM "
        f"(SELECT l_suppkey, {hash_sql(LINEITEM)} AS h FROM ({rows}) q) t GROUP BY l_suppkey"
    )


_COMPARED_SQL = f"""
b AS ({_grouped_bag_sql("SELECT * FROM lineitem")}), a AS ({_grouped_bag_sql(PERTURBED_SQL)}),
c AS (SELECT b.l_suppkey, b.n AS n_before, a.n AS n_after, b.fp AS fp_before, a.fp AS fp_after,
  b.n = a.n AS same_count, b.fp = a.fp AS same FROM b JOIN a USING (l_suppkey))"""


@query(
    "eq_evidence_ledger",
    f"""
WITH {_COMPARED_SQL}
SELECT l_suppkey, 'DB_COUNT' AS source, 'row_count' AS fingerprint_key, CAST(n_after AS VARCHAR) AS observed,
  CAST(n_before AS VARCHAR) AS expected, CASE WHEN same_count THEN 'EXACT' ELSE 'NONE' END AS match_strength,
  'DB_COUNT' AS evidence_level, 'row count comparison' AS notes FROM c
UNION ALL
SELECT l_suppkey, 'DB_FINGERPRINT', 'key_set_hash', CASE WHEN same_count THEN fp_after END,
  CASE WHEN same_count THEN fp_before END, CASE WHEN same THEN 'EXACT' ELSE 'NONE' END, 'DB_FINGERPRINT',
  CASE WHEN same_count THEN 'full row-set fingerprint' ELSE 'skipped: row counts differ' END FROM c""",
)
def eq_evidence_ledger(t):
    compared = eq.compare_bags(t.lineitem, perturbed_lineitem(t), ["l_suppkey"], algorithm="md5")
    return eq.evidence_ledger(compared, ["l_suppkey"])


@query(
    "eq_grouped_verdict",
    f"""
WITH {_COMPARED_SQL},
v AS (SELECT l_suppkey, n_before, n_after, CASE WHEN same_count THEN 'MATCH' ELSE 'MISMATCH' END AS count_status,
  CASE WHEN NOT same_count THEN 'SKIPPED' WHEN same THEN 'MATCH' ELSE 'MISMATCH' END AS fingerprint_status FROM c)
SELECT *, CASE WHEN fingerprint_status = 'MATCH' THEN 'PASS' ELSE 'FAIL' END AS gate_status,
  'HIGH' AS confidence FROM v""",
)
def eq_grouped_verdict(t):
    """Compare two versions of a table supplier by supplier and judge each one, in one shuffle."""
    c = eq.compare_bags(t.lineitem, perturbed_lineitem(t), ["l_suppkey"])
    stable = {name: F.lit("PASS") for name in verdicts.CHECKS}
    rc, fp = F.col("count_status"), F.col("fingerprint_status")
    gate = verdicts.gate_status(rc, stable, fp)
    conflicts = F.size(verdicts.hard_conflicts(rc, stable, fp)) > 0
    strength = verdicts.fingerprint_strength(fp)
    return c.select(
        "l_suppkey",
        "n_before",
        "n_after",
        "count_status",
        "fingerprint_status",
        gate.alias("gate_status"),
        verdicts.confidence(gate, rc, strength, conflicts).alias("confidence"),
    )


@query(
    "eq_native_compare",
    f"""
WITH b AS ({bag_sql("SELECT * FROM lineitem", LINEITEM)}), a AS ({bag_sql(PERTURBED_SQL, LINEITEM)})
SELECT 'same' AS compared, b.n AS n_before, b.n AS n_after, 'MATCH' AS count_status, 'MATCH' AS fingerprint_status FROM b
UNION ALL SELECT 'perturbed', b.n, a.n, CASE WHEN a.n = b.n THEN 'MATCH' ELSE 'MISMATCH' END,
  CASE WHEN a.n <> b.n THEN 'SKIPPED' WHEN a.fp = b.fp THEN 'MATCH' ELSE 'MISMATCH' END FROM a, b""",
)
def eq_native_compare(t):
    """The same verdicts with Spark's own hash, for comparisons that stay inside Spark."""
    columns = ["count_status", "fingerprint_status"]
    same = eq.compare_bags(t.lineitem, t.lineitem)
    other = eq.compare_bags(t.lineitem, perturbed_lineitem(t))
    return same.select(F.lit("same").alias("compared"), "n_before", "n_after", *columns).unionByName(
        other.select(F.lit("perturbed").alias("compared"), "n_before", "n_after", *columns)
    )


# The evidence table. Statuses are picked by the remainder of a key.
COUNT_STATES = ["MATCH", "MISMATCH", "ERROR", "SKIPPED", ""]
FINGERPRINT_STATES = ["MATCH", "MISMATCH", "SKIPPED", "ERROR", ""]
FAMILIES = [r.name for r in verdicts.OVERRIDE_RULES] + [verdicts.CONJUNCT_REMOVED]


def _pick(column, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values)).cast("int") + 1)


def _pick_sql(column, values):
    return f"([{', '.join(repr(v) for v in values)}])[{column} % {len(values)} + 1]"


def evidence(t):
    """One evidence row per line item: statuses, clause checks and the name of the rewrite."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    after = F.when(line == "F", "N").otherwise(flag)
    null_a = F.lit("A")
    return t.lineitem.select(
        _pick("l_partkey", COUNT_STATES).alias("row_count"),
        _pick("l_suppkey", FINGERPRINT_STATES).alias("key_set"),
        _pick("l_linenumber", FINGERPRINT_STATES).alias("sample"),
        verdicts.clause_check(F.nullif(flag, null_a), F.nullif(after, null_a)).alias("predicate"),
        F.when(F.col("l_quantity") > 25, "UNCERTAIN").otherwise("PASS").alias("projection"),
        verdicts.clause_check(
            F.nullif(F.col("l_tax"), F.lit(0.01)), F.nullif(F.col("l_tax"), F.lit(0.01)) + F.when(line == "F", 0.0), "UNCERTAIN"
        ).alias("ordering"),
        F.when(F.col("l_discount") > 0.075, "FAIL").otherwise("PASS").alias("pagination"),
        _pick("l_orderkey", FAMILIES).alias("family"),
    )


EVIDENCE_SQL = f"""
l AS (SELECT {_pick_sql("l_partkey", COUNT_STATES)} AS row_count,
  {_pick_sql("l_suppkey", FINGERPRINT_STATES)} AS key_set, {_pick_sql("l_linenumber", FINGERPRINT_STATES)} AS sample,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'FAIL' WHEN l_returnflag = 'R' AND l_linestatus = 'F'
       THEN 'UNCERTAIN' ELSE 'PASS' END AS predicate,
  CASE WHEN l_quantity > 25 THEN 'UNCERTAIN' ELSE 'PASS' END AS projection,
  CASE WHEN l_tax <> 0.01 AND l_linestatus <> 'F' THEN 'UNCERTAIN' ELSE 'PASS' END AS ordering,
  CASE WHEN l_discount > 0.075 THEN 'FAIL' ELSE 'PASS' END AS pagination,
  {_pick_sql("l_orderkey", FAMILIES)} AS family FROM lineitem),
f AS (SELECT *, CASE WHEN key_set IN ('MISMATCH', 'MATCH') THEN key_set WHEN sample = 'MISMATCH' THEN 'MISMATCH_SAMPLE'
  WHEN sample = 'MATCH' THEN 'SAMPLE_MATCH' WHEN key_set = 'ERROR' OR sample = 'ERROR' THEN 'ERROR'
  WHEN key_set <> '' THEN key_set WHEN sample <> '' THEN sample ELSE 'SKIPPED' END AS fingerprint FROM l),
g AS (SELECT *, CASE WHEN fingerprint = 'MATCH' THEN 'EXACT' WHEN fingerprint = 'SAMPLE_MATCH' THEN 'PARTIAL' ELSE 'NONE'
  END AS strength,
  CASE WHEN fingerprint = 'MISMATCH' OR row_count = 'MISMATCH' THEN 'FAIL' WHEN row_count <> 'MATCH' THEN 'UNCERTAIN'
  WHEN 'FAIL' IN (predicate, projection, ordering, pagination) THEN 'FAIL'
  WHEN 'UNCERTAIN' IN (predicate, projection, ordering, pagination) THEN 'UNCERTAIN'
  WHEN fingerprint IN ('MISMATCH_SAMPLE', 'ERROR') THEN 'UNCERTAIN' ELSE 'PASS' END AS gate,
  'FAIL' IN (predicate, projection, ordering, pagination) OR row_count = 'MISMATCH' OR fingerprint = 'MISMATCH'
  AS conflicted FROM f)"""


def _judged(t):
    e = evidence(t)
    checks = {c: F.col(c) for c in verdicts.CHECKS}
    fingerprint = verdicts.fingerprint_status(F.col("key_set"), F.col("sample"))
    e = e.withColumn("fingerprint", fingerprint)
    e = e.withColumn("strength", verdicts.fingerprint_strength(F.col("fingerprint")))
    e = e.withColumn("gate", verdicts.gate_status(F.col("row_count"), checks, F.col("fingerprint")))
    conflicts = verdicts.hard_conflicts(F.col("row_count"), checks, F.col("fingerprint"))
    return e.withColumn("conflicted", F.size(conflicts) > 0), checks


def _counted(df, *names):
    return df.groupBy(*names).agg(F.count("*").alias("n"))


@query(
    "eq_fingerprint_status",
    f"WITH {EVIDENCE_SQL} SELECT key_set, sample, fingerprint, strength, "
    "CASE WHEN fingerprint IN ('MATCH', 'MISMATCH', 'SAMPLE_MATCH', 'MISMATCH_SAMPLE') THEN 'DB_FINGERPRINT' "
    "WHEN row_count IN ('MATCH', 'MISMATCH') THEN 'DB_COUNT' ELSE 'STRUCTURE' END AS level, count(*) AS n "
    "FROM g GROUP BY ALL",
)
def eq_fingerprint_status(t):
    e, _ = _judged(t)
    e = e.withColumn("level", verdicts.evidence_level(F.col("row_count"), F.col("fingerprint")))
    return _counted(e, "key_set", "sample", "fingerprint", "strength", "level")


@query(
    "eq_gate_verdict",
    f"WITH {EVIDENCE_SQL} SELECT row_count, fingerprint, predicate, projection, ordering, pagination, gate, "
    "conflicted, count(*) AS n FROM g GROUP BY ALL",
)
def eq_gate_verdict(t):
    e, checks = _judged(t)
    return _counted(e, "row_count", "fingerprint", *checks, "gate", "conflicted")


_CONFIDENCE_SQL = """CASE
  WHEN {s} = 'FAIL' AND row_count IN ('MATCH', 'MISMATCH') THEN 'HIGH'
  WHEN NOT conflicted AND strength = 'EXACT' AND {s} = 'PASS' THEN 'HIGH'
  WHEN {s} = 'FAIL' OR row_count IN ('MATCH', 'MISMATCH') THEN 'MEDIUM'
  WHEN NOT conflicted AND strength <> 'NONE' THEN 'MEDIUM' ELSE 'LOW' END"""


@query(
    "eq_confidence",
    f"WITH {EVIDENCE_SQL} SELECT gate, row_count, strength, conflicted, {_CONFIDENCE_SQL.format(s='gate')} AS confidence, "
    "count(*) AS n FROM g GROUP BY ALL",
)
def eq_confidence(t):
    e, _ = _judged(t)
    c = verdicts.confidence(F.col("gate"), F.col("row_count"), F.col("strength"), F.col("conflicted"))
    return _counted(e.withColumn("confidence", c), "gate", "row_count", "strength", "conflicted", "confidence")


_EXACT = "row_count = 'MATCH' AND strength = 'EXACT'"
_ORDERED = "row_count = 'MATCH' AND sample = 'MATCH' AND fingerprint <> 'MISMATCH'"
_UNTAKEN = "row_count IN ('', 'SKIPPED', 'ERROR')"


def _only(*targets):
    return " AND ".join(f"{c} = 'PASS'" for c in verdicts.CHECKS if c not in targets) or "TRUE"


def _override_sql():
    def known(name):
        return f"SEMANTIC_KNOWN_EQUIVALENCE_{name}"

    unsure = "gate = 'UNCERTAIN'"
    both = "gate IN ('FAIL', 'UNCERTAIN')"
    lines = []

    def add(names, *conditions):
        listed = ", ".join(f"'{n}'" for n in names)
        lines.append(f"WHEN family IN ({listed}) AND {' AND '.join(conditions)} THEN family")

    add(
        [known(n) for n in ("COUNT_STAR_ONE", "PROJECTION_QUALIFIER_ONLY", "CASE_WHEN_TRUE", "COALESCE_IDENTITY")],
        unsure, _EXACT, _only("projection"), "projection = 'UNCERTAIN'",
    )
    add(
        [known("PREDICATE_AND_ORDER"), known("PREDICATE_QUALIFIER_ONLY")],
        unsure, _EXACT, _only("predicate"), "predicate = 'UNCERTAIN'",
    )
    add([known("ORDERING_QUALIFIER_ONLY")], unsure, _ORDERED, _only("ordering"), "ordering = 'UNCERTAIN'")
    add(
        [known("SINGLE_TABLE_QUALIFIER_ONLY")],
        unsure, _EXACT, "pagination = 'PASS'", "predicate <> 'FAIL'",
        "'UNCERTAIN' IN (predicate, projection, ordering)", "(ordering = 'PASS' OR sample = 'MATCH')",
    )
    add([known("BOOLEAN_TAUTOLOGY_REMOVAL")], "gate = 'FAIL'", _EXACT, _only("predicate"))
    add(
        [known(n) for n in ("SINGLE_VALUE_IN_LIST", "OR_TO_IN", "CONSTANT_EXPRESSION_FOLDING", "EXISTS_SELF_REWRITE",
                            "EXISTS_TO_IN_REWRITE")]
        + [f"SEMANTIC_DB_EQUIVALENCE_{n}" for n in ("NULL_COMPARISON_NORMALIZATION", "REDUNDANT_ID_NOT_NULL_CONJUNCT")],
        both, _EXACT, _only("predicate"),
    )
    add([known("CONSTANT_ORDER_BY_REMOVAL")], both, _ORDERED, _only("ordering"))
    add(
        ["SEMANTIC_SAFE_BASELINE_CONSTANT_ORDER_BY_REMOVAL"],
        unsure, _UNTAKEN, "fingerprint IN ('', 'SKIPPED', 'ERROR')", _only("ordering"),
    )
    add(["SEMANTIC_DB_EQUIVALENCE_LARGE_LIMIT_REMOVAL"], both, _EXACT, _only("pagination"))
    add([known("DISTINCT_ON_SIMPLIFICATION")], both, _ORDERED, _only("projection", "ordering"))
    add(
        ["SEMANTIC_DML_NOOP_STABLE"]
        + [f"SEMANTIC_SAFE_BASELINE_{n}" for n in (
            "REDUNDANT_GROUP_BY_WRAPPER", "REDUNDANT_HAVING_WRAPPER", "DISTINCT_FROM_ALIAS_CLEANUP",
            "GROUP_BY_FROM_ALIAS_CLEANUP", "GROUP_BY_HAVING_FROM_ALIAS_CLEANUP")],
        unsure, _UNTAKEN, _only(),
    )
    return "CASE " + "\n".join(lines) + " END"


_OVERRIDDEN_SQL = f"""{EVIDENCE_SQL},
o AS (SELECT *, {_override_sql()} AS rule FROM g),
s AS (SELECT * REPLACE (conflicted AND rule IS NULL AS conflicted),
  CASE WHEN rule IS NOT NULL THEN 'PASS' ELSE gate END AS final_status FROM o),
k AS (SELECT *, CASE WHEN {_CONFIDENCE_SQL.format(s="final_status")} = 'LOW' AND (rule LIKE 'SEMANTIC_SAFE_BASELINE_%'
  OR rule = 'SEMANTIC_DML_NOOP_STABLE') THEN 'MEDIUM' ELSE {_CONFIDENCE_SQL.format(s="final_status")} END
  AS confidence FROM s)"""


def _overridden(t):
    e, checks = _judged(t)
    rule = verdicts.override_rule(
        F.col("family"), F.col("gate"), F.col("row_count"), checks, F.col("fingerprint"), F.col("sample")
    )
    e = e.withColumn("rule", rule)
    e = e.withColumn("final_status", F.when(F.col("rule").isNotNull(), "PASS").otherwise(F.col("gate")))
    e = e.withColumn("conflicted", F.col("conflicted") & F.col("rule").isNull())
    plain = verdicts.confidence(F.col("final_status"), F.col("row_count"), F.col("strength"), F.col("conflicted"))
    return e.withColumn("confidence", verdicts.structural_confidence(plain, F.col("rule")))


@query(
    "eq_known_override",
    f"WITH {_OVERRIDDEN_SQL} SELECT family, gate, rule IS NOT NULL AS lifted, final_status, confidence, "
    "count(*) AS n FROM k GROUP BY ALL",
)
def eq_known_override(t):
    e = _overridden(t).withColumn("lifted", F.col("rule").isNotNull())
    return _counted(e, "family", "gate", "lifted", "final_status", "confidence")


_COSTS_SQL = (
    "SELECT *, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS before_cost, "
    "CASE WHEN l_linenumber <> 5 THEN l_extendedprice * (1 - l_discount) END AS after_cost FROM lineitem"
)


def _costs(t):
    price = F.col("l_extendedprice")
    return t.lineitem.withColumns(
        {
            "before_cost": F.when(F.col("l_linenumber") != 3, price),
            "after_cost": F.when(F.col("l_linenumber") != 5, price * (1 - F.col("l_discount"))),
        }
    )


@query(
    "eq_cost_compare",
    f"""
WITH c AS (SELECT l_linestatus, after_cost < before_cost * (1.0 - 5.0::DOUBLE / 100.0::DOUBLE) AS improved FROM ({_COSTS_SQL}) q)
SELECT l_linestatus, improved, CASE WHEN improved THEN 'TOTAL_COST_REDUCED' WHEN NOT improved
  THEN 'TOTAL_COST_NOT_REDUCED' END AS reason, count(*) AS n FROM c GROUP BY ALL""",
)
def eq_cost_compare(t):
    improved = verdicts.cost_improved(F.col("before_cost"), F.col("after_cost"), 5)
    c = _costs(t).withColumn("improved", improved)
    return _counted(c.withColumn("reason", verdicts.cost_reason(F.col("improved"))), "l_linestatus", "improved", "reason")


PROFILES = ["strict", "balanced", "relaxed"]


@query(
    "eq_acceptance",
    f"""
WITH e AS (SELECT {_pick_sql("l_partkey", COUNT_STATES)} AS row_count, {_pick_sql("l_orderkey", PROFILES)} AS profile,
  CASE WHEN l_linenumber <> 3 THEN l_discount > 0.055 END AS improved,
  {_pick_sql("l_suppkey", ["PASS", "UNCERTAIN", "FAIL"])} AS gate,
  CASE WHEN l_quantity > 33 THEN 'HIGH' WHEN l_quantity > 17 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM lineitem),
f AS (SELECT *, CASE WHEN row_count = 'MISMATCH' THEN 'VALIDATE_EQUIVALENCE_MISMATCH' WHEN row_count = 'ERROR'
  THEN 'VALIDATE_SEMANTIC_ERROR' WHEN coalesce(improved, false) THEN NULL
  WHEN row_count = 'MATCH' AND profile <> 'strict' THEN NULL ELSE 'VALIDATE_PERF_NOT_IMPROVED' END AS code FROM e),
s AS (SELECT *, CASE WHEN code IS NULL THEN 'PASS' WHEN row_count = 'MISMATCH' THEN 'FAIL' ELSE 'NEED_MORE_PARAMS' END
  AS first FROM f),
l AS (SELECT *, first <> 'PASS' AND gate = 'PASS' AND confidence <> 'LOW' AS lifted FROM s)
SELECT row_count, profile, improved, CASE WHEN lifted THEN 'PASS' ELSE first END AS status,
  CASE WHEN NOT lifted THEN code END AS feedback,
  CASE WHEN lifted AND first = 'NEED_MORE_PARAMS' THEN 'VALIDATE_PERF_NOT_IMPROVED_BUT_SEMANTIC_OK'
       WHEN code IS NULL AND NOT coalesce(improved, false) THEN 'VALIDATE_PERF_NOT_IMPROVED_WARN' END AS warning,
  count(*) AS n FROM l GROUP BY ALL""",
)
def eq_acceptance(t):
    e = t.lineitem.select(
        _pick("l_partkey", COUNT_STATES).alias("row_count"),
        _pick("l_orderkey", PROFILES).alias("profile"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount") > 0.055).alias("improved"),
        _pick("l_suppkey", ["PASS", "UNCERTAIN", "FAIL"]).alias("gate"),
        first_match([(F.col("l_quantity") > 33, "HIGH"), (F.col("l_quantity") > 17, "MEDIUM")], "LOW").alias("confidence"),
    )
    decided = verdicts.acceptance(*[F.col(c) for c in ("row_count", "improved", "profile", "gate", "confidence")])
    return _counted(e.withColumns(decided), "row_count", "profile", "improved", "status", "feedback", "warning")


@query("eq_batch", "\nUNION ALL\n".join(f"(SELECT * FROM ({sql}) p)" for sql in PAIR_SQL.values()))
def eq_batch(t):
    """Every registered rewrite pair, one row each, in one job."""
    return eq.compare_batch([(name, *make(t)) for name, make in PAIRS.items()], algorithm="md5")


def _side(table, where="true", columns=None):
    plain = {"orders": ORDERS, "customer": CUSTOMER}[table]
    return [Side(table, tuple(columns or (c.split(":")[0] for c in plain.split())), where)]


_STATUS = "nullif(o_orderstatus, 'P')"
#: The registered pairs whose sides filter and project one table, as what they do to its rows.
SHARED_PAIRS = {
    "pf_alias_cleanup_pair": (_side("customer"), _side("customer")),
    "pf_qualifier_cleanup_pair": (_side("customer", "c_mktsegment = 'BUILDING'"), _side("customer", "c_mktsegment = 'BUILDING'")),
    "pf_conjunct_reorder_pair": (
        _side("orders", "o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 250000 AND o_orderpriority <> '5-LOW'"),
        _side("orders", "o_orderpriority <> '5-LOW' AND o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 250000"),
    ),
    "pf_boolean_tautology_pair": (_side("customer", "1 = 1 AND 0 = 0 AND TRUE"), _side("customer")),
    "pf_in_single_pair": (_side("customer", "c_mktsegment IN ('BUILDING')"), _side("customer", "c_mktsegment = 'BUILDING'")),
    "pf_not_in_single_pair": (
        _side("customer", "nullif(c_mktsegment, 'MACHINERY') NOT IN ('BUILDING')"),
        _side("customer", "nullif(c_mktsegment, 'MACHINERY') <> 'BUILDING'"),
    ),
    "pf_or_to_in_pair": (_side("orders", "o_orderstatus = 'O' OR o_orderstatus = 'F'"), _side("orders", "o_orderstatus IN ('O', 'F')")),
    "pf_case_true_pair": (
        _side("orders", columns=("o_orderkey", "CASE WHEN TRUE THEN o_orderstatus ELSE o_orderstatus END")),
        _side("orders", columns=("o_orderkey", "o_orderstatus")),
    ),
    "pf_coalesce_identity_pair": (
        _side("orders", columns=("o_orderkey", f"coalesce({_STATUS}, {_STATUS})", f"coalesce({_STATUS}, NULL)")),
        _side("orders", columns=("o_orderkey", _STATUS, _STATUS)),
    ),
    "pf_constant_fold_pair": (_side("orders", "o_custkey < 100 + 20 * 5 - 8 div 4"), _side("orders", "o_custkey < 198")),
    "sl_order_constant_pair": (_side("customer"), _side("customer")),
}


@query("eq_batch_shared", "\nUNION ALL\n".join(f"(SELECT * FROM ({PAIR_SQL[name]}) p)" for name in SHARED_PAIRS))
def eq_batch_shared(t):
    """Pairs over two tables from two scans, each row with an entry for every branch it passes."""
    pairs = [(name, before, after) for name, (before, after) in SHARED_PAIRS.items()]
    return compare_on_shared_scans({"orders": t.orders, "customer": t.customer}, pairs, algorithm="md5")


@query(
    "eq_proof_with_confidence",
    f"""
WITH b AS ({bag_sql("SELECT count(1) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') w", "n:v")}),
a AS ({bag_sql("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'", "n:v")})
SELECT 'count_wrapper' AS pair_id, b.n AS n_before, a.n AS n_after, b.fp = a.fp AS fp_match, 'PASS' AS status,
       'HIGH' AS confidence FROM a, b""",
)
def eq_proof_with_confidence(t):
    """One pair end to end: counts, fingerprint, gate, known equivalence and confidence."""
    opened = t.orders.filter(F.col("o_orderstatus") == "O")
    before = opened.select("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    after = opened.agg(F.count("*").alias("n"))
    c = eq.compare_bags(before, after)
    checks = {name: F.lit("PASS") for name in verdicts.CHECKS} | {"projection": F.lit("UNCERTAIN")}
    rc, fp = F.col("count_status"), F.col("fingerprint_status")
    gate = verdicts.gate_status(rc, checks, fp)
    family = F.lit("SEMANTIC_KNOWN_EQUIVALENCE_COUNT_STAR_ONE")
    rule = verdicts.override_rule(family, gate, rc, checks, fp, fp)
    status = F.when(rule.isNotNull(), "PASS").otherwise(gate)
    conflicted = F.size(verdicts.hard_conflicts(rc, checks, fp)) > 0
    return c.select(
        F.lit("count_wrapper").alias("pair_id"),
        "n_before",
        "n_after",
        (F.col("fp_before") == F.col("fp_after")).alias("fp_match"),
        status.alias("status"),
        verdicts.confidence(status, rc, verdicts.fingerprint_strength(fp), conflicted).alias("confidence"),
    )


@query(
    "eq_type_widths",
    """
SELECT unnest(['md5 changed', 'md5 equal', 'md5 rounded long', 'md5 rounded decimal', 'native changed', 'native equal',
               'native rounded long', 'native rounded decimal']) AS compared,
  unnest(['MISMATCH', 'MATCH', 'MISMATCH', 'MISMATCH', 'MISMATCH', 'MATCH', 'MISMATCH', 'MISMATCH']) AS status,
  (SELECT count(*) FROM lineitem) AS n_before, (SELECT count(*) FROM lineitem) AS n_after""",
)
def eq_type_widths(t):
    """Equal values of unequal widths match and changed ones don't, under both hashes.

    Whole numbers of three widths, decimals of two, numbers against doubles, a float against a double, and
    nested types. A long or decimal that a double can only round is not equal to it.
    """

    def narrow(extra):
        return t.lineitem.select(
            F.col("l_linenumber").cast("int"),
            F.col("l_orderkey").cast("int"),
            F.col("l_quantity").cast("decimal(12,2)"),
            (F.col("l_linenumber") + extra).cast("smallint").alias("l_small"),
            F.col("l_linenumber").cast("float").alias("l_real"),
            F.col("l_orderkey").cast("bigint").alias("l_long"),
            F.col("l_discount").cast("decimal(20,4)").alias("l_rate"),
            F.array(F.col("l_linenumber").cast("int"), F.lit(None)).alias("l_list"),
            F.struct(F.col("l_suppkey").cast("int").alias("a"), F.create_map(F.lit("k"), F.col("l_partkey").cast("int")).alias("b")).alias("l_nest"),
        )

    wide = t.lineitem.select(
        F.col("l_linenumber").cast("bigint"),
        F.col("l_orderkey").cast("decimal(20,0)"),
        F.col("l_quantity").cast("decimal(20,4)"),
        F.col("l_linenumber").cast("bigint").alias("l_small"),
        F.col("l_linenumber").cast("double").alias("l_real"),
        F.col("l_orderkey").cast("double").alias("l_long"),
        F.col("l_discount").alias("l_rate"),
        F.array(F.col("l_linenumber").cast("bigint"), F.lit(None)).alias("l_list"),
        F.struct(F.col("l_suppkey").cast("bigint").alias("a"), F.create_map(F.lit("k"), F.col("l_partkey").cast("bigint")).alias("b")).alias("l_nest"),
    )
    far = t.lineitem.select((F.col("l_orderkey") * 2 + 2**53 + 1).alias("v"))
    fine = t.lineitem.select((F.col("l_orderkey").cast("decimal(10,0)") + F.expr("0.12345678901234567891BD")).alias("v"))
    changed = F.when(F.col("l_orderkey") % 1000 == 1, 1).otherwise(0)
    cases = [
        ("equal", narrow(0), wide),
        ("changed", narrow(changed), wide),
        *((f"rounded {kind}", df, df.select(F.col("v").cast("double"))) for kind, df in (("long", far), ("decimal", fine))),
    ]
    every = eq.pair_reports(cases, ("md5", "native"))
    return every.select(F.concat_ws(" ", "algorithm", "pair_id").alias("compared"), "status", "n_before", "n_after")
