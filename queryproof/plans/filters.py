"""Projections, filters, predicates and updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.operators import audits, filters
from queryproof.operators.equivalence import changed_cells, compare_bags
from queryproof.operators.joins import exists_in
from queryproof.plans.registry import CUSTOMER, ORDERS, bag_sql, pair, query

CUSTOMER_COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query(
    "pf_projection",
    "SELECT c_custkey, c_name AS customer_name, c_mktsegment AS segment FROM customer",
)
def pf_projection(t):
    return t.customer.select(
        "c_custkey", F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment")
    )


@pair(
    "pf_alias_cleanup_pair",
    "SELECT c_custkey AS c_custkey, c_name AS c_name, c_nationkey AS c_nationkey, "
    "c_acctbal AS c_acctbal, c_mktsegment AS c_mktsegment FROM customer",
    f"SELECT {CUSTOMER_COLUMNS} FROM customer",
    CUSTOMER,
)
def pf_alias_cleanup_pair(t):
    c = t.customer
    return c.select(*[F.col(n).alias(n) for n in c.columns]), c.select(*c.columns)


@pair(
    "pf_qualifier_cleanup_pair",
    "SELECT u.c_custkey, u.c_name, u.c_nationkey, u.c_acctbal, u.c_mktsegment FROM customer u "
    "WHERE u.c_mktsegment = 'BUILDING'",
    f"SELECT {CUSTOMER_COLUMNS} FROM customer WHERE c_mktsegment = 'BUILDING'",
    CUSTOMER,
)
def pf_qualifier_cleanup_pair(t):
    u = t.customer.alias("u")
    before = u.filter(F.col("u.c_mktsegment") == "BUILDING").select(
        *[F.col(f"u.{n}") for n in t.customer.columns]
    )
    return before, t.customer.filter(F.col("c_mktsegment") == "BUILDING")


@pair(
    "pf_conjunct_reorder_pair",
    f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND "
    "250000 AND o_orderpriority <> '5-LOW'",
    f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'O' "
    "AND o_totalprice BETWEEN 1000 AND 250000",
    ORDERS,
)
def pf_conjunct_reorder_pair(t):
    a = F.col("o_orderstatus") == "O"
    b = F.col("o_totalprice").between(1000, 250000)
    c = F.col("o_orderpriority") != "5-LOW"
    return t.orders.filter(a).filter(b).filter(c), t.orders.filter(c).filter(a).filter(b)


@query(
    "pf_conjunct_removed_audit",
    """
WITH o AS (SELECT o_orderpriority = '1-URGENT' AS kept,
                  nullif(o_orderstatus, 'P') = 'O' AS removed FROM orders),
a AS (SELECT count(*) FILTER (kept AND removed) AS n_before, count(*) FILTER (kept) AS n_after,
             count(*) FILTER (kept AND NOT coalesce(removed, false)) AS n_let_in FROM o)
SELECT n_before, n_after, n_let_in,
       CASE WHEN n_let_in = 0 THEN 'REVIEW' ELSE 'BLOCKED' END AS decision FROM a""",
)
def pf_conjunct_removed_audit(t):
    return audits.conjunct_removal(
        t.orders,
        kept=F.col("o_orderpriority") == "1-URGENT",
        removed=F.nullif(F.col("o_orderstatus"), F.lit("P")) == "O",
    )


@pair(
    "pf_boolean_tautology_pair",
    f"SELECT {CUSTOMER_COLUMNS} FROM customer WHERE 1 = 1 AND 0 = 0 AND TRUE",
    f"SELECT {CUSTOMER_COLUMNS} FROM customer",
    CUSTOMER,
)
def pf_boolean_tautology_pair(t):
    return t.customer.filter("1 = 1 AND 0 = 0 AND TRUE"), t.customer


@pair(
    "pf_in_single_pair",
    f"SELECT {CUSTOMER_COLUMNS} FROM customer WHERE c_mktsegment IN ('BUILDING')",
    f"SELECT {CUSTOMER_COLUMNS} FROM customer WHERE c_mktsegment = 'BUILDING'",
    CUSTOMER,
)
def pf_in_single_pair(t):
    seg = F.col("c_mktsegment")
    return t.customer.filter(seg.isin(["BUILDING"])), t.customer.filter(seg == "BUILDING")


@pair(
    "pf_not_in_single_pair",
    f"SELECT {CUSTOMER_COLUMNS} FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') NOT IN ('BUILDING')",
    f"SELECT {CUSTOMER_COLUMNS} FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') <> 'BUILDING'",
    CUSTOMER,
)
def pf_not_in_single_pair(t):
    seg = F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))
    return t.customer.filter(~seg.isin(["BUILDING"])), t.customer.filter(seg != "BUILDING")


@pair(
    "pf_or_to_in_pair",
    f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'F'",
    f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus IN ('O', 'F')",
    ORDERS,
)
def pf_or_to_in_pair(t):
    s = F.col("o_orderstatus")
    return t.orders.filter((s == "O") | (s == "F")), t.orders.filter(s.isin("O", "F"))


@pair(
    "pf_case_true_pair",
    "SELECT o_orderkey, CASE WHEN TRUE THEN o_orderstatus ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "SELECT o_orderkey, o_orderstatus FROM orders",
    "o_orderkey:v o_orderstatus:s",
)
def pf_case_true_pair(t):
    s = F.col("o_orderstatus")
    before = t.orders.select("o_orderkey", F.when(F.lit(True), s).otherwise(s).alias("o_orderstatus"))
    return before, t.orders.select("o_orderkey", "o_orderstatus")


@pair(
    "pf_coalesce_identity_pair",
    "SELECT o_orderkey, coalesce(s, s) AS a, coalesce(s, NULL) AS b FROM "
    "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) o",
    "SELECT o_orderkey, s AS a, s AS b FROM "
    "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) o",
    "o_orderkey:v a:s b:s",
)
def pf_coalesce_identity_pair(t):
    o = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"))
    s = F.col("s")
    before = o.select(
        "o_orderkey", F.coalesce(s, s).alias("a"), F.coalesce(s, F.lit(None).cast("string")).alias("b")
    )
    return before, o.select("o_orderkey", s.alias("a"), s.alias("b"))


@pair(
    "pf_constant_fold_pair",
    f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_custkey < 100 + 20 * 5 - 8 // 4",
    f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_custkey < 198",
    ORDERS,
)
def pf_constant_fold_pair(t):
    return t.orders.filter("o_custkey < 100 + 20 * 5 - 8 div 4"), t.orders.filter("o_custkey < 198")


@query(
    "pf_null_comparison_audit",
    """
WITH c AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg FROM customer),
a AS (SELECT count(*) AS n_rows, count(*) FILTER (seg = NULL) AS n_equals_null,
             count(*) FILTER (seg IS NULL) AS n_is_null, count(*) FILTER (seg <> NULL) AS n_not_equals_null,
             count(*) FILTER (seg IS NOT NULL) AS n_is_not_null FROM c)
SELECT *, n_equals_null = n_is_null AS equals_safe, n_not_equals_null = n_is_not_null AS not_equals_safe
FROM a""",
)
def pf_null_comparison_audit(t):
    seg = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    null = F.lit(None).cast("string")
    return (
        t.customer.agg(
            F.count("*").alias("n_rows"),
            F.count_if(seg == null).alias("n_equals_null"),
            F.count_if(seg.isNull()).alias("n_is_null"),
            F.count_if(seg != null).alias("n_not_equals_null"),
            F.count_if(seg.isNotNull()).alias("n_is_not_null"),
        )
        .withColumn("equals_safe", F.col("n_equals_null") == F.col("n_is_null"))
        .withColumn("not_equals_safe", F.col("n_not_equals_null") == F.col("n_is_not_null"))
    )


_NOT_NULL_SIDES = (
    "SELECT o.o_orderkey, o.k FROM (SELECT o_orderkey, nullif(o_custkey, 7) AS k FROM orders) o "
    "WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.k)"
)


@query(
    "pf_redundant_not_null_audit",
    f"""
WITH n AS (SELECT count(*) FILTER (nullif(o_custkey, 7) IS NULL) AS n_null_keys FROM orders),
b AS ({bag_sql(_NOT_NULL_SIDES + " AND o.k IS NOT NULL", "o_orderkey:v k:v")}),
a AS ({bag_sql(_NOT_NULL_SIDES, "o_orderkey:v k:v")})
SELECT n_null_keys, b.n AS n_before, a.n AS n_after,
       CASE WHEN b.fp = a.fp THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM n, b, a""",
)
def pf_redundant_not_null_audit(t):
    o = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey"), F.lit(7)).alias("k"))
    after = exists_in(o, "k", t.customer, "c_custkey")
    before = after.filter(F.col("k").isNotNull())
    null_keys = audits.null_count(o, F.col("k")).select("n_null").scalar()
    same = F.col("fp_before") == F.col("fp_after")
    return compare_bags(before, after).select(
        null_keys.alias("n_null_keys"), "n_before", "n_after", F.when(same, "MATCH").otherwise("MISMATCH").alias("status")
    )


PARAMETER_SETS = [
    ("none", None, None),
    ("status", "O", ""),
    ("priority", None, "1-URGENT"),
    ("both", "O", "1-URGENT"),
]


@query(
    "pf_optional_filter",
    """
SELECT 'none' AS parameters, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders
UNION ALL SELECT 'status', count(*), min(o_orderkey), max(o_orderkey) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'priority', count(*), min(o_orderkey), max(o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'both', count(*), min(o_orderkey), max(o_orderkey) FROM orders
  WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""",
)
def pf_optional_filter(t):
    def one(name, status, priority):
        kept = filters.optional_filter(
            t.orders,
            [
                (status, F.col("o_orderstatus") == status),
                (priority, F.col("o_orderpriority") == priority),
            ],
        )
        return kept.agg(
            F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
        ).select(F.lit(name).alias("parameters"), "n", "first_key", "last_key")

    return reduce(DataFrame.unionByName, [one(*p) for p in PARAMETER_SETS])


@query(
    "pf_choose_filter",
    """
WITH j AS (SELECT o.*, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'segment'
                            WHEN c.c_nationkey < 5 THEN 'nation' ELSE 'otherwise' END AS branch
           FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)
SELECT branch, o_orderstatus, count(*) AS n FROM j
WHERE CASE branch WHEN 'segment' THEN o_orderstatus = 'O' WHEN 'nation' THEN o_orderpriority = '1-URGENT'
      ELSE o_orderstatus <> 'P' END
GROUP BY ALL""",
)
def pf_choose_filter(t):
    branch = filters.branch_of(
        [("segment", F.col("c_mktsegment") == "BUILDING"), ("nation", F.col("c_nationkey") < 5)]
    )
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("branch", branch)
    keep = (
        F.when(F.col("branch") == "segment", F.col("o_orderstatus") == "O")
        .when(F.col("branch") == "nation", F.col("o_orderpriority") == "1-URGENT")
        .otherwise(F.col("o_orderstatus") != "P")
    )
    return joined.filter(keep).groupBy("branch", "o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "pf_choose_parameters",
    """
SELECT 'keyword' AS given, count(*) AS n FROM customer WHERE c_name ILIKE '%00012%'
UNION ALL SELECT 'segment', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'nothing', count(*) FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
)
def pf_choose_parameters(t):
    def one(label, keyword, segment):
        kept = filters.choose_filter(
            t.customer,
            [
                (keyword, F.col("c_name").ilike(f"%{keyword}%")),
                (segment, F.col("c_mktsegment") == segment),
            ],
            otherwise=F.col("c_mktsegment") != "MACHINERY",
        )
        return kept.agg(F.count("*").alias("n")).select(F.lit(label).alias("given"), "n")

    sets = [("keyword", "00012", "BUILDING"), ("segment", "", "BUILDING"), ("nothing", None, None)]
    return reduce(DataFrame.unionByName, [one(*s) for s in sets])


@query(
    "pf_foreach_in",
    """
SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
GROUP BY o_orderstatus""",
)
def pf_foreach_in(t):
    ids = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    few = filters.member_filter(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    kept = filters.member_filter(few, "o_custkey", ids)
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query(
    "pf_ilike_search",
    "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%BOLT%' OR p_type ILIKE '%eco%'",
)
def pf_ilike_search(t):
    return t.part.filter(F.col("p_name").ilike("%BOLT%") | F.col("p_type").ilike("%eco%")).select(
        "p_partkey", "p_name", "p_type"
    )


@query(
    "pf_selective_update",
    """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'X' ELSE o_orderstatus END
       AS o_orderstatus, o_orderpriority FROM orders""",
)
def pf_selective_update(t):
    updated = filters.selective_update(
        t.orders,
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        {"o_orderstatus": "X", "o_orderpriority": None},
    )
    return updated.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "pf_dml_clause_check",
    """
WITH u AS (
  SELECT o_orderkey,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS s1, o_orderpriority AS p1,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'X' ELSE o_orderstatus END AS s2,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN '0-NOW' ELSE o_orderpriority END AS p2
  FROM orders)
SELECT o_orderkey, 'CHANGED' AS change, 'o_orderstatus' AS column_name, s1 AS old_value, s2 AS new_value FROM u
  WHERE s1 IS DISTINCT FROM s2 AND o_orderkey % 10 > 1
UNION ALL SELECT o_orderkey, 'CHANGED', 'o_orderpriority', p1, p2 FROM u WHERE p1 IS DISTINCT FROM p2 AND o_orderkey % 10 > 1
UNION ALL SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'DELETED' ELSE 'INSERTED' END, NULL, NULL, NULL FROM u
  WHERE o_orderkey % 10 < 2""",
)
def pf_dml_clause_check(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    first = filters.selective_update(o, urgent, {"o_orderstatus": "X"})
    second = filters.selective_update(
        o, urgent & (F.col("o_orderstatus") != "F"), {"o_orderstatus": "X", "o_orderpriority": "0-NOW"}
    )
    last = F.col("o_orderkey") % 10
    return changed_cells(first.filter(last != 1), second.filter(last != 0), ["o_orderkey"])
