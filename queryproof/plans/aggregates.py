"""Grouping, HAVING, DISTINCT, conditional counters and code counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryproof.operators import audits
from queryproof.operators.counting import code_counts, group_totals
from queryproof.operators.equivalence import compare_bags
from queryproof.plans.registry import bag_sql, pair, query

MONEY = "CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE)"


def money_sum(column: str):
    """Exact decimal sum of a money column, shown as a double."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


@query(
    "ag_group_count_sum",
    f"SELECT o_orderstatus, count(*) AS total, {MONEY} AS total_amount FROM orders GROUP BY o_orderstatus",
)
def ag_group_count_sum(t):
    return t.orders.groupBy("o_orderstatus").agg(
        F.count("*").alias("total"), money_sum("o_totalprice").alias("total_amount")
    )


@query(
    "ag_having",
    "SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 10",
)
def ag_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("total")).filter(F.col("total") > 10)


@query("ag_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def ag_distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@pair(
    "ag_count_star_pair",
    "SELECT o_orderstatus, count(1) AS n FROM orders GROUP BY 1",
    "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "o_orderstatus:s n:v",
)
def ag_count_star_pair(t):
    g = t.orders.groupBy("o_orderstatus")
    return g.agg(F.count(F.lit(1)).alias("n")), g.agg(F.count("*").alias("n"))


@query(
    "ag_count_column_audit",
    """
WITH o AS (SELECT nullif(o_orderstatus, 'P') AS s FROM orders)
SELECT count(*) AS n_star, count(1) AS n_one, count(s) AS n_column, count(*) - count(s) AS n_null,
       count(*) = count(s) AS safe FROM o""",
)
def ag_count_column_audit(t):
    s = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t.orders.agg(
        F.count("*").alias("n_star"),
        F.count(F.lit(1)).alias("n_one"),
        F.count(s).alias("n_column"),
        F.count_if(s.isNull()).alias("n_null"),
        (F.count("*") == F.count(s)).alias("safe"),
    )


_WRAPPED = "SELECT count(*) AS n FROM (SELECT {d} o_custkey FROM orders WHERE o_orderstatus = 'O') q"
_DIRECT = "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'"


@query(
    "ag_count_wrapper_pair",
    f"""
SELECT 'plain' AS inner_query, w.n AS n_wrapped, d.n AS n_direct, w.n = d.n AS same
FROM ({_WRAPPED.format(d="")}) w, ({_DIRECT}) d
UNION ALL
SELECT 'distinct', w.n, d.n, w.n = d.n FROM ({_WRAPPED.format(d="DISTINCT")}) w, ({_DIRECT}) d""",
)
def ag_count_wrapper_pair(t):
    inner = t.orders.filter(F.col("o_orderstatus") == "O").select("o_custkey")
    direct = t.orders.filter(F.col("o_orderstatus") == "O").agg(F.count("*").alias("n"))

    def one(label, wrapped):
        both = wrapped.agg(F.count(F.lit(1)).alias("w")).select("w", F.lit(None).cast("bigint").alias("d")).unionAll(
            direct.select(F.lit(None).cast("bigint"), "n")
        )
        return both.agg(F.max("w").alias("n_wrapped"), F.max("d").alias("n_direct")).select(
            F.lit(label).alias("inner_query"),
            "n_wrapped",
            "n_direct",
            (F.col("n_wrapped") == F.col("n_direct")).alias("same"),
        )

    return one("plain", inner).unionByName(one("distinct", inner.distinct()))


_GROUPED = "SELECT o_orderstatus, count(*) AS total, max(o_orderkey) AS last_key FROM orders GROUP BY o_orderstatus"
_GROUPED_SPEC = "o_orderstatus:s total:v last_key:v"


def _grouped(orders, column="o_orderstatus", prefix=""):
    key = F.col(f"{prefix}{column}")
    return orders.groupBy(key.alias(column)).agg(
        F.count("*").alias("total"), F.max(f"{prefix}o_orderkey").alias("last_key")
    )


@pair(
    "ag_groupby_wrapper_pair",
    f"SELECT o_orderstatus, total, last_key FROM ({_GROUPED}) og",
    _GROUPED,
    _GROUPED_SPEC,
)
def ag_groupby_wrapper_pair(t):
    g = _grouped(t.orders)
    return g.alias("og").select("og.o_orderstatus", "og.total", "og.last_key"), g


_HAVING = "SELECT o_custkey, count(*) AS total, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey HAVING count(*) > 10"
_HAVING_SPEC = "o_custkey:v total:v last_key:v"


@pair(
    "ag_having_wrapper_pair",
    f"SELECT o_custkey, total, last_key FROM ({_HAVING}) oh",
    _HAVING,
    _HAVING_SPEC,
)
def ag_having_wrapper_pair(t):
    g = _grouped(t.orders, "o_custkey").filter(F.col("total") > 10)
    return g.alias("oh").select("oh.o_custkey", "oh.total", "oh.last_key"), g


@pair(
    "ag_distinct_wrapper_pair",
    "SELECT DISTINCT o_orderstatus FROM (SELECT DISTINCT o_orderstatus FROM orders) ds",
    "SELECT DISTINCT o_orderstatus FROM orders",
    "o_orderstatus:s",
)
def ag_distinct_wrapper_pair(t):
    once = t.orders.select("o_orderstatus").distinct()
    return once.distinct(), once


@pair(
    "ag_groupby_alias_pair",
    "SELECT o.o_orderstatus AS o_orderstatus, count(*) AS total, max(o.o_orderkey) AS last_key FROM orders o "
    "GROUP BY o.o_orderstatus",
    _GROUPED,
    _GROUPED_SPEC,
)
def ag_groupby_alias_pair(t):
    return _grouped(t.orders.alias("o"), prefix="o."), _grouped(t.orders)


@pair(
    "ag_having_alias_pair",
    "SELECT o.o_custkey AS o_custkey, count(*) AS total, max(o.o_orderkey) AS last_key FROM orders o "
    "GROUP BY o.o_custkey HAVING count(*) > 10",
    _HAVING,
    _HAVING_SPEC,
)
def ag_having_alias_pair(t):
    many = F.col("total") > 10
    return (
        _grouped(t.orders.alias("o"), "o_custkey", "o.").filter(many),
        _grouped(t.orders, "o_custkey").filter(many),
    )


@pair(
    "ag_distinct_alias_pair",
    "SELECT DISTINCT o.o_orderpriority FROM orders o",
    "SELECT DISTINCT o_orderpriority FROM orders",
    "o_orderpriority:s",
)
def ag_distinct_alias_pair(t):
    return (
        t.orders.alias("o").select(F.col("o.o_orderpriority")).distinct(),
        t.orders.select("o_orderpriority").distinct(),
    )


@query(
    "ag_distinct_relaxation_audit",
    """
WITH k AS (SELECT 'orders' AS projected, o_orderkey AS a, 0 AS b, count(*) AS n FROM orders GROUP BY ALL
           UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber, count(*) FROM lineitem GROUP BY ALL)
SELECT projected, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys,
       count(*) FILTER (n > 1) AS n_duplicated_keys, max(n) AS max_copies,
       count(*) FILTER (n > 1) = 0 AS is_unique
FROM k GROUP BY projected""",
)
def ag_distinct_relaxation_audit(t):
    unique = audits.key_uniqueness(t.orders, ["o_orderkey"])
    repeated = audits.key_uniqueness(t.lineitem, ["l_orderkey", "l_linenumber"])
    return unique.select(F.lit("orders").alias("projected"), "*").unionByName(
        repeated.select(F.lit("lineitem").alias("projected"), "*")
    )


@query(
    "ag_conditional_counts",
    """
SELECT count(*) AS n_units, count(*) FILTER (o_orderstatus = 'F') AS n_pass,
       count(*) FILTER (o_orderstatus = 'O') AS n_fail, count(*) FILTER (o_orderstatus = 'P') AS n_need_params,
       count(*) FILTER (o_totalprice > 250000) AS n_expensive,
       count(*) FILTER (o_orderstatus <> 'F' OR o_orderpriority = '5-LOW') AS n_blocked FROM orders""",
)
def ag_conditional_counts(t):
    status = F.col("o_orderstatus")
    return t.orders.agg(
        F.count("*").alias("n_units"),
        F.count_if(status == "F").alias("n_pass"),
        F.count_if(status == "O").alias("n_fail"),
        F.count_if(status == "P").alias("n_need_params"),
        F.count_if(F.col("o_totalprice") > 250000).alias("n_expensive"),
        F.count_if((status != "F") | (F.col("o_orderpriority") == "5-LOW")).alias("n_blocked"),
    )


_TOKENS = "SELECT p_partkey, unnest(string_split(concat(p_name, ' ', lower(p_type), ' ', p_name, ' '), ' ')) AS code FROM part"


def _tokens(t):
    text = F.concat_ws(" ", "p_name", F.lower("p_type"), "p_name", F.lit(""))
    return t.part.select("p_partkey", F.split(text, " ").alias("codes"))


@query(
    "ag_code_counts",
    f"SELECT code, count(*) AS n FROM ({_TOKENS}) x WHERE trim(code) <> '' GROUP BY code",
)
def ag_code_counts(t):
    return code_counts(_tokens(t), "codes")


@query(
    "ag_code_counts_distinct_per_row",
    f"SELECT code, count(*) AS n FROM (SELECT DISTINCT p_partkey, code FROM ({_TOKENS}) y) x "
    "WHERE trim(code) <> '' GROUP BY code",
)
def ag_code_counts_distinct_per_row(t):
    return code_counts(_tokens(t), "codes", once_per_row=True)


@query(
    "ag_two_level_counts",
    """
SELECT o_orderstatus AS phase, o_orderpriority AS reason, count(*) AS n,
       CASE WHEN grouping(o_orderpriority) = 0 THEN 'phase+reason' WHEN grouping(o_orderstatus) = 0
            THEN 'phase' ELSE 'all' END AS level
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""",
)
def ag_two_level_counts(t):
    return (
        t.orders.groupingSets(
            [["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], "o_orderstatus", "o_orderpriority"
        )
        .agg(
            F.count("*").alias("n"),
            F.when(F.grouping("o_orderpriority") == 0, "phase+reason")
            .when(F.grouping("o_orderstatus") == 0, "phase")
            .otherwise("all")
            .alias("level"),
        )
        .withColumnsRenamed({"o_orderstatus": "phase", "o_orderpriority": "reason"})
    )


@query(
    "ag_batch_rollup",
    """
SELECT o_orderpriority AS batch, grouping(o_orderpriority) = 1 AS is_total, count(*) AS n_statements,
  count(*) FILTER (o_orderstatus = 'F') AS n_auto, count(*) FILTER (o_orderstatus = 'O') AS n_review,
  count(*) FILTER (o_orderstatus = 'P') AS n_not_patchable,
  count(*) - count(*) FILTER (o_orderstatus = 'F') AS n_blocked,
  round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS auto_rate
FROM orders GROUP BY ROLLUP (o_orderpriority)""",
)
def ag_batch_rollup(t):
    return group_totals(t.orders, "o_orderpriority", "o_orderstatus", auto="F", review="O", not_patchable="P")


@query(
    "ag_grouped_fingerprint_pair",
    f"""
WITH b AS ({bag_sql("SELECT DISTINCT o_custkey, o_orderstatus FROM orders", "o_custkey:v o_orderstatus:s")}),
a AS ({bag_sql("SELECT o_custkey, o_orderstatus FROM orders", "o_custkey:v o_orderstatus:s")})
SELECT b.n AS n_distinct, a.n AS n_all, CASE WHEN b.fp = a.fp THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM a, b""",
)
def ag_grouped_fingerprint_pair(t):
    """Dropping a DISTINCT that is needed must be reported as a mismatch."""
    rows = t.orders.select("o_custkey", "o_orderstatus")
    return compare_bags(rows.distinct(), rows).select(
        F.col("n_before").alias("n_distinct"),
        F.col("n_after").alias("n_all"),
        F.when(F.col("fp_before") == F.col("fp_after"), "MATCH").otherwise("MISMATCH").alias("status"),
    )
