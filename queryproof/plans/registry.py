"""Registry of queries and their oracle SQL, and the SQL side of the bag fingerprint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from queryproof.operators.equivalence import pair_report
from queryproof.session import Tables


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with the SQL it must agree with."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return wrap


# Column kinds used by the SQL side: "s" for strings, "d" for doubles (-0.0 is written as 0.0), "v" for other scalars.
ORDERS = "o_orderkey:v o_custkey:v o_orderstatus:s o_totalprice:d o_orderdate:v o_orderpriority:s"
CUSTOMER = "c_custkey:v c_name:s c_nationkey:v c_acctbal:d c_mktsegment:s"
LINEITEM = (
    "l_orderkey:v l_partkey:v l_suppkey:v l_linenumber:v l_quantity:d l_extendedprice:d "
    "l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:v"
)


def text_sql(spec: str) -> str:
    """Canonical row text in SQL for ``"name:kind name:kind"``."""
    parts = []
    for item in spec.split():
        name, kind = item.split(":")
        if kind == "s":
            parts.append(f"coalesce('S' || length({name}) || ':' || {name}, 'N')")
        elif kind == "d":
            parts.append(f"coalesce('V' || CAST(CASE WHEN {name} = 0 THEN 0 ELSE {name} END AS VARCHAR), 'N')")
        else:
            parts.append(f"coalesce('V' || CAST({name} AS VARCHAR), 'N')")
    return " || '|' || ".join(parts)


def hash_sql(spec: str) -> str:
    return f"('0x' || substr(md5({text_sql(spec)}), 1, 15))::BIGINT"


def bag_sql(rows_sql: str, spec: str) -> str:
    """One-row SQL: ``n`` and the fingerprint text ``fp`` of a query."""
    return (
        "SELECT CAST(count(*) AS BIGINT) AS n, concat(count(*), ':', coalesce(sum(h), 0), ':', "
        f"coalesce(bit_xor(h), 0)) AS fp FROM (SELECT {hash_sql(spec)} AS h FROM ({rows_sql}) q) t"
    )


def pair_sql(pair_id: str, before: str, after: str, spec: str, after_spec: str | None = None) -> str:
    return f"""
WITH b AS ({bag_sql(before, spec)}), a AS ({bag_sql(after, after_spec or spec)})
SELECT '{pair_id}' AS pair_id, b.n AS n_before, a.n AS n_after, b.fp AS fp_before, a.fp AS fp_after,
       CASE WHEN b.fp = a.fp THEN 'MATCH' ELSE 'MISMATCH' END AS status,
       (b.n = 0 AND a.n = 0) AS vacuous
FROM b, a"""


PAIRS: dict[str, Callable[[Tables], tuple[DataFrame, DataFrame]]] = {}
PAIR_SQL: dict[str, str] = {}


def pair(name: str, before: str, after: str, spec: str, after_spec: str | None = None):
    """Register a rewrite pair: ``fn(tables) -> (before, after)``; the query is its one-row report."""

    def wrap(fn: Callable[[Tables], tuple[DataFrame, DataFrame]]):
        PAIRS[name] = fn
        PAIR_SQL[name] = pair_sql(name, before, after, spec, after_spec)
        query(name, PAIR_SQL[name])(lambda t: pair_report(name, *fn(t), algorithm="md5"))
        return fn

    return wrap


def load_all() -> dict[str, Entry]:
    """Import every plan module once and return the registry."""
    from queryproof.plans import modules

    modules()
    return REGISTRY
