"""Statement texts: features, tables, shapes, profiles and lint on a hand-labelled fixture."""

import pytest
from pyspark.sql import functions as F

from queryproof.functions import statements as st
from queryproof.functions.text import normalize
from queryproof.plans.corpus import TEMPLATES
from queryproof.sources import markup


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (i, x.text.replace(":k", "42").replace(":s", "NEW"), x.shape, x.features, x.aggregation, x.tables)
        for i, x in enumerate(TEMPLATES)
    ]
    return spark.createDataFrame(rows, "no int, sql string, shape string, features string, aggregation string, tables string")


def test_labels(corpus):
    df = corpus.withColumnsRenamed({"shape": "want_shape", "features": "want_features", "aggregation": "want_aggregation"})
    df = st.with_aggregation_profile(st.with_shape(df, "sql"), "sql")
    for r in df.withColumn("refs", F.array_join(st.table_refs(F.col("sql")), ",")).collect():
        assert r["shape"] == r["want_shape"], r["sql"]
        assert ",".join(r["features"]) == r["want_features"], r["sql"]
        assert r["aggregation_shape"] == r["want_aggregation"], r["sql"]
        assert r["refs"] == r["tables"], r["sql"]


def test_shapes_do_not_depend_on_layout(spark, corpus):
    messy = corpus.withColumn("sql", F.concat(F.lit("\n  "), F.regexp_replace("sql", " ", " \n\t ")))
    messy = messy.filter("NOT contains(sql, '--')")  # a line comment would swallow less text
    df = st.with_shape(messy.withColumnRenamed("shape", "want").drop("features"), "sql")
    assert df.filter("shape <> want").count() == 0


def test_every_shape_is_covered():
    assert len({x.shape for x in TEMPLATES}) == 29


def test_top_level_clauses_ignore_subqueries(spark):
    sql = "SELECT a FROM t WHERE b IN (SELECT c FROM (SELECT c FROM d GROUP BY c) e) ORDER BY a"
    df = st.with_aggregation_profile(spark.createDataFrame([(sql,)], "sql string"), "sql")
    assert df.collect()[0]["aggregation_shape"] == "NONE"


def test_normalize(spark):
    sql = " SELECT /* a\n b */ X -- tail\n  FROM\tT  "
    assert spark.createDataFrame([(sql,)], "s string").select(normalize(F.col("s"))).collect()[0][0] == "select x from t"


@pytest.mark.parametrize(
    "sql, problem",
    [
        ("", "EMPTY"),
        ("-- only\n-- comments", "ONLY_COMMENTS"),
        ("-- note\nSELECT 1", None),
        ("FETCH x", "INVALID_START"),
        ("SELECT (a FROM t", "UNCLOSED_PARENTHESIS"),
        ("SELECT a) FROM t", "UNMATCHED_CLOSING"),
        ("SELECT )a( FROM t", "UNMATCHED_CLOSING"),
        ("SELECT ')' FROM t", None),
        ("SELECT a FROM t WHERE", "WHERE_WITHOUT_CONDITION"),
        ("SELECT a FROM", "FROM_WITHOUT_TABLE"),
        ("SELECT a FROM t WHERE a IN ( )", "IN_EMPTY_LIST"),
        ("SELECT a FROM t WHERE ((a) = (1))", None),
    ],
)
def test_syntax_problem(spark, sql, problem):
    assert st.with_syntax_problem(spark.createDataFrame([(sql,)], "sql string"), "sql").collect()[0]["problem"] == problem


def test_rewrite_warnings(spark):
    cases = [
        ("SELECT a FROM t WHERE b = #{b}", "SELECT a, b, c, d FROM t", ["COLUMNS_TRIPLED", "WHERE_REMOVED", "PLACEHOLDER_REMOVED"]),
        ("SELECT a FROM t", "SELECT a FROM t JOIN b JOIN c JOIN d WHERE 1=1", ["JOINS_ADDED", "TAUTOLOGY_WHERE"]),
        ("SELECT a FROM t WHERE x", "SELECT a FROM t WHERE x OR 1 = 1", ["TAUTOLOGY_OR"]),
        ("SELECT * FROM t", "SELECT a, b FROM t", []),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "o string, r string")
    got = [r["w"] for r in df.select(st.rewrite_warnings(F.col("o"), F.col("r")).alias("w")).collect()]
    assert got == [c[2] for c in cases]


def test_line_comments_end_at_the_line(spark):
    rows = [("SELECT a -- x\nFROM t", "SELECT a FROM t", "y"), ("SELECT a -- x\nFROM t", "SELECT a -- x\nFROM u", "y")]
    df = st.with_low_value_category(spark.createDataFrame(rows, "o string, r string, s string"), "o", "r", "s")
    assert [r["category"] for r in df.collect()] == ["CANONICAL_NOOP_HINT", None]


def test_strategy_family(spark):
    names = ["remove redundant-subquery", "OR to IN", "group by having from alias", "brand new"]
    df = spark.createDataFrame([(n,) for n in names], "s string").select(st.strategy_family(F.col("s")).alias("f"))
    assert [r["f"] for r in df.collect()] == [
        "DYNAMIC_FILTER_WRAPPER_COLLAPSE", "STATIC_OR_SIMPLIFICATION", "GROUP_BY_HAVING_FROM_ALIAS_CLEANUP", None,
    ]


# Exact names, as fixed by hand: each of these means its family without any marker.
EXACT = {
    "REMOVE_REDUNDANT_DISTINCT_WRAPPER_RECOVERED": "REDUNDANT_DISTINCT_WRAPPER",
    "REMOVE_CONSTANT_ORDER_BY_RECOVERED": "STATIC_ORDER_BY_SIMPLIFICATION",
    "REMOVE_BOOLEAN_TAUTOLOGY_RECOVERED": "STATIC_BOOLEAN_SIMPLIFICATION",
    "SIMPLIFY_CASE_WHEN_TRUE_RECOVERED": "STATIC_CASE_SIMPLIFICATION",
    "SIMPLIFY_COALESCE_IDENTITY_RECOVERED": "STATIC_COALESCE_SIMPLIFICATION",
    "FOLD_CONSTANT_EXPRESSION_RECOVERED": "STATIC_EXPRESSION_FOLDING",
    "REMOVE_REDUNDANT_HAVING_WRAPPER_RECOVERED": "REDUNDANT_HAVING_WRAPPER",
    "subquery inline": "DYNAMIC_FILTER_WRAPPER_COLLAPSE",
    "SUBQUERY_UNNEST": "DYNAMIC_FILTER_WRAPPER_COLLAPSE",
    "SAFE_JOIN_CONSOLIDATION": "STATIC_JOIN_CONSOLIDATION",
    "SAFE_JOIN_ELIMINATION": "STATIC_JOIN_ELIMINATION",
    "SAFE_JOIN_LEFT_TO_INNER": "STATIC_JOIN_LEFT_TO_INNER",
    "SAFE_JOIN_REORDERING": "STATIC_JOIN_REORDERING",
}


def test_exact_strategy_names(spark):
    df = spark.createDataFrame([(n,) for n in EXACT], "s string").select("s", st.strategy_family(F.col("s")).alias("f"))
    assert {r["s"]: r["f"] for r in df.collect()} == EXACT


@pytest.mark.parametrize(
    "sql, shape",
    [
        ("SELECT o.status, COUNT(*) FROM orders o JOIN users u ON u.id = o.uid GROUP BY o.status", "STATIC_STATEMENT"),
        ("SELECT o.status, COUNT(*) FROM orders o, users u WHERE u.id = o.uid GROUP BY o.status", "STATIC_STATEMENT"),
        ("SELECT o.status, COUNT(*) FROM orders AS o GROUP BY o.status", "GROUP_BY_ALIAS"),
        ("SELECT status FROM orders GROUP BY status", "STATIC_STATEMENT"),
        ("SELECT a FROM (SELECT a FROM t) x JOIN u ON u.a = x.a", "STATIC_STATEMENT"),
        ("SELECT a FROM (SELECT a FROM t) x WHERE a = 1", "STATIC_SUBQUERY_WRAPPER"),
        ("SELECT a FROM t WHERE f(g(h(1))) = ((2))", "STATIC_STATEMENT"),
        ("", "STATIC_STATEMENT"),
    ],
)
def test_shapes_by_hand(spark, sql, shape):
    assert st.with_shape(spark.createDataFrame([(sql,)], "sql string"), "sql").collect()[0]["shape"] == shape


def test_long_nested_text_takes_one_pass(spark):
    sql = "SELECT a FROM t WHERE " + "(" * 2000 + "a = 1" + ")" * 2000
    df = spark.createDataFrame([(sql,)], "sql string")
    assert st.with_syntax_problem(df, "sql").collect()[0]["problem"] is None
    assert st.with_aggregation_profile(df, "sql").collect()[0]["aggregation_shape"] == "NONE"


MAPPER = """<?xml version="1.0"?><mapper namespace="m">
<!-- <select id="gone">SELECT 0</select> <![CDATA[ not one either ]]> -->
<select id="a">SELECT a FROM t WHERE a &lt; 1 AND b &gt;= 2 AND c = &apos;x&apos;</select>
<select id="b"><![CDATA[SELECT '<select id="no">' AS s, '&amp;' AS e, '<!-- kept -->' AS k FROM t WHERE a < 1]]></select>
<select id="c">SELECT &#65;&#x42; FROM t <!-- a note --><if test="x"> WHERE a &amp;lt; &#zz; 1</if></select>
<update id="d">UPDATE t SET a = 'plain' <where><![CDATA[a <> 1]]></where></update>
</mapper>
"""


def test_xml_is_read_as_it_is_meant(spark, tmp_path):
    (tmp_path / "m.xml").write_text(MAPPER)
    got = {r.statement_id: r.body for r in markup.read_statements(spark, str(tmp_path)).collect()}
    assert got == {
        "a": "SELECT a FROM t WHERE a < 1 AND b >= 2 AND c = 'x'",
        "b": """SELECT '<select id="no">' AS s, '&amp;' AS e, '<!-- kept -->' AS k FROM t WHERE a < 1""",
        "c": 'SELECT AB FROM t <if test="x"> WHERE a &lt; &#zz; 1</if>',
        "d": "UPDATE t SET a = 'plain' <where>a <> 1</where>",
    }


TABLES = [
    ("SELECT a FROM s.t, u JOIN \"x\".\"y\" ON 1 = 1", ["t", "y"]), ("select 1 from (select b from t) q join t on 1=1", ["t"]),
    ("SELECT fromage FROM\n  t1\tWHERE x IN (SELECT y FROM t2)", ["t1", "t2"]), ("UPDATE t SET a = 1", []), ("SELECT 1 FROM ${table} JOIN", []), ("", []),
]


@pytest.mark.parametrize("sql, want", TABLES)
def test_tables_by_words(spark, sql, want):
    assert spark.createDataFrame([(sql,)], "s string").select(st.table_refs(F.col("s"))).first()[0] == want


NAMES = [("add_time_filter", True), ("TimeFilter", True), ("join reorder", True), ("a or b", True), ("predicate_push", False), ("store_vendor", False), ("", False)]


@pytest.mark.parametrize("name, want", NAMES)
def test_names_speak_of_a_change(spark, name, want):
    assert spark.createDataFrame([(name,)], "s string").select(st.about(F.col("s"), st.TEMPLATE_STEMS)).first()[0] is want


def test_shapes_from_facts(spark):
    cases = {
        "select a from t order by 'x'": "ORDER_BY_CONSTANT", "select a from t order by 2.5": "ORDER_BY_CONSTANT", "select a from t order by 'x', 'y'": "STATIC_STATEMENT",
        "select a from t limit 1000000": "LIMIT_LARGE", "select a from t limit 0999999": "STATIC_STATEMENT", "select a from t limit 99999999999": "LIMIT_LARGE",
        "select a from t where b = 2*3": "EXPRESSION_FOLDING", "select a from t where b = '2020-01-01'": "STATIC_STATEMENT", "select a from t where b = c-1": "STATIC_STATEMENT",
        "select a from t where exists (select 1 from t x where x.id = t.id)": "EXISTS_SELF", "select a from t where exists (select 1 from u x where x.id = t.id)": "STATIC_STATEMENT",
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r.s: r["shape"] for r in st.with_shape(df, "s").collect()} == cases
