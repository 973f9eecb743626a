"""Text jobs over documents, pages, conversations and the derived statement corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryproof.functions import rules, statements as st
from queryproof.functions.canon import row_text
from queryproof.functions.rules import first_match
from queryproof.functions.text import collapse, normalize, without_qualifiers
from queryproof.operators.counting import code_counts
from queryproof.plans import corpus
from queryproof.plans.registry import query

NORMAL_SQL = (
    r"lower(trim(regexp_replace(regexp_replace(regexp_replace({c}, '(?s)/\*.*?\*/', ' ', 'g'), "
    r"'--[^\n\r]*', ' ', 'g'), '[ \t\n\f\r]+', ' ', 'g')))"
)


def counted(df, *names):
    return df.groupBy(*names).agg(F.count("*").alias("n"))


@query(
    "tx_normalize",
    f"SELECT doc_id, md5({NORMAL_SQL.format(c='text')}) AS digest, length({NORMAL_SQL.format(c='text')}) AS n_chars "
    "FROM documents",
)
def tx_normalize(t):
    clean = normalize(F.col("text"))
    return t.documents.select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("n_chars"))


@query(
    "tx_fingerprint_dedup",
    f"""
WITH d AS (SELECT doc_id, sha256('S' || length(lang) || ':' || lang || '|S' || length(t) || ':' || t) AS fingerprint
  FROM (SELECT doc_id, lang, {NORMAL_SQL.format(c='text')} AS t FROM documents))
SELECT fingerprint, count(*) AS n_copies, min(doc_id) AS first_doc FROM d GROUP BY fingerprint""",
)
def tx_fingerprint_dedup(t):
    """Stable fingerprint over the sorted stable fields; ids, sources and counters are left out."""
    stable = t.documents.select("doc_id", "lang", normalize(F.col("text")).alias("text"))
    printed = stable.select("doc_id", F.sha2(row_text(stable, ["lang", "text"]), 256).alias("fingerprint"))
    return printed.groupBy("fingerprint").agg(
        F.count("*").alias("n_copies"), F.min("doc_id").alias("first_doc")
    )


@query(
    "tx_risk_flags",
    f"""
WITH s AS ({corpus.statements_sql()})
SELECT template_no, CASE WHEN contains(sql, '${{') THEN 'DOLLAR_SUBSTITUTION' ELSE '' END AS flags,
  CASE WHEN contains(sql, '${{') THEN 'FAIL' ELSE 'PASS' END AS strict_verdict,
  CASE WHEN contains(sql, '${{') THEN 'NEED_MORE_PARAMS' ELSE 'PASS' END AS balanced_verdict,
  count(*) AS n FROM s GROUP BY ALL""",
)
def tx_risk_flags(t):
    s = corpus.statements(t.orders).withColumn("f", st.risk_flags(F.col("sql")))
    risky = F.size("f") > 0
    return counted(
        s.select(
            "template_no",
            F.array_join("f", ",").alias("flags"),
            F.when(risky, "FAIL").otherwise("PASS").alias("strict_verdict"),
            F.when(risky, "NEED_MORE_PARAMS").otherwise("PASS").alias("balanced_verdict"),
        ),
        "template_no", "flags", "strict_verdict", "balanced_verdict",
    )


PAGE_TAGS = {"nav": "NAVIGATION", "script": "SCRIPT", "style": "STYLE", "ul": "LIST", "article": "ARTICLE", "b": "BOLD"}
PAGE_PLAIN = ("html", "head", "body", "meta", "title", "div", "p", "a", "li", "h1", "br")


@query(
    "tx_dynamic_features",
    r"""
WITH f AS (SELECT page_id, list_filter(["""
    + ", ".join(
        f"CASE WHEN regexp_matches(html, '(?i)<{tag}\\b') THEN '{name}' END" for tag, name in PAGE_TAGS.items()
    )
    + r""", CASE WHEN regexp_matches(html, '(?i)<footer\b') THEN 'OTHER' END], lambda x: x IS NOT NULL) AS fs FROM pages)
SELECT page_id, array_to_string(fs, ',') AS features FROM f""",
)
def tx_dynamic_features(t):
    features = st.tag_features(F.col("html"), PAGE_TAGS, "OTHER", PAGE_PLAIN)
    return t.pages.select("page_id", F.array_join(features, ",").alias("features"))


@query(
    "tx_statement_features",
    f"WITH s AS ({corpus.statements_sql()}) SELECT template_no, {corpus.label_sql('features')} AS features, count(*) AS n "
    "FROM s GROUP BY ALL",
)
def tx_statement_features(t):
    features = st.statement_features(F.col("sql"))
    s = corpus.statements(t.orders).withColumn("features", F.array_join(features, ","))
    return counted(s, "template_no", "features")


@query(
    "tx_table_refs",
    f"""
WITH s AS ({corpus.statements_sql()}),
x AS (SELECT sql_key, unnest(string_split({corpus.label_sql('tables')}, ',')) AS table_name FROM s)
SELECT table_name, count(*) AS n_statements FROM x WHERE table_name <> '' GROUP BY table_name""",
)
def tx_table_refs(t):
    s = corpus.statements(t.orders).select(st.table_refs(F.col("sql")).alias("tables"))
    return code_counts(s, "tables").toDF("table_name", "n_statements")


@query(
    "tx_link_refs",
    r"""
WITH x AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/?([^"]+)"', 1)) AS target FROM pages)
SELECT target, count(*) AS n_pages FROM x GROUP BY target""",
)
def tx_link_refs(t):
    targets = F.array_distinct(F.regexp_extract_all("html", F.lit('href="/?([^"]+)"'), 1))
    links = t.pages.select(F.explode(targets).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("n_pages"))


@query(
    "tx_shape_family",
    f"WITH s AS ({corpus.statements_sql()}) SELECT template_no, {corpus.label_sql('shape')} AS shape, count(*) AS n "
    "FROM s GROUP BY ALL",
)
def tx_shape_family(t):
    return counted(st.with_shape(corpus.statements(t.orders), "sql"), "template_no", "shape")


@query(
    "tx_aggregation_profile",
    f"""
WITH s AS ({corpus.statements_sql()}),
p AS (SELECT template_no, {corpus.label_sql('aggregation')} AS aggregation_shape,
        regexp_matches(lower(sql), 'select distinct') AS distinct_present FROM s)
SELECT template_no, aggregation_shape, distinct_present,
  CASE WHEN aggregation_shape = 'NONE' THEN 'NONE' WHEN distinct_present THEN 'DISTINCT_RELAXATION'
       ELSE aggregation_shape || '_AGGREGATION' END AS constraint_family,
  CASE WHEN aggregation_shape = 'NONE' THEN 'NONE' ELSE 'REVIEW_REQUIRED' END AS capability_tier, count(*) AS n
FROM p GROUP BY ALL""",
)
def tx_aggregation_profile(t):
    """The rewrite under test drops every DISTINCT, which is always a review case."""
    rewritten = F.regexp_replace("sql", "(?i)distinct ", "")
    profiled = st.with_aggregation_profile(corpus.statements(t.orders), "sql", rewritten)
    return counted(
        profiled, "template_no", "aggregation_shape", "distinct_present", "constraint_family", "capability_tier"
    )


STRATEGIES = [
    "Remove redundant-subquery", "or to in", "  simplify_aliases ", "GROUP BY having from alias", "noop case",
    "constant folding!", "large limit", "null_comparison", "distinct on", "inline cte", "Safe-Union-Collapse", "new idea",
]


@query(
    "tx_strategy_to_family",
    f"""
WITH p AS (SELECT ({corpus.list_sql(STRATEGIES)})[p_partkey % {len(STRATEGIES)} + 1] || ' ' || p_name AS strategy FROM part),
n AS (SELECT trim(regexp_replace(upper(trim(strategy)), '[^A-Z0-9]+', '_', 'g'), '_') AS name FROM p)
SELECT name, CASE {' '.join(f"WHEN contains(name, '{m}') THEN '{f}'" for m, f in st.STRATEGY_FAMILIES)} END AS family,
  count(*) AS n FROM n GROUP BY ALL""",
)
def tx_strategy_to_family(t):
    base = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), (F.col("p_partkey") % len(STRATEGIES)).cast("int") + 1)
    p = t.part.select(F.concat_ws(" ", base, "p_name").alias("strategy"))
    named = p.select(
        st.strategy_name(F.col("strategy")).alias("name"), st.strategy_family(F.col("strategy")).alias("family")
    )
    return counted(named, "name", "family")


REASONS = [
    "NO_PATCHABLE_CANDIDATE_LOW_VALUE_ONLY", "NO_SAFE_BASELINE_GROUP_BY", "SEMANTIC_PREDICATE_CHANGED",
    "VALIDATE_PARAM_INSUFFICIENT", "shape_family_not_target", "PATCH_SURFACE_CONFLICT",
    "NO_SAFE_BASELINE_COLLECTION_GUARDED_PREDICATE", "NO_PATCHABLE_CANDIDATE_UNSUPPORTED_STRATEGY",
    "VALIDATE_SECURITY_DOLLAR_SUBSTITUTION", "SEMANTIC_GATE_FAIL", "",
]


def reason(column, values=REASONS):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values)).cast("int") + 1)


def reason_sql(column, values=REASONS):
    return f"({corpus.list_sql(values)})[{column} % {len(values)} + 1]"


@query(
    "tx_code_bucket",
    f"""
WITH r AS (SELECT o_orderpriority, upper({reason_sql('o_custkey')}) AS code FROM orders)
SELECT o_orderpriority, CASE WHEN code LIKE 'NO\\_PATCHABLE\\_CANDIDATE%' ESCAPE '\\' THEN 'NO_PATCHABLE_CANDIDATE_SELECTED'
  WHEN starts_with(code, 'NO_SAFE_BASELINE_') THEN 'NO_SAFE_BASELINE_RECOVERY'
  WHEN starts_with(code, 'SEMANTIC_') THEN 'SEMANTIC_GATE_NOT_PASS'
  WHEN starts_with(code, 'VALIDATE_') THEN 'VALIDATE_STATUS_NOT_PASS'
  WHEN code = 'SHAPE_FAMILY_NOT_TARGET' THEN code ELSE 'OTHER' END AS bucket, count(*) AS n FROM r GROUP BY ALL""",
)
def tx_code_bucket(t):
    o = t.orders.withColumn("bucket", rules.blocker_bucket(reason("o_custkey")))
    return counted(o, "o_orderpriority", "bucket")


PHASES = ["validate", "scan", "patch_generate", "other", "preflight"]
CODES = [
    "VALIDATE_TIMEOUT", "SCAN_MAPPER_NOT_FOUND", "PATCH_GENERATION_ERROR", "RUNTIME_STAGE_TIMEOUT", "NEW_CODE",
    "VALIDATE_DB_UNREACHABLE", "PREFLIGHT_CHECK_FAILED",
]
CLASS_SQL = """CASE WHEN code IN ('VALIDATE_TIMEOUT', 'PATCH_GENERATION_ERROR', 'RUNTIME_STAGE_TIMEOUT') THEN 'retryable'
  WHEN code = 'VALIDATE_DB_UNREACHABLE' THEN 'degradable' ELSE 'fatal' END"""


@query(
    "tx_code_class",
    f"""
WITH e AS (SELECT {reason_sql('user_id', PHASES)} AS phase, {reason_sql('event_id', CODES)} AS code FROM events)
SELECT phase, code, {CLASS_SQL} AS class, count(*) AS n FROM e GROUP BY ALL""",
)
def tx_code_class(t):
    e = t.events.select(reason("user_id", PHASES).alias("phase"), reason("event_id", CODES).alias("code"))
    return counted(
        e.withColumn("class", rules.failure_class(F.col("code"), F.col("phase"))), "phase", "code", "class"
    )


DECISIONS = ["AUTO_PATCHABLE", "MANUAL_REVIEW", "NOT_PATCHABLE"]


@query(
    "tx_boundary_category",
    f"""
WITH e AS (SELECT o_custkey < 10 AS limited, {reason_sql('o_orderkey')} AS raw, upper({reason_sql('o_orderkey')}) AS code,
  {reason_sql('o_custkey', DECISIONS)} AS decision FROM orders),
c AS (SELECT code, decision, limited, CASE WHEN decision = 'AUTO_PATCHABLE' THEN 'SUPPORTED'
  WHEN limited AND code = 'NO_PATCHABLE_CANDIDATE_LOW_VALUE_ONLY' THEN 'PROVIDER_LIMITED'
  WHEN code = 'NO_SAFE_BASELINE_COLLECTION_GUARDED_PREDICATE' THEN 'DEFERRED_CAPABILITY'
  WHEN starts_with(code, 'SEMANTIC_') THEN 'SEMANTIC_BOUNDARY'
  WHEN starts_with(code, 'VALIDATE_') THEN 'VALIDATE_SECURITY_BOUNDARY'
  WHEN starts_with(code, 'NO_PATCHABLE_CANDIDATE_UNSUPPORTED_') OR code IN ('NO_SAFE_BASELINE_GROUP_BY',
    'NO_PATCHABLE_CANDIDATE_LOW_VALUE_ONLY') THEN 'FROZEN_NON_GOAL' ELSE 'OTHER' END AS category FROM e)
SELECT category, CASE category WHEN 'SUPPORTED' THEN 'apply_patch' WHEN 'PROVIDER_LIMITED' THEN
  'consider_provider_investment' WHEN 'DEFERRED_CAPABILITY' THEN 'wait_for_future_capability'
  WHEN 'FROZEN_NON_GOAL' THEN 'do_not_retry_current_scope' ELSE 'review_candidate' END AS action, count(*) AS n
FROM c GROUP BY ALL""",
)
def tx_boundary_category(t):
    o = t.orders.select(
        (F.col("o_custkey") < 10).alias("limited"),
        reason("o_orderkey").alias("code"),
        reason("o_custkey", DECISIONS).alias("decision"),
    )
    category = rules.boundary_category(F.col("code"), F.col("decision"), F.col("limited"))
    o = o.withColumn("category", category)
    return counted(o.withColumn("action", rules.BOUNDARY_ACTION.lookup(F.col("category"))), "category", "action")


TIERS = ["READY_TO_APPLY", "MANUAL_REVIEW", "BLOCKED"]
GATES = ["PASS", "FAIL", "UNCERTAIN", "PASS", "PASS"]
BLOCKERS = ["VALIDATE_SECURITY_DOLLAR_SUBSTITUTION", "SEMANTIC_GATE_FAIL", "PATCH_FAMILY_SPEC_MISSING", ""]


@query(
    "tx_blocker_family",
    f"""
WITH e AS (SELECT {reason_sql('o_orderkey', TIERS)} AS tier, {reason_sql('o_custkey', GATES)} AS gate,
  {reason_sql('(o_orderkey // 3)', BLOCKERS)} AS code FROM orders)
SELECT tier, gate, code, CASE WHEN tier = 'READY_TO_APPLY' THEN 'READY'
  WHEN code = 'VALIDATE_SECURITY_DOLLAR_SUBSTITUTION' THEN 'SECURITY'
  WHEN gate = 'FAIL' OR code = 'SEMANTIC_GATE_FAIL' THEN 'SEMANTIC' ELSE 'TEMPLATE_UNSUPPORTED' END AS family,
  count(*) AS n FROM e GROUP BY ALL""",
)
def tx_blocker_family(t):
    o = t.orders.withColumn("third", F.floor(F.col("o_orderkey") / 3)).select(
        reason("o_orderkey", TIERS).alias("tier"),
        reason("o_custkey", GATES).alias("gate"),
        reason("third", BLOCKERS).alias("code"),
    )
    family = rules.blocker_family(F.col("tier"), F.col("code"), F.col("gate"))
    return counted(o.withColumn("family", family), "tier", "gate", "code", "family")


def _lint_sql():
    cols = r"""CASE WHEN regexp_extract({c}, '(?is)select\s+(?:distinct\s+)?(.*?)\s+from', 1) = '' THEN 0 ELSE
      len(regexp_extract_all(regexp_extract({c}, '(?is)select\s+(?:distinct\s+)?(.*?)\s+from', 1), ',')) + 1 END"""
    return rf"""
WITH a AS ({corpus.statements_sql()}), b AS ({corpus.statements_sql(shift=7)}),
p AS (SELECT a.sql AS o, b.sql AS r FROM a JOIN b USING (o_orderkey)),
w AS (SELECT unnest([
  CASE WHEN {cols.format(c='o')} > 0 AND {cols.format(c='r')} > ({cols.format(c='o')}) * 3 THEN 'COLUMNS_TRIPLED' END,
  CASE WHEN o ILIKE '%where%' AND NOT r ILIKE '%where%' THEN 'WHERE_REMOVED' END,
  CASE WHEN len(regexp_extract_all(r, '(?i)\bjoin\b')) > len(regexp_extract_all(o, '(?i)\bjoin\b')) + 2 THEN 'JOINS_ADDED' END,
  CASE WHEN contains(o, '#{{') AND NOT contains(r, '#{{') THEN 'PLACEHOLDER_REMOVED' END,
  CASE WHEN regexp_matches(r, '(?i)\bor\s+1\s*=\s*1\b') THEN 'TAUTOLOGY_OR' END,
  CASE WHEN regexp_matches(r, '(?i)\bwhere\s+1\s*=\s*1\b') THEN 'TAUTOLOGY_WHERE' END]) AS code FROM p)
SELECT code, count(*) AS n FROM w WHERE code IS NOT NULL GROUP BY code"""


@query("tx_candidate_lint", _lint_sql())
def tx_candidate_lint(t):
    """Warnings of rewriting each statement into the one seven templates further."""
    pairs = corpus.rewritten(t.orders, 7)
    warned = pairs.select(st.rewrite_warnings(F.col("original"), F.col("rewritten")).alias("codes"))
    return code_counts(warned, "codes")


BROKEN = [
    ("", ""), (" WHERE", "WHERE_WITHOUT_CONDITION"), (" WHERE id IN ()", "IN_EMPTY_LIST"),
    (" WHERE (id = 1", "UNCLOSED_PARENTHESIS"), (" WHERE id = 1)", "UNMATCHED_CLOSING"),
    (" WHERE name = '('", ""), (" WHERE id BETWEEN 1 AND", "BETWEEN_WITHOUT_END"), (" WHERE (id = (1))", ""),
]


@query(
    "tx_syntax_lint",
    f"""
SELECT ({corpus.list_sql(b[1] for b in BROKEN)})[o_orderkey % {len(BROKEN)} + 1] AS problem, count(*) AS n
FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1
UNION ALL SELECT 'INVALID_START', count(*) FROM orders WHERE o_orderstatus = 'P'""",
)
def tx_syntax_lint(t):
    tail = reason("o_orderkey", [b[0] for b in BROKEN])
    head = F.when(F.col("o_orderstatus") == "P", "GIVE ME ").otherwise("SELECT ")
    sql = F.concat(head, F.col("o_orderkey").cast("string"), F.lit(" FROM users"), tail)
    judged = st.with_syntax_problem(t.orders.select(sql.alias("sql")), "sql")
    return counted(judged.fillna("", ["problem"]), "problem")


NOTES = [
    " a slow full scan", " risk of SQL injection", " logic stays equivalent", "", " unsafe index use", " nothing to add",
]


@query(
    "tx_keyword_issue_type",
    f"""
WITH c AS (SELECT conv_id, turn, role, lower({reason_sql('(conv_id + turn)', NOTES)} || ' ' || text) AS note FROM conversations),
i AS (SELECT conv_id, turn, CASE
  WHEN contains(note, 'performance') OR contains(note, 'slow') OR contains(note, 'full scan') OR contains(note, 'index')
    THEN 'performance'
  WHEN contains(note, 'sql injection') OR contains(note, 'security') OR contains(note, 'unsafe') THEN 'security'
  WHEN contains(note, 'semantic') OR contains(note, 'equivalent') OR contains(note, 'logic') THEN 'semantic' END AS issue,
  note FROM c)
SELECT conv_id, turn, issue, md5(note) AS description_digest FROM i WHERE issue IS NOT NULL""",
)
def tx_keyword_issue_type(t):
    note = F.lower(F.concat(reason_of_turn(), F.lit(" "), F.col("text")))
    c = t.conversations.withColumn("note", note).withColumn("issue", st.issue_type(F.col("note")))
    return c.filter(F.col("issue").isNotNull()).select(
        "conv_id", "turn", "issue", F.md5("note").alias("description_digest")
    )


def reason_of_turn():
    position = ((F.col("conv_id") + F.col("turn")) % len(NOTES)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(n) for n in NOTES]), position)


@query(
    "tx_actionability_score",
    f"""
WITH s AS ({corpus.statements_sql()}),
f AS (SELECT *, {corpus.label_sql('features')} AS features FROM s),
p AS (SELECT *, CASE WHEN contains(sql, '${{') THEN 0 ELSE 70 + CASE WHEN features <> '' THEN -20 ELSE 10 END
  + CASE WHEN contains(features, 'INCLUDE') THEN -10 ELSE 0 END END AS score FROM f)
SELECT template_no, score, CASE WHEN score = 0 THEN 'BLOCKED' WHEN score >= 80 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM'
  ELSE 'LOW' END AS tier, CASE WHEN score = 0 THEN 'LOW' WHEN features = '' THEN 'HIGH'
  WHEN contains(features, 'INCLUDE') THEN 'LOW' ELSE 'MEDIUM' END AS likelihood, count(*) AS n FROM p GROUP BY ALL""",
)
def tx_actionability_score(t):
    s = corpus.statements(t.orders).withColumn("features", st.statement_features(F.col("sql")))
    scored = s.withColumns(st.actionability(F.col("features"), F.col("sql")))
    return counted(scored, "template_no", "score", "tier", "likelihood")


@query(
    "tx_patchability_score",
    """
WITH p AS (SELECT greatest(0, least(100, 60 + CASE WHEN l_returnflag = 'N' THEN 15 ELSE 0 END
  + CASE WHEN l_linenumber = 1 THEN 15 ELSE 0 END + CASE WHEN l_linenumber = 2 THEN 20 ELSE 0 END
  + CASE WHEN l_linenumber = 3 THEN 5 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 10 ELSE 0 END
  + CASE WHEN l_quantity > 25 THEN -10 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN -25 ELSE 0 END
  + CASE WHEN l_linestatus <> 'O' AND l_tax > 0.04 THEN -20 ELSE 0 END)) AS score FROM lineitem)
SELECT score, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS tier, count(*) AS n
FROM p GROUP BY ALL""",
)
def tx_patchability_score(t):
    scored = t.lineitem.withColumns(rules.patchability(patchability_flags()))
    return counted(scored, "score", "tier")


def patchability_flags():
    """The eight facts of a candidate, read from line item columns."""
    kept = F.col("l_linestatus") == "O"
    return {
        "RULE_SOURCE_CONSERVATIVE": F.col("l_returnflag") == "N",
        "PROJECTION_REWRITE_PATCHABLE": F.col("l_linenumber") == 1,
        "AGGREGATION_WRAPPER_FLATTEN_PATCHABLE": F.col("l_linenumber") == 2,
        "ORDERING_REWRITE_PATCHABLE": F.col("l_linenumber") == 3,
        "PLACEHOLDER_PRESERVED": kept,
        "JOIN_HEAVY_PATCH_SURFACE": F.col("l_quantity") > 25,
        "AGGREGATION_SPECULATIVE_PENALTY": F.col("l_discount") > 0.05,
        "GENERIC_PLACEHOLDER_PENALTY": ~kept & (F.col("l_tax") > 0.04),
    }


@query(
    "tx_nested_counts",
    """
SELECT 'event_type' AS field, event_type AS code, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'k', json_extract_string(props, '$.k'), count(*) FROM events GROUP BY ALL
UNION ALL SELECT 'missing', NULL, 0 WHERE false""",
)
def tx_nested_counts(t):
    """Counts of several fields in one pass, blanks skipped, in long form."""
    fields = t.events.select(
        F.inline(
            F.array(
                F.struct(F.lit("event_type").alias("field"), F.col("event_type").alias("code")),
                F.struct(F.lit("k").alias("field"), F.get_json_object("props", "$.k").alias("code")),
                F.struct(F.lit("missing").alias("field"), F.get_json_object("props", "$.none").alias("code")),
            )
        )
    )
    return counted(fields.filter(F.trim(F.coalesce("code", F.lit(""))) != ""), "field", "code")


MESSAGES = [
    "ERROR: Syntax error at or near x", "(1064, 'check the manual')", "connection reset", "Parse error: line 1",
    "You have an error in your SQL syntax;", "", "timeout",
]


@query(
    "tx_syntax_error",
    f"""
WITH c AS (SELECT role, lower({reason_sql('(conv_id * 3 + turn)', MESSAGES)} || text) AS m FROM conversations)
SELECT role, contains(m, 'syntax error') OR contains(m, 'you have an error in your sql syntax')
  OR contains(m, 'parse error') OR contains(m, '(1064,') AS is_error, count(*) AS n FROM c GROUP BY ALL""",
)
def tx_syntax_error(t):
    position = ((F.col("conv_id") * 3 + F.col("turn")) % len(MESSAGES)).cast("int") + 1
    message = F.concat(F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), position), F.col("text"))
    return counted(t.conversations.withColumn("is_error", st.is_syntax_error(message)), "role", "is_error")


@query(
    "tx_json_field",
    """
WITH e AS (SELECT json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.a.b.c') AS abc FROM events)
SELECT coalesce(k, '0') AS k, coalesce(abc, 'none') AS abc, count(*) AS n FROM e GROUP BY ALL""",
)
def tx_json_field(t):
    e = t.events.select(
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).alias("k"),
        F.coalesce(F.get_json_object("props", "$.a.b.c"), F.lit("none")).alias("abc"),
    )
    return counted(e, "k", "abc")


@query(
    "tx_statement_key",
    f"WITH s AS ({corpus.statements_sql()}) SELECT split_part(sql_key, '#', 1) AS statement_key, count(*) AS n FROM s GROUP BY ALL",
)
def tx_statement_key(t):
    s = corpus.statements(t.orders)
    return s.groupBy(st.statement_key(F.col("sql_key")).alias("statement_key")).agg(F.count("*").alias("n"))


# One candidate per row: original, rewritten, strategy and the category a reader would give it.
CANDIDATES = [
    ("SELECT id FROM users", "SELECT id  FROM users", "none", "IDENTITY_NOOP"),
    ("SELECT id FROM users", "SELECT id FROM users", "projection", "CANONICAL_NOOP_HINT"),
    ("SELECT id FROM users", "", "x", "IDENTITY_NOOP"),
    ("SELECT id FROM users", "SELECT id FROM users /* hint */", "x", "CANONICAL_NOOP_HINT"),
    ("SELECT id FROM users", "SELECT 1", "opencode_text_fallback", "CANONICAL_NOOP_HINT"),
    ("SELECT id FROM users", "SELECT id FROM users WHERE id > 5", "x", "STATIC_STATEMENT_SPECULATIVE_REWRITE"),
    ("SELECT id FROM users", "SELECT id FROM users LIMIT 5", "x", "STATIC_STATEMENT_SPECULATIVE_REWRITE"),
    ("SELECT s, COUNT(*) FROM t GROUP BY s ORDER BY s", "SELECT s, COUNT(*) FROM t GROUP BY s",
     "remove_redundant_order_by", "AGGREGATION_TRANSFORM"),
    ("SELECT s, COUNT(*) FROM t GROUP BY s", "SELECT s, COUNT(*) FROM t WHERE a = 1 GROUP BY s", "add_filter_x",
     "SPECULATIVE_AGGREGATE_ADDITION"),
    ("SELECT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 1 AND c = 2", "extract_window_function", "WINDOW_FUNCTION_EXTRACT"),
    ("UPDATE t SET a = 1 WHERE b = 2", "UPDATE t SET a = 1 WHERE b = 3", "batch_optimization", "DML_SPECULATIVE"),
    ("SELECT <include refid=\"c\" /> FROM t WHERE a = 1", "SELECT <include refid=\"c\" /> FROM t WHERE a = 1 LIMIT 5", "x",
     "STATIC_INCLUDE_SPECULATIVE_PAGINATION"),
    ("SELECT a FROM t <where><if test=\"x\">AND x = 1</if></where>", "SELECT a FROM t <where><if test=\"x\">AND x = 1</if></where> ORDER BY a",
     "x", "DYNAMIC_FILTER_SPECULATIVE_REWRITE"),
    ("SELECT a FROM t WHERE b IN (SELECT c FROM d)", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM d WHERE d.c = t.b)",
     "in-to-exists", "UNSUPPORTED_STRATEGY"),
    ("SELECT DISTINCT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 1 GROUP BY a", "group", "DISTINCT_TRANSFORM"),
    ("SELECT a FROM t WHERE b = 1 UNION SELECT a FROM u WHERE b = 1", "SELECT a FROM t WHERE b = 1 UNION ALL SELECT a FROM u WHERE b = 1",
     "union_all", "UNION_SIMPLIFICATION"),
    ("SELECT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = ANY(1)", "array_param", "ARRAY_PARAMETER_CONVERSION"),
    ("SELECT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 2", "template_fix", "PARAMETER_TEMPLATE_FIX"),
    ("SELECT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 2", "explicit_column", "CONDITION_PLACEHOLDER_FIX"),
    ("SELECT a FROM t WHERE b IN (1, 2)", "SELECT a FROM t WHERE b = #{b}", "x", "IN_TO_EQUAL_CONVERSION"),
    ("SELECT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 2", "foreach_change", "FOREACH_TEMPLATE_FIX"),
    ("SELECT a FROM (SELECT a FROM t WHERE b = 1) x", "SELECT a FROM t WHERE b = 1", "REMOVE_REDUNDANT_SUBQUERY", ""),
]


@query(
    "cd_low_value_rules",
    f"""
SELECT CAST(o_orderkey % {len(CANDIDATES)} AS INTEGER) AS candidate_no,
  ({corpus.list_sql(c[3] for c in CANDIDATES)})[o_orderkey % {len(CANDIDATES)} + 1] AS category, count(*) AS n
FROM orders GROUP BY ALL""",
)
def cd_low_value_rules(t):
    """Candidates per order: texts carry the order key, so every row is a text of its own."""
    number = (F.col("o_orderkey") % len(CANDIDATES)).cast("int")

    def column(i):
        text = F.element_at(F.array(*[F.lit(c[i]) for c in CANDIDATES]), number + 1)
        return F.replace(text, F.lit("users"), F.concat(F.lit("users"), F.col("o_orderkey").cast("string")))

    c = t.orders.select(
        number.alias("candidate_no"), column(0).alias("original"), column(1).alias("rewritten"), column(2).alias("strategy")
    )
    judged = st.with_low_value_category(c, "original", "rewritten", "strategy")
    return counted(judged.fillna("", ["category"]), "candidate_no", "category")


@query(
    "cd_valid_filter",
    f"""
WITH a AS ({corpus.statements_sql()}), b AS ({corpus.statements_sql(shift=7)}),
p AS (SELECT a.template_no AS template_no, a.sql AS o, replace(b.sql, '#{{id}}', '?') AS r FROM a JOIN b USING (o_orderkey)),
v AS (SELECT template_no, NOT contains(r, '${{') AND regexp_matches(r, '(?i)^\\s*(select|with|update|delete|insert)\\b') AS valid,
  NOT contains(o, '#{{') OR contains(r, '#{{') OR NOT contains(r, '?') AS keeps FROM p)
SELECT template_no, count(*) AS n_candidates, count(*) FILTER (valid AND keeps) AS n_valid,
  count(*) FILTER (valid AND NOT keeps) AS n_placeholder_rejected, count(*) FILTER (NOT valid) AS n_malformed
FROM v GROUP BY ALL""",
)
def cd_valid_filter(t):
    changed = F.replace(F.col("rewritten"), F.lit("#{id}"), F.lit("?"))
    pairs = corpus.rewritten(t.orders, 7).select("template_no", F.col("original").alias("o"), changed.alias("r"))
    valid = st.is_valid_candidate(F.col("r"))
    keeps = st.keeps_placeholders(F.col("o"), F.col("r"))
    return (
        pairs.groupBy("template_no")
        .agg(
            F.count("*").alias("n_candidates"),
            F.count_if(valid & keeps).alias("n_valid"),
            F.count_if(valid & ~keeps).alias("n_placeholder_rejected"),
            F.count_if(~valid).alias("n_malformed"),
        )
    )


_VARIANT = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' /* note */ ' WHEN 2 THEN '  ' || text ELSE text || ' more' END"


_BARE_SQL = "regexp_replace({c}, '[a-z_][a-z0-9_]*\\.([a-z_])', '\\1', 'g')"
_QUALIFIED = "SELECT u.name, u.city FROM users u WHERE u.id = "


@query(
    "cd_noop_filter",
    f"""
WITH d AS (SELECT text AS o, {_VARIANT} AS r FROM documents
  UNION ALL SELECT '{_QUALIFIED}' || o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'SELECT name, city FROM users u WHERE id = ' || o_orderkey
    WHEN 1 THEN 'SELECT name, city FROM users u WHERE id = 0' ELSE 'select u.name, u.city from users u where u.id = ' || o_orderkey END FROM orders),
n AS (SELECT *, {NORMAL_SQL.format(c='o')} AS no, {NORMAL_SQL.format(c='r')} AS nr FROM d),
k AS (SELECT CASE WHEN o = r THEN 'IDENTICAL' WHEN trim(regexp_replace(o, '[ \\t\\n\\f\\r]+', ' ', 'g'))
    = trim(regexp_replace(r, '[ \\t\\n\\f\\r]+', ' ', 'g')) THEN 'WHITESPACE_ONLY'
  WHEN no = nr THEN 'COMMENT_ONLY' WHEN {_BARE_SQL.format(c='no')} = {_BARE_SQL.format(c='nr')} THEN 'QUALIFIER_ONLY' ELSE 'CHANGED' END AS kind FROM n)
SELECT kind, kind = 'CHANGED' AS kept, count(*) AS n FROM k GROUP BY ALL""",
)
def cd_noop_filter(t):
    """Changes of white space, comments, letter case or qualifiers only are noise."""
    number = F.col("doc_id") % 4
    variant = first_match(
        [
            (number == 0, F.col("text")),
            (number == 1, F.concat(F.col("text"), F.lit(" /* note */ "))),
            (number == 2, F.concat(F.lit("  "), F.col("text"))),
        ],
        F.concat(F.col("text"), F.lit(" more")),
    )
    key = F.col("o_orderkey")
    bare, lower = (F.concat(F.lit(text), key) for text in ("SELECT name, city FROM users u WHERE id = ", _QUALIFIED.lower()))
    other = F.lit("SELECT name, city FROM users u WHERE id = 0")
    changed = first_match([(key % 3 == 0, bare), (key % 3 == 1, other)], lower)
    d = t.documents.select(F.col("text").alias("o"), variant.alias("r"))
    d = d.union(t.orders.select(F.concat(F.lit(_QUALIFIED), key), changed))
    n = d.select("o", "r", normalize(F.col("o")).alias("no"), normalize(F.col("r")).alias("nr"))
    kind = first_match(
        [
            (F.col("o") == F.col("r"), "IDENTICAL"),
            (collapse(F.col("o")) == collapse(F.col("r")), "WHITESPACE_ONLY"),
            (F.col("no") == F.col("nr"), "COMMENT_ONLY"),
            (without_qualifiers(F.col("no")) == without_qualifiers(F.col("nr")), "QUALIFIER_ONLY"),
        ],
        "CHANGED",
    )
    return counted(n.select(kind.alias("kind")).withColumn("kept", F.col("kind") == "CHANGED"), "kind", "kept")


@query(
    "cd_effective_change",
    f"""
WITH d AS (SELECT doc_id, text AS o, {_VARIANT} AS r FROM documents)
SELECT doc_id, trim(regexp_replace(o, '[ \\t\\n\\f\\r]+', ' ', 'g')) <> trim(regexp_replace(r, '[ \\t\\n\\f\\r]+', ' ', 'g'))
  AS effective_change FROM d""",
)
def cd_effective_change(t):
    number = F.col("doc_id") % 4
    variant = first_match(
        [
            (number == 0, F.col("text")),
            (number == 1, F.concat(F.col("text"), F.lit(" /* note */ "))),
            (number == 2, F.concat(F.lit("  "), F.col("text"))),
        ],
        F.concat(F.col("text"), F.lit(" more")),
    )
    return t.documents.select("doc_id", (collapse(F.col("text")) != collapse(variant)).alias("effective_change"))
