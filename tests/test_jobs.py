"""Sources, streaming, closure, consensus and feedback on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from queryproof.operators import audits, consensus as cons, filters
from queryproof.operators.closure import reference_closure
from queryproof.operators.ordering import non_constant_order
from queryproof.session import scratch_path
from queryproof.sources import catalog, contracts, jsonl, markup
from queryproof.streaming import eventlog as log


def closed(edges):
    """All references of every fragment, by joining the relation with itself until nothing is new."""
    pairs = {(f, r) for f, refs in edges.items() for r in refs}
    while True:
        more = pairs | {(a, d) for a, b in pairs for c, d in pairs if b == c}
        if more == pairs:
            return pairs
        pairs = more


@pytest.mark.parametrize("seed", range(2))
def test_closure_equals_the_fixed_point(spark, seed):
    rng = random.Random(seed)
    edges = {i: sorted({rng.randrange(i + 1, i + 6) for _ in range(rng.randrange(3))}) for i in range(25)}
    edges[30], edges[31], edges[32], edges[33] = [31], [32], [30], [33]
    edges.update({100 + i: [101 + i] for i in range(25)})
    rows = [(f, r) for f, refs in edges.items() for r in (refs or [None])]
    frame = spark.createDataFrame(rows, "fragment bigint, ref bigint")
    roots = spark.createDataFrame([(f,) for f in edges], "root bigint")
    got = {r["root"]: (r["n_refs"], r["degraded"]) for r in reference_closure(roots, frame, scratch_path(spark, "closure")).collect()}
    pairs = closed(edges)
    circle = {f for f, r in pairs if f == r}
    assert got == {
        f: (sum(a == f for a, _ in pairs), f in circle or any(a == f and b in circle for a, b in pairs)) for f in edges
    }


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def __init__(self, **known):
            self.known = known

        def get(self, name, default=None):
            return self.known.get(name.rsplit(".", 1)[-1], default)

    class Session:
        conf = Conf(master="spark://host:7077")

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session(), "x")
    Session.conf = Conf(master="yarn", dir="hdfs://shared/")
    assert scratch_path(Session(), "x").startswith("hdfs://shared/queryproof/x-")
    Session.conf = Conf(master="local[4]")
    assert scratch_path(Session(), "x")


def test_event_log_is_tailed_and_upserts_are_idempotent(spark, t):
    folder = scratch_path(spark, "upsert")
    schema = t.events.schema
    first, second = t.events.filter("event_id % 2 = 0"), t.events.filter("event_id % 2 = 1")
    store = log.UpsertStore(spark, f"{folder}/store", ["user_id"], [("ts", "desc"), ("event_id", "desc")])
    jsonl.write_jsonl(first, f"{folder}/log")
    stream = log.read_event_log(spark, f"{folder}/log", schema)
    log.run_batches(stream, "append", f"{folder}/ck", store.merge)
    half = store.current().collect()
    jsonl.write_jsonl(second, f"{folder}/log", append=True)
    log.run_batches(log.read_event_log(spark, f"{folder}/log", schema), "append", f"{folder}/ck", store.merge)
    want = {r["user_id"]: r["event_id"] for r in t.events.orderBy("ts", "event_id").collect()}
    now = {r["user_id"]: r["event_id"] for r in store.current().collect()}
    assert now == want and len(half) <= len(now)
    store.merge(second, 1)
    store.merge(second, 1)
    assert {r["user_id"]: r["event_id"] for r in store.current().collect()} == want
    compacted = store.compact(f"{folder}/compacted")
    assert {r["user_id"]: r["event_id"] for r in compacted.current().collect()} == want


def test_state_survives_a_restart(spark, t):
    folder = scratch_path(spark, "state")
    result = log.VersionedResult(spark, f"{folder}/result")
    for part in (0, 1):
        jsonl.write_jsonl(t.events.filter(F.col("event_id") % 2 == part), f"{folder}/log", append=part == 1)
        stream = log.read_event_log(spark, f"{folder}/log", t.events.schema)
        counts = log.failure_counts(stream, F.lit("scan"), F.col("event_type"))
        log.run_batches(counts, "complete", f"{folder}/ck", result.write)
    got = {r["code"]: r["n"] for r in result.current().collect()}
    assert got == {r["event_type"]: r["count"] for r in t.events.groupBy("event_type").count().collect()}


def test_jsonl_keeps_bad_lines(spark):
    path = scratch_path(spark, "bad")
    spark.createDataFrame([('{"a": 1}',), ("not json",), ('{"a": "x"}',)], "value string").write.text(path)
    from pyspark.sql import types as T

    rows = jsonl.read_jsonl(spark, path, T.StructType([T.StructField("a", T.LongType())]))
    assert {(r["a"], r[jsonl.CORRUPT]) for r in rows.collect()} == {(1, None), (None, "not json"), (None, '{"a": "x"}')}


def test_statements_from_hand_written_mappers(spark):
    path = scratch_path(spark, "mappers")
    text = """<?xml version="1.0"?>
<mapper namespace="demo.user">
  <sql id="cols">id, name</sql>
  <select id="one" resultType="map">
    SELECT <include refid="cols" /> FROM users <where><if test="a != null">AND a = #{a}</if></where>
  </select>
  <update id="two">UPDATE users SET a = 1</update>
</mapper>
"""
    other = '<mapper namespace="demo.order"><delete id="three">DELETE FROM t</delete></mapper>'
    spark.createDataFrame([(text,), (other,)], "value string").coalesce(1).write.text(path)
    got = {(r["namespace"], r["statement_id"], r["statement_type"]): r["body"] for r in markup.read_statements(spark, path).collect()}
    assert set(got) == {("demo.user", "one", "select"), ("demo.user", "two", "update"), ("demo.order", "three", "delete")}
    assert got["demo.user", "one", "select"].startswith("SELECT <include") and "#{a}" in got["demo.user", "one", "select"]


def test_contract(spark):
    rows = [(1, "A", '{"k": 1}'), (None, "A", "{}"), (2, "Z", '{"x": 1}'), (3, None, "oops")]
    df = spark.createDataFrame(rows, "id bigint, s string, j string")
    contract = contracts.Contract(required=["id"], enums={"s": ["A"]}, json_keys={"j": ["k"]})
    valid, broken = contracts.split_by_contract(df, contract)
    assert [r["id"] for r in valid.collect()] == [1]
    codes = {r["id"]: r["violations"] for r in broken.collect()}
    assert codes == {None: ["MISSING:id"], 2: ["ENUM:s", "UNEXPECTED:j"], 3: ["NOT_JSON:j"]}


def test_metadata(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (2, "b")], "a bigint, b string")
    got = {r["column_name"]: (r["n_rows"], r["n_null"], r["n_distinct"]) for r in catalog.table_metadata("x", df, "approx").collect()}
    assert got == {"a": (3, 0, 2), "b": (3, 1, 2)}


def test_filters(spark, t):
    o = t.orders
    given = filters.optional_filter(o, [("", F.lit(False)), (None, F.lit(False)), ("x", F.col("o_orderkey") < 10)])
    assert given.count() == 10
    chosen = filters.choose_filter(o, [("", F.lit(False)), ("x", F.col("o_orderkey") < 3), ("y", F.lit(False))], F.lit(False))
    assert chosen.count() == 3
    assert filters.choose_filter(o, [(None, F.lit(True))], F.col("o_orderkey") == 1).count() == 1
    assert filters.member_filter(o, "o_orderkey", range(5000)).count() == o.filter("o_orderkey < 5000").count()
    assert filters.holds("A", "==", "A") and filters.holds(2, "!=", "3") and not filters.holds(None, "==", "A")
    assert filters.optional_filter(o, [(filters.holds("A", "==", "B"), F.lit(False))]).count() == o.count()
    updated = filters.selective_update(o, F.col("o_orderkey") == 1, {"o_orderstatus": "X", "o_orderpriority": ""})
    assert updated.filter("o_orderstatus = 'X'").count() == 1
    assert updated.filter("o_orderpriority = ''").count() == 0


def test_audits(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (9,)], "a bigint")
    right = spark.createDataFrame([(1,), (2,), (2,)], "b bigint")
    row = audits.join_elimination(left, "a", right, "b").collect()[0]
    assert (row["n_duplicated_right_keys"], row["n_orphan_rows"], row["left_join_removable"]) == (1, 1, False)
    fan = audits.join_fanout(left, "a", right, "b").collect()[0]
    assert (fan["n_semi"], fan["n_join"], fan["max_fanout"], fan["safe"]) == (3, 4, 2, False)
    assert audits.join_fanout(left, "a", right.distinct(), "b").collect()[0]["safe"]
    keys = audits.key_uniqueness(left, ["a"]).collect()[0]
    assert (keys["n_rows"], keys["n_keys"], keys["max_copies"], keys["is_unique"]) == (4, 3, 2, False)


def test_ordinals_are_not_constants():
    assert len(non_constant_order([None, "x", "a", 2], ["a", "b"])) == 2


def test_consensus_ladder(spark):
    base = dict(status="PASS", gate="PASS", family="F", surface="S", ops="O", candidate="c", supported=True, status_reason=None, gate_reason=None)
    cases = {
        "agreed": [{}, {}],
        "shape": [{"supported": False}],
        "status": [{}, {"status": "FAIL", "status_reason": "LATER"}, {"status": "PENDING", "status_reason": "LAST"}],
        "gate": [{"gate": "UNCERTAIN"}, {"gate": "BLOCKED", "gate_reason": "G"}],
        "none": [{"family": None, "candidate": None}],
        "strategy": [{"family": None}],
        "families": [{}, {"family": "G"}],
        "surfaces": [{}, {"surface": "T"}],
        "ops": [{"ops": None}, {"ops": "P"}, {}],
        "one_surface": [{"surface": None}, {}],
        "nothing": [{"status": None, "gate": None, "supported": None}, {}],
        "blank": [{"family": " ", "surface": "", "ops": " "}, {}],
    }
    rows = [(k, i, *(base | change).values()) for k, changes in cases.items() for i, change in enumerate(changes)]
    schema = "k string, pos int, status string, gate string, family string, surface string, ops string, candidate string, supported boolean, status_reason string, gate_reason string"
    got = {r["k"]: r for r in cons.consensus(spark.createDataFrame(rows, schema), "k", ["pos"]).collect()}
    assert {k: r["conflict_reason"] for k, r in got.items()} == {
        "agreed": None,
        "shape": "SHAPE_FAMILY_NOT_TARGET",
        "status": "LATER",
        "gate": "G",
        "none": "NO_PATCHABLE_CANDIDATE_SELECTED",
        "strategy": "NO_PATCHABLE_CANDIDATE_UNSUPPORTED_STRATEGY",
        "families": "PATCH_FAMILY_CONFLICT_OR_MISSING",
        "surfaces": "PATCH_SURFACE_CONFLICT",
        "ops": "REWRITE_OPS_CONFLICT",
        "one_surface": None,
        "nothing": "SHAPE_FAMILY_NOT_TARGET",
        "blank": None,
    }
    for r in got.values():
        assert r["n_pass"] + r["n_partial"] + r["n_fail"] == r["n_variants"]
        assert r["n_gate_pass"] + r["n_gate_blocked"] + r["n_gate_uncertain"] == r["n_variants"]
    assert (got["nothing"]["n_partial"], got["nothing"]["n_gate_uncertain"]) == (1, 1)
    assert (got["one_surface"]["surface"], got["agreed"]["decision"]) == ("S", "AUTO_PATCHABLE")
    assert (got["status"]["n_pass"], got["status"]["n_partial"], got["status"]["n_fail"]) == (1, 1, 1)


def test_elements_and_includes_of_a_mapper_file(spark, tmp_path):
    text = """<?xml version="1.0"?><mapper
      namespace = 'shop.a'><!-- two fragments -->
    <sql id="cols">id, <include refid="more"/></sql><sql id='more'>x</sql>
    <select resultType="int" id="q"> SELECT <include refid="cols"/>, <include
       refid='other.far'></include> FROM t WHERE a &lt; 1 </select>
    <update id="u">UPDATE t SET a = 1</select></update>
    <insert id="empty"></insert><delete id="d">DELETE FROM t</delete></mapper>
    <mapper namespace="shop.b"><select id="q">SELECT 1</select></mapper>"""
    (tmp_path / "m.xml").write_text(text)
    rows = markup.read_elements(spark, str(tmp_path))
    got = {(r["namespace"], r["element_id"], r["element"]) for r in rows.collect()}
    assert got == {("shop.a", "cols", "sql"), ("shop.a", "more", "sql"), ("shop.a", "q", "select"), ("shop.a", "u", "update"),
                   ("shop.a", "empty", "insert"), ("shop.a", "d", "delete"), ("shop.b", "q", "select")}
    assert rows.filter("element_id = 'u'").collect()[0]["body"] == "UPDATE t SET a = 1</select>"
    edges = {(r["fragment"], r["ref"]) for r in markup.include_edges(rows).collect() if r["ref"]}
    assert edges == {("shop.a.cols", "shop.a.more"), ("shop.a.q", "shop.a.cols"), ("shop.a.q", "other.far")}
    assert markup.read_statements(spark, str(tmp_path)).count() == 5

def test_winners_with_null_keys(spark):
    rows = [(None, "a", "PASS"), (None, "b", "FAIL"), (1, "a", None), (1, None, "PASS"), (2, "a", "PASS"), (2, "b", "PASS")]
    df = spark.createDataFrame(rows, "s long, v string, status string")
    got = {(r["s"], r["v"], r["status"]): (r["n_pass"], r["gate_code"] is None) for r in cons.clear_winners(df, "s", "v").collect()}
    assert len(got) == len(rows)
    assert got[None, "a", "PASS"] == (1, True) and got[None, "b", "FAIL"] == (1, False)
    assert got[1, "a", None] == (1, False) and got[2, "a", "PASS"] == (2, False)


def test_null_right_keys_do_not_block_an_elimination(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([(1,), (2,), (None,), (None,)], "r long")
    row = audits.join_elimination(left, "k", right, "r").collect()[0]
    assert (row["left_join_removable"], row["inner_join_removable"], row["n_orphan_rows"]) == (True, False, 1)


def test_an_optional_json_column_may_be_null(spark):
    contract = contracts.Contract(json_keys={"j": ["a"]})
    df = spark.createDataFrame([(None,), ("{\"a\": 1}",), ("{\"b\": 1}",), ("no",)], "j string")
    got = [r["v"] for r in df.select(contract.violations().alias("v")).collect()]
    assert got == [[], [], ["UNEXPECTED:j"], ["NOT_JSON:j"]]


def test_exact_metadata_repeats_no_row(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (1, -0.0, None), (None, float("nan"), "b")], "a int, b double, `c.d` string")
    found = catalog.table_metadata("x", df, "exact")
    got = {r["column_name"]: (r["position"], r["n_rows"], r["n_null"], r["n_distinct"]) for r in found.collect()}
    assert got == {"a": (1, 3, 1, 1), "b": (2, 3, 0, 2), "c.d": (3, 3, 1, 2)}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_consensus_sends_flags_and_no_idle_places(spark):
    columns = "key int, n int, status string, gate string, family string, surface string, ops string, candidate string, supported boolean, status_reason string, gate_reason string"
    rows = [(1, i, "PASS", "PASS", "F", "S", "o", "c" * 500, True, None, "idle") for i in range(3)]
    rows += [(2, 2, "FAIL", "PASS", "F", "S", "o", None, True, "late", None), (2, 1, "FAIL", "PASS", "F", "S", "o", None, True, "early", None)]
    rows += [(3, 1, "PASS", "PASS", "F", "S", "o", None, True, None, "open"), (3, 2, None, "BLOCKED", "F", "S", "o", None, None, None, "shut")]
    found = cons.consensus(spark.createDataFrame(rows, columns), "key", ["n"])
    got = {r["key"]: (r["n_partial"], r["n_gate_uncertain"], r["decision"], r["conflict_reason"]) for r in found.collect()}
    assert got == {1: (0, 0, "AUTO_PATCHABLE", None), 2: (0, 0, "MANUAL_REVIEW", "early"), 3: (1, 0, "MANUAL_REVIEW", "SHAPE_FAMILY_NOT_TARGET")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or(_flags" in plan and "count(candidate" not in plan


@pytest.mark.parametrize("every_root", [True, False])
def test_closure_doubles_its_reach(spark, tmp_path, every_root):
    edges = [(i, i + 1) for i in range(40)] + [(i, j) for i in range(100, 106) for j in range(106, 112)] + [(111, 100), (20, 200), (3, 9)]
    links = {}
    for a, b in edges:
        links.setdefault(a, []).append(b)
    want = {}
    for root in links if every_root else (0, 101):
        level, seen, todo = 0, {}, links[root]
        while todo:
            seen.update({n: level for n in todo})
            todo, level = {m for n in todo for m in links.get(n, ()) if m not in seen}, level + 1
        want[root] = (len(seen), max(seen.values()), root >= 100)
    roots = spark.createDataFrame([(r,) for r in want], "root bigint")
    out = reference_closure(roots, spark.createDataFrame(edges, "fragment bigint, ref bigint").coalesce(2), str(tmp_path))
    assert {r["root"]: tuple(r)[1:] for r in out.collect()} == want
    assert not every_root or len(list((tmp_path / "reached").glob("round=*"))) <= 8
