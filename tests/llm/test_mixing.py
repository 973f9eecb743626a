import re
from collections import defaultdict

import pytest

from queryproof.llm import mixing
from queryproof.llm.queries import QUERIES
from tests.conftest import SMALL


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Share what is left by weight, stop sources at three times their size, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        for s in above or open_:
            target[s] = 3.0 * sizes[s] if above else unit * weight[s]
            left -= target[s]
        open_ -= above or open_
    return target


def check(rows, got):
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += words(text)
    target, taken = brute_targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_query_meets_every_budget(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op4_mix_sources"](spark, SMALL).collect()
    check(rows, got)
    assert {r.doc_id: r.size for r in got} == {i: words(t) for i, _, t in rows}
    assert sorted(got) == sorted(QUERIES["op4_mix_sources"](spark, SMALL).collect())


def test_stopped_sources_and_edges(spark, rows_of):
    rows = [(i, "big", "w " * 50) for i in range(60)] + [(100, "c", "a b"), (101, "b", "x\x0by\xa0z"), (102, None, "q r s"),
            (103, None, None), (104, "empty", ""), (105, "Ä", " \t\n"), (None, "b", "n n"), (106, "big", "w " * 50)]
    df = rows_of("doc_id long, source string, text string, target string", [(*r, "t") for r in rows])
    got = mixing.mix(df).collect()
    check(rows, got)
    assert {r.doc_id: r.size for r in got}[101] == 2
    again = mixing.mix(df.repartition(5, "source")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).collect() == []
    assert [r.taken for r in mixing.mix(df.filter("doc_id = 104")).collect()] == [0]


def test_applied_mix_has_the_words_of_the_plan(spark, rows_of):
    rows = [(i, "abc"[i % 3], f"w{i} " * (i % 7)) for i in range(90)]
    df = rows_of("doc_id long, source string, text string", rows).withColumn("n_chars", mixing.F.length("text"))
    plan = {r.doc_id: r for r in mixing.mix(df).collect()}
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += words(r.text)
        assert r.n_chars == len(r.text) and set(r.text.split()) == {f"w{r.doc_id}"}
    assert dict(got) == {i: r.taken for i, r in plan.items() if r.taken}


def test_applied_mix_keeps_rows_without_an_id_and_repeated_ids(spark, rows_of):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "ab"[i % 2], f"w{i} " * (1 + i % 7)) for i in range(90)]
    rows += [(None, "a", "same words here")] * 5 + [(8, "b", "same words here")] * 5
    df = rows_of("doc_id long, source string, text string", rows)
    plan, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(df).collect():
        plan[r.source, r.doc_id] += r.taken
    for r in mixing.apply_mix(df).collect():
        got[r.source, r.doc_id] += words(r.text)
    assert plan["a", None] and dict(got) == {i: n for i, n in plan.items() if n}


def test_the_cut_keeps_the_layout(spark, rows_of):
    text = "\n# Title\n\n  a  b\tc\n" * 20
    df = rows_of("doc_id long, source string, text string", [(1, "a", text), (2, "b", text[::-1])])
    texts = {1: text, 2: text[::-1]}
    got = mixing.apply_mix(df).collect()
    assert any(r.text != texts[r.doc_id] for r in got) and all(texts[r.doc_id].startswith(r.text) for r in got)
