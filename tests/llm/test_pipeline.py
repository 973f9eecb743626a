import re

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_minhash import brute_classes

MIDDLE = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_every_stage_does_its_part(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, MIDDLE).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or name == "bpe"
        held[name] = docs.collect()
    assert list(held) == ["toxicity", "near_copies", "personal_data", "mix", "bpe"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id: r.text for r in held["toxicity"]}
    assert len(toxic & set(clean)) < 0.3 * len(toxic) and len(clean) > 900
    assert {r.doc_id for r in held["near_copies"]} == set(brute_classes(clean).values())
    assert [r.doc_id for r in held["personal_data"]] and len(held["personal_data"]) == len(held["near_copies"])
    size = {r.doc_id: len(words(r.text)) for r in held["personal_data"]}
    mixed = {}
    for r in held["mix"]:
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(words(r.text))
    assert all(n <= 3 * size[i] for i, n in mixed.items())
    assert abs(sum(mixed.values()) - sum(size.values())) <= 20
    assert len(held["bpe"]) == len(held["mix"]) and all(len(r.ids) > 0 for r in held["bpe"])


def test_registered(spark):
    assert "pipeline" in entry.queries()
    assert {int(n[2:].split("_")[0]) for n in entry.queries() if re.match(r"op\d+_", n)} == set(range(1, 14))


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls, repeated ids, an empty table and columns that stages use themselves."""
    prose = ["the quick brown fox jumps over the lazy dog near the river bank today"] * 2 + ["completely other words stand here in this long enough line of text"]
    rows = [(i, t, "s", 1.5, 7, "kept", "dot") for i, t in enumerate(prose)]
    rows += [(1, "the second text under this id has its own ten words in it", None, None, 8, "kept", "dot"), (None, prose[0], "s", 0.0, 1, "kept", "dot"),
             (5, None, None, None, None, None, None), (5, None, None, None, None, None, None), (6, "", "t", 1.0, 2, "kept", "dot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, predicted int, toxic_score string, `a.b` string")
    for some in (docs, docs.limit(0)):
        stage_docs = some
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, stage_docs, MIDDLE).write.parquet(str(tmp_path / f"{name}-{some is docs}"))
            stage_docs = spark.read.parquet(str(tmp_path / f"{name}-{some is docs}"))
            got = stage_docs.collect()
            assert set(docs.columns) <= set(stage_docs.columns)
            assert all(r.toxic_score in ("kept", None) and (r.predicted or 0) in (0, 1, 2, 7, 8) for r in got)
            if name in ("near_copies", "personal_data") and some is docs:
                texts = [(r.doc_id, r.text) for r in got]
                assert (1, rows[3][1]) in texts and (0, prose[0]) in texts and (1, prose[0]) not in texts and (None, prose[0]) in texts
                assert texts.count((5, None)) + texts.count((6, "")) == 1
        assert some is docs or got == []
