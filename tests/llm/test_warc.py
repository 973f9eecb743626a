import gzip
import random
from pathlib import Path

import pytest

from queryproof.llm import warc
from queryproof.llm.queries import QUERIES, SQL
from tests.check import compare, duck
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_their_sql(name, spark):
    assert compare(QUERIES[name](spark, SMALL), duck(SMALL), SQL[name]) == ""


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges_any_number_of_runs(runs):
    rng = random.Random(runs)
    made = [sorted((rng.randrange(50), r, i) for i in range(rng.randrange(0, 30))) for r in range(runs)]
    made = [[(key,) for key in run] for run in made]
    assert list(warc.LoserTree(made)) == sorted(x for run in made for x in run)


def test_url_keys():
    assert warc.url_key("http://WWW.Example.com/A?b=C") == "com,example,www)/a?b=c"
    assert warc.url_key(None) == ")/" and warc.url_key("http://[bad") == ")http://[bad"


def test_edges_of_the_input(spark, rows_of, tmp_path):
    body = "<html>" + "ä\r\n\r\nWARC/1.1\r\n" * 30
    rows = [(5, "http://b.example/1", body), (3, "http://b.example/1", body), (9, "http://a.example/", body), (7, None, "short"),
            (8, "http://a.example/x\r\nEvil: 1", "short"), (10, "http://[bad", None), (None, "http://c.example", body),
            (11, "http://c.example", ""), (3, "http://b.example/1", body), (12, "http://z.example", "long " * 100_000)]
    df = rows_of("page_id long, url string, html string, record_type string", [(*r, "old") for r in rows])
    path = str(tmp_path / "archives")
    got = warc.archived(df.repartition(3), path, records=3).orderBy("range", "position").collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    size = len(body.encode())
    want = [(5, "revisit", 3, size), (3, "response", None, size), (9, "revisit", 3, size), (7, "response", None, 5),
            (8, "response", None, 5), (10, "response", None, 0), (None, "revisit", 3, size), (11, "response", None, 0),
            (3, "response", None, size), (12, "response", None, 500_000)]
    assert kinds == sorted(want, key=str)
    assert len({r.payload_digest for r in got if r.payload_bytes == size}) == 1
    assert all(r.intact for r in got if r.record_type == "response")
    order = [(r.url_key, r.capture_date) for r in got]
    assert order == sorted(order)
    for r in got:  # the index leads to the record
        data = gzip.decompress(Path(r.file.removeprefix("file:")).read_bytes())
        record = data[r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and record.endswith(b"\r\n\r\n")
    assert warc.archived(df.limit(0), str(tmp_path / "none")).collect() == []


def test_a_frequent_url_is_spread_over_ranges(spark, tmp_path):
    rows = [(i, "http://hot.example/" if i % 3 else f"http://h{i}.example/", "x") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    warc.write_archives(pages, str(tmp_path / "w"), records=40)
    captures = warc.read_archives(spark, str(tmp_path / "w"))
    got = warc.merged_index(captures, range_rows=50).orderBy("range", "position").collect()
    assert [r.page_id for r in got] == [r.page_id for r in sorted(got, key=lambda r: (r.url_key, r.capture_date, r.page_id))]
    assert len(got) == 900 and max(sum(r.range == k for r in got) for k in range(18)) <= 60
    assert len({r.range for r in got if r.url == "http://hot.example/"}) >= 10
