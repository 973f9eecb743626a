import itertools
import random
import zlib
from collections import Counter, defaultdict

from queryproof.llm import sharding
from queryproof.llm.queries import QUERIES
from tests.conftest import SMALL


def loads(sizes, place, shards):
    out = [0] * shards
    for s, p in zip(sizes, place, strict=True):
        out[p] += s
    return out


def test_differencing_by_hand():
    # 8 and 7 differ by 1, 6 and 5 by 1, then 4 meets the rest: sums 16 and 14
    assert sorted(loads([8, 7, 6, 5, 4], sharding.difference([8, 7, 6, 5, 4], 2), 2)) == [14, 16]
    assert sharding.difference([], 3) == [] and sharding.difference([5], 3) in ([0], [1], [2])


def test_differencing_is_close_to_the_best_and_beats_greedy():
    rng = random.Random(0)
    for _ in range(20):
        sizes = [rng.randrange(1, 60) for _ in range(9)]
        got = max(loads(sizes, sharding.difference(sizes, 2), 2))
        assert got <= min(max(loads(sizes, p, 2)) for p in itertools.product(range(2), repeat=9)) * 1.1 + 2
    sizes = [int(rng.lognormvariate(8, 1.5)) + 1 for _ in range(2000)]
    sums = loads(sizes, sharding.difference(sizes, 8), 8)
    greedy = [0] * 8
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert max(sums) - min(sums) <= max(greedy) - min(greedy)


def check(rows, got, shards=8):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str
    )
    slots, bytes_ = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [bytes_[s] for s in range(shards)]


def test_query_balances_bytes_and_keeps_groups(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op9_difference_shards"](spark, SMALL).collect()
    sums = check(rows, got)
    assert max(sums) - min(sums) <= 0.01 * sum(sums) / 8
    texts, at = dict(rows), {}
    assert all(at.setdefault(texts[r.doc_id], r.shard) == r.shard for r in got)


def test_hot_group_and_edges(spark, rows_of):
    rng = random.Random(2)
    rows = [(i, "hot text " * 30) for i in range(300)] + [(1000 + i, "x" * rng.randrange(400)) for i in range(2500)]
    rows += [(9000, None), (9001, ""), (None, "no id"), (1000, rows[300][1]), (9002, "long " * 20_000)]
    df = rows_of("doc_id long, text string, shard string", [(*r, "old") for r in rows])
    got = sharding.shard_by_bytes(df, items=64).collect()
    sums = check(rows, got)
    assert max(sums) - min(sums) <= max(300 * 271, 100_001, sum(sums) / 64)
    assert len({r.shard for r in got if r.doc_id in range(300)}) == 1
    assert len({r.shard for r in got if r.doc_id in (9000, 9001)}) == 1
    assert sharding.shard_by_bytes(df.limit(0)).collect() == []
    one = sharding.shard_by_bytes(df.filter("doc_id = 9001")).collect()
    assert [(r.size, r.slot) for r in one] == [(1, 0)]
