import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from queryproof.llm import resampling
from queryproof.llm.queries import QUERIES
from tests.conftest import SMALL

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def expected(docs, target, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    """Rows of (id, text): the contract by plain counting."""
    split = [(i, *features(t, longest)) for i, t in docs]
    s = Counter(bucket(f, buckets) for _, _, fs in split for f in fs)
    t = Counter(bucket(f, buckets) for x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, words, fs in split:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f, buckets)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(enough[: percent * len(enough) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_query_agrees_with_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_automaton_resampling"](spark, SMALL).collect()), key=str)
    assert got == expected(docs, target)
    assert any(r[4] for r in got)


def test_payloads_compose():
    rng = random.Random(2)
    for _ in range(200):
        words = ["".join(rng.choice("abcé日0") for _ in range(rng.choice([1, 2, 5, 300]))) for _ in range(rng.randrange(6))]
        carried = np.array([len(w.encode()) << 32 | zlib.crc32(w.encode()) for w in words], np.int64)
        for longest in (1, 2, 3, 4):
            want = [" ".join(words[i : i + n]).encode() for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
            assert resampling.runs(carried, longest).tolist() == [len(w) << 32 | zlib.crc32(w) for w in want]


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_words_of_odd_texts(most):
    rng = random.Random(4)
    texts = ["", " ", "...", "One", "one two ONE", "a" * 500 + " " + "b" * 199 + "-" + "b" * 200, "\x01 \x02 x\x01y", "日本 é_é Ç", "x" * 5000]
    texts += ["".join(rng.choice("aB1 .-é\n\x00") for _ in range(rng.randrange(200))) for _ in range(200)]
    found = list(resampling.word_payloads([t.encode() for t in texts], most))
    assert len(found) == len(texts)
    for t, payloads in zip(texts, found):
        want = [w.encode() for w in features(t, 1)[0]]
        assert payloads.tolist() == [len(w) << 32 | zlib.crc32(w) for w in want]


@pytest.mark.parametrize("longest, buckets", [(1, 97), (3, 100_000)])
def test_edges_of_the_input(spark, rows_of, longest, buckets):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["red", "Blue", "grün", "x1"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    docs += [(None, "red " * 30), (None, None), (7, "red " * 30), (7, "red " * 30), (200, ""), (201, "long words " * 30_000)]
    target = [("red blue " * 5,), (None,), ("",)]
    df = rows_of("doc_id long, text string, row string, n_words string, features string, bucket string", [(*d, "x", "x", "x", "x") for d in docs])
    other = rows_of("item_id long, text string", [(1, *t) for t in target])
    out = resampling.resample(df, other, longest=longest, buckets=buckets, percent=50)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == expected(docs, [t for (t,) in target], 50, 20, buckets, longest)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark, rows_of):
    docs = rows_of("doc_id long, text string", [(1, "a b c")])
    assert resampling.resample(docs.limit(0), docs).collect() == []
    got = [tuple(r) for r in resampling.resample(docs, docs.limit(0), least=1, percent=100).collect()]
    assert got == expected([(1, "a b c")], [], 100, 1)
