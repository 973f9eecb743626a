import random
import re
from collections import Counter

import numpy as np
import pytest

from queryproof.llm import minhash
from queryproof.llm.components import components
from queryproof.llm.queries import QUERIES
from tests.conftest import SMALL


def shingle_set(text):
    words = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset([text or ""])


def brute_classes(texts):
    """Smallest id reachable over links of similarity 0.8 or more."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    near = {i: {i} for i in texts}
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in where[x]).items():
            if both * 10 >= 8 * (len(s) + len(sets[j]) - both):
                near[i].add(j)
    label = {i: i for i in texts}
    while True:
        new = {i: min(label[j] for j in near[i]) for i in texts}
        if new == label:
            return label
        label = new


def test_signatures_estimate_weighted_similarity():
    sets = [{1: 2.5, 2: 1.0, 3: 4.0, 4: 0.3}, {1: 1.5, 2: 3.0, 3: 4.0, 5: 2.0}, {}]
    elements = np.array([x for s in sets for x in s], np.uint64)
    weights = np.array([w for s in sets for w in s.values()])
    signs = minhash.dart_signatures(elements, weights, np.array([0, 4, 8, 8]), 6000)
    exact = (1.5 + 1 + 4) / (2.5 + 3 + 4 + 0.3 + 2)
    assert abs((signs[0] == signs[1]).mean() - exact) < 0.03
    assert (signs[2] == 0).all()


@pytest.mark.parametrize("size", [1, 7, 200, 4000])
def test_signatures_of_sets_of_any_size(size):
    rng = np.random.default_rng(size)
    pool = rng.integers(0, 2**63, size + size // 4 + 1).astype(np.uint64)
    a, b = pool[:size], pool[-size:]
    exact = len(np.intersect1d(a, b)) / len(pool)
    signs = minhash.dart_signatures(np.concatenate([a, b]), np.ones(2 * size), np.array([0, size, 2 * size]), 3000)
    assert abs((signs[0] == signs[1]).mean() - exact) < 0.04


def test_repeats_of_an_element_change_no_signature():
    a = np.array([1, 2, 3, 3, 3, 1], np.uint64)
    signs = minhash.dart_signatures(a, np.ones(6), np.array([0, 6]), 100)
    assert (signs == minhash.dart_signatures(a[:3], np.ones(3), np.array([0, 3]), 100)).all()


def test_query_agrees_with_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in QUERIES["op1_dart_minhash"](spark, SMALL).collect()}
    assert got == brute_classes(texts)


def edited(words, rng, share):
    return [f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def test_groups_of_edited_copies(spark, rows_of):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = {i: " ".join(edited(base, rng, rng.choice([0, 0.01, 0.02, 0.04]))) for i in range(120)}
    texts |= {1000 + i: " ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for i in range(20)}
    # a chain: only neighbours are similar enough
    chain = [f"c{i}" for i in range(200)]
    texts |= {2000 + i: " ".join(chain[8 * i : 8 * i + 100]) for i in range(8)}
    df = rows_of("doc_id long, text string", list(texts.items()))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == brute_classes(texts)
    kept = {r.doc_id for r in minhash.first_of_class(df).collect()}
    assert kept == set(got.values())


def test_edges_of_the_input(spark, rows_of):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "  "), (4, "One two"), (5, "one TWO"), (6, "one"), (7, long), (8, long + " more"),
            (9, "?!"), (10, "?!"), (11, "one two"), (11, "one two"), (None, "one two")]
    df = rows_of("doc_id long, text string", rows)
    out = minhash.near_duplicates(df)
    assert out.columns == ["doc_id", "class_id", "class_size", "links"]
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in out.collect()), key=str)
    want = [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 3), (5, 4, 3), (6, 6, 1), (7, 7, 2), (8, 7, 2), (9, 9, 2),
            (10, 9, 2), (11, 4, 3), (11, 4, 3), (None, None, 1)]
    assert got == sorted(want, key=str)
    kept = minhash.first_of_class(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 6, 7, 9, None]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_counted_weights(spark, rows_of):
    a = "a b c d e " * 10
    rows = [(1, a), (2, "a b c d e " * 40)]
    df = rows_of("doc_id long, text string", rows)
    assert {r.class_id for r in minhash.near_duplicates(df).collect()} == {1}
    assert {r.class_id for r in minhash.near_duplicates(df, weighting="count").collect()} == {1, 2}


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200, 205), (205, 205)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 205: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
