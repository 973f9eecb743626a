import random
import tracemalloc
import zlib

import numpy as np

from queryproof.llm import toxicity
from queryproof.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


def prose(rng, n, extra=()):
    words = [f"w{rng.randrange(300)}" for _ in range(n)]
    for w in extra:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


def logits_by_hand(model, slots):
    terms = [i for i, s in enumerate(model.slots) if s in slots]
    pairs = sum(float(model.factor[i] @ model.factor[j]) for a, i in enumerate(terms) for j in terms[a + 1 :])
    return model.bias + sum(model.weight[i] for i in terms) + pairs


def test_scores_are_those_of_all_pairs(spark, rows_of):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(12)]
    slots = np.unique([s for w in words for s in toxicity.slots_of(w)])
    model = toxicity.Machine(slots, -0.3, rng.normal(0, 0.5, len(slots)), rng.normal(0, 0.3, (len(slots), 4)))
    texts = ["w1 w2 W3", "w4 unknown w4 w4", "", None, "  ?", " ".join(words) + " filler" * 200_000]
    df = rows_of("doc_id long, text string, score string", [(i, t, "old") for i, t in enumerate(texts)])
    out = toxicity.score(df, model)
    assert set(out.columns) == {*df.columns, "score", "predicted"}
    for r in out.collect():
        found = {s for w in toxicity.words_of(texts[r.doc_id]) for s in toxicity.slots_of(w)}
        assert np.isclose(r.score, 1 / (1 + np.exp(-logits_by_hand(model, found))))
        assert r.predicted == (r.score >= 0.3)
    assert toxicity.score(df.limit(0), model).collect() == []


def test_a_pair_is_learnt_that_no_single_word_tells():
    """Toxic is who says exactly both: an insult alone and a group alone are fine."""
    rng = random.Random(4)
    rows, slots, labels = [], [], []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        own = {s for w in [*(["insult"] if a else []), *(["group"] if b else []), f"w{rng.randrange(9)}"] for s in toxicity.slots_of(w)[:1]}
        rows += [i] * len(own)
        slots += sorted(own)
        labels.append(int(a == b))
    model = toxicity.train(np.array(rows), np.array(slots), np.array(labels), 4096, 6, 40)
    single = toxicity.train(np.array(rows), np.array(slots), np.array(labels), 4096, 0, 40)

    def right(m):
        at = np.searchsorted(m.slots, slots)
        hit = [k for k, s in zip(at, slots, strict=True) if k < len(m.slots) and m.slots[k] == s]
        where = [r for r, k, s in zip(rows, at, slots, strict=True) if k < len(m.slots) and m.slots[k] == s]
        return ((m.logits(np.array(where, int), np.array(hit, int), 1500) > 0) == np.array(labels)).mean()

    assert right(model) > 0.9 > 0.8 > right(single)


def test_held_out_accuracy_of_the_query(spark):
    got = {r.doc_id: r for r in QUERIES["op8_factorization_toxicity"](spark, MIDDLE).collect()}
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert len(got) == docs
    counts = {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 0}
    for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect():
        held_out = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert got[r.doc_id].held_out == held_out
        if held_out:
            counts[r.toxic, got[r.doc_id].predicted] += 1
    assert counts[0, 1] <= 3 and counts[1, 1] >= 0.5 * (counts[1, 0] + counts[1, 1])


def test_labels_held_out_null_or_missing(spark, rows_of):
    rng = random.Random(1)
    docs = rows_of("doc_id long, text string", [(i, prose(rng, 20, ["vile"] * (i % 5 == 0))) for i in range(300)] + [(None, "vile"), (900, None)])
    labels = rows_of("doc_id long, toxic int", [(i, int(i % 5 == 0)) for i in range(250)] + [(None, 1), (3, None), (4, 0), (5, 0)])
    used = {r.doc_id: r.toxic for r in toxicity.training_sample(docs, labels, 1000).collect()}
    assert used == {i: int(i % 5 == 0) for i in range(250) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert toxicity.training_sample(docs, labels, 10).count() == 10
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all(r.predicted == int("vile" in (r.text or "")) for r in got)
    flipped = toxicity.fit(docs, labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic"))
    assert np.array_equal(flipped.weight, model.weight) and flipped.bias == model.bias
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}


def test_a_pair_gets_through_the_real_selection(spark, rows_of):
    rng = random.Random(4)
    rows = []
    for i in range(2500):
        extra = [w for w, there in (("insult", i & 1), ("group", i & 2)) if there]
        rows.append((i, prose(rng, 6, extra), int(len(extra) != 1)))
    assert {toxicity.slots_of(w)[0] for w in ("insult", "group")} <= set(
        toxicity.fit(
            rows_of("doc_id long, text string", [r[:2] for r in rows]), rows_of("doc_id long, toxic int", [(r[0], r[2]) for r in rows])
        ).slots.tolist()
    )
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels), 0.5).filter(toxicity.HELD_OUT).collect()
    assert sum(r.predicted == rows[r.doc_id][2] for r in got) > 0.9 * len(got) > 500


def test_repeated_ids_are_learnt_from_once(spark, rows_of):
    rng = random.Random(6)
    docs = [(i, prose(rng, 20, ["vile"] * (i % 4 == 0))) for i in range(200)]
    labels = rows_of("doc_id long, toxic int", [(i, int(i % 4 == 0)) for i in range(200)])
    once = toxicity.fit(rows_of("doc_id long, text string", docs), labels)
    often = toxicity.fit(rows_of("doc_id long, text string", docs + [docs[8]] * 300 + [docs[9]] * 300).repartition(7), labels)
    assert np.array_equal(once.slots, often.slots) and np.allclose(once.weight, often.weight)


def test_training_holds_little_beside_its_sample():
    """Counting and choosing slots works on blocks of entries; all at once took over three times the sample."""
    rng = np.random.default_rng(2)
    count, each = 1000, 4000
    slots = np.concatenate([np.sort(rng.choice(20_000, each, replace=False)).astype(np.int32) for _ in range(count)])
    rows = np.repeat(np.arange(count, dtype=np.int32), each)
    labels = (np.bincount(rows[slots < 40], minlength=count) > 8).astype(int)
    tracemalloc.start()
    model = toxicity.train(rows, slots, labels, 64, 2, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.slots) and peak < 1.5 * (rows.nbytes + slots.nbytes)
