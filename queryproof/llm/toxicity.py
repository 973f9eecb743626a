"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import map_batches, ship, with_fields, worker_memo

ship(__name__)

WORD = re.compile(r"\w+")
#: Slots of the hashed term space.
SLOTS = 1 << 20
#: How many times its own noise the log odds of a slot must be to be learnt.
LEAST_STRENGTH = 2.5
#: The same for what two slots tell together beyond the sum of both; there are many more pairs.
LEAST_PAIR = 5.0
#: Steps of training at least, so that few labels are learnt as well as many.
LEAST_STEPS, BATCH = 1000, 128
#: Entries of the sample that are worked on at a time while it is counted, which bounds what comes beside it.
ENTRIES = 1 << 20
#: Words are known by these many first letters too, so that new endings of a known stem count.
STEMS = (4, 5, 6)


def slots_of(word: str) -> list[int]:
    """Hashed slots of a lower-case word: itself and its stems."""
    terms = [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % SLOTS for t in terms]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + pairwise products of factors) over the known slots."""

    slots: np.ndarray  # sorted
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, rows: np.ndarray, terms: np.ndarray, count: int) -> np.ndarray:
        """rows, terms: pairs of row number and index of a slot, each pair once."""
        total = self.bias + np.bincount(rows, self.weight[terms], count)
        for f in range(self.factor.shape[1]):
            v = self.factor[terms, f]
            total += 0.5 * (np.bincount(rows, v, count) ** 2 - np.bincount(rows, v * v, count))
        return total


def blocks_of(size: int) -> Iterator[slice]:
    return (slice(i, i + ENTRIES) for i in range(0, size, ENTRIES))


def places_of(slots: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the slots are among the sorted terms, and the places of those."""
    at = np.searchsorted(terms, slots)
    hit = terms[np.minimum(at, len(terms) - 1)] == slots
    return hit, at[hit].astype(np.int32)


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of counts with one half added, and their squared noise."""
    return np.log((toxic + 0.5) / (clean + 0.5)), 1 / (toxic + 0.5) + 1 / (clean + 0.5)


def pair_strength(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, terms: np.ndarray, step: int = 512) -> np.ndarray:
    """For each of the terms the strongest of its pairs: how many times its noise the log odds with both
    terms differ from those that both give added up. All pairs of ``terms`` are counted, a block of
    columns at a time."""
    clean = int(len(labels) - labels.sum())
    place = np.empty(len(labels), np.int64)
    place[np.argsort(labels, kind="stable")] = np.arange(len(labels))
    there = np.zeros((len(labels), len(terms)), np.uint8)
    for block in blocks_of(len(slots)):
        hit, at = places_of(slots[block], terms)
        there[place[rows[block][hit]], at] = 1
    sides = [(clean, len(labels)), (0, clean)]  # toxic, clean
    alone = [there[a:b].sum(0, dtype=np.int64).astype(np.float32) for a, b in sides]
    best = np.zeros(len(terms), np.float32)
    for first in range(0, len(terms), step):
        some = slice(first, first + step)
        counts = []
        for (a, b), one in zip(sides, alone, strict=True):
            both = np.zeros((len(terms), len(one[some])), np.float32)
            for i in range(a, b, 2048):
                part = there[i : min(i + 2048, b)].astype(np.float32)
                both += part.T @ part[:, some]
            left, right = one[:, None] - both, one[some][None, :] - both
            counts.append((both, left, right, (b - a) - both - left - right))
        total, noise = np.float32(0), np.float32(0)
        for sign, toxic, fine in zip((1, -1, -1, 1), *counts, strict=True):
            odds, square = log_odds(toxic, fine)
            total, noise = total + sign * odds, noise + square
        strength = np.abs(total) / np.sqrt(noise)
        best[some] = np.maximum(best[some], strength.max(0))
    return best


def select_slots(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, most: int) -> np.ndarray:
    """The slots that tell most about the label, at most ``most``: by their own presence (the chi-square value
    with one half added), or by what they tell in a pair beyond both alone. Pairs are those of the ``most``
    slots that most rows have."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    size = int(slots.max(initial=-1)) + 1
    every, toxic = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for block in blocks_of(len(slots)):
        part = slots[block]
        every += np.bincount(part, minlength=size)
        toxic += np.bincount(part[labels[rows[block]] > 0], minlength=size)
    used = np.flatnonzero(every)
    with1 = toxic[used]
    with0 = every[used] - with1
    (odds, square), (rest, rest_square) = log_odds(with1, with0), log_odds(n1 - with1, n0 - with0)
    strength = np.abs(odds - rest) / np.sqrt(square + rest_square) / LEAST_STRENGTH
    frequent = np.sort(np.lexsort((used, -every[used]))[:most])
    pairs = pair_strength(rows, slots, labels, used[frequent]) / LEAST_PAIR
    strength[frequent] = np.maximum(strength[frequent], pairs)
    best = np.lexsort((used, -strength))[:most]
    return np.sort(used[best[strength[best] > 1]])


def train(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, most: int, factors: int, epochs: int) -> Machine:
    """Logistic loss, AdaGrad over shuffled mini-batches; a fixed seed and order."""
    rng = np.random.default_rng(8)
    labels = labels.astype(float)
    rate = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    known = np.zeros(0, np.int64)
    if 0 < labels.sum() < len(labels):
        known = select_slots(rows, slots, labels, most)
    model = Machine(known, float(np.log(rate / (1 - rate))), np.zeros(len(known)), rng.normal(0, 0.05, (len(known), factors)))
    if not len(known):
        return model
    kept = [(rows[block][hit], at) for block in blocks_of(len(slots)) for hit, at in [places_of(slots[block], known)]]
    rows, at = (np.concatenate(parts) for parts in zip(*kept, strict=True))
    del kept
    step = np.diff(rows)
    if not np.all((step > 0) | (step == 0) & (np.diff(at) > 0)):
        order = np.lexsort((at, rows))
        rows, at = rows[order], at[order]
    starts = np.searchsorted(rows, np.arange(len(labels) + 1, dtype=rows.dtype))
    sum_b, sum_w, sum_v = 1e-8, np.full(len(known), 1e-8), np.full((len(known), factors), 1e-8)
    for _ in range(max(epochs, LEAST_STEPS * BATCH // len(labels))):
        shuffled = rng.permutation(len(labels))
        for i in range(0, len(labels), BATCH):
            batch = shuffled[i : i + BATCH]
            sizes = starts[batch + 1] - starts[batch]
            row = np.repeat(np.arange(len(batch)), sizes)
            term = at[np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            p = 1 / (1 + np.exp(-np.clip(model.logits(row, term, len(batch)), -30, 30)))
            error = p - labels[batch]
            touched, back = np.unique(term, return_inverse=True)
            grad_w = np.bincount(back, error[row], len(touched)) + 1e-3 * model.weight[touched]
            v = model.factor[term]
            grad_v = 1e-3 * model.factor[touched]
            for f in range(factors):
                sums = np.bincount(row, v[:, f], len(batch))
                grad_v[:, f] += np.bincount(back, error[row] * (sums[row] - v[:, f]), len(touched))
            grad_b = error.sum()
            sum_b += grad_b**2
            sum_w[touched] += grad_w**2
            sum_v[touched] += grad_v**2
            model.bias -= 0.1 * grad_b / np.sqrt(sum_b)
            model.weight[touched] -= 0.2 * grad_w / np.sqrt(sum_w[touched])
            model.factor[touched] -= 0.05 * grad_v / np.sqrt(sum_v[touched])
    return model


def training_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most ``sample`` labelled ids, the lowest by a hash of the id.

    A label counts if its id is not null and crc32(id as text) mod 4 is not 2; an id that is labelled
    both ways is toxic. The ids, ``sample`` at most, are sent to every task that reads ``docs``, so no
    text is shuffled.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL AND NOT " + HELD_OUT)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    count, place = known.count(), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    if count > 2 * sample:  # leaves more than the sample, but little for each task to send
        known = known.filter(place < (3 * sample << 29) // count)
    known = known.orderBy(place, "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 16_000, most: int = 4096, factors: int = 6, epochs: int = 20
) -> Machine:
    """A machine learnt from texts and ``toxic`` only.

    At most ``sample`` labelled documents are learnt from (see ``training_sample``); of rows that share an id, one. Tasks hash their words;
    what is brought together for training is the hashed slots of the sample, never texts. The machine
    keeps the ``most`` slots that tell most about the label, alone or in a pair of the ``most`` slots that
    most rows have; pairs with rarer words that tell nothing alone are not looked for. Without both kinds of labels it knows no
    slot and every score is the rate of toxic labels.
    """

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        worker_memo("toxicity-learning", dict)  # what the worker kept of other tasks goes
        slots = [np.unique([s for w in words_of(t) for s in slots_of(w)]).astype(np.int32) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "slots": pa.array(slots, pa.list_(pa.int32()))})

    terms = map_batches(training_sample(docs, labels, sample), hashed, "doc_id long, toxic int, slots array<int>")
    # of rows that share an id one is learnt from, the same whatever their order, so that the rows are bounded too
    one = F.min(F.struct(F.xxhash64("slots").alias("h"), "slots", "toxic")).alias("one")
    terms = terms.groupBy("doc_id").agg(one).select("doc_id", "one.toxic", "one.slots")

    def learn(table: pa.Table) -> pa.Table:
        worker_memo("toxicity-learning", dict)
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        labels = table.column("toxic").to_numpy()[order]
        lists = table.column("slots").chunks
        sizes = np.concatenate([np.diff(part.offsets.to_numpy()) for part in lists])
        starts = np.empty(len(order), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        slots, at = np.empty(int(sizes.sum()), np.int32), 0
        for part in lists:
            offsets, values = part.offsets.to_numpy(), part.values.to_numpy()
            for low, high, start in zip(offsets[:-1], offsets[1:], starts[at : at + len(part)], strict=True):
                slots[start : start + high - low] = values[low:high]
            at += len(part)
        rows = np.repeat(np.arange(len(order), dtype=np.int32), sizes[order])
        m = train(rows, slots, labels, most, factors, epochs)
        found = {"slots": [m.slots.tolist()], "bias": [m.bias], "weight": [m.weight.tolist()], "factor": [m.factor.ravel().tolist()]}
        return pa.table(found, schema=learnt)

    kind = "slots array<bigint>, bias double, weight array<double>, factor array<double>"
    learnt = pa.schema([("slots", pa.list_(pa.int64())), ("bias", pa.float64()), *((c, pa.list_(pa.float64())) for c in ("weight", "factor"))])
    row = terms.groupBy().applyInArrow(learn, kind).first()
    if row is None:
        return train(np.zeros(0, int), np.zeros(0, int), np.zeros(0), most, factors, epochs)
    slots = np.array(row["slots"], np.int64)
    return Machine(slots, row["bias"], np.array(row["weight"]), np.array(row["factor"]).reshape(len(slots), factors))


def score(
    docs: DataFrame, model: Machine, threshold: float = 0.3, text: str = "text", into: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` up) to all columns of ``docs``, under the
    names ``into``.

    Whole texts are scored, each by its distinct lower-case words. Null, empty and wordless texts get
    the score of the bias. Columns of the same names are replaced. The machine, of bounded size, goes
    along with the tasks; nothing is shuffled.
    """
    names = [c for c in docs.columns if c not in into]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = with_fields(kept.schema, f"`{into[0]}` double, `{into[1]}` int")
    index = {int(s): i for i, s in enumerate(model.slots)}
    mark = f"toxicity-{zlib.crc32(model.slots.tobytes())}-{model.bias!r}"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo: dict[str, tuple[int, ...]] = worker_memo(mark, dict)
        rows, terms = [], []
        for i, t in enumerate(batch.column(names.index(text)).to_pylist()):
            found: set[int] = set()
            for w in words_of(t):
                hit = memo.get(w)
                if hit is None:
                    hit = memo[w] = tuple(index[s] for s in slots_of(w) if s in index)
                    if len(memo) > 300_000:
                        memo.clear()
                if hit:
                    found.update(hit)
            rows += [i] * len(found)
            terms += sorted(found)
        logits = model.logits(np.array(rows, np.int64), np.array(terms, np.int64), batch.num_rows)
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        columns = [batch.column(i) for i in range(len(names))]
        columns += [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [*names, *into])

    return map_batches(kept, run, schema)
