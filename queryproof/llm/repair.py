"""Structure repair of conversations: cheapest edits by a dynamic program with square-root checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import batched, in_order, key_text, runs_of, ship, written

ship(__name__)

#: White space of the contract, as inside a character class, and the marks that may end a text.
BLANK = r"\x20\x09-\x0D"
SHOWN, CUT, DOUBLE = f"[^{BLANK}]", f"[^{BLANK}.!?][{BLANK}]*$", r"[.!?]"

# What has been said so far: nothing, the system turn, a user turn, an assistant turn. A conversation may
# end where no user turn waits for its answer and the system turn does not stand alone.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or rewritten turn, for each state; it is a user turn, but an answer after one.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a turn kept as it is, by state and class (s, u, a, other); None where it does not fit.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
ROLES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REWRITE, TRUNCATED = 3, 2, 2, 1

Costs = tuple[float, float, float, float]


def with_inserts(costs: list[float]) -> list[float]:
    """Costs to go of the states if turns may be inserted first; three in a row are enough to reach any."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[n]) for c, n in zip(costs, NEXT)]
    return costs


#: Costs at the end of a conversation.
END: Costs = tuple(with_inserts([0, inf, inf, 0]))


@cache
def before(after: Costs, code: int) -> tuple[float, Costs]:
    """Costs to go before a row, from those after it, as ``(least, costs above the least)``.

    ``code`` is the row's class, plus 4 if it is truncated or 8 if it must go. As only differences are
    kept, few vectors ever occur, and each is worked out once.
    """
    costs = []
    for state, cost in enumerate(after):
        options = [DELETE + cost]
        if code < 8:
            extra = TRUNCATED * (code >= 4)
            options.append(extra + REWRITE + after[NEXT[state]])
            if KEPT[state][code % 4] is not None:
                options.append(extra + after[KEPT[state][code % 4]])
        costs.append(min(options))
    costs = with_inserts(costs)
    least = min(costs)
    return least, tuple(c - least for c in costs)


@cache
def edits(after: Costs, code: int, state: int) -> tuple[str, int, int]:
    """The ASCII-least cheapest edits for a row from a state: their initials, the state and cost after."""
    least, costs = before(after, code)
    if costs[state] == inf:
        return "", state, 0  # no way on from here, so nobody comes by
    done, paid, extra = "", 0, TRUNCATED * (4 <= code < 8)
    while True:
        left = costs[state] + least
        if DELETE + after[state] == left:
            return done + "D", state, paid + DELETE
        if INSERT + costs[NEXT[state]] + least == left:
            done, paid, state = done + "I", paid + INSERT, NEXT[state]
            continue
        kept = KEPT[state][code % 4] if code < 8 else None
        if kept is not None and extra + after[kept] == left:
            return done + "K", kept, paid + extra
        return done + "R", NEXT[state], paid + extra + REWRITE


def backward(codes: bytes, after: Costs) -> tuple[float, Costs]:
    """Costs to go before the first of some rows, from those after the last."""
    total = 0.0
    for code in reversed(codes):
        least, after = before(after, code)
        total += least
    return total, after


def walk(codes: bytes, after: Costs, starts: list[int], ends: bool) -> list[tuple[str, int, int]]:
    """``(edits, last state, cost)`` from each start state, ``after`` being the costs behind the last row.

    Backward cost vectors are kept at every square root of the rows only. The walk forward works out those
    of one stretch at a time again, from the checkpoint behind it. ``ends``: the conversation ends here,
    so inserted turns may follow the last row.
    """
    n = len(codes)
    width = max(1, isqrt(n))
    checkpoints = {n: after}
    for start in range((n - 1) // width * width, 0, -width):
        end = min(start + width, n)
        checkpoints[start] = backward(codes[start:end], checkpoints[end])[1]
    out = [([], state, 0) for state in starts]
    for start in range(0, n, width):
        end = min(start + width, n)
        vectors = [checkpoints[end]]
        for code in reversed(codes[start + 1 : end]):
            vectors.append(before(vectors[-1], code)[1])
        for i, (done, state, paid) in enumerate(out):
            for code in codes[start:end]:
                some, state, cost = edits(vectors[end - 1 - len(done)], code, state)
                done.append(some)
                paid += cost
            out[i] = (done, state, paid)
    found = []
    for done, state, paid in out:
        while ends and after[state] > 0:
            done, state, paid = [*done, "I"], NEXT[state], paid + INSERT
        found.append(("".join(done), state, paid))
    return found


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``(conv_id, turn, role, text)`` as the test of the repair damages them.

    The CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes ``. ! ?``
    out of it, 3 repeats the row, 4 makes it a user's. Nulls in the key, the role and the text read as
    one blank. Other columns are dropped.
    """
    blank = F.lit(" ")
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), blank) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    rows = rows.select(
        "conv_id", "turn", *(F.coalesce(F.col(c), blank).alias(c) for c in ("role", "text")), (F.crc32(key.cast("binary")) % 20).alias("kind")
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", DOUBLE, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_time")).drop("_time")


def facts_of(rows: DataFrame) -> DataFrame:
    """``(conv, part, pos, turn, code, fault)`` for ordered rows; texts are reduced to their first fault."""
    digest = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    initial = F.substring("role", 1, 1)
    slim = written(
        rows.select(
            "conv", "part", "pos", "turn",
            F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("class"),
            F.col("text").rlike(SHOWN).alias("shown"),
            F.col("text").rlike(CUT).alias("cut"),
            digest.alias("digest"),
        ),
        "repair-digests",
    )
    # the first of equal rows, found by position: a row repeated any number of times meets nowhere
    firsts = slim.groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    marked = slim.join(firsts, "pos", "left")
    fault = (
        F.when(~F.col("shown"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    )
    marked = marked.withColumn("fault", fault)
    must_go = F.col("fault").isin("blank", "duplicate")
    code = F.col("class") + F.when(must_go, 8).when(F.col("fault") == "truncated", 4).otherwise(0)
    return written(marked.select("conv", "part", "pos", "turn", code.cast("int").alias("code"), "fault"), "repair-facts")


def codes_of(pieces: Iterator[pa.RecordBatch], column: int) -> bytes:
    return b"".join(bytes(p.column(column).to_pylist()) for p in pieces)


def block_costs(facts: DataFrame) -> DataFrame:
    """Costs behind each part of the conversations that lie in several parts: ``(conv, part, after)``.

    A part is a matrix: the cost from each state before it to each behind it. Matrices, a few numbers
    for each part of such a conversation, are passed from the last to the first.
    """
    spread = facts.groupBy("conv").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("conv")
    slim = facts.join(spread, "conv", "left_semi").select("conv", "part", "pos", "code")

    kinds = (pa.string(), pa.int32(), pa.list_(pa.list_(pa.float64())))
    after_kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()))

    @batched("conv part columns", kinds)
    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, part), pieces in runs_of(batches, 2):
            codes = codes_of(pieces, 3)
            columns = []
            for behind in range(4):
                total, costs = backward(codes, tuple(0.0 if s == behind else inf for s in range(4)))
                columns.append([total + c for c in costs])
            yield conv, part, columns

    @batched("conv part after", after_kinds)
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), pieces in runs_of(batches, 1):
            after: list[float] = list(END)
            for piece in pieces:
                for part, columns in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                    yield conv, part, after
                    after = with_inserts([min(after[t] + columns[t][s] for t in range(4)) for s in range(4)])
                    after = [c - min(after) for c in after]

    matrix = slim.repartition("conv", "part").sortWithinPartitions("conv", "part", "pos").mapInArrow(
        matrices, "conv string, part int, columns array<array<double>>"
    )
    back = matrix.repartition("conv").sortWithinPartitions("conv", F.desc("part"))
    return written(back.mapInArrow(chain, "conv string, part int, after array<double>"), "repair-costs")


def blocks_of(facts: DataFrame) -> DataFrame:
    """``(conv, part, start, audit, cost, illegal)``: the edits of each part of each conversation."""
    costs = block_costs(facts)
    firsts = facts.groupBy("conv").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    ends = costs.join(firsts, "conv").select("conv", "part", "after", (F.col("part") == F.col("lo")).alias("first"), (F.col("part") == F.col("hi")).alias("last"))
    placed = facts.select("conv", "part", "pos", "code").join(ends, ["conv", "part"], "left")
    placed = placed.select("conv", "part", "pos", "code", "after", "first", "last")

    strings, states, costs = pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())

    @batched("conv part audits states costs illegal head tail", (pa.string(), pa.int32(), strings, states, costs, pa.int64(), pa.int32(), pa.int32()))
    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, part), pieces in runs_of(batches, 2):
            head = next(pieces)
            after, first, last = (head.column(i)[0].as_py() for i in (4, 5, 6))
            codes = bytes(head.column(3).to_pylist()) + codes_of(pieces, 3)
            starts = [NOTHING] if first is not False else [*range(4)]
            found = walk(codes, tuple(after or END), starts, last is not False)
            kinds = bytes(c % 4 for c in codes)
            illegal = sum(pair not in LEGAL for pair in zip(kinds, kinds[1:]))
            yield conv, part, *map(list, zip(*found)), illegal, kinds[0], kinds[-1]

    @batched("conv part start audit cost illegal", (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), pieces in runs_of(batches, 1):
            state, latest = NOTHING, None
            for piece in pieces:
                for part, audits, ends, costs, illegal, head, tail in zip(*(c.to_pylist() for c in piece.columns[1:])):
                    at = state if len(audits) > 1 else 0
                    border = latest is not None and (latest, head) not in LEGAL
                    yield conv, part, state, audits[at], costs[at], illegal + border
                    state, latest = ends[at], tail

    walked = placed.repartition("conv", "part").sortWithinPartitions("conv", "part", "pos").mapInArrow(
        walks, "conv string, part int, audits array<string>, states array<int>, costs array<long>, illegal long, head int, tail int"
    )
    return written(
        walked.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(
            chain, "conv string, part int, start int, audit string, cost long, illegal long"
        ),
        "repair-blocks",
    )


#: Classes that may follow each other: system user, user assistant, assistant user.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def repaired_turns(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(conv, conv_id, pos, sub, role, text, edit)``: the turns after the edits, in order of pos and sub.

    The edits of a part come before its rows in one sorted stream, so a part is never held whole.
    """
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("conv_id", "role", "text")]
    heads = blocks.select("conv", "part", F.lit(-1).cast("long").alias("pos"), *none, "start", "audit")
    body = rows.select(
        "conv", "part", "pos", "conv_id", "role", "text", F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("audit")
    )
    schema = rows.select("conv", "conv_id", "pos", F.lit(0).alias("sub"), "role", "text", F.lit("").alias("edit")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), pieces in runs_of(batches, 2):
            state, audit, at, tail = NOTHING, "", 0, 0
            for piece in pieces:
                positions, roles, texts = (piece.column(i).to_pylist() for i in (2, 4, 5))
                picked, out = [], []
                for i, pos in enumerate(positions):
                    if pos < 0:
                        state, audit = piece.column(6)[i].as_py(), piece.column(7)[i].as_py()
                        tail = len(audit.rstrip("I"))
                        continue
                    sub = 0
                    while audit[at] == "I":
                        state = NEXT[state]
                        picked.append(i)
                        out.append((pos, sub, ROLES[state], "", "I"))
                        at, sub = at + 1, sub + 1
                    edit = audit[at]
                    at += 1
                    if edit == "R":
                        state = NEXT[state]
                        picked.append(i)
                        out.append((pos, sub, ROLES[state], texts[i], "R"))
                    elif edit == "K":
                        state = KEPT[state]["sua".find(roles[i][0])]
                        picked.append(i)
                        out.append((pos, sub, roles[i], texts[i], "K"))
                    while tail <= at < len(audit):  # turns inserted behind the last row
                        state, sub, at = NEXT[state], sub + 1, at + 1
                        picked.append(i)
                        out.append((pos, sub, ROLES[state], "", "I"))
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))]
                    ids = piece.column(3).take(pa.array(picked))
                    yield pa.RecordBatch.from_arrays([pa.array([conv] * len(out)), ids, *columns], names=schema.names)

    stream = heads.unionByName(body).repartition("conv", "part").sortWithinPartitions("conv", "part", "pos")
    return stream.mapInArrow(apply, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations of ``(conv_id, turn, role, text)``: ``(report, turns)``.

    Rows of a conversation stand in order of turn (nulls first), then role, then text, both by code point;
    rows that agree in all of these are interchangeable. The first fault of a row is blank (nothing but
    white space), duplicate (role and text occurred before in the conversation) or truncated (does not end
    in ``. ! ?``). Edits keep a row (0), rewrite its role to user or assistant (2), delete it (3; blank
    and duplicate rows must go) or insert an empty turn (2); a truncated row that stays costs 1 more. The
    cheapest edits whose role initials read ``(s?(ua)+)?`` are taken, of several the ASCII-least ``audit``.

    ``report`` has one row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit``; ``gaps`` are missing turns between the first and last, 0 where all turns are null. ``turns``
    has the repaired turns: ``conv, conv_id, pos, sub, role, text, edit``, ordered in a conversation by pos
    and sub. Null roles and texts read as one blank; null ids are one conversation; other columns are
    dropped; an empty table gives no rows. Strings must be valid UTF-8.

    Rows are sorted once by ranges of (conversation, turn, role, text), so one conversation may hold any
    share of all rows: it lies in several parts, whose cost matrices are chained. Texts are moved twice.
    """
    blank = F.lit(" ")
    rows = rows.select(
        key_text("conv_id").alias("conv"), "conv_id", "turn", *(F.coalesce(F.col(c), blank).alias(c) for c in ("role", "text"))
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = in_order(rows, order, "repair-rows")
    facts = facts_of(rows)
    blocks = blocks_of(facts)
    per_turn = facts.groupBy("conv", "turn").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in FAULTS))
    span = F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count("turn")
    stats = per_turn.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *(F.sum(f).alias(f) for f in FAULTS))
    edited = blocks.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.expr("array_join(transform(array_sort(collect_list(struct(part, audit))), x -> x.audit), '')").alias("audit"),
    )
    ids = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    report = ids.join(stats, "conv").join(edited, "conv")
    return report.select("conv", "conv_id", *NUMBERS, "audit"), repaired_turns(rows, blocks)


FAULTS = ["blank", "duplicate", "truncated"]
NUMBERS = ["gaps", *FAULTS, "illegal", "cost"]


def digests(turns: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` of ``role:text`` lines, joined by newlines.

    A hash of a whole conversation can only be taken in order; turns stream past it and none is held.
    """

    @batched("conv repaired_sha256", (pa.string(), pa.string()))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), pieces in runs_of(batches, 1):
            seen, total = False, hashlib.sha256()
            for piece in pieces:
                lines = "\n".join(map("{}:{}".format, piece.column(3).to_pylist(), piece.column(4).to_pylist()))
                total.update(("\n" * seen + lines).encode())
                seen = True
            yield conv, total.hexdigest()

    stream = turns.select("conv", "pos", "sub", "role", "text").repartition("conv").sortWithinPartitions("conv", "pos", "sub")
    return stream.mapInArrow(run, "conv string, repaired_sha256 string")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation id of the undamaged rows: the report, and the hash of the repaired turns.

    A conversation without rows after the damage has zeros, an empty audit and the empty string's hash.
    """
    report, turns = repair(damage(conversations))
    everyone = conversations.select("conv_id").distinct().withColumn("conv", key_text("conv_id"))
    out = everyone.join(report.drop("conv_id"), "conv", "left").join(digests(turns), "conv", "left")
    zeros = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in NUMBERS]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
