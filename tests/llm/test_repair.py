import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import pytest

from queryproof.llm import repair
from queryproof.llm.queries import QUERIES
from tests.conftest import SMALL

EMPTY = hashlib.sha256(b"").hexdigest()
BLANK = " \t\n\x0b\x0c\r"


def spoilt(rows):
    """The damage, row by row in Python."""
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        yield conv, turn, "user" if kind == 4 else role, text
        if kind == 3:
            yield conv, turn, role, text


def cheapest(rows):
    """The ASCII-least cheapest edits of rows of (role, text, fault) by plain recursion over all edits."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def take(cost, letter, i, state, inserted, line):
            rest = best(i, state, inserted)
            if rest:
                options.append((cost + rest[0], letter + rest[1], line + rest[2]))

        for role in ("user", "assistant"):
            if inserted < 3 and (state, role[0]) in moves:
                take(2, "I", i, role[0], inserted + 1, (role + ":",))
        if i < len(rows):
            role, text, fault = rows[i]
            take(3, "D", i + 1, state, 0, ())
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (state, role[:1]) in moves:
                    take(extra, "K", i + 1, role[0], 0, (f"{role}:{text}",))
                for other in ("user", "assistant"):
                    if (state, other[0]) in moves:
                        take(2 + extra, "R", i + 1, other[0], 0, (f"{other}:{text}",))
        return min(options, default=None)

    return best(0, "", 0)


def expected(rows):
    """The whole contract over rows of (conv, turn, role, text)."""
    convs = defaultdict(list)
    for row in rows:
        convs[row[0]]
    for row in spoilt(rows):
        convs[row[0]].append(row[1:])
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
            if fault:
                counts[fault] += 1
        numbers = {t for t, *_ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(tuple(faulty))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def test_walk_is_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "u"]), f"{i}", rng.choice([None, None, "truncated", "blank"])) for i in range(rng.randrange(8))]
        codes = bytes("suat".find(r[0]) + {None: 0, "truncated": 4, "blank": 8}[f] for r, _, f in rows)
        ((audit, _, cost),) = repair.walk(codes, repair.END, [repair.NOTHING], True)
        want = cheapest(tuple(rows))
        assert (cost, audit) == want[:2]


def test_blocks_join_to_the_whole():
    rng = random.Random(6)
    for _ in range(50):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 9]) for _ in range(rng.randrange(2, 60)))
        cut = rng.randrange(1, len(codes))
        ((whole, _, cost),) = repair.walk(codes, repair.END, [repair.NOTHING], True)
        middle = repair.backward(codes[cut:], repair.END)[1]
        ((left, state, first),) = repair.walk(codes[:cut], middle, [repair.NOTHING], False)
        right, _, second = repair.walk(codes[cut:], repair.END, [0, 1, 2, 3], True)[state]
        assert (left + right, first + second) == (whole, cost)


def test_query_agrees_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_checkpoint_repair"](spark, SMALL).collect()}
    assert got == want


ODD = [
    (1, None, "user", "a."), (1, 2, None, None), (1, 2, "user", "b?"), (1, 2, "user", "b?"), (1, 5, "", "x"), (1, 6, "assistant", "c\x85"),
    (None, 1, "system", "s!"), (None, 2, "assistant", "d. \n"), (None, None, "tool", "e"), (7, 3, "system", "."), (8, 0, "user", ""),
    *((9, None, "assistant", f"{i % 7}.") for i in range(30)),
]


def test_edges_of_the_input(spark, rows_of):
    df = rows_of("conv_id long, turn long, role string, text string, pos string, part string, audit string", [(*r, "x", "x", "x") for r in ODD])
    got = {r.conv_id: tuple(r)[1:] for r in repair.damaged_and_repaired(df).collect()}
    assert got == expected(ODD)
    assert repair.damaged_and_repaired(df.limit(0)).collect() == []
    report, turns = repair.repair(df.limit(0))
    assert report.collect() == [] and turns.collect() == []


def test_all_rows_dropped(spark, rows_of):
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    (row,) = repair.damaged_and_repaired(rows_of("conv_id long, turn long, role string, text string", [(*gone, "user", "hi.")])).collect()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", EMPTY)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_one_conversation_in_many_parts(spark, rows_of, partitions):
    rng = random.Random(9)
    rows = [(5, i // 2, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", " ", f"{i}."])) for i in range(400)]
    rows += [(6, 1, "user", "again.")] * 200 + [(c, i, "user", f"{i}.") for c in range(10, 40) for i in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = rows_of("conv_id long, turn long, role string, text string", rows)
        got = {r.conv_id: tuple(r)[1:] for r in repair.damaged_and_repaired(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    small = [r for r in rows if r[0] != 5 and r[0] != 6]
    want = expected(small)
    assert {c: got[c] for c in want} == want
    for conv in (5, 6):
        turns = sorted((r for r in spoilt(rows) if r[0] == conv), key=lambda r: (r[1], r[2], r[3]))
        seen, codes = set(), []
        for _, _, role, text in turns:
            flag = 8 if not text.strip() or (role, text) in seen else 4 * (text[-1] not in ".!?")
            seen.add((role, text))
            codes.append(flag + ("sua".find(role[0]) if role[0] in "sua" else 3))
        ((audit, _, cost),) = repair.walk(bytes(codes), repair.END, [repair.NOTHING], True)
        assert got[conv][5:7] == (cost, audit)


def test_turns_follow_the_grammar(spark, rows_of):
    df = rows_of("conv_id long, turn long, role string, text string", ODD)
    _, turns = repair.repair(df)
    roles = defaultdict(str)
    for r in sorted(turns.collect(), key=lambda r: (r.pos, r.sub)):
        roles[r.conv_id] += r.role[0]
        assert r.edit in "KRI" and (r.text == "") == (r.edit == "I")
    assert all(r.removeprefix("s") == "ua" * (len(r) // 2) for r in roles.values())
