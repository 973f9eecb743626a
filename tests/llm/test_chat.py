import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from queryproof.llm import chat
from queryproof.llm.queries import QUERIES
from tests.conftest import SMALL

ODD = [
    "", "plain", "<|im_end|>", "<|", "<\\|", "<\\\\|im_start|>", "<<|", "|<|>", "<\\", "\\|", "a<\\|b<|c", "<|endoftext|>", "é\x00 \n\r ", "日本👍🏽",
    chat.HOSTILE, "<" * 50 + "\\" * 50 + "|", "x" * 5000, " \t" * 3000,
]


@pytest.fixture(scope="module")
def code():
    return chat.Template(chat.byte_vocabulary())


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["<", "\\", "|", "im_end", ">", "a"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t
        assert "<|" not in chat.escape(t)
    assert len({chat.escape(t) for t in set(texts)}) == len(set(texts))


def test_turns_round_trip(code):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for role in ("user", "assistant", "<|im_sep|>\n", ""):
        for text, ids in zip(ODD, code.turns([role] * len(ODD), ODD), strict=True):
            ((r, t),) = code.read(ids)
            assert (chat.unescape(r), chat.unescape(t)) == (role, text)
            want = library.encode(chat.escape(text), add_special_tokens=False).ids
            assert ids[len(ids) - 1 - len(want) : -1].tolist() == want
            assert (ids >= code.start).sum() == 3
            assert code.render(ids) == f"<|im_start|>{chat.escape(role)}<|im_sep|>{chat.escape(text)}<|im_end|>"


def test_mask_is_a_prefix_sum_of_marks(code):
    turns = list(code.turns(["user", "assistant", "assistant", "tool"], ["q", "", "answer <|im_end|>", "t"]))
    ids = np.concatenate(turns)
    before = np.cumsum([0, *map(len, turns)])
    starts = [int(before[i]) + turns[i].tolist().index(code.separator) for i in (1, 2)]
    mask = code.learnt(ids, np.array(starts))
    assert chat.unescape(code.decode(ids[mask])) == "answer <|im_end|>"


def expected(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    found = {}
    for conv, turns in out.items():
        turns.sort()
        text = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        chars = sum(len(f"<|im_start|>{chat.escape(r)}<|im_sep|>{chat.escape(t)}<|im_end|>") for *_, r, t in turns)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (text, loss)]
        found[conv] = (len(turns), digest[0], len(loss), digest[1], chars)
    return found


def test_query_agrees_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_token_chat"](spark, SMALL).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("most", [1 << 16, 40])
@pytest.mark.parametrize("partitions", ["1", "5"])
def test_edges_and_long_conversations(spark, rows_of, most, partitions):
    rows = [(i % 3, i // 3, ["user", "assistant", None, "<|im_start|>"][i % 4], t) for i, t in enumerate([*ODD, None, None])]
    rows += [(None, None, "assistant", "n"), (None, 1, "assistant", None)] + [(9, 1, "assistant", f"again {i % 2}") for i in range(60)]
    rows += [(20 + i, 0, "user", "alone") for i in range(20)]
    df = rows_of("conv_id long, turn long, role string, text string, part string, conv string, ids string", [(*r, "x", "x", "x") for r in rows])
    vocabulary = chat.byte_vocabulary()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = chat.format_conversations(df, vocabulary, most=most)
        got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(pieces, vocabulary).collect()}
        kept = pieces.collect()
        text = chat.rendered(pieces, vocabulary).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected(rows)
    assert all(len(p.ids) == len(p.loss_mask) for p in kept)
    counts = defaultdict(int)
    for p in kept:
        counts[p.conv] += 1
    assert all(counts[p.conv] == 1 for p in kept if p.whole)
    assert sum(len(r.formatted) for r in text) == sum(v[4] for v in got.values())
    assert most > 40 or max(counts.values()) > 1


def test_empty_table(spark, rows_of):
    df = rows_of("conv_id long, turn long, role string, text string", [(1, 1, "user", "a")]).limit(0)
    vocabulary = chat.byte_vocabulary()
    assert chat.read_back(chat.format_conversations(df, vocabulary), vocabulary).collect() == []
    (row,) = chat.read_back(chat.format_conversations(chat.with_hostile(df), vocabulary), vocabulary).collect()
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-1, 2, len(chat.HOSTILE))
