import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from queryproof.llm import trie_bpe
from queryproof.llm.queries import QUERIES, word_vocabulary
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def codec():
    return trie_bpe.Codec(word_vocabulary())


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def agree(texts, codec, library):
    for text, packed in zip(texts, codec.encode_batch(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(packed) == ids, text[:80]
        assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_odd_texts(codec, library):
    agree(
        ["", "  ", "Hello WORLD it's we'll don't", "<|startoftext|>A<|endoftext|> b<|ENDOFTEXT|> <|x", "ΑΣ ΣΑΣ İ ﬁ Å é",
         "\x1c\x1d a\x1fb᠎ c​ d\x85e\xa0f  g　", "日本語 １２３ ½ ² Ⅷ", "a" * 3000 + "!" * 999, "👍🏽👨‍👩‍👧", "\x00 �",
         "aaaaaaaaaaaaaaaaaaaaaaaa!!!!!!!!!!!!?????......", "x,, y.; z!? 'tis 'S rock'n'roll can't've"],
        codec, library,
    )


def test_random_words(codec, library):
    rng = random.Random(3)
    tokens = [t.removesuffix("</w>") for t in codec.v.ids]
    plain = [t for t in tokens if t.isascii() and t.isalpha()]
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 15))) for _ in range(4000)]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randrange(1, 5))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1000)])) for _ in range(9)) for _ in range(1000)]
    texts += ["".join(rng.choice("ab!.?-") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    agree(texts, codec, library)


def test_clearing_changes_nothing(library):
    small = trie_bpe.Codec(word_vocabulary(), most=10)
    small.trie.most = 20
    for text in ("the cat sat on the mat", "another set of words, entirely", "the cat again <|endoftext|>"):
        agree([text], small, library)


def test_a_prefix_is_computed_once(codec):
    trie = trie_bpe.WordTrie(codec.v)
    trie.add([b"prefixes"])
    nodes = len(trie.last)
    trie.add([b"prefixing", b"prefixes"])
    assert len(trie.last) == nodes + 3  # i, n, and the g that ends the word


def test_query_agrees_with_the_library(spark, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op7_trie_bpe"](spark, SMALL).collect():
        ids = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edges_of_the_input(spark, rows_of, library):
    texts = [None, "", "word", "word", "many words " * 50_000]
    df = rows_of("doc_id long, text string, decoded string", [(i, t, "old") for i, t in enumerate(texts)])
    out = trie_bpe.encode_column(df, word_vocabulary())
    assert set(out.columns) == {*df.columns, "ids", "decoded"}
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False) and got[i].text == t
    assert trie_bpe.encode_column(df.limit(0), word_vocabulary()).collect() == []
