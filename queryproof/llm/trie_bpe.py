"""BPE encoding and decoding by a trie of words whose nodes keep the last token of their prefix."""

from __future__ import annotations

import array
import hashlib
import json
import sys
import unicodedata
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import map_batches, ship, with_fields, worker_memo

ship(__name__)

SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


#: White space to Python's split that is none here.
ODD = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, if it is visible, or one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b if b in visible else extra))
        extra += b not in visible
    return letters


class Vocabulary:
    """Tokens, merges and word pattern of a vocabulary file with word ends."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.ids, **self.special}.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # Tokens by rank: single letters first (-1), then merges in order; parts[r] are the ranks of a merge's two halves.
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        letters = [t for t in sorted(self.ids, key=self.ids.get) if t not in made and t not in self.special]
        self.rank = {t: i for i, t in enumerate(letters)}
        self.singles = len(letters)
        self.parts = [(i, i) for i in range(self.singles)]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            r = len(self.parts)
            self.rank.setdefault(a + b, r)
            self.parts.append((self.rank[a], self.rank[b]))
            self.pair.setdefault((self.rank[a], self.rank[b]), r)
        self.token = [-1] * len(self.parts)
        for t, r in self.rank.items():
            self.token[r] = self.ids[t]
        # the bytes of each token that BPE can give, by whether it ends a word
        self.known_whole: dict[int, bool] = {}
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for t, r in self.rank.items():
            ends = bool(self.suffix) and t.endswith(self.suffix)
            if self.whole(r):
                (self.final if ends else self.inner)[bytes(byte[c] for c in (t[: -len(self.suffix)] if ends else t))] = r
        if not self.suffix:
            self.final = self.inner
        self.longest = max(map(len, [*self.inner, *self.final]))


    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart: undo their merges, latest first, and see whether a
        pair across the border would have been merged before."""
        pair, parts, singles = self.pair, self.parts, self.singles
        limit = len(parts) + 1
        while True:
            across = pair.get((left, right))
            if across is not None and across < limit:
                return False
            if left < singles and right < singles:
                return True
            if left > right:
                limit, left = left, parts[left][1]
            else:  # of the same rank, what stands further left was merged first
                limit, right = right + 1, parts[right][0]

    def whole(self, token: int) -> bool:
        """Whether BPE of a token's own letters gives the token back."""
        if token < self.singles:
            return True
        known = self.known_whole.get(token)
        if known is None:
            a, b = self.parts[token]
            # apart from the last step, the halves must come about side by side
            known = self.pair.get((a, b)) == token and self.whole(a) and self.whole(b) and self.beside(a, b, token)
            self.known_whole[token] = known
        return known

    def beside(self, left: int, right: int, limit: int) -> bool:
        pair, parts, singles = self.pair, self.parts, self.singles
        while left >= singles or right >= singles:
            if left > right:
                limit, left = left, parts[left][1]
            else:
                limit, right = right + 1, parts[right][0]
            across = pair.get((left, right))
            if across is not None and across < limit:
                return False
        return True


class WordTrie:
    """Encodings of words with shared prefixes computed once.

    Each node is a prefix and keeps the last token of the prefix's encoding and the node where that token
    starts. A node's last token is the one suffix token that stays whole beside the last token of the
    node it starts from: BPE of the two together must not merge across their border.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 600_000):
        self.v = vocabulary
        self.most = most
        self.fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last = array.array("i", [0])
        self.start = array.array("i", [0])
        self.span = array.array("i", [0])  # bytes of the last token

    def add(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The token ids of each word. Words are inserted in order, which visits new nodes depth first:
        a word goes on from the prefix that it shares with the one before."""
        if len(self.last) > self.most:
            self.clear()
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        child, last, start, span = self.child, self.last, self.start, self.span
        token, longest = self.v.token, self.v.longest
        out: dict[bytes, list[int]] = {}
        before, path = b"", [0]
        for word in sorted(words):
            size = len(word)
            shared = 0
            for x, y in zip(word[:-1], before[:-1]):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            node = path[shared]
            tokens, mark = self.v.inner, 0
            for depth in range(shared + 1, size + 1):
                if depth == size:
                    tokens, mark = self.v.final, 256
                key = node << 9 | mark | word[depth - 1]
                parent = node
                node = child.get(key)
                if node is None:
                    node = child[key] = len(last)
                    # first the last token of the prefix made longer, then a token of one byte, then all
                    begin = depth - 1 - span[parent]
                    t = tokens.get(word[begin:depth])
                    origin = path[begin]
                    if t is None or origin and not self.fit(last[origin], t):
                        begin = depth - 1
                        t = tokens[word[begin:]] if mark else tokens[word[begin:depth]]
                        origin = parent
                        if origin and not self.fit(last[origin], t):
                            for begin in range(max(0, depth - longest), depth - 1):
                                t = tokens.get(word[begin:depth])
                                if t is not None:
                                    origin = path[begin]
                                    if not origin or self.fit(last[origin], t):
                                        break
                    last.append(t)
                    start.append(origin)
                    span.append(depth - begin)
                path.append(node)
            before = word
            ids = [token[last[node]]]
            node = start[node]
            while node:
                ids.append(token[last[node]])
                node = start[node]
            ids.reverse()
            out[word] = ids
        return out

    def fit(self, left: int, right: int) -> bool:
        pair = left << 17 | right
        known = self.fits.get(pair)
        if known is None:
            known = self.fits[pair] = self.v.compatible(left, right)
        return known


class Codec:
    """Encodes and decodes whole texts; keeps what it learnt about pieces between texts."""

    #: After a run of letters one of these is a word of its own.
    ends = frozenset(",.;:!?")

    def __init__(self, text: str, most: int = 400_000):
        self.v = Vocabulary(text)
        self.trie = WordTrie(self.v)
        self.most = most
        self.pieces: dict[str, bytes] = {}
        self.names = [self.v.names.get(i, "") for i in range(max(self.v.names) + 1)]
        self.clear()

    def clear(self) -> None:
        # a special token's key holds a blank, which no other piece does
        self.pieces = {f" {t}": pack([i]) for t, i in self.v.special.items()}

    def normal(self, text: str) -> list[str]:
        """The pieces between white space of the composed, lower-case text."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # letter by letter where a rule for the end of words would apply
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        return [p for p in SPACE.split(text) if p] if ODD.search(text) else text.split()

    def split(self, text: str) -> list[str]:
        if "<|" not in text or not self.v.special_split:
            return self.normal(text)
        out: list[str] = []
        for part in self.v.special_split.split(text):
            out += [f" {part}"] if part in self.v.special else self.normal(part)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode distinct new pieces together, so that the trie shares their prefixes."""
        known = self.pieces
        plain, ended, mixed = [], [], {}
        for p in pieces:
            if p.isalpha():
                plain.append(p)
            elif p[-1] in self.ends and p[:-1].isalpha():
                ended.append(p)
            else:
                mixed[p] = self.v.word.findall(p)
        wanted = {*plain, *(w for ws in mixed.values() for w in ws), *(w for p in ended for w in (p[:-1], p[-1]))}
        spelt = {w: w.encode("utf-8", "surrogatepass") for w in wanted if w not in known}
        ids = self.trie.add(spelt.values())
        for w, letters in spelt.items():
            known[w] = pack(ids[letters])
        for p in ended:
            known[p] = known[p[:-1]] + known[p[-1]]
        for p, ws in mixed.items():
            known[p] = b"".join([known[w] for w in ws])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.pieces) > self.most:
            self.clear()
        new = {p for s in split for p in s} - self.pieces.keys()
        if new:
            self.learn(new)
        known = self.pieces.__getitem__
        return [b"".join(map(known, s)) for s in split]

    def decode(self, packed: bytes) -> str:
        """The tokens' names, joined by blanks, as the file names no decoder."""
        ids = array.array("I", packed)
        if sys.byteorder == "big":
            ids.byteswap()
        return " ".join(map(self.names.__getitem__, ids))


def pack(ids: list[int]) -> bytes:
    packed = array.array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def slices(texts: list[str], most: int = 2_000_000) -> Iterable[list[str]]:
    """Texts in runs of about ``most`` characters, to bound what is held at once."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_column(docs: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` to all columns of ``docs``.

    ``vocabulary`` is the text of a tokenizer file with word ends. Whole texts are encoded without added
    tokens; a null text counts as the empty one and gives no ids and an empty decoding. Tasks encode the
    distinct words of a batch together; each Python worker keeps its trie and word table, cleared beyond
    a fixed number of entries, which changes no result. Nothing is shuffled. Columns named ``ids`` or
    ``decoded`` are replaced.
    """
    return _coded(docs, vocabulary, column, False)


def digest_column(docs: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """Like ``encode_column``, but adds ``n_tokens, ids_sha256, decoded_sha256`` instead of the values."""
    return _coded(docs, vocabulary, column, True)


def _coded(docs: DataFrame, vocabulary: str, column: str, digests: bool) -> DataFrame:
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digests else {"ids": "array<int>", "decoded": "string"}
    names = [c for c in docs.columns if c not in added]
    kept = [c for c in names if c != column or not digests]
    read = [*kept, *([] if column in kept else [column])]
    schema = with_fields(docs.select(*(F.col(f"`{c}`") for c in kept)).schema, ", ".join(f"{c} {kind}" for c, kind in added.items()))
    shipped = docs.sparkSession.sparkContext.broadcast(zlib.compress(vocabulary.encode()))
    mark = f"bpe-{hashlib.md5(vocabulary.encode()).hexdigest()}"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec: Codec = worker_memo(mark, lambda: Codec(zlib.decompress(shipped.value).decode()))
        texts = [t or "" for t in batch.column(read.index(column)).to_pylist()]
        first, second, third = [], [], []
        for some in slices(texts):
            for ids in codec.encode_batch(some):
                decoded = codec.decode(ids)
                if digests:
                    first.append(len(ids) // 4)
                    second.append(hashlib.sha256(ids).hexdigest())
                    third.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    first.append(ids)
                    second.append(decoded)
        columns = [batch.column(i) for i in range(len(kept))]
        if digests:
            columns += [pa.array(first, pa.int64()), pa.array(second, pa.string()), pa.array(third, pa.string())]
        else:
            ends = np.cumsum([0, *(len(ids) // 4 for ids in first)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(first), "<u4").astype(np.int32))
            columns += [pa.ListArray.from_arrays(pa.array(ends), values), pa.array(second, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*kept, *added])

    return map_batches(docs.select(*(F.col(f"`{c}`") for c in read)), run, schema)
