import random

from queryproof.llm import spans
from queryproof.llm.queries import QUERIES
from tests.conftest import SMALL


def split(text):
    """Sentences letter by letter: (normal words, from, to); white space behind an end belongs to it."""
    cuts, i = [], 0
    while i < len(text):
        j = i
        if text[i] == "\n":
            j = i + 1
        elif text[i] in ".!?…":
            while j < len(text) and text[j] in ".!?…":
                j += 1
            while j < len(text) and text[j] in "\"'”’)]":
                j += 1
            if not (j < len(text) and text[j].isspace()):
                j = i
        elif text[i] in "。！？":
            while j < len(text) and text[j] in "。！？":
                j += 1
        if j > i:
            while j < len(text) and text[j].isspace():
                j += 1
            cuts.append(j)
            i = j
        else:
            i += 1
    out, start = [], 0
    for end in [*cuts, len(text)]:
        words = text[start:end].lower().split()
        if words:
            out.append((tuple(words), start))
            start = end
    return [words for words, _ in out]


def brute(rows, several=3, least=12, enough=40):
    """One pass over all documents by id, remembering every run of words seen: what goes, and what only long runs take."""
    seen, out = {}, {}
    for doc in sorted(rows):
        parts, whole, short = split(rows[doc] or ""), set(), set()
        for start in range(len(parts)):
            for stop in range(start + 1, len(parts) + 1):
                run, words = tuple(parts[start:stop]), sum(map(len, parts[start:stop]))
                shorter = stop - start < several
                if words >= (enough if shorter else least) and seen.setdefault(run, (doc, start)) != (doc, start):
                    (short if shorter else whole).update(range(start, stop))
                if not shorter and words >= least:
                    break
        out[doc] = (sorted(whole | short), sorted(short - whole))
    return out


def test_sentences_are_the_whole_text():
    for text in ("", "A b. C d!  E\nf", "\n\n x. y", "  ...  ", "no end", "日本。語！ x", "a.b c. \"d.\" e"):
        parts = spans.sentences(text)
        assert "".join(text[s:e] for s, e, _, _ in parts) == (text if parts else "")
    assert [n for _, _, n, _ in spans.sentences("A  b. C!! D\nE")] == ["a b.", "c!!", "d", "e"]


def test_query_agrees_with_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op2_sentence_spans"](spark, SMALL).collect()
    assert {r.doc_id: (r.removed, r.removed_long) for r in got} == brute(rows)
    for r in got:
        parts = spans.sentences(rows[r.doc_id])
        assert r.text == "".join(rows[r.doc_id][s:e] for k, (s, e, _, _) in enumerate(parts) if k not in set(r.removed))


def test_planted_passages_go_but_for_the_first(spark, rows_of):
    rng = random.Random(2)

    def prose(n):
        return " ".join(" ".join(f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(3, 12))) + "." for _ in range(n))

    passage = prose(12)
    long_sentence = " ".join(f"z{i}" for i in range(55)) + "."
    rows = {i: f"{prose(8)} {passage if i % 2 else long_sentence} {prose(8)}" for i in range(40)}
    rows[99] = prose(30)
    got = {r.doc_id: r for r in spans.drop_repeats(rows_of("doc_id long, text string", list(rows.items()))).collect()}
    assert {i: (r.removed, r.removed_long) for i, r in got.items()} == brute(rows)
    for i, r in got.items():
        held = passage in r.text or long_sentence in r.text
        assert held == (i in (0, 1))
    assert got[99].text == rows[99] and got[0].text == rows[0] and got[1].text == rows[1]


def test_every_run_of_several_sentences(spark, rows_of):
    rng = random.Random(4)

    def sentence(n):
        return " ".join(f"w{rng.randrange(10**7)}" for _ in range(n)) + ". "

    passages = [[20, 22, 15], [15, 20, 22], [45, 5, 35], [5, 5, 5], [40, 28], [30, 15], [41], [39], [20, 19], [2, 2, 2, 2, 2], [30, 45, 8, 50]]
    texts = {}
    for n, sizes in enumerate(passages):
        passage = "".join(map(sentence, sizes))
        for copy in range(3):
            texts[10 * n + copy] = sentence(9) + passage + sentence(9)
    got = {r.doc_id: r for r in spans.drop_repeats(rows_of("doc_id long, text string", list(texts.items()))).collect()}
    assert {i: (r.removed, r.removed_long) for i, r in got.items()} == brute(texts)
    for n, sizes in enumerate(passages):
        whole = list(range(1, len(sizes) + 1))
        for copy in (1, 2):
            r = got[10 * n + copy]
            if len(sizes) >= 3 and sum(sizes) >= 12:
                assert (r.removed, r.removed_long) == (whole, [])
            elif sum(sizes) >= 40:
                assert (r.removed, r.removed_long) == (whole, whole)
            else:
                assert r.removed == []
        assert got[10 * n].removed == []


def test_edges_of_the_input(spark, rows_of):
    run = "One two three four five. Six seven eight nine. Ten eleven twelve thirteen. "
    rows = [(1, None), (2, ""), (3, "x"), (4, run * 3), (5, run), (5, run), (None, run), (6, "tail. " + run), (7, "\n")]
    df = rows_of("doc_id long, text string, removed string", [(*r, "old") for r in rows])
    out = spans.drop_repeats(df)
    assert out.columns == [c for c in df.columns if c != "removed"] + ["n_sentences", "removed", "removed_long"]
    got = sorted(((r.doc_id, r.text, r.n_sentences, r.removed) for r in out.collect()), key=str)
    want = [(1, None, 0, []), (2, "", 0, []), (3, "x", 1, []), (4, run, 9, [3, 4, 5, 6, 7, 8]), (5, "", 3, [0, 1, 2]),
            (5, "", 3, [0, 1, 2]), (6, "tail. ", 4, [1, 2, 3]), (7, "\n", 0, []), (None, run, 3, [])]
    assert got == sorted(want, key=str)
    assert spans.drop_repeats(df.limit(0)).collect() == []
