"""Operators 4 and 6 against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from peakloom.llm import bpe, transducer
from peakloom.llm.op4_bpe_codec import Codec, encoded, lexicon, op4_bpe_codec, tokenizer_path
from peakloom.llm.op6_token_counts import counted, op6_token_counts

from .common import corpus, frame, stored

HARD = ["", "  ", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ß ﬁ é Å", "a<|endoftext|>B <|startoftext|>", "don't I'LL we'd 's'''s 123 ½ ² ४५", "\x1c\x1d\x85\xa0x ​y 😀👩‍👩‍👧 <|endoftext", "日本語テキスト\x00z﻿", "aaaa aaaaaaa ''' !!!!!!???", "x" * 3000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding(spark, library):
    rows = corpus(1, 30) + [(1000 + i, t, None, None) for i, t in enumerate(HARD)]
    got = {r.doc_id: tuple(r)[1:] for r in encoded(frame(spark, rows)).collect()}
    assert got == {i: want(library, t) for i, t, *_ in rows}
    n = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counted(frame(spark, rows), limit=50).collect()}
    assert n == {i: (len((t or "").encode()), want(library, t)[0], want(library, t)[0] > 50) for i, t, *_ in rows}


def test_round_trip(spark):
    rows = [(i, t, None, None) for i, t in enumerate(HARD)]
    c = Codec(tokenizer_path(), lexicon(frame(spark, rows), tokenizer_path()))
    for r in encoded(frame(spark, rows), keep_ids=True).collect():
        ids, text = c.encode(HARD[r.doc_id])
        assert ids == list(r.ids) and text == r.decoded == c.decode(ids)


def test_long_words(spark, library):
    """Merged by a heap, in rounds if short; both as the library does."""
    import random

    rng = random.Random(0)
    model = bpe.load(tokenizer_path())
    for n in (1, 2, 30, 200, 3000):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "éßtheinonre"):
            word = "".join(rng.choices(letters, k=n))
            ids = [model.inner[b] for b in word.encode()[:-1]] + [model.last[word.encode()[-1]]]
            assert model.joined_by_heap(ids) == model.joined(ids) == list(model.merge(word)) == library.encode(word, add_special_tokens=False).ids
    rows = [(1, "".join(rng.choices("etaoinshrdlu", k=300_000)), None, None), (2, "x" * 200_000 + " y", None, None), (2, "z", None, None), (2, "z", None, None)]
    got = sorted(tuple(r) for r in encoded(frame(spark, rows)).collect())
    assert got == sorted((i, *want(library, t)) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in counted(frame(spark, rows)).collect()) == sorted((i, want(library, t)[0]) for i, t, *_ in rows)


def test_memory_starts_anew(spark, library, monkeypatch):
    from peakloom.llm import op4_bpe_codec as O4
    from peakloom.llm import op6_token_counts as O6

    monkeypatch.setattr(O4, "MEMORY", 50)
    monkeypatch.setattr(O6, "MEMORY", 50)
    rows = corpus(4, 12)
    c, n = Codec(tokenizer_path(), transducer.compiled({})), O6.Counts(tokenizer_path())
    for _, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert c.encode(t or "") == (ids, library.decode(ids, skip_special_tokens=False)) and n.of(t) == len(ids)


def test_queries(spark, tmp_path, library):
    rows = corpus(2, 15)
    sf = stored(spark, tmp_path, rows)
    assert {r.doc_id: r.n_tokens for r in op4_bpe_codec(spark, sf).collect()} == {r.doc_id: r.n_tokens for r in op6_token_counts(spark, sf).collect()} == {i: want(library, t)[0] for i, t, *_ in rows}


def test_empty(spark):
    assert encoded(frame(spark, [])).count() == 0 and counted(frame(spark, [])).count() == 0


def test_whole_tokens_are_proved(library):
    words = bpe.load(tokenizer_path()).whole_tokens()
    assert len(words) > 30_000
    for w in list(words)[::997]:
        assert library.encode(w, add_special_tokens=False).ids == [words[w]]


def test_transducer():
    entries = {w.encode(): tuple(range(i % 3 + 1)) for i, w in enumerate("talking walking walked talk walk a ab abc z".split())}
    lex = transducer.mapped(transducer.compiled(entries))
    words = sorted(entries)
    assert lex.numbers([*words, b"", b"wal", b"walkingx", b"\xff"]).tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert [lex.ids(i) for i in range(len(words))] == [entries[w] for w in words] and lex.states < sum(map(len, words))
    assert transducer.Lexicon(np.frombuffer(transducer.compiled({}), np.uint8)).numbers([b"a"]).tolist() == [-1]


def many_rows():
    """2,500 documents, each but for the common words with one word that stands in one other document only; and the hard ones."""
    letters = str.maketrans("0123456789", "abcdefghij")
    return [(i, f"common Zq{i // 2}\n(common)".translate(letters), None, None) for i in range(2500)] + [(3000 + i, t, None, None) for i, t in enumerate([*HARD, None])]


def repeated_words(rows):
    """word -> how often the short words that occur twice or more stand in all rows."""
    from collections import Counter

    seen = Counter(w for _, t, *_ in rows for w in bpe.load(tokenizer_path()).pieces(t or "") if len(w) <= 64)
    return {w: n for w, n in seen.items() if n > 1}


def test_lexicon_counts_every_row(spark):
    """All documents are counted, not some; words of one count enter together or not at all."""
    from peakloom.llm.op4_bpe_codec import frequent, word_counts

    rows, docs = many_rows(), frame(spark, many_rows())
    want_counts = repeated_words(rows)
    assert {r.word: r.n for r in word_counts(docs, tokenizer_path()).where("n > 1").collect()} == want_counts and len(want_counts) > 1250
    assert frequent(docs, tokenizer_path()) == sorted(want_counts)
    pairs = sum(n == 2 for n in want_counts.values())
    above = sorted(w for w, n in want_counts.items() if n > 2)
    assert frequent(docs, tokenizer_path(), len(want_counts) - 1) == above and len(above) == len(want_counts) - pairs
    assert frequent(docs, tokenizer_path(), 1) == frequent(docs, tokenizer_path(), 2) == ["common"]  # "(" and ")" are as frequent as each other


def test_pipeline_stage_counts_every_row(spark, library, monkeypatch):
    """The pipeline's last stage compiles its lexicon from all rows that it gets, and encodes as the library does."""
    import corpus_pipeline

    rows, entered, compiled = many_rows(), {}, transducer.compiled
    monkeypatch.setattr(transducer, "compiled", lambda entries: entered.update(entries) or compiled(entries))
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.codec_stage(spark, frame(spark, rows), "").collect()}
    assert {w.encode() for w in repeated_words(rows) if w not in bpe.load(tokenizer_path()).special} <= entered.keys()
    assert got == {i: want(library, t) for i, t, *_ in rows}


def test_merges_side_by_side(library):
    """Many words at once: as one by one and as the library, with lengths that few and many words share, and beyond SHORT."""
    import random

    rng = random.Random(3)
    model = bpe.load(tokenizer_path())
    words = ["".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 7, 9, 12, 40, 70]))) for letters in ("etaoinshrdlu", "ab", "a", "éßtheinonre", "日本語x") for _ in range(300)] + ["x" * 13, "x" * 64, "x" * 65]
    ids, many = model.merges([w.encode() for w in words])
    own = np.split(ids, np.cumsum(many)[:-1])
    assert [x.tolist() for x in own] == [list(model.merge(w)) for w in words] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [x.tolist() for x in model.merges([])] == [[], []]


def test_split_of_many_chunks():
    """Pieces of all chunks at once are those of each by itself, special strings, lone marks and final sigmas among them."""
    model = bpe.load(tokenizer_path())
    hard = [c for t in HARD for c in model.chunks(t)] + ["\u0301e", "e\u0301", "ΑΣ", "Σ", "x\ty\r", "'", "s", "'S", "<|", "|>", "İ"]
    for chunks in (hard, hard[::-1], [c for c in hard if "<|" not in c], [c for c in hard if "<|" in c], ["a<|endoftext|>B"], ["don't"], [""], []):
        words, at, chunk = model.split(chunks)
        got = [[] for _ in chunks]
        for k, c in zip(at.tolist(), chunk.tolist(), strict=True):
            got[c].append(words[k])
        assert got == [model.pieces(c) for c in chunks] and len(set(words)) == len(words)


def test_words_are_not_merged_one_by_one(monkeypatch):
    """Words outside the lexicon are merged together: 2,000 distinct ones take few single merges, and ids stay the same."""
    import itertools

    import pyarrow as pa

    words = ["zq" + "".join(w) for w in itertools.islice(itertools.product("bcdfghjklm", repeat=5), 2000)]
    model, single, merge = bpe.load(tokenizer_path()), [], bpe.WordBPE.merge
    want_ids = [" ".join(map(str, model.ids(w))) for w in words]
    monkeypatch.setattr(bpe.WordBPE, "merge", lambda self, w: single.append(w) or merge(self, w))
    c = Codec(tokenizer_path(), transducer.compiled({}))
    assert c.encode(" ".join(words))[0] == [int(i) for w in want_ids for i in w.split()] and len(single) < 100
    assert [x for as_ids, *_ in c.encoded(pa.array([*words, None, "", "\n \n"])) for x in as_ids.to_pylist()] == [*want_ids, "", "", ""] and len(single) < 100
