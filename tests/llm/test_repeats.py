"""Operators 1 and 5 against brute force, with every path of the shared engine."""

import random

import numpy as np
import pyarrow as pa
import pytest

from peakloom.llm import anchored as A
from peakloom.llm import op1_suffix_dedup as O1
from peakloom.llm import op5_rlz_dedup as O5
from peakloom.llm.op1_suffix_dedup import BYTES, op1_suffix_dedup, suffix_stage, trimmed
from peakloom.llm.op5_rlz_dedup import WORDS, op5_rlz_dedup, parsed

from .common import answers, brute_bytes, brute_words, corpus, frame, stored


@pytest.mark.parametrize("seed", range(2))
def test_bytes(spark, seed):
    rows = corpus(seed)
    assert answers(trimmed(frame(spark, rows).repartition(5)), 4) == brute_bytes(rows)


@pytest.mark.parametrize("seed", range(2))
def test_words(spark, seed):
    rows = corpus(seed)
    assert answers(parsed(frame(spark, rows).repartition(5)), 3) == brute_words(rows)


def test_queries(spark, tmp_path):
    rows = corpus(7, 25)
    sf = stored(spark, tmp_path, rows)
    assert answers(op1_suffix_dedup(spark, sf), 4) == brute_bytes(rows)
    assert answers(op5_rlz_dedup(spark, sf), 3) == brute_words(rows)


def test_empty_and_without_id(spark):
    assert trimmed(frame(spark, [])).count() == 0 and parsed(frame(spark, [])).count() == 0
    t = "x" * 50 + "y" * 90
    rows = {r.doc_id: r.n_removed for r in trimmed(frame(spark, [(None, t, None, None), (1, t, None, None)])).collect()}
    assert rows == {None: 0, 1: 0}


def shared_ids():
    """Equal rows, rows of one id with equal passages, and rows that repeat an earlier id's passage."""
    rng = random.Random(6)
    text = lambda k: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(k))
    whole, passage, other = text(80), text(40), text(60)
    return [
        (1, whole, "en", "s"), (1, whole, "en", "s"), (2, other, "en", "s"), (2, text(9) + " " + passage, "en", "s"), (2, passage + " " + text(5), "en", "s"),
        (3, text(5) + " " + passage, "en", "s"), (3, text(30), "en", "s"), (3, whole, "en", "s"), (4, passage + " " + passage, "en", "s"), (4, passage + " " + passage, "en", "s"),
    ]


@pytest.mark.parametrize("parts", [1, 4])
def test_rows_that_share_an_id(spark, parts, monkeypatch):
    monkeypatch.setattr(A, "RANGE_ROWS", 20)  # several ranges
    rows = shared_ids()
    got = answers(trimmed(frame(spark, rows).repartition(parts)), 4)
    assert got == brute_bytes(rows) and [x[1] for x in got[1]] == [0, 0] and got[2][0][1] == got[2][1][1] == got[2][2][1] == 0
    assert answers(parsed(frame(spark, rows).repartition(parts)), 3) == brute_words(rows)


def test_stage_with_rows_that_share_an_id(spark, tmp_path):
    rows = shared_ids() + [(9, None, None, None), (10, "", None, None)]
    out = [(r.doc_id, r.text) for r in suffix_stage(spark, frame(spark, rows), str(tmp_path)).collect()]
    assert sorted(len((t or "").encode()) for _, t in out) == sorted(n for v in brute_bytes(rows).values() for x in (v if isinstance(v, list) else [v]) for n in [x[0] - x[1]])
    assert [t for i, t in out if i == 1] == [rows[0][1]] * 2 and (9, None) in out and (10, "") in out


def test_hot_passage_in_many_contexts(spark, monkeypatch):
    """One line in every document, each time in another context: its suffixes are split over ranges."""
    monkeypatch.setattr(A, "RANGE_ROWS", 100)
    monkeypatch.setattr(A, "PACK", 500)
    monkeypatch.setattr(A, "HELD", 5000)
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 9)))
    line = " ".join(word() for _ in range(14))
    rows = [(i, " ".join(word() for _ in range(30)) + " " + line + " " + " ".join(word() for _ in range(30)), "en", "s") for i in range(200)]
    assert answers(trimmed(frame(spark, rows)), 4) == brute_bytes(rows)
    assert answers(parsed(frame(spark, rows)), 3) == brute_words(rows)


def test_stage_keeps_columns(spark, tmp_path):
    rows = corpus(3, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars")
    out = suffix_stage(spark, docs, str(tmp_path))
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())


@pytest.mark.parametrize("spec", [BYTES, WORDS])
def test_every_window_has_an_anchor(spec):
    rng = np.random.default_rng(4)
    for n in (0, spec.window - 1, spec.window, 700):
        p, h = A.find_anchors(rng.integers(0, 4, n).astype(np.uint64), spec)
        for s in range(n - spec.window + 1):
            assert ((p >= s) & (p + spec.gram <= s + spec.window)).any()
        assert len(p) == len(h)


def test_pieces_give_the_same_anchors(monkeypatch):
    tokens = np.random.default_rng(5).integers(0, 3, 3000).astype(np.uint8)
    whole = A.find_anchors(tokens, BYTES)
    monkeypatch.setattr(A, "PIECE", 97)
    assert all((a == b).all() for a, b in zip(whole, A.find_anchors(tokens, BYTES)))


def test_multikey_quicksort():
    rng = random.Random(2)
    rows = [bytes(rng.choices(b"ab", k=24)) for _ in range(300)] + [b"a" * 24] * 20
    order, length, shared = O1.sorted_array(rows, 24)
    assert [rows[i] for i in order] == sorted(rows) and set(length.tolist()) == {24}
    for k, n in enumerate(shared.tolist()):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert n == (0 if k == 0 else next((j for j in range(24) if a[j] != b[j]), 24))


@pytest.mark.parametrize("parts", [1, 3, 50])
@pytest.mark.parametrize("which", [O1, O5])
def test_ranges_compare_across_their_ends(spark, parts, which, monkeypatch):
    """The same open contexts, uncombined, in any number of ranges give the same spans."""
    monkeypatch.setattr(A, "HELD", 0)
    spec, brute = (BYTES, brute_bytes) if which is O1 else (WORDS, brute_words)
    rows = corpus(9, 30)
    docs = A.placed(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").where("text is not null"))
    place = {r.doc_id: r.row for r in docs.collect()}
    every = spark.createDataFrame([(i, place[i], int(p)) for i, t, *_ in rows if t for p in A.find_anchors(spec.tokens(t), spec)[0]], "doc long, row long, pos int")

    def run(batches):
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield from A.compared_rows(*which.compare(pa.Table.from_batches(held), spec), 5)

    spread = A.contexts(docs, every, spec).where("suffix is not null").select("suffix", "before", "doc", "row", "pos").repartitionByRange(parts, "suffix", "before", "doc", "row", "pos")
    c = spread.mapInArrow(run, A.COMPARED).cache()
    found = {}
    for r in c.where("bucket is null").select("doc", "value").unionByName(A.across(c, spec).select("doc", "value")).collect():
        found.setdefault(r.doc, []).append(r.value)
    assert {i: sum(hi - lo for lo, hi in A.merged(v)) for i, v in found.items()} == {i: w[1] for i, w in brute(rows).items() if w[1]}


def test_factors_have_their_source(spark):
    """The parse reproduces every document from literals and from words of earlier documents; a mere union of matches has no such source."""
    rows = corpus(5) + [(2000 + i, t, "en", "s") for i, (_, t, *_) in enumerate(corpus(5)[:20])]
    words = {i: O5.words_of(t) for i, t, *_ in rows}
    copied = 0
    for r in parsed(frame(spark, rows), keep_factors=True).collect():
        own, at = words[r.doc_id], 0
        for f in r.factors:
            assert f["from"] == at < f["to"]
            at = f["to"]
            if f.s_doc is not None:
                copied += 1
                assert f.s_doc < r.doc_id and words[f.s_doc][f.s_pos : f.s_pos + f["to"] - f["from"]] == own[f["from"] : f["to"]]
        assert at == len(own)
    assert copied > 20


def test_block_parses_greedily():
    """A factor goes on as far as its source; windows over its end are looked up again; the same document is no reference."""
    block = O5.Block(3)

    def factors(text, doc):
        words = text.split()
        return block.factors(text.encode() + b" ", [0, *np.cumsum([len(w) + 1 for w in words]).tolist()], doc, 0, 100)[0]

    assert factors("a b c d e f", 1) == [] and factors("d e f g h a b c d e f", 1) == []
    assert factors("x a b c d y", 2) == [(101, 105, 1, 0, 100)]
    assert factors("b c d e f g h q", 3) == [(100, 105, 1, 0, 101), (103, 107, 1, 0, 101)]
    assert factors("x a b c d y", 3) == [(100, 106, 2, 0, 100)]


def test_parse():
    assert O5.parse(0, []) == [] and O5.parse(3, []) == [(0, 3, None, None, None)]
    a, b = (2, 6, 1, 0, 50), (4, 8, 3, 0, 10)
    assert O5.parse(10, [a, b]) == [(0, 2, None, None, None), (2, 6, 1, 0, 50), (6, 8, 3, 0, 12), (8, 10, None, None, None)]
    assert O5.duplicates(O5.parse(10, [a, b]), [a, b], 4) == [(2, 8)] and O5.duplicates(O5.parse(10, [a, b]), [a, b], 5) == []
    assert O5.stitched([a, (5, 9, 1, 0, 53), (5, 9, 1, 0, 60)]) == [(2, 9, 1, 0, 50), (5, 9, 1, 0, 60)]


def test_packs():
    f = {"h": np.array([1, 2], np.uint32), "doc": np.array([-1, 7]), "row": np.array([-(2**63), 7]), "pos": np.array([0, 2**31 - 1], np.int32), "known": np.array([0, 1])}
    back = A.unpack([A.pack(f), A.pack(f)])
    assert all((back[k][:2] == v).all() and (back[k][2:] == v).all() for k, v in f.items()) and A.unpack([])["h"].dtype == np.uint32


def test_a_shared_folder_must_be_named_on_a_cluster(spark):
    from peakloom.llm.common import shared_dir

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(ValueError):
        shared_dir(Session)
