"""Operators 2, 3, 7, 8, 9 and 10, and the pipeline."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from peakloom.llm import op2_crf_quality as O2
from peakloom.llm import op3_hilbert_shards as O3
from peakloom.llm import op7_quality_rules as O7
from peakloom.llm import op8_simhash_ball as O8
from peakloom.llm import op9_ppm_scores as O9
from peakloom.llm import op10_template_leaks as O10
from peakloom.llm.components import components

from .common import WORD, corpus, crc, frame, stored

SF = "/root/testdata/sf0.001"


# --- 2


def test_crf_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in O2.op2_crf_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_crf_of_awkward_rows_with_a_trained_model(spark, monkeypatch):
    """Nulls, empty and very long texts, repeated ids, several labels, clashing columns; blocks by lines give the same scores as one by one."""
    good = lambda i: "\n".join(f"This is line {k} of a calm text, number {i}, that says something." for k in range(4))
    bad = lambda i: "\n".join("$$$ BUY!!! *** NOW &&& " + "X" * (k + i % 3) for k in range(5))
    rows = [(i, (good if i % 2 else bad)(i), "en", "s") for i in range(60)] + [(100, None, None, None), (101, "", None, None), (7, good(7), None, None), (102, good(3) + "\n$$$ !!!\n" * 30_000, None, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    want = sorted((r.doc_id, round(r.score, 9)) for r in O2.scored(frame(spark, rows), labels).collect())
    assert len(want) == len(rows) and all(0 <= s <= 1 for _, s in want) and [i for i, _ in want].count(7) == 2
    assert all((s >= 0.3) == bool(i % 2) for i, s in want if i < 60 and i != 7)
    monkeypatch.setattr(O2, "CELLS", 7)
    again = sorted((r.doc_id, r.score) for r in O2.scored(frame(spark, rows), labels).collect())
    assert [s for _, s in again] == pytest.approx([s for _, s in want], abs=1e-3)  # training adds up in another order
    assert {r.score for r in O2.scored(frame(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_crf_marginals_are_exact():
    f = O2.Field()
    rng = np.random.default_rng(0)
    f.weights, f.moves = rng.normal(size=O2.FEATURES), rng.normal(size=(2, 2))
    x = rng.normal(size=(1, 5, O2.FEATURES))
    good, moves = f.marginals(np.concatenate([x, np.zeros((1, 2, O2.FEATURES))], 1), np.array([[True] * 5 + [False] * 2]))
    total, by, pair = 0.0, np.zeros(5), np.zeros((2, 2))
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        p = math.exp(sum(float(x[0, i] @ f.weights) * y[i] for i in range(5)) + sum(f.moves[a, b] for a, b in zip(y, y[1:])))
        total, by = total + p, by + p * np.array(y)
        for a, b in zip(y, y[1:]):
            pair[a, b] += p
    assert good[0, :5] == pytest.approx(by / total) and moves == pytest.approx(pair / total) and (good[0, 5:] == 0).all()


def test_crf_edges(spark, tmp_path):
    sf = stored(spark, tmp_path, corpus(0, 10))
    assert {r.score for r in O2.op2_crf_quality(spark, sf).collect()} == {0.5}
    assert O2.scored(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# --- 3


def test_hilbert_neighbours_touch():
    cells = {O3.hilbert_index(x, y, z, 3): (x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    assert sorted(cells) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1])) == 1 for i in range(511))


def test_shards(spark):
    rows = corpus(0) + [(5, "again", "en", "s0")] * 4
    out = O3.placed(frame(spark, rows).repartition(3), tasks=7).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    order = [r.curve for s in range(24) for r in sorted(by[s], key=lambda r: r.slot)]
    assert order == sorted(order)
    import zlib

    text = {i: t or "" for i, t, *_ in rows}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in out)
    assert O3.placed(frame(spark, [])).count() == 0
    assert sorted((r.shard, r.slot) for r in O3.placed(frame(spark, rows[:3])).collect()) == [(0, 0), (8, 0), (16, 0)]


def test_a_box_touches_few_shards(spark):
    """Files hold runs of the curve: a predicate on language, source or both prunes most of them by minimum and maximum."""
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 400), rng.choice(["en", "de", "fr", "es"]), rng.choice(["s0"] * 5 + ["s1", "s2", "s3", "s4", "s5"])) for i in range(3000)]
    out = O3.placed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), tasks=5).collect()
    cell = {(rows[r.doc_id][2], rows[r.doc_id][3]): (r.q_lang, r.q_source) for r in out}
    assert len(set(cell.values())) == 24  # values don't share cells
    low = {s: [min(getattr(r, q) for r in out if r.shard == s) for q in ("q_lang", "q_source")] for s in range(24)}
    high = {s: [max(getattr(r, q) for r in out if r.shard == s) for q in ("q_lang", "q_source")] for s in range(24)}
    touched = lambda box: sum(all(v is None or low[s][k] <= v <= high[s][k] for k, v in enumerate(box)) for s in range(24))
    for lang in ("en", "de", "fr", "es"):
        assert touched((cell[lang, "s0"][0], None)) <= 16
        for source in ("s1", "s4"):
            assert touched((None, cell[lang, source][1])) <= 14 and touched(cell[lang, source]) <= 8


def test_rare_values_share_the_last_cell(spark):
    rows = [(i, "x", f"l{i % 40}" if i % 2 else "en", None) for i in range(200)]
    out = O3.placed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.q_lang for r in out} == set(range(1, 16)) and {r.q_lang for r in out if rows[r.doc_id][2] == "en"} == {1} and {r.q_source for r in out} == {0}


def test_shards_query(spark):
    assert O3.op3_hilbert_shards(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# --- 7


def brute_rules(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_rules(spark):
    rows = corpus(0) + [(9000, "a b c a b c a|b #x", "en", "s0")]
    for r in O7.judged(frame(spark, rows)).collect():
        assert tuple(r)[1:7] == brute_rules(dict((i, t) for i, t, *_ in rows)[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert O7.judged(frame(spark, [])).count() == 0


def test_rules_with_many_groups(spark, monkeypatch):
    rows = corpus(1)
    want = sorted((r.doc_id, r.kept, tuple(r.outside)) for r in O7.judged(frame(spark, rows)).collect())
    monkeypatch.setattr(O7, "SMALL", 0)
    assert sorted((r.doc_id, r.kept, tuple(r.outside)) for r in O7.judged(frame(spark, rows)).collect()) == want


def test_rules_reject_junk_and_keep_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r for r in O7.op7_quality_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    bad = [kept[r.doc_id].kept for r in labels if r.quality == 0]
    good = [kept[r.doc_id].kept for r in labels if r.quality == 1 and not kept[r.doc_id].base_failed]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.97 * len(good)


def test_sketches_merge_and_are_near(spark):
    rng = random.Random(0)
    values = [(rng.choice(["en", "fr"]), rng.choice(["a", "b"]), rng.lognormvariate(0, 1)) for _ in range(2000)]
    df = spark.createDataFrame([(a, b, "length", int(round(math.log(x) / math.log(O7.GAMMA)))) for a, b, x in values], "lang string, source string, rate string, bin int").groupBy("lang", "source", "rate", "bin").agg(F.count("*").alias("n"))
    x = sorted(v for *_, v in values)
    q = O7.quartiles(df).first()
    assert q.q1 == pytest.approx(x[499], rel=0.011) and q.q3 == pytest.approx(x[1499], rel=0.011) and q["rows"] == 2000


# --- 8


def brute_print(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    """doc -> least doc reachable over links of four bits or fewer."""
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    label[a], changed = label[b], True
    return label


def test_simhash(spark):
    rows = corpus(0)
    out = {r.doc_id: r for r in O8.classed(frame(spark, rows)).collect()}
    fps = {i: brute_print(t) for i, t, *_ in rows}
    assert {i: r.fingerprint for i, r in out.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in out.items()} == linked(fps)
    assert O8.classed(frame(spark, [])).count() == 0


def test_links_of_chains(spark, monkeypatch):
    rng = random.Random(3)
    fps = {}
    for c in range(8):
        f = rng.getrandbits(64)
        for i in range(6):
            fps[100 * c + i] = f
            for b in rng.sample(range(64), 4 if i % 2 else 5):
                f ^= 1 << b
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f), i) for i, f in fps.items()], "fp long, node long")
    want = {i: c for i, c in linked(fps).items() if c != i}
    assert {r.node: r.component for r in components(O8.links(df)).collect()} == want


def test_a_large_family_is_cut_at_further_bits(spark, monkeypatch):
    """Near copies of one fingerprint share its leading bits: their range is split until it is small."""
    monkeypatch.setattr(O8, "MOST", 10)
    rng = random.Random(8)
    base, fps = rng.getrandbits(64), {}
    for i in range(60):
        f = base ^ (rng.getrandbits(64) if i % 10 == 0 else 0)
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            f ^= 1 << b
        fps[i] = f
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    least = {}
    for i, f in sorted(fps.items()):
        least.setdefault(f, i)
    df = spark.createDataFrame([(signed(f), i) for f, i in least.items()], "fp long, node long")
    want = linked({i: f for f, i in least.items()})
    assert {r.node: r.component for r in components(O8.links(df)).collect()} == {i: c for i, c in want.items() if i != c}


@pytest.mark.parametrize("size", [1 << 21, 4000])
def test_slices_find_the_same(monkeypatch, size):
    monkeypatch.setattr(O8, "SLICE", size)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(0b1011), base ^ np.uint64(1 << 62 | 1 << 3)])
    lead, want, got = 8, set(), set()
    for a in range(len(fps)):
        want |= {(a, b) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 4}
    for prefix in range(256):
        near = np.nonzero(np.bitwise_count(fps >> np.uint64(56) ^ np.uint64(prefix)) <= 2)[0]
        a, b = O8.met(prefix, fps[near], lead)
        got |= {(int(min(near[x], near[y])), int(max(near[x], near[y]))) for x, y in zip(a, b)}
    assert got <= want
    label = {i: i for i in range(len(fps))}
    for _ in range(len(fps)):
        for a, b in got:
            label[a] = label[b] = min(label[a], label[b])
    assert all(label[a] == label[b] for a, b in want)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: c for n, c in label.items() if n != c}


# --- 9


def test_ppm(spark):
    rows = corpus(0, 30)
    texts = {i: t or "" for i, t, *_ in rows}
    train = [i for i in texts if crc(i) % 5 != 1]
    count: Counter = Counter()
    context = defaultdict(Counter)
    K = O9.ORDER
    for i in train:
        count.update(texts[i].encode().lower().split())
        count[None] += 1
        b = b"\xff" * K + texts[i].encode() + b"\xff"
        for p in range(K, len(b)):
            for k in range(K + 1):
                context[b[p - k : p]][b[p]] += 1
    total, kinds = sum(count.values()), len(count)

    def log(c, s):
        out, p = set(), 1.0
        for k in range(K, -1, -1):
            left = {x: n for x, n in context.get(c[K - k :], {}).items() if x not in out}
            if left:
                bottom = sum(left.values()) + len(left)
                if s in left:
                    return math.log10(p * left[s] / bottom)
                p *= len(left) / bottom
                out |= set(left)
        return math.log10(p / (256 - len(out)))

    got = {r.doc_id: r for r in O9.scored(frame(spark, rows)).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        w = [*t.encode().lower().split(), None]
        b = b"\xff" * K + t.encode() + b"\xff"
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w), sum(x in count for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(x, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for x in w))
        assert r.score == pytest.approx(sum(log(b[p - K : p], b[p]) for p in range(K, len(b))), rel=1e-5)


def test_ppm_of_empty_and_short_texts(spark):
    assert O9.scored(frame(spark, [])).count() == 0
    one = O9.scored(frame(spark, [(1, None, None, None), (2, "a", None, None)])).collect()
    assert {r.doc_id: r.n_tokens for r in one} == {1: 1, 2: 2}


def test_ppm_scores_do_not_depend_on_groups_and_buckets(spark, monkeypatch):
    """The model of all texts at once gives the same scores as any dealing of groups and buckets; repeated rows are scored each."""
    rows = corpus(0, 20) + [(4, "once more", None, None)] * 2
    train = [t for i, t, *_ in rows if crc(i) % 5 != 1]
    code, n = np.unique(O9.codes(train, O9.ORDER)[0], return_counts=True)
    whole = O9.Model(code, n.astype(np.float64), O9.ORDER)
    want = sorted(float(whole.log(O9.codes([t], O9.ORDER)[0]).sum()) for _, t, *_ in rows)
    for size, share in ((1 << 10, 1 << 9), (1 << 30, 1 << 30)):
        monkeypatch.setattr(O9, "GROUP_BYTES", size)
        monkeypatch.setattr(O9, "BUCKET_BYTES", share)
        got = O9.scored(frame(spark, rows)).collect()
        assert sorted(r.score for r in got) == pytest.approx(want, rel=1e-6)
        assert [r.doc_id for r in got].count(4) == [i for i, *_ in rows].count(4)


def test_near_strings_are_counted_in_all_texts(spark):
    texts = [t for _, t, *_ in corpus(0, 20)]
    code, n = O9.near_strings(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.unique(O9.codes(texts, O9.NEAR - 1)[0], return_counts=True)
    assert (code == want[0]).all() and (n == want[1]).all()


# --- 10


ITEM = "Late last week Anna carried 20 boxes over the long bridge to the market, and in the evening Anna sold 3 kg of apples there to Bob."


def leaked(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in O10.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_templates(spark):
    other = ITEM.replace("Anna", "Maria").replace("Bob", "Peter").replace("20", "35").replace("3 kg", "7 kg")
    mixed = ITEM.replace("evening Anna", "evening Carl")
    clean = "Nothing in this text has to do with any of the questions that a benchmark may ask about walking home in the rain at night."
    docs = [(1, "Before it. " + ITEM + " After."), (2, "x " + other), (3, mixed), (4, clean), (5, None), (6, ""), (7, "a b"), (1, "Before it. " + ITEM + " After.")]
    got = leaked(spark, docs, [(10, ITEM), (11, None), (12, ""), (13, "Which of the two rivers is longer")])
    assert (1, 10) in got and (2, 10) in got and got[(2, 10)].consistent
    assert not any(d in (4, 5, 6, 7) for d, _ in got)
    assert (3, 10) not in got or not got[(3, 10)].consistent


PENS = "Tom buys 14 pens for 35 cents each and 6 books for 48 cents each and pays with 90 dollars"


def test_each_copy_is_judged_by_itself(spark):
    second = PENS.replace("14", "20").replace("35", "10").replace("6", "9").replace("48", "77").replace("90", "11")
    equal = PENS.replace("35", "48").replace("14", "6")
    split = second.replace("each and 9", "each and then 9")
    docs = [(1, PENS + " . " + second), (2, second + " . " + second.replace("20", "33")), (3, equal), (4, split), (5, second + " . " + split)]
    got = leaked(spark, docs, [(1, PENS)])
    assert set(got) == {(i, 1) for i in range(1, 6)} and all(r.consistent for r in got.values())
    assert min(r.covered for r in got.values()) >= 13 and got[(3, 1)].covered >= got[(2, 1)].covered == 19


def test_items_with_few_literal_words_are_found_as_they_stand(spark):
    sums = "Compute 12 + 7 + 30 + 45 and then 8 * 9 - 14 and add 5 to 61"
    names = "In Berlin wohnt Anna Schmidt neben Herrn Meier und Frau Krause bei der Kirche am Markt"
    docs = [(1, "First: " + sums + "."), (2, names), (3, "3 of 7 12 " + sums.replace("12", "13").replace("45", "46").replace("9", "10").replace("61", "62")), (4, PENS)]
    got = leaked(spark, docs, [(1, sums), (2, names), (3, PENS)])
    assert set(got) == {(1, 1), (2, 2), (4, 3)} and all(r.covered == r.item_words for r in got.values())


def test_short_items_and_empty_tables(spark):
    got = leaked(spark, [(1, "we ask which of the two rivers is longer now"), (2, "which of the rivers")], [(1, "Which of the two rivers is"), (2, "of the")])
    assert set(got) == {(1, 1)}
    assert leaked(spark, [], [(1, ITEM)]) == {} and leaked(spark, [(1, ITEM)], []) == {}


def test_leaks_are_the_planted_ones(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in O10.op10_template_leaks(spark, sf).collect()}
    plain = lambda s: " ".join(re.findall(r"\w+", s.lower()))
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert got == {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}


def test_reparameterised_questions_are_found(spark):
    """Planted: items with other numbers and names, in documents of other words. Nine in ten at least are found, and no document without one."""
    rng = random.Random(11)
    names, things = ["Anna", "Boris", "Clara", "David", "Elena", "Felix"], ["pens", "books", "apples", "tickets", "bottles", "chairs"]
    shapes = [
        "When {a} buys {n} {t} for {m} dollars each and then gives {k} of them to {b}, how much money did the rest cost",
        "A train with {n} seats leaves at noon and {a} waits {m} minutes for it; after {k} km it meets the slow train that {b} took, so how far is the town",
        "Last summer {a} planted {n} rows of {t} in the garden and {b} watered {m} of them with {k} litres, what share stayed dry",
        "If {a} reads {n} pages on the first day and {m} pages on every day after that, on which day does {b} who reads {k} pages a day fall behind",
    ]
    fill = lambda s: s.format(a=(p := rng.sample(names, 2))[0], b=p[1], n=rng.randrange(10, 99), m=rng.randrange(10, 99), k=rng.randrange(10, 99), t=rng.choice(things))
    items = [(i, fill(s)) for i, s in enumerate(shapes)]
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choices(words, k=k)) + ". "
    same = lambda s, item: fill(s.replace("{t}", next((t for t in things if t in item), "")))
    docs = [(i, text(30) + same(shapes[i % 4], items[i % 4][1]) + "? " + text(30)) for i in range(80)] + [(1000 + i, text(120)) for i in range(40)]
    got = leaked(spark, docs, items)
    assert sum((i, i % 4) in got for i in range(80)) >= 72 and all(d < 1000 and d % 4 == i for d, i in got)


def test_leaks_with_clashing_columns_and_long_texts(spark):
    text = "word after word " * 20_000 + ITEM + " and on " * 5000
    docs = frame(spark, [(1, text, None, None), (2, None, None, None), (2, ITEM, None, None)])
    for c in ("item_id", "w", "slots", "runs", "best", "n"):
        docs = docs.withColumn(c, F.lit("clash"))
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("h", F.lit("clash"))
    assert {(r.doc_id, r.item_id) for r in O10.leaks(docs, items).collect()} == {(1, 7), (2, 7)}


def test_leaks_run_on_the_jvm(spark):
    plan = O10.op10_template_leaks(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


# --- pipeline


def by_hand(spark, sf):
    """The pipeline's rows by other means: rules in SQL, classes by comparing all pairs, brute-force strings, plain search of the items' words, the tokenizers library."""
    import duckdb
    from tokenizers import Tokenizer

    from peakloom.llm.op4_bpe_codec import tokenizer_path
    from peakloom.llm.queries import SQL

    from .common import brute_bytes, sha

    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet{'/*.parquet' if os.path.isdir(f'{sf}/documents.parquet') else ''}')")
    rel = c.sql(SQL["op7_quality_rules"])
    kept = {r[rel.columns.index("doc_id")] for r in rel.fetchall() if r[rel.columns.index("kept")]}
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.doc_id in kept}
    steps = [set(rows)]
    label = linked({i: brute_print(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if label[i] == i}
    steps.append(set(rows))
    gone = {i: bytearray(len((t or "").encode())) for i, t in rows.items()}
    seen = set()
    for i in sorted(rows):
        b = rows[i].encode()
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[i][s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
    assert {i: sum(g) for i, g in gone.items()} == {i: x[1] for i, x in brute_bytes(list(rows.items())).items()}
    rows = {i: bytes(x for x, g in zip(t.encode(), gone[i]) if not g).decode("utf-8", "ignore") for i, t in rows.items()}
    steps.append(dict(rows))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    windows = [[" ".join(x[k : k + 8]) for k in range(len(x) - 7)] for x in items]

    def leaks(text):
        own = words(text)
        held = {" ".join(own[k : k + 8]) for k in range(len(own) - 7)}
        for x, w in zip(items, windows):
            at = {j for k, y in enumerate(w) if y in held for j in range(k, k + 8)}
            if len(at) >= 13 or len(at) >= 0.5 * len(x):
                return True
        return False

    rows = {i: t for i, t in rows.items() if not leaks(t)}
    steps.append(set(rows))
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    out = {}
    for i, t in rows.items():
        ids = library.encode(t, add_special_tokens=False).ids
        out[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    return steps, out


@pytest.mark.parametrize("sf", ["sf0.001", "own"])
def test_pipeline(spark, tmp_path, sf):
    """Every stage and run() against brute force."""
    import corpus_pipeline as P

    if sf == "own":
        rng = random.Random(3)
        item = "which of the seven old bridges over the long river was built before the great flood came"
        vocab = ["".join(rng.choices("abcdefghijklmno", k=rng.randrange(2, 8))) for _ in range(300)]
        text = lambda k: " ".join(rng.choices(vocab, k=k))
        passage = text(40)
        texts = [text(80) for _ in range(30)] + [None, "", "short one"] + [text(50) + " " + passage + " " + text(50) for _ in range(6)] + [text(60) + " " + item + " " + text(60)]
        texts += [texts[0], texts[3], text(20_000), "x " * 3000]
        folder = stored(spark, tmp_path, [(i, t, rng.choice(["en", None]), rng.choice(["s0", None])) for i, t in enumerate(texts)], benchmark=[(1, item), (2, None)])
    else:
        folder = SF
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "bpe_codec"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps, want = by_hand(spark, folder)
    seen = docs
    for k, (name, stage) in enumerate(P.STAGES[:4]):
        seen = stage(spark, seen, folder).cache()
        assert seen.columns == docs.columns, name
        got = {r.doc_id: r.text for r in seen.collect()}
        assert len(got) == seen.count() and (got == steps[k] if k == 2 else set(got) == steps[k]), name
    assert {r.doc_id: tuple(r)[1:] for r in P.run(spark, folder).collect()} == want and want


def test_stages_with_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty tables, repeated ids and columns that clash: each stage but the last keeps the columns, and rows as its docstring says."""
    import corpus_pipeline as P

    long = "The words of this text differ from one another, so " + " ".join(f"w{i} goes to x{i * 7 % 101}," for i in range(40))
    rows = [(None, long, None, None), (1, None, None, None), (2, "", "en", "s"), (3, long, "en", "s"), (3, long, "en", "s"), (4, long[::-1], None, "s"), (4, long.upper(), "en", None)]
    sf = stored(spark, tmp_path, rows[:1], benchmark=[])
    for name, stage in P.STAGES[:4]:
        out = stage(spark, frame(spark, rows), sf)
        assert out.schema.names == frame(spark, rows).schema.names
        ids = [r.doc_id for r in out.collect()]
        assert set(ids) <= {None, 1, 2, 3, 4} and ids.count(3) in ((2,) if name != "quality_rules" else (0, 2)), name
        assert stage(spark, frame(spark, []), sf).count() == 0, name
    assert P.STAGES[4][1](spark, frame(spark, rows), sf).count() == len(rows)
