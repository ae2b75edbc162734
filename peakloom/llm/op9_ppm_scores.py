"""Operator 9, language-model scoring by prediction by partial matching over bytes.

A trie of byte contexts up to ORDER bytes is counted over all training documents. A symbol not seen
in a context escapes to the next shorter one with probability D / (T + D), T the context's count and
D its distinct symbols (escape method C); symbols already offered by the longer context are excluded
below it. For a trained trie the code length of a symbol depends on its context alone, so the trie
is found once: symbols seen after their longest context have it by their counts, the rest walk down
the orders. The trie is dealt to buckets by the last NEAR bytes of the context: all strings that the
walk of a symbol meets above that order lie in one bucket, and the strings of at most NEAR bytes (65,792
at most) are known to every bucket. So the order is the same for a corpus of any size.

Documents are dealt to groups of bounded size; a group sends its distinct strings of ORDER + 1 bytes,
once each, with their counts in training texts to the strings' buckets; a bucket adds up and answers
each group with the code lengths, in the order it asked. The unigram baseline's words go the same way.
So a word in every document moves once a group, and neither trie nor word table is ever gathered.
There are at most 65,536 buckets and only those asked are written to, so rows grow with the texts. How
many training words there are, and how many distinct, is summed over the buckets in one row.

Null texts count as empty; an empty text has one token, the end. Only doc_id and text are read;
repeated rows are scored (and counted) each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchored import planes, unplanes
from .common import buckets, crc_mod5, documents, text_bytes_of

ORDER = 5
#: Bytes of a context that decide its bucket.
NEAR = 2
#: The byte before a text and after it; UTF-8 never has it.
EDGE = 0xFF
#: Bytes of text that a group should hold.
GROUP_BYTES = 6 << 20
#: Bytes counted or scored at once.
PIECE = 4 << 20
#: Bytes of text whose strings one bucket answers, in as many groups as they lie.
BUCKET_BYTES = 32 << 20


# --- the trie -----------------------------------------------------------------------------------


def codes(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end: the `order` bytes before it and itself, as one number. And where each text begins."""
    edge = bytes([EDGE])
    raw = [edge * order + (t or "").encode() + edge for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    sizes = np.array([len(x) for x in raw], np.int64)
    code = np.zeros(max(0, len(b) - order), np.int64)
    for k in range(order + 1):
        code = code << 8 | b[k : len(b) - order + k]
    # positions whose string would begin in one text and end in the next
    ends = np.cumsum(sizes)
    inside = np.ones(len(code), bool)
    for k in range(1, order + 1):
        inside[ends[:-1] - k] = False
    return code[inside], np.concatenate([[0], np.cumsum(sizes - order)])


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([p[1] for p in parts]), minlength=len(code)).astype(np.int64)


def near_strings(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The strings of at most NEAR bytes of all texts, and their counts: at most 65,536 rows, added up before they reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 8 * NEAR, np.int64)
        held, size = [], 0

        def add() -> None:
            total[:] += np.bincount(codes(held, NEAR - 1)[0], minlength=len(total))
            held.clear()

        for batch in batches:
            column = batch.column(0)
            for i in range(batch.num_rows):
                held.append(t := column[i].as_py())
                size += len(t or "") + NEAR
                if size >= PIECE:
                    add()
                    size = 0
        if held:
            add()
        code = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    rows = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    return rows.column("code").to_numpy(), rows.column("n").to_numpy().astype(np.float64)


def found(among: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(among):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return at, among[at] == x


class Table:
    """A hash table from codes to numbers."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(2 * len(code)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        slot, todo = self.slot(code), np.arange(len(code))
        self.probes = 0
        while len(todo):  # linear probing, all at once: the first to claim a free slot has it
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = code[won], value[won]
            todo = todo[self.keys[slot[todo]] != code[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each code's number, and where there is none."""
        out, slot, todo = np.zeros(len(code), np.float64), self.slot(code), None
        key = self.keys[slot]
        hit = key == code
        out[hit] = self.values[slot[hit]]
        todo = np.nonzero(~hit)[0]
        missed = [todo[key[todo] == -1]]
        todo = todo[key[todo] != -1]
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            key = self.keys[slot[todo]]
            hit = key == code[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            missed.append(todo[key == -1])
            todo = todo[~hit & (key != -1)]
        return out, np.concatenate([*missed, todo])


class Model:
    """The trie by order: strings with counts, contexts with escapes, and what a context leaves to the next shorter one.

    near: all strings of NEAR bytes with counts, where code holds the strings of one bucket only.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, order: int, near: tuple[np.ndarray, np.ndarray] | None = None):
        self.order, self.levels = order, []
        for k in range(order + 1):
            own, own_n = near if near and k < NEAR else (code, n)
            c, at = np.unique(own & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(at, own_n, minlength=len(c))
            ctx, row = np.unique(c >> 8, return_inverse=True)
            total, kinds = np.bincount(row, count, minlength=len(ctx)), np.bincount(row, minlength=len(ctx)).astype(np.float64)
            level = {"code": c, "n": count, "ctx": ctx, "bottom": total + kinds, "escape": kinds / np.maximum(total + kinds, 1), "kinds": kinds, "total": total}
            if k:  # the shorter context without the symbols that this one offers
                low = self.levels[-1]
                own, _ = found(low["code"], c & ((1 << 8 * k) - 1))
                up, _ = found(low["ctx"], ctx & ((1 << 8 * (k - 1)) - 1))
                left = low["total"][up] - np.bincount(row, low["n"][own], minlength=len(ctx)) if len(ctx) else np.zeros(0)
                kinds_left = low["kinds"][up] - kinds if len(ctx) else np.zeros(0)
                level["low_bottom"] = np.maximum(left + kinds_left, 1)
                level["low_escape"] = np.where(left > 0, kinds_left / level["low_bottom"], 1.0)
            self.levels.append(level)
            if k:  # what only the next longer context needs
                del low["total"]
                low["kinds"] = low["kinds"][:1]
                for name in ("n", "bottom", "escape", "low_bottom", "low_escape"):
                    if name in low:
                        low[name] = low[name].astype(np.float32)
        top = self.levels[-1]
        row, _ = found(top["ctx"], top["code"] >> 8)
        value = np.log10(top["n"] / top["bottom"][row]) if len(row) else np.zeros(0)
        self.table = Table(top["code"], value)

    def log(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each code's last byte after those before it."""
        out, missed = self.table.get(code)
        out[missed] = self.walked(code[missed])
        return out

    def walked(self, code: np.ndarray) -> np.ndarray:
        """The same by walking down the orders, with escapes and exclusions."""
        out, longer, live = np.zeros(len(code)), np.full(len(code), -1, np.int64), np.arange(len(code))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            c = code[live] & ((1 << 8 * (k + 1)) - 1)
            row, known = found(level["ctx"], c >> 8)
            at, seen = found(level["code"], c)
            if not len(level["ctx"]):
                continue
            above = longer[live]
            bottom, escape = level["bottom"][row], level["escape"][row]
            if k < self.order:
                up = self.levels[k + 1]
                cut = above >= 0
                bottom = np.where(cut, up["low_bottom"][np.maximum(above, 0)], bottom) if len(up["ctx"]) else bottom
                escape = np.where(cut, up["low_escape"][np.maximum(above, 0)], escape) if len(up["ctx"]) else escape
            out[live] += np.where(seen, np.log10(level["n"][at] / bottom), np.where(known, np.log10(np.maximum(escape, 1e-300)), 0.0))
            longer[live] = np.where(known, row, -1)
            live = live[~seen]
        kinds = self.levels[0]["kinds"]
        out[live] -= np.log10(256 - (kinds[0] if len(kinds) else 0))
        return out


def total_scores(texts: list[str | None], order: int, table: Table) -> np.ndarray:
    """log10 probability of each text and its end."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < PIECE // 8):
            size += len(texts[stop] or "")
            stop += 1
        code, first = codes(texts[at:stop], order)
        out[at:stop] = np.add.reduceat(table.get(code)[0], first[:-1])
        at = stop
    return out


def asked_codes(texts: list[str | None], train: list[bool], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each bucket a group's distinct strings in order, and their training counts."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for kind in (True, False):
        held, size = [], 0
        for t in [*(t for t, own in zip(texts, train) if own == kind), None]:
            if t is not None:
                held.append(t)
                size += len(t) + ORDER + 1
            if held and (t is None or size >= PIECE // 4):
                code, count = np.unique(codes(held, ORDER)[0], return_counts=True)
                parts.append((code, count if kind else np.zeros(len(code), np.int64)))
                held, size = [], 0
    code, count = added(parts)
    bucket = (code >> 8 & ((1 << 8 * NEAR) - 1)) * 40_503 % 65_521 % n
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(n + 1))
    return [(code[by[a:b]], count[by[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]


def answered(packs: list[memoryview], near: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """A bucket's answers: the log10 probabilities of the strings of each pack."""
    parts, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    asks = lambda raw: unplanes(raw, np.int64, len(raw) // 12)
    for raw in packs:
        m = len(raw) // 12
        parts.append((asks(raw), unplanes(raw[8 * m :], np.uint32, m)))
        size += m
        if size >= 2_000_000:
            parts, size = [added(parts)], 0
    code, n = added(parts)
    value = Model(code[n > 0], n[n > 0].astype(np.float64), ORDER, near).log(code).astype(np.float32)
    return [planes(value[np.searchsorted(code, asks(raw))]) for raw in packs]


# --- the words ----------------------------------------------------------------------------------


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def asked(texts: Iterable[list[bytes]], train: list[bool], n: int) -> tuple[dict[bytes, int], list[tuple[np.ndarray, np.ndarray]]]:
    """A group's distinct words, and for each bucket their hashes in order and their training counts."""
    count: Counter = Counter()
    for own, t in zip(texts, train):
        if t:
            count.update(own)
        else:
            count.update(dict.fromkeys(own, 0))
    names = list(count)
    h = np.fromiter((xxhash.xxh64_intdigest(w, 9) for w in names), np.uint64, len(names))
    c = np.fromiter(count.values(), np.uint32, len(names))
    bucket = (h % np.uint64(n)).astype(np.int64)
    order = np.lexsort((h, bucket))
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    return dict(zip(names, place.tolist())), [(h[order[a:b]], c[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_mod5() == 1, F.lit(False)).alias("held_out"))
    near = near_strings(tagged.where("not held_out"))
    size = text_bytes_of(tagged)
    ends = tagged.where("not held_out").count()
    n = min(buckets(docs.sparkSession, -(-size // BUCKET_BYTES)), 1 << 8 * NEAR)
    groups = max(4, -(-size // GROUP_BYTES))
    dealt = tagged.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        train = [not x for x in table.column("held_out").to_pylist()]
        whole = table.column("text").to_pylist()
        _, asks = asked((words(t) for t in whole), train, n)
        strings = asked_codes([t or "" for t in whole], train, n)
        rows = [(b, np.int64(len(h)).tobytes() + planes(h) + planes(c) + planes(code) + planes(count.astype(np.uint32))) for b, ((h, c), (code, count)) in enumerate(zip(asks, strings)) if len(h) + len(code)]
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "grp": pa.array([grp] * len(rows), pa.int32()), "pack": pa.array([raw for _, raw in rows], pa.binary())})

    def unpacked(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[memoryview]]:
        """Of a bucket's packs the words' hashes, their training counts, and the strings as they came."""
        hs, cs, strings = [], [], []
        for raw in table.column("pack").to_pylist():
            m = int(np.frombuffer(raw, np.int64, 1)[0])
            view = memoryview(raw)[8:]
            hs.append(unplanes(view[: 8 * m], np.uint64, m))
            cs.append(unplanes(view[8 * m :], np.uint32, m))
            strings.append(view[12 * m :])
        return hs, cs, strings

    def totals(hs: list[np.ndarray], cs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate(hs), return_inverse=True)
        return at, np.bincount(at, np.concatenate(cs), minlength=len(h)).astype(np.uint64)

    def fact(table: pa.Table) -> pa.Table:
        """The bucket's training words, and distinct training words."""
        hs, cs, _ = unpacked(table)
        _, total = totals(hs, cs)
        return pa.table({"_tokens": pa.array([int(total.sum())], pa.int64()), "_kinds": pa.array([int((total > 0).sum())], pa.int64())})

    def answer(table: pa.Table) -> pa.Table:
        """To each group its numbers, in the order it asked."""
        hs, cs, strings = unpacked(table)
        at, total = totals(hs, cs)
        cuts = np.cumsum([0, *map(len, hs)])
        packs = [planes(total[at[a:b]]) + own for a, b, own in zip(cuts[:-1], cuts[1:], answered(strings, near))]
        return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "pack": pa.array(packs, pa.binary())})

    asks = dealt.groupBy("grp").applyInArrow(ask, "bucket int, grp int, pack binary")
    answers = asks.groupBy("bucket").applyInArrow(answer, "grp int, bucket int, pack binary")
    facts = asks.groupBy("bucket").applyInArrow(fact, "_tokens long, _kinds long")  # from the same shuffle
    facts = facts.agg((F.coalesce(F.sum("_tokens"), F.lit(0)) + ends).alias("_tokens"), (F.coalesce(F.sum("_kinds"), F.lit(0)) + int(ends > 0)).alias("_kinds"))

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "log", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        whole = table.column("text").to_pylist()
        held = table.column("held_out").to_pylist()
        place, asks = asked(map(words, whole), [not x for x in held], n)
        strings = [code for code, _ in asked_codes([t or "" for t in whole], [not x for x in held], n)]
        counts, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        for b, raw in sorted(zip(answers.column("bucket").to_pylist(), answers.column("pack").to_pylist())):
            m, view = len(asks[b][0]), memoryview(raw)
            counts.append(unplanes(view, np.uint64, m))
            values.append(unplanes(view[8 * m :], np.float32, len(strings[b])))
        c = np.concatenate(counts).astype(np.float64)
        log, known = np.log10(c + 0.5), (c > 0).astype(np.int64)
        table_of = Table(np.concatenate(strings), np.concatenate(values))
        n_tokens, n_known, base = [], [], []
        for own in map(words, whole):
            at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            n_tokens.append(len(own) + 1)
            n_known.append(int(known[at].sum()) + (ends > 0))
            base.append(float(log[at].sum() + np.log10(ends + 0.5)))
        cols = [table.column("doc_id").to_pylist(), held, n_tokens, n_known, base, total_scores(whole, ORDER, table_of)]
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds)], names=names)

    by_group = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, log double, score double")
    base = F.col("log") - F.col("n_tokens") * F.log10(F.col("_tokens") + 0.5 * (F.col("_kinds") + 1))
    return by_group.crossJoin(F.broadcast(facts)).select("doc_id", "held_out", "n_tokens", "n_known", F.col("_tokens").alias("train_tokens"), base.alias("base_score"), "score")  # facts: one row


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
