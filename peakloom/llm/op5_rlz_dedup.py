"""Operator 5, substring dedup by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller doc_id. It is indexed in blocks: sorted
ranges of the texts around its anchors (see `anchored`), dealt by sampled splitters. What a document
can share with a block lies in the contexts that fall into the same range, so it is factored against
every block that could hold a match, and in no other. A block is read in order of documents: each
context that stands as a whole in an earlier document is one factor; any other is parsed greedily from
the left against the index of WINDOW-word strings read so far, a hit being drawn out along its source
as far as the words agree. Windows over a factor's end are looked up
too, and those whose class reaches the end of the block are held against the other blocks.

A document puts its blocks' factors together: those of one source that continue one another are one.
The parse then takes, from left to right, the factor that reaches farthest; words without one are
literals. A greedy factor may stop another one short; what is left of that counts as duplicate if it
and the words before the boundary make WINDOW words that its source holds. So a word is removed
exactly if some window of WINDOW words over it starts in an earlier document.

Null text has no words; texts shorter than a window lose nothing, nor do rows without a doc_id. Rows
that share a doc_id are no reference to one another, equal rows get equal answers; repeats within one
document are kept. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchored import ROW_BITS, Spec, digest, merged, placed, repeated
from .common import documents

WINDOW, GRAM = 13, 5

#: A factor: from, to, and the document, row and word its source begins at; a literal has no source.
Factor = tuple[int, int, int | None, int | None, int | None]


class _Hashes(dict):
    """64-bit hashes of words, as bytes; forgets everything when full."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_digest(word, 7)
        return h


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def word_hashes(text: str | None) -> np.ndarray:
    """Of words, to find anchors by; what is equal is decided on the words."""
    return np.frombuffer(b"".join(map(_hashes.__getitem__, words_of(text))), np.uint64)


def around(words: list[bytes], lo: int, p: int, hi: int) -> tuple[bytes, bytes]:
    """Each word ends in a blank, so texts that share words lie together when sorted."""
    return b" ".join([*words[p:hi], b""]), b" ".join([*words[lo:p], b""])


WORDS = Spec(WINDOW, GRAM, True, word_hashes, words_of, around)


class Block:
    """The index of a reference block: where each whole text stands first, and where each string of WINDOW words starts first. Texts are added in order of documents."""

    def __init__(self, window: int = WINDOW):
        self.window, self.whole, self.first, self.texts = window, {}, {}, []

    def copy(self, text: bytes, doc: int, at: int) -> tuple[int, int, int, int, int] | None:
        """The factor of a text that stands as a whole in an earlier document."""
        hit = self.whole.get(text)
        if hit is None or hit[0] >= doc:
            return None
        return at, at + text.count(b" "), *hit

    def factors(self, text: bytes, ends: list[int], doc: int, row: int, at: int) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
        """Parses a text (words that end in a blank; ends[i] bytes before word i) which starts at word `at` of a document, and adds it.

        Gives copied factors (from, to, source doc, row, word), and the windows that occur here first."""
        W, n, get, out, new = self.window, len(ends) - 1, self.first.get, [], []
        i = done = 0  # windows that end at or before `done` lie in a factor
        me = len(self.texts)
        self.texts.append((text, ends, doc, row, at))
        self.whole.setdefault(text, (doc, row, at))
        while i + W <= n:
            if i + W <= done:
                i += 1
                continue
            key = text[ends[i] : ends[i + W]]
            hit = get(key)
            if hit is None:
                self.first[key] = (me, i)
                new.append(i)
            elif self.texts[hit[0]][2] < doc:
                s_text, s_ends, s_doc, s_row, s_at = self.texts[hit[0]]
                j, end = hit[1] + W, i + W
                while end < n and j + 1 < len(s_ends) and text[ends[end] : ends[end + 1]] == s_text[s_ends[j] : s_ends[j + 1]]:
                    j, end = j + 1, end + 1
                out.append((at + i, at + end, s_doc, s_row, s_at + hit[1]))
                done = end
            else:
                new.append(i)  # of the same document: it may still occur in an earlier one elsewhere
            i += 1
        return out, new


def compare(table: pa.Table, spec: Spec) -> tuple[list, list[tuple[bytes, int, int, int]]]:
    """Of one range: factors of its contexts against the others', and windows whose class may reach into other ranges."""
    by = np.lexsort([table.column(c).to_numpy() for c in ("pos", "row", "doc")])
    table = table.take(pa.array(by))
    W, block, found, sent = spec.window, Block(spec.window), [], []
    suffixes = table.column("suffix").to_pylist()
    least, most = min(suffixes).split(), max(suffixes).split()
    gram = lambda suffix: b" ".join(suffix.split(b" ", spec.gram)[: spec.gram])
    edges, alone = {gram(min(suffixes)), gram(max(suffixes))}, {}  # the only text around each gram, None if there are several
    befores = table.column("before").to_pylist()
    for suffix, before in zip(suffixes, befores):
        if alone.setdefault(gram(suffix), (before, suffix)) != (before, suffix):
            alone[gram(suffix)] = None
    for suffix, before, doc, row, pos in zip(suffixes, befores, *(table.column(c).to_pylist() for c in ("doc", "row", "pos"))):
        text, o = before + suffix, before.count(b" ")
        if whole := block.copy(text, doc, pos - o):
            found.append((doc, row, whole[0] << 32 | whole[1], *whole[2:]))
            continue
        key = gram(suffix)
        if key not in edges and alone[key] is not None:  # nothing but copies of it can share a window
            block.whole.setdefault(text, (doc, row & ROW_BITS, pos - o))
            continue
        words = text.split()
        ends = list(accumulate([len(w) + 1 for w in words], initial=0))
        factors, new = block.factors(text, ends, doc, row & ROW_BITS, pos - o)
        found += [(doc, row, lo << 32 | hi, *source) for lo, hi, *source in factors]
        right = words[o:]
        if new and key in edges:
            # the words from the anchor on which this context shares with an end of the range
            reach = max(shared_words(right, least), shared_words(right, most))
            sent += [(digest(text[ends[k] : ends[k + W]]), doc, row, pos - o + k) for k in new if k + W - o <= reach]
    return list(zip(*found)) or [()] * 6, sent


def shared_words(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def stitched(matches: list[Factor]) -> list[Factor]:
    """Matches of one source that overlap or touch and continue one another, as one."""
    out: list[Factor] = []
    for lo, hi, doc, row, at in sorted(set(matches), key=lambda m: (m[2], m[3], m[4] - m[0], m[0])):
        if out and (last := out[-1])[2:4] == (doc, row) and last[4] - last[0] == at - lo and lo <= last[1]:
            out[-1] = (last[0], max(last[1], hi), *last[2:])
        else:
            out.append((lo, hi, doc, row, at))
    return out


def parse(n: int, matches: list[Factor]) -> list[Factor]:
    """Greedy factors of n words, one after another: from each place the (stitched) match that reaches farthest, else literals."""
    out: list[Factor] = []
    matches = sorted(matches, key=lambda m: (m[0], -m[1], m[2:]))
    at = i = 0
    best: Factor | None = None
    while at < n:
        while i < len(matches) and matches[i][0] <= at:
            if best is None or matches[i][1] > best[1]:
                best = matches[i]
            i += 1
        if best is not None and best[1] > at:
            lo, hi, doc, row, start = best
            out.append((at, min(hi, n), doc, row, start + at - lo))
            at = min(hi, n)
        else:
            stop = min(n, matches[i][0]) if i < len(matches) else n
            out.append((at, stop, None, None, None))
            at = stop
    return out


def duplicates(factors: list[Factor], matches: list[Factor], window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs of words to remove: factors of `window` words; shorter ones, cut at a boundary, if a match over the boundary has as many and holds them."""
    out, whole, i, best = [], sorted(m[:2] for m in matches), 0, (0, 0)
    for lo, hi, doc, *_ in factors:
        while i < len(whole) and whole[i][0] <= lo:
            if whole[i][1] - whole[i][0] >= window:
                best = max(best, whole[i], key=lambda m: m[1])
            i += 1
        if doc is not None and (hi - lo >= window or best[1] >= hi):
            out.append(lo << 32 | hi)
    return merged(out)



def parsed(docs: DataFrame, keep_factors: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors (copied ones); with keep_factors also factors (from, to, s_doc, s_pos; the last two null for literals)."""
    narrow = placed(docs)
    matches = repeated(narrow, WORDS, compare).groupBy("doc", F.col("row").alias("_row")).agg(F.collect_set(F.struct("value", "s_doc", "s_row", "s_pos")).alias("matches"))
    joined = narrow.join(matches, (F.col("doc_id") == F.col("doc")) & (F.col("row") == F.col("_row")), "left").select("doc_id", "text", "matches")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"] + ["factors"] * keep_factors
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("s_doc", pa.int64()), ("s_pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha, count, every = [], [], [], [], []
            lists = batch.column(2)
            fields = [lists.values.field(k).to_pylist() for k in range(4)]
            value, s_doc, s_row, s_pos = fields
            starts = lists.offsets.to_pylist()
            for text, a, b in zip(batch.column(1).to_pylist(), starts, starts[1:]):
                words = words_of(text)
                own = stitched([(v >> 32, v & 0xFFFFFFFF, d, r, p) for v, d, r, p in zip(value[a:b], s_doc[a:b], s_row[a:b], s_pos[a:b])])
                factors = parse(len(words), own)
                kept, at = [], 0
                for lo, hi in duplicates(factors, own):
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(kept))
                count.append(sum(f[2] is not None for f in factors))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                every.append([{"from": f[0], "to": f[1], "s_doc": f[2], "s_pos": f[4]} for f in factors])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(every, kind)] * keep_factors, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long"
    return joined.mapInArrow(run, schema + ", factors array<struct<`from`:int,`to`:int,s_doc:long,s_pos:int>>" * keep_factors)


def op5_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(documents(spark, sf_dir)).drop("n_factors")
