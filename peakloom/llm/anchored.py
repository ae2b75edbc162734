"""Repeated windows of a fixed length in token sequences, exactly, over a whole table.

Every window of WINDOW tokens is represented by the gram of GRAM tokens in it whose hash is least;
equal windows choose equal grams at equal offsets, so only suffixes that start at such anchors need
sorting. Steps:

1. `anchors`: each task lists the anchors of its documents with a hash of the gram. A gram that occurs
   more than once in a batch is known to repeat: its anchors are open at once and one of them is dealt
   to the gram's bucket to say so. The others are dealt as they are, so a gram that every document
   holds sends a row a batch.
2. `settle`: per bucket, anchors whose gram occurs more than once are open; the rest is done. Hashes
   only decide what is looked at: a collision opens an anchor for nothing.
3. `contexts`: open anchors fetch the text around them, the widest that a window through the gram can
   have. Of contexts that are equal byte by byte within a batch only the earliest goes on; the others
   are repeats as a whole, with the earliest as their source.
4. `ranged`: sampled splitters deal the suffixes that start at the anchors to ranges by their leading
   tokens (and what lies before them, so equal suffixes are split too).
5. The operator compares the contexts of a range (op1 in a sorted array, op5 by a parse).
6. `across`: a window whose class reaches the end of a range is held against the first ones of its
   class in the other ranges, by a 128-bit digest of its tokens; at most one row a range and window moves.

A row's place is (doc_id, hash of its text): rows that share a doc_id are apart unless they are equal,
and equal rows get equal answers. "Earlier" is a smaller doc_id, or the same place and an earlier
start; with `other` only a smaller doc_id counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, text_bytes_of, written

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Tokens hashed at once, anchors packed at once, bytes of contexts compared at once.
PIECE, PACK, HELD = 1 << 17, 1 << 19, 32 << 20
#: Bytes of text whose anchors one bucket takes, and contexts that one range takes.
BUCKET_BYTES, RANGE_ROWS = 64 << 20, 60_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's powers 0..n-1 modulo 2**64."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << int(n - 1).bit_length() if n > 1 else 1
        with np.errstate(over="ignore"):
            _powers[0] = tuple(np.concatenate([[U(1)], np.cumprod(np.full(size - 1, b, U))]) for b in (_BASE, _INVERSE))
    return _powers[0][0][:n], _powers[0][1][:n]


def least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    span, now = 1, h
    while span * 2 <= w:
        now = np.minimum(now[:-span], now[span:])
        span *= 2
    rest = w - span
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


@dataclass(frozen=True)
class Spec:
    window: int
    gram: int
    other: bool
    tokens: Callable[[str | None], np.ndarray]  # text -> tokens as unsigned integers
    #: text -> what `around` cuts contexts from
    units: Callable[[str], object]
    #: (units, from, anchor, to) -> the bytes of the tokens from the anchor on, and of those before it, in an order of the operator's choice
    around: Callable[[object, int, int, int], tuple[bytes, bytes]]

    @property
    def reach(self) -> int:
        return self.window - self.gram


def find_anchors(tokens: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of one document's anchors, piece by piece."""
    n, W, K, C = len(tokens), spec.window, spec.gram, spec.reach
    if n < W:
        return np.zeros(0, np.int64), np.zeros(0, U)
    parts = []
    for start in range(0, n - W + 1, PIECE):
        stop = min(n - W + 1, start + PIECE)  # windows starting in [start, stop)
        t = tokens[start : stop - 1 + W]
        power, inverse = powers(len(t) + 1)
        sums = np.zeros(len(t) + 1, U)
        np.cumsum(mix(t.astype(U) + U(0x5851F42D4C957F2D)) * power[:-1], out=sums[1:])
        h = mix((sums[K:] - sums[: len(t) - K + 1]) * inverse[: len(t) - K + 1]) | U(1)
        low = least(h, C + 1)  # of each window
        edge = np.zeros(C, U)
        high = ~least(~np.concatenate([edge, low, edge]), C + 1)
        at = np.nonzero(high == h)[0]
        parts.append((at + start, h[at]))
    if len(parts) == 1:
        return parts[0]
    p, h = (np.concatenate(x) for x in zip(*parts))
    p, first = np.unique(p, return_index=True)
    return p, h[first]


def planes(x: np.ndarray) -> bytes:
    """Byte planes one after another: the high bytes, mostly zero, then compress away."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(raw: memoryview, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


Fields = tuple[tuple[str, type], ...]
ANCHOR: Fields = (("h", np.uint32), ("doc", np.int64), ("row", np.int64), ("pos", np.int32), ("known", np.uint8))
PLACE: Fields = (("doc", np.int64), ("row", np.int64), ("pos", np.int32))


def pack(f: dict[str, np.ndarray], fields: Fields = ANCHOR) -> bytes:
    return b"".join(planes(np.ascontiguousarray(f[k].astype(kind))) for k, kind in fields)


def unpack(packs: Iterable[bytes], fields: Fields = ANCHOR) -> dict[str, np.ndarray]:
    one = sum(np.dtype(kind).itemsize for _, kind in fields)
    out: dict[str, list] = {k: [np.zeros(0, kind)] for k, kind in fields}
    for raw in packs:
        n, at, view = len(raw) // one, 0, memoryview(raw)
        for k, kind in fields:
            size = n * np.dtype(kind).itemsize
            out[k].append(unplanes(view[at : at + size], kind, n))
            at += size
    return {k: np.concatenate(v) for k, v in out.items()}


def take(f: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in f.items()}


def starts(*keys: np.ndarray) -> np.ndarray:
    """Along sorted keys, which rows begin a new class."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def firsts(new: np.ndarray) -> np.ndarray:
    """For each row the first row of its class."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)


def several(h: np.ndarray, doc: np.ndarray, other: bool) -> np.ndarray:
    """Along rows sorted by (h, doc), which belong to a gram of two rows or more (with `other`, of two documents)."""
    new = starts(h)
    group = np.cumsum(new) - 1
    size = np.bincount(group, starts(h, doc) if other else None, minlength=1)
    return size[group] > 1 if len(h) else np.zeros(0, bool)


def anchors(docs: DataFrame, spec: Spec, n: int) -> DataFrame:
    """bucket, early, pack: anchors by the bucket of their gram; early packs are places known to be open, in any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            f = {k: np.concatenate([x[i] for x in held]) for i, k in enumerate(("gram", "doc", "row", "pos"))}
            held.clear()
            f = take(f, np.lexsort((f["pos"], f["row"], f["doc"], f["gram"])))
            again = several(f["gram"], f["doc"], spec.other)
            early, home = take(f, again), take(f, ~again | starts(f["gram"]))
            home["known"] = again[~again | starts(f["gram"])]
            home["h"] = (home["gram"] >> U(32)).astype(np.uint32)
            bucket = (home["gram"] & U(0x7FFFFFFF)).astype(np.int64) % n
            by = np.lexsort((home["pos"], home["doc"], bucket))
            bucket, home = bucket[by], take(home, by)
            cuts = np.append(np.nonzero(starts(bucket))[0], len(bucket)) if len(bucket) else np.zeros(1, np.int64)
            rows = [(int(bucket[a]), False, pack(take(home, slice(a, b)))) for a, b in zip(cuts[:-1], cuts[1:])]
            early = take(early, np.lexsort((early["pos"], early["doc"])))
            for at in range(0, len(early["doc"]), 20_000):
                some = take(early, slice(at, at + 20_000))
                rows.append((int(some["doc"][0] + some["pos"][0]) % n, True, pack(some, PLACE)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "early", "pack"])

        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i in range(batch.num_rows):
                p, h = find_anchors(spec.tokens(batch.column(2)[i].as_py()), spec)
                if len(p):
                    held.append((h, np.full(len(p), ids[i], np.int64), np.full(len(p), rows[i], np.int64), p))
                    count += len(p)
                if count >= PACK:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket int, early boolean, pack binary")


def settle(packs: DataFrame, spec: Spec) -> DataFrame:
    """doc, row, pos of open anchors."""

    def run(table: pa.Table) -> pa.Table:
        packs = list(zip(table.column("early").to_pylist(), table.column("pack").to_pylist()))
        early = unpack((raw for e, raw in packs if e), PLACE)
        f = unpack(raw for e, raw in packs if not e)
        f = take(f, np.lexsort((f["pos"], f["doc"], f["h"])))
        is_open = several(f["h"], f["doc"], spec.other)
        if len(is_open):
            group = np.cumsum(starts(f["h"])) - 1
            is_open |= np.bincount(group, f["known"])[group] > 0
        found = take(f, is_open & (f["known"] == 0))  # the known ones are among the early
        return pa.table({k: pa.array(np.concatenate([found[k], early[k]]), pa.from_numpy_dtype(kind)) for k, kind in PLACE})

    return packs.groupBy("bucket").applyInArrow(run, "doc long, row long, pos int")


#: A span of a place, and where its source begins: doc_id, a few bits of the row's hash (to tell rows of one doc_id apart) and token.
FOUND = "doc long, row long, value long, s_doc long, s_row short, s_pos int"
ROW_BITS = 0x7FFF
CONTEXT = "suffix binary, before binary, pos int, " + FOUND


def span(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo.astype(np.int64) << 32 | hi.astype(np.int64)


def contexts(docs: DataFrame, open_anchors: DataFrame, spec: Spec) -> DataFrame:
    """CONTEXT: with suffix and before, a context that goes on; with value, a span that repeats as a whole, and where its source begins."""
    wanted = open_anchors.groupBy("doc", F.col("row").alias("_row")).agg(F.collect_list("pos").alias("at"))
    joined = docs.join(wanted, (F.col("doc_id") == F.col("doc")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "text", "at")
    C, W, names = spec.reach, spec.window, [x.split()[0] for x in CONTEXT.split(", ")]
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for key, place, lo, hi in held:
                source = first[key]
                if place[0] > source[0] or (not spec.other and place[:2] == source[:2] and place[2] > source[2]):
                    rows.append((None, None, None, place[0], place[1], lo << 32 | hi, source[0], source[1] & ROW_BITS, source[2] - place[2] + lo))
                else:
                    rows.append((*key, place[2], place[0], place[1], None, None, None, None))
            first.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            docs, rows, places = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for i, (doc, row) in enumerate(zip(docs, rows)):
                units = spec.units(batch.column(2)[i].as_py())
                n = len(units)
                for p in places[i].as_py():
                    lo, hi = max(0, p - C), min(n, p + W)
                    key, place = spec.around(units, lo, p, hi), (doc, row, p)
                    if first.setdefault(key, place) > place:
                        first[key] = place
                    held.append((key, place, lo, hi))
                    size += len(key[0]) + len(key[1]) + 100
                    if size > HELD:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return joined.mapInArrow(run, CONTEXT)


def ranged(going: DataFrame, rows: int) -> DataFrame:
    """suffix, before, doc, row, pos in ranges by the splitters that Spark samples; as many as the rows need."""
    n = max(buckets(going.sparkSession), -(-rows // RANGE_ROWS))
    return going.select("suffix", "before", "doc", "row", "pos").repartitionByRange(n, "suffix", "before", "doc", "row", "pos")


def twins(new: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray, other: bool) -> np.ndarray:
    """Along rows sorted by (class, doc, row, pos), which have an earlier one in their class."""
    out = doc > doc[firsts(new)]
    if not other and len(new):
        out |= pos > pos[firsts(new | starts(doc, row))]
    return out


def digest(window: bytes) -> bytes:
    return hashlib.blake2b(window, digest_size=16).digest()


REACHING: Fields = (("k1", np.uint64), ("k2", np.uint64), ("doc", np.int64), ("row", np.int64), ("pos", np.int32))


def reaching(sent: list[tuple[bytes, int, int, int]], n: int) -> tuple[list[int], list[bytes]]:
    """Buckets and packs of (digest of a window, doc, row, start)."""
    if not sent:
        return [], []
    key = np.frombuffer(b"".join([s[0] for s in sent]), np.uint64).reshape(-1, 2)
    f = {"k1": key[:, 0], "k2": key[:, 1]} | {k: np.array(v, np.int64) for k, v in zip(("doc", "row", "pos"), list(zip(*sent))[1:])}
    bucket = (f["k1"] % U(n)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    bucket, f = bucket[by], take(f, by)
    cuts = np.append(np.nonzero(starts(bucket))[0], len(bucket))
    return bucket[cuts[:-1]].tolist(), [pack(take(f, slice(a, b)), REACHING) for a, b in zip(cuts[:-1], cuts[1:])]


def across(compared: DataFrame, spec: Spec) -> DataFrame:
    """FOUND: windows of classes that reach over ranges, but for each class's earliest. A range has sent of a class only windows without an earlier twin in it."""

    def run(table: pa.Table) -> pa.Table:
        f = unpack(table.column("pack").to_pylist(), REACHING)
        f = take(f, np.lexsort((f["pos"], f["row"], f["doc"], f["k2"], f["k1"])))
        new = starts(f["k1"], f["k2"])
        later = twins(new, f["doc"], f["row"], f["pos"], spec.other)
        source = take(f, firsts(new)[later])
        f = take(f, later)
        cols = [f["doc"], f["row"], span(f["pos"], f["pos"].astype(np.int64) + spec.window), source["doc"], (source["row"] & ROW_BITS).astype(np.int16), source["pos"]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int16(), pa.int32()])], names=[x.split()[0] for x in FOUND.split(", ")])

    return compared.where("bucket is not null").select("bucket", "pack").groupBy("bucket").applyInArrow(run, FOUND)


#: What a range's comparison gives: found spans, or the packs for other ranges.
COMPARED = FOUND + ", bucket int, pack binary"


def compared_rows(found: list, sent: list[tuple[bytes, int, int, int]], n: int) -> Iterator[pa.RecordBatch]:
    """COMPARED from columns of FOUND and windows that may go on in other ranges."""
    names = [x.split()[0] for x in COMPARED.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int16(), pa.int32(), pa.int32(), pa.binary()]
    m = len(found[0])
    if m:
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(found, kinds)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
    bucket, packs = reaching(sent, n)
    if packs:
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(packs), t) for t in kinds[:6]), pa.array(bucket, pa.int32()), pa.array(packs, pa.binary())], names=names)


Compare = Callable[[pa.Table, Spec], tuple[list, list[tuple[bytes, int, int, int]]]]


def repeated(docs: DataFrame, spec: Spec, compare: Compare) -> DataFrame:
    """FOUND: spans (lo << 32 | hi, in tokens; they overlap) whose windows have earlier twins, and the place of one. docs: doc_id, row, text."""
    docs = docs.where("doc_id is not null")
    n = buckets(docs.sparkSession, -(-text_bytes_of(docs) // BUCKET_BYTES))
    told = written(settle(anchors(docs, spec, n), spec))
    around = written(contexts(docs, told, spec))
    going = around.where("suffix is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield from compared_rows(*compare(pa.Table.from_batches(held), spec), n)

    compared = written(ranged(going, going.count()).mapInArrow(run, COMPARED))
    names = [x.split()[0] for x in FOUND.split(", ")]
    return around.where("suffix is null").select(*names).unionByName(compared.where("bucket is null").select(*names)).unionByName(across(compared, spec))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, row (with doc_id the row's place), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of a document's spans; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for v in sorted(spans or ()):
        lo, hi = v >> 32, v & 0xFFFFFFFF
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out
