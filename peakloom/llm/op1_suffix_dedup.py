"""Operator 1, suffix-array dedup of byte strings.

Removes each byte that a string of LENGTH bytes covers which also starts earlier in the corpus. The
suffix array is sparse: it holds the suffixes that start at content-defined anchors, of which every
string of LENGTH bytes contains one, and of those only the ones whose leading bytes repeat (see
`anchored`). Suffixes are range-partitioned by sampled splitters, sorted in their range by multikey
quicksort, compared with their neighbours, and held against other ranges at the boundaries. Within a
range two strings are equal if their suffixes share enough leading bytes and what lies before the
anchors, sorted the same way, does too: bytes decide, no hash does.

Null and short texts lose nothing (null counts as empty), nor do rows without a doc_id. Rows that
share a doc_id are apart: neither starts earlier than the other, so each keeps what only they share;
equal rows get equal answers. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchored import Spec, digest, merged, placed, repeated, span, twins
from .common import documents

LENGTH, GRAM = 100, 30
U = np.uint64


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def around(raw: bytes, lo: int, p: int, hi: int) -> tuple[bytes, bytes]:
    return raw[p:hi], raw[lo:p][::-1]


BYTES = Spec(LENGTH, GRAM, False, text_bytes, str.encode, around)


def characters(rows: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded to `size` bytes (a multiple of 8) as big-endian 8-byte characters, and their lengths."""
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = b"".join([r.ljust(size, b"\0") for r in rows])
    return np.frombuffer(flat, ">u8").reshape(len(rows), size // 8).astype(U), n


def multikey(chars: np.ndarray) -> np.ndarray:
    """An order of the rows by multikey quicksort, breadth first: at each depth every class of still equal rows is split by one character; only classes that stay equal go on."""
    n, depth = chars.shape
    order = np.arange(n)
    at, group = np.arange(n), np.zeros(n, np.int64)  # places that are not settled, and their classes
    for d in range(depth):
        if not len(at):
            break
        c = chars[order[at], d]
        by = np.lexsort((c, group))
        order[at], c = order[at[by]], c[by]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (c[1:] != c[:-1])
        size = np.diff(np.append(np.nonzero(new)[0], len(at)))
        open_ = np.repeat(size > 1, size)
        at, group = at[open_], np.cumsum(new)[open_]
    return order


def common(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 14):
        part = rows[a - 1 : a + (1 << 14)]
        differ = part[1:] != part[:-1]
        out[a : a + len(differ)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def sorted_array(rows: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted order, each row's length (as given), and what each shares with the one before it in the order."""
    size = max(8, -(-size // 8) * 8)
    chars, length = characters(rows, size)
    order = multikey(chars)
    return order, length, common(chars[order].astype(">u8").view(np.uint8).reshape(len(rows), size))


def compare(table: pa.Table, spec: Spec) -> tuple[list, list[tuple[bytes, int, int, int]]]:
    """Of one range: spans of windows with an earlier twin, and windows whose class may reach into other ranges."""
    W, C = spec.window, spec.reach
    suffix, before = table.column("suffix").to_pylist(), table.column("before").to_pylist()
    by = np.lexsort([table.column(c).to_numpy() for c in ("pos", "row", "doc")])
    suffix, before = [suffix[i] for i in by], [before[i] for i in by]
    doc, row, pos = (table.column(c).to_numpy()[by].astype(np.int64) for c in ("doc", "row", "pos"))
    order, length, shared = sorted_array(suffix, W)
    back, left, left_shared = sorted_array(before, C)
    m = len(doc)
    right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
    low, high = np.full(m, C + 1), np.full(m, -1)  # least and greatest offset with an earlier twin
    sent = []
    for o in range(C + 1):
        need = W - o
        right_class[order] = np.cumsum(shared < need)  # suffixes that share `need` bytes lie together
        left_class[back] = np.cumsum(left_shared < o)
        rows = np.nonzero((left >= o) & (length >= need))[0]  # by document and position
        if not len(rows):
            continue
        key = right_class[rows] * (m + 2) + left_class[rows]
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        new = np.append(True, key[1:] != key[:-1])
        twin = twins(new, doc[rows], row[rows], pos[rows], spec.other)
        hit = rows[twin]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = np.maximum(high[hit], o)
        ends = right_class[order[0]], right_class[order[-1]]
        for i in rows[~twin & ((right_class[rows] == ends[0]) | (right_class[rows] == ends[1]))].tolist():
            sent.append((digest(before[i][:o][::-1] + suffix[i][:need]), doc[i], row[i], pos[i] - o))
    hit = np.nonzero(high >= 0)[0]
    # all windows between the least and greatest offset contain the gram; their union is one span
    none = np.full(len(hit), None)
    return [doc[hit], row[hit], span(pos[hit] - high[hit], pos[hit] - low[hit] + W), none, none, none], sent


def spans_of(docs: DataFrame) -> DataFrame:
    """doc, row, spans; docs as `placed` gives them."""
    return repeated(docs, BYTES, compare).groupBy("doc", F.col("row").alias("_row")).agg(F.collect_set("value").alias("spans"))


def rest(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in runs:
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]])


def trimmed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    narrow = placed(docs)
    joined = narrow.join(spans_of(narrow), (F.col("doc_id") == F.col("doc")) & (F.col("row") == F.col("_row")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, count, sha = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, runs = (text or "").encode(), merged(spans)
                n.append(len(raw))
                gone.append(sum(hi - lo for lo, hi in runs))
                count.append(len(runs))
                sha.append(hashlib.sha256(rest(raw, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trimmed(documents(spark, sf_dir))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated strings. Characters that a cut splits are dropped; n_chars follows the text. Every row stays, with null text as it is; rows that share a doc_id as in the operator; further columns pass through."""
    spans = spans_of(placed(docs)).select(F.col("doc").alias("__doc"), F.col("_row").alias("__row"), F.col("spans").alias("__spans"))
    joined = docs.join(spans, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__row")), "left")
    schema = docs.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {name: batch.column(name) for name in names}
            texts = [t if t is None or not s else rest(t.encode(), merged(s)).decode("utf-8", "ignore") for t, s in zip(table["text"].to_pylist(), batch.column("__spans").to_pylist())]
            table["text"] = pa.array(texts, pa.string())
            if "n_chars" in table:
                table["n_chars"] = pa.array([None if t is None else len(t) for t in texts], table["n_chars"].type)
            yield pa.RecordBatch.from_arrays([table[name] for name in names], names=names)

    return joined.select(*[F.col(f"`{c}`") for c in names], "__spans").mapInArrow(run, schema)
