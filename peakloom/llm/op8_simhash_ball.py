"""Operator 8, SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in RADIUS bits or fewer exactly if some value lies within half the radius
of both. Every distinct fingerprint therefore stands for all variants within that half; variants
are dealt by their leading bits, equal variants collide, and colliding fingerprints are verified
and linked. Sending each variant would move 2081 rows a fingerprint. Instead a fingerprint is sent
once to each variant range (leading bits) that its ball meets, and the range's task lists the
variants that fall into it, slice by slice, so memory stays bounded. A range with more than MOST
fingerprints, as a large family of near copies makes it, is cut at further bits until it has not.

Fingerprints that meet in one variant are all within the radius of one another, so a chain through
them loses no connection; the task keeps a spanning forest of its links. Components of the forest
edges over all ranges give each fingerprint its class, and a join gives it to the documents.

Null and empty texts have fingerprint zero and link like any other. Copies share a fingerprint and
count once. A repeated doc_id keeps its rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written
from .components import components

RADIUS, BITS, SHINGLE, SEED = 4, 64, 4, 42
#: Variants that one slice of a range's task holds at once.
SLICE = 1 << 21
#: Fingerprints that one range holds at most, bits by which a larger one is cut, and ranges whose prefixes are broadcast.
MOST, DEEPER, SMALL = 50_000, 4, 100_000


def shingle_hashes(text: str) -> np.ndarray:
    words = text.encode().lower().split()  # bytes: lowers A-Z only, splits at the contract's six characters
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: str) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def masks(bits: int, most: int) -> np.ndarray:
    """All masks of `bits` low bits with up to `most` set."""
    return np.array([sum(1 << b for b in c) for k in range(min(most, bits) + 1) for c in combinations(range(bits), k)], np.uint64)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given edges among 0..n-1."""
    parent = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((min(x, y), max(x, y)))
    return out


def met(prefix: int, fps: np.ndarray, lead: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (chains) of the fingerprints whose balls of half the radius meet in the range of this prefix."""
    half, rest = radius // 2, BITS - lead
    apart = np.bitwise_count(fps >> np.uint64(rest) ^ np.uint64(prefix))
    low = fps & np.uint64((1 << rest) - 1)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    full = sum(int((apart == k).sum()) * len(masks(rest, half - k)) for k in range(half + 1))
    # slices by bits below the prefix: each holds the variants with those bits
    cut = min(rest, max(0, int(np.ceil(np.log2(max(1, full / SLICE))))))
    by_flips = [masks(rest, half - k) for k in range(half + 1)]
    for part in range(1 << cut):
        values, who = [], []
        for k in range(half + 1):
            mine = np.nonzero(apart == k)[0]
            if not len(mine):
                continue
            if not cut:
                v = (low[mine][:, None] ^ by_flips[k][None, :]).ravel()
                values.append(v)
                who.append(np.repeat(mine, len(by_flips[k])))
                continue
            head = rest - cut
            need = low[mine] >> np.uint64(head) ^ np.uint64(part)
            used = np.bitwise_count(need)
            tail = low[mine] & np.uint64((1 << head) - 1)
            for f in range(half - k + 1):
                sub = used == f
                if sub.any():
                    m = masks(head, half - k - f)
                    values.append((tail[sub][:, None] ^ m[None, :]).ravel())
                    who.append(np.repeat(mine[sub], len(m)))
        if not values:
            continue
        v, w = np.concatenate(values), np.concatenate(who)
        order = np.argsort(v, kind="stable")
        v, w = v[order], w[order]
        same = np.nonzero(v[1:] == v[:-1])[0]
        a, b = w[same], w[same + 1]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius  # the verification
        pair = np.unique(np.minimum(a, b)[near] << 32 | np.maximum(a, b)[near])
        left.append(pair >> 32)
        right.append(pair & 0xFFFFFFFF)
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, node -> u, v: edges between nodes that connect all fingerprints within the radius of one another."""
    n, half = fps.count(), radius // 2
    lead = int(min(24, max(8, np.ceil(np.log2(max(1, n * 2081 / (2 * SLICE)))))))
    dealt = deepened(fps.select("fp", "node", F.lit(0).alias("lead"), F.lit(0).cast("long").alias("prefix")), 0, lead, half)
    done: DataFrame | None = None
    while True:  # ranges with too many fingerprints for one task are cut at further bits
        dealt = written(dealt)
        large = dealt.groupBy("prefix").count().where(F.col("count") > MOST).select("prefix")
        m = 0 if lead + DEEPER > BITS - 8 else large.count()
        if not m:
            break
        few = F.broadcast(large) if m <= SMALL else large
        small = dealt.join(few, "prefix", "left_anti")
        done = small if done is None else done.unionByName(small)
        dealt, lead = deepened(dealt.join(few, "prefix", "left_semi"), lead, lead + DEEPER, half), lead + DEEPER
    dealt = dealt if done is None else done.unionByName(dealt)

    def run(table: pa.Table) -> pa.Table:
        prefix, lead = table.column("prefix")[0].as_py(), table.column("lead")[0].as_py()
        fp, node = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        fp, node = fp[order], node[order]
        a, b = met(prefix, fp, lead, radius)
        edges = forest(a, b, len(fp))
        return pa.table({"u": pa.array([int(node[y]) for _, y in edges], pa.int64()), "v": pa.array([int(node[x]) for x, _ in edges], pa.int64())})

    return dealt.groupBy("lead", "prefix").applyInArrow(run, "u long, v long")


def deepened(dealt: DataFrame, old: int, new: int, half: int) -> DataFrame:
    """fp, node, lead, prefix by the `new` leading bits instead of the `old`: each fingerprint goes to every range that its ball of half the radius still meets."""
    width = new - old
    flips = F.lit([int(m) for m in masks(width, half)])
    head = lambda bits: F.shiftrightunsigned("fp", BITS - bits) if bits else F.lit(0).cast("long")
    used = F.bit_count(head(old).bitwiseXOR(F.col("prefix"))) + F.bit_count("m")
    prefix = F.shiftleft("prefix", width).bitwiseOR(head(new).bitwiseAND((1 << width) - 1).bitwiseXOR(F.col("m")))
    return dealt.withColumn("m", F.explode(flips)).where(used <= half).select("fp", "node", F.lit(new).alias("lead"), prefix.alias("prefix"))


def classed(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    prints = written(fingerprints(docs))  # two longs a document
    nodes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))  # a class of equal fingerprints
    found = components(links(nodes, radius))
    classes = nodes.join(found, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, F.col("fp") == F.col("_fp"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(documents(spark, sf_dir))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one of the smallest doc_id (all rows of that id). Null and empty texts are one class; rows without a doc_id go. Further columns pass through."""
    lasting = classed(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(lasting, F.col("doc_id") == F.col("_kept_id"), "left_semi")
