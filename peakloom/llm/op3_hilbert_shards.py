"""Operator 3, sharding along a Hilbert curve. DataFrame functions only.

Language, source and size are quantised to BITS bits each; their index on a three-dimensional
Hilbert curve orders the rows, so that a run of the order covers a compact box of the three and
file-level minima and maxima prune on any of them. The order is cut into runs whose row counts
differ by one at most (law `rows`). Language and source are quantised by a dictionary: the most
frequent values have a cell each, by rank (ties by value), the others share the last one.

Rows are sorted by range partitions on (curve, checksum of text, size, doc_id): a cell that holds a
third of all rows is split over many tasks, and equal texts of one cell lie side by side. A row's place
is its place in its partition plus the rows of the partitions before; only one count a partition
and the dictionaries (BITS bits each) are ever brought together.

Null text has size 8 and the checksum of no bytes; null language or source quantises to 0. Equal
rows are placed each, in any order among themselves. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets, documents, written

SHARDS, BITS = 24, 4


def hilbert_index(x: int, y: int, z: int, bits: int = BITS) -> int:
    """Index of a cell on the curve (Skilling's transform of the transposed index)."""
    v, top = [x, y, z], 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(3):
            if v[i] & q:
                v[0] ^= p
            else:
                t = (v[0] ^ v[i]) & p
                v[0] ^= t
                v[i] ^= t
        q >>= 1
    for i in (1, 2):
        v[i] ^= v[i - 1]
    t, q = 0, top
    while q > 1:
        if v[2] & q:
            t ^= q - 1
        q >>= 1
    v = [a ^ t for a in v]
    out = 0
    for b in reversed(range(bits)):
        for a in v:
            out = out << 1 | a >> b & 1
    return out


def curve(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """hilbert_index as a column: a table of all cells, built from the rule."""
    n = 1 << bits
    table = F.lit([hilbert_index(a, b, c, bits) for a in range(n) for b in range(n) for c in range(n)])
    return F.element_at(table, ((x * n + y) * n + z + 1).cast("int"))


def coded(docs: DataFrame, column: str) -> Column:
    """The value's cell: 0 for null, its rank by frequency from 1, the last cell for all others. The dictionary has less than 2**BITS rows."""
    last = (1 << BITS) - 1
    top = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(last - 1).collect()
    out = F.when(F.col(column).isNull(), 0)
    for rank, row in enumerate(top):
        out = out.when(F.col(column) == row.v, rank + 1)
    return out.otherwise(last).cast("int")


def placed(docs: DataFrame, shards: int = SHARDS, tasks: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the quantised dimensions."""
    cells = (1 << BITS) - 1
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        coded(docs, "lang").alias("q_lang"), coded(docs, "source").alias("q_source"),
        F.least(F.floor(F.log2(size.cast("double"))) - 3, F.lit(cells)).cast("int").alias("q_size"),
    ).withColumn("curve", curve(F.col("q_lang"), F.col("q_source"), F.col("q_size")))
    order = ["curve", "text_crc32", "size", "doc_id"]
    dealt = narrow.repartitionByRange(tasks or buckets(docs.sparkSession), *order).sortWithinPartitions(*order)
    # the id holds the partition above bit 33 and the place below; written, so that it is drawn once
    fixed = written(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    runs = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # a row a partition
    w = Window.orderBy("_part")
    runs = runs.select("_part", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    numbered = fixed.withColumn("_part", part).join(F.broadcast(runs), "_part").withColumn("g", F.col("before") + place)
    shard = F.expr(f"int((g * {shards}) div total)")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")  # the first place of the shard
    return numbered.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("g") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "curve", "q_lang", "q_source", "q_size",
    )


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
