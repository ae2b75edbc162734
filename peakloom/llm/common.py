"""Shared helpers: reading tables, cutting lineage, dealing packed records to buckets."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract: a run of anything but space, tab, LF, VT, FF, CR.
WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. A temporary one only in local mode, where there is one machine; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="peakloom-")
        spark.conf.set("spark.checkpoint.dir", named) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder. A lost executor costs a reread, not a recomputation. The shuffles behind them are let go, so Spark can delete their files."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/peakloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    spark.sparkContext._jvm.java.lang.System.gc()
    return spark.read.schema(schema).parquet(path)


def buckets(spark: SparkSession, least: int = 1) -> int:
    """How many buckets packed records are dealt to: the shuffle width, or more where the data need more."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_bytes_of(docs: DataFrame) -> int:
    """Bytes of all texts, by a scan of that column."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def utf8(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The bytes of a string column, one after another, and the offsets of its rows (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = memoryview(column.buffers()[1]).cast("q")[column.offset : column.offset + len(column) + 1] if len(column) else [0]
    data = column.buffers()[2]
    return memoryview(data if data is not None else b""), list(offsets)


def per_batch(columns: list[str], types: list[pa.DataType]):
    """Decorates rows(batch) -> column lists; makes a mapInArrow function of it."""
    names = columns

    def wrap(rows):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows(batch), types, strict=True)], names=names)

        return run

    return wrap


def crc_mod5(column: str = "doc_id"):
    """crc32 of the id as decimal text, modulo 5."""
    return F.crc32(F.col(column).cast("string")) % 5
