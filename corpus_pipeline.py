"""From raw documents to training tokens in five stages; each is written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from peakloom.llm.common import shared_dir
from peakloom.llm.op1_suffix_dedup import suffix_stage
from peakloom.llm.op4_bpe_codec import encoded
from peakloom.llm.op7_quality_rules import quality_stage
from peakloom.llm.op8_simhash_ball import simhash_stage
from peakloom.llm.op10_template_leaks import leak_stage


def codec_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' and decodings' digests of what is left: a row per document with the columns of op4. Null and empty texts have no tokens; repeated ids keep their rows; an empty table gives none; other columns are not read."""
    return encoded(docs)


STAGES = [
    ("quality_rules", quality_stage),  # rejected documents go
    ("simhash_near_dedup", simhash_stage),  # one document of each class stays
    ("suffix_array_dedup", suffix_stage),  # repeated strings go from the texts
    ("benchmark_decontamination", leak_stage),  # documents that leak an item go
    ("bpe_codec", codec_stage),
]

#: SQL can't express a merge loop, a random field or connected components over bit balls at this size; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
