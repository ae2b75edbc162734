"""Operator 6, token counts by the whole-token shortcut.

Offline, every word-final vocabulary string is proved to encode alone as one token or not; a
pre-token in the proved set counts one without any merge. Only the rest is merged, exactly, long words
by a heap of pairs. What stands between two blanks is counted once and remembered.

Null text counts as empty; empty text has no tokens. A word may be as long as the text. Repeated rows
and ids are counted each. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import documents
from .op4_bpe_codec import tokenizer_path

LIMIT = 2048
#: Characters (and 50 an entry) that a worker remembers counts of; beyond it the memory starts anew.
MEMORY = 40_000_000


class Counts(dict):
    """Tokens of what stands between two blanks: one for proved pre-tokens, the others by merging."""

    def __init__(self, path: str):
        self.model = bpe.load(path)
        self.proved = dict.fromkeys([*self.model.whole_tokens(), *self.model.special], 1)
        self.merged: dict[str, int] = {}
        self.held = 0
        super().__init__()

    def __missing__(self, chunk: str) -> int:
        if self.held > MEMORY:
            self.clear()
            self.merged.clear()
            self.held = 0
        self.held += len(chunk) + 50
        n = self[chunk] = sum(self.proved.get(w) or self.merged.get(w) or self.merge(w) for w in self.model.pieces(chunk))
        return n

    def merge(self, word: str) -> int:
        n = self.merged[word] = len(self.model.merge(word))
        self.held += len(word) + 50
        return n

    def of(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.model.chunks(text))) if text else 0


_counts: dict[str, Counts] = {}


def counts(path: str) -> Counts:
    if path not in _counts:
        _counts[path] = Counts(path)
    return _counts[path]


def counted(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counts(path).of
        for batch in batches:
            n = list(map(of, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir))
