"""Operator 4, BPE encoding and decoding through a minimal acyclic transducer lexicon.

Frequent words (those the vocabulary holds whole, and the most frequent of all documents, counted in
every row) are compiled with their ids into a shared-suffix automaton that workers map into memory.
Words outside it are merged exactly, those of one length side by side, long ones by a heap of pairs. The
lexicon only saves merges: ids never depend on it. Of the texts that are encoded together, what stands
between two blanks is encoded once.

Null text is taken as empty; empty text gives no tokens and an empty decoding. A word may be as long
as the text. Repeated rows and ids are encoded each. Other columns of the input are passed by; a clash
of names with the outputs is avoided by selecting id and text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, transducer
from .common import documents, utf8, written

#: Counted words that enter the lexicon at most, and their greatest length in characters.
LEXICON_WORDS, LEXICON_LENGTH = 50_000, 64
#: Bytes of text that are encoded together at most; a longer text by itself.
MEMORY = 8_000_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word, n: how often each short word stands in all documents. What stands between two blanks is counted first, so each is split into words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        for batch in batches:
            words, at, chunk = model.split(batch.column(0).to_pylist())
            n = np.zeros(len(words), np.int64)
            np.add.at(n, at, batch.column(1).to_numpy()[chunk])
            short = np.fromiter(map(len, words), np.int64, len(words)) <= LEXICON_LENGTH
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n)], names=["word", "n"]).filter(pa.array(short))

    chunks = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("chunk")).where("chunk != ''")  # as WordBPE.chunks
    return chunks.groupBy("chunk").agg(F.count("*").alias("n")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all documents: at most `words`, those of one count together or not at all, none that occurs once."""
    counts = written(word_counts(docs, path).where("n > 1"))
    least, room = None, words  # each n has a word at least, so the limit leaves out no n that has room
    for n, k in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(words).collect():
        if k > room:
            break
        least, room = n, room - k
    return [] if least is None else sorted(r.word for r in counts.where(F.col("n") >= least).select("word").collect())


def lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    """Compiles the frequent words. Bounded: the vocabulary's whole words and at most `words` counted ones."""
    model = bpe.load(path)
    entries = {w.encode(): (i,) for w, i in model.whole_tokens().items()}
    for w in frequent(docs, path, words):
        if w not in model.special:
            entries.setdefault(w.encode(), model.merge(w))
    return transducer.compiled(entries)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def ends(sizes: np.ndarray) -> np.ndarray:
    """Offsets of lists of these sizes."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def blank_joined(offsets: np.ndarray, strings: pa.Array) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), strings), pa.scalar(" ", pa.large_string()))


class Codec:
    """Texts to (ids as text, tokens as text, count), many at once."""

    def __init__(self, path: str, blob: bytes):
        self.model, self.lexicon = bpe.load(path), transducer.mapped(blob)
        size = max(self.model.token) + 1
        self.tokens = pa.array([self.model.token.get(i) for i in range(size)], pa.large_string())
        self.numerals = pa.array(map(str, range(size)), pa.large_string())

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Looks the words up in the automaton, all at once, and merges the rest: their ids one after another, and how many each has."""
        raw = [w.encode() for w in words]
        number, lex = self.lexicon.numbers(raw), self.lexicon
        known, rest = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        number, special = number[known], {}
        if self.model.special.keys() & set(words):
            special = {k: self.model.special[words[k]] for k in rest.tolist() if words[k] in self.model.special}
            rest = rest[~np.isin(rest, list(special))]
        merged, many = self.model.merges([raw[k] for k in rest.tolist()])
        sizes = np.ones(len(words), np.int64)
        sizes[known], sizes[rest] = lex.starts[number + 1] - lex.starts[number], many
        out, starts = np.empty(int(sizes.sum()), np.int64), np.cumsum(sizes) - sizes
        out[runs(starts[known], sizes[known])] = lex.outputs[runs(lex.starts[number], sizes[known])]
        out[runs(starts[rest], many)] = merged
        for k, i in special.items():
            out[starts[k]] = i
        return out, sizes

    def learned(self, chunks: list[str]) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """For each chunk its ids and tokens, joined by blanks, and their count."""
        words, piece, chunk = self.model.split(chunks)
        order = np.argsort(chunk, kind="stable")
        piece, chunk = piece[order], chunk[order]
        ids, sizes = self.ids(words)
        ids = ids[runs((np.cumsum(sizes) - sizes)[piece], sizes[piece])]
        counts = np.zeros(len(chunks), np.int64)
        np.add.at(counts, chunk, sizes[piece])
        return *(blank_joined(ends(counts), strings.take(pa.array(ids))) for strings in (self.numerals, self.tokens)), counts

    def together(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """For each text its ids and tokens, joined by blanks, and their count. Cut into chunks as WordBPE.chunks does."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        as_ids, as_tokens, counts = self.learned(coded.dictionary.to_pylist())
        chunk, offsets = coded.indices.to_numpy(), parts.offsets.to_numpy()
        some = counts[chunk] > 0  # a chunk without tokens leaves no blank
        chunk, offsets = chunk[some], ends(some)[offsets - offsets[0]]
        total = ends(counts[chunk])[offsets]
        chunk = pa.array(chunk)
        return *(blank_joined(offsets, strings.take(chunk)) for strings in (as_ids, as_tokens)), np.diff(total)

    def encoded(self, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        """Texts in order, so many together as MEMORY holds."""
        texts = texts.cast(pa.large_string()).fill_null("")
        upto, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while at < len(texts):
            room = (int(upto[at - 1]) if at else 0) + MEMORY
            stop = max(at + 1, int(np.searchsorted(upto, room, "right")))
            yield self.together(texts.slice(at, stop - at))
            at = stop

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids of one text and their decoding."""
        as_ids, decoded, _ = next(self.encoded(pa.array([text], pa.string())))
        return [int(i) for i in as_ids[0].as_py().split()], decoded[0].as_py()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.model.token[i] for i in ids])


def digests(strings: pa.Array) -> pa.Array:
    """SHA-256 of each string's UTF-8."""
    data, at = utf8(strings)
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string())


_codecs: dict[tuple, Codec] = {}


def codec(path: str, blob: bytes) -> Codec:
    key = (path, len(blob), hash(blob))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(path, blob)
    return _codecs[key]


def encoded(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids and decoded. Nulls and empty texts: zero tokens."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    blob = spark.sparkContext.broadcast(lexicon(docs, path))  # bounded by the vocabulary and LEXICON_WORDS
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, blob.value)
        for batch in batches:
            at = 0
            for as_ids, decoded, n in c.encoded(batch.column(1)):
                cols, names = [batch.column(0).slice(at, len(n)), pa.array(n), digests(as_ids), digests(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ids = [[int(i) for i in x.split()] for x in as_ids.to_pylist()]
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32())), decoded.cast(pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))
