"""Which patterns (peptides, items) occur in which sequences (proteins, documents)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of patterns that may be sent to all tasks as one automaton.
SMALL = 8_000_000


def contained(sequences: DataFrame, patterns: DataFrame, small: int = SMALL) -> DataFrame:
    """(sequence id, pattern id) for every pattern that is a substring. Both frames: id, text.

    A small pattern table becomes an Aho-Corasick automaton in every task and each sequence is
    read once, whatever the number of patterns. Beyond `small` characters, patterns go in blocks.
    Null texts match nothing; the empty pattern is in every sequence that isn't null.
    """
    (sid, stext), (pid, ptext) = sequences.columns, patterns.columns
    sizes = patterns.where(F.col(ptext).isNotNull()).select(F.sum(F.length(ptext))).first()[0] or 0
    blocks = max(1, -(-sizes // small))
    out = None
    schema = f"`{sid}` {dict(sequences.dtypes)[sid]}, `{pid}` {dict(patterns.dtypes)[pid]}"
    kinds = [pa.int64() if dict(f.dtypes)[c] == "bigint" else pa.int32() if dict(f.dtypes)[c] == "int" else pa.string() for f, c in ((sequences, sid), (patterns, pid))]
    for block in range(blocks):
        mine = patterns.where(F.col(ptext).isNotNull() & (F.pmod(F.xxhash64(pid), F.lit(blocks)) == block))
        by_text: dict[str, list] = {}
        for i, text in mine.collect():  # at most about `small` characters
            by_text.setdefault(text, []).append(i)

        def run(batches: Iterator[pa.RecordBatch], by_text=by_text) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for text, ids in by_text.items():
                if text:
                    automaton.add_word(text, ids)
            automaton.make_automaton()
            for batch in batches:
                a, b = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text is None:
                        continue
                    hits = {h for _, ids in automaton.iter(text) for h in ids} if len(automaton) else set()
                    for h in sorted(hits | set(by_text.get("", ()))):
                        a.append(i)
                        b.append(h)
                yield pa.RecordBatch.from_arrays([pa.array(a, kinds[0]), pa.array(b, kinds[1])], names=[sid, pid])

        part = sequences.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
