"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

import math

from . import op1_suffix_dedup as O1
from . import op3_hilbert_shards as O3
from . import op7_quality_rules as O7

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

RLZ = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) t(i) WHERE len(ws) >= 13),
f AS (SELECT k, min(doc_id) AS earliest FROM p GROUP BY k),
d AS (SELECT DISTINCT p.doc_id, j FROM p JOIN f ON p.k = f.k, unnest(range(i, i + 13)) u(j) WHERE p.doc_id > earliest),
g AS (SELECT doc_id, list(j) AS js FROM d GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(js, i), false)), ' ')) AS kept_sha256 FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""


def rules(reach: float = O7.REACH, least: int = O7.LEAST) -> str:
    rate = {"symbols": "n_symbols / greatest(n_words, 1)", "marks": "n_marks / greatest(n_words, 1)", "capitals": "n_capitals / greatest(word_chars, 1)", "length": "word_chars / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)"}
    rates = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{k}' AS rate, CAST({v} AS DOUBLE) AS x, {s}::DOUBLE AS s, {'true' if low else 'false'} AS low FROM b" for (k, v), (s, low) in zip(rate.items(), O7.RATES.values(), strict=True))
    value = f"CASE WHEN bin = -100000 THEN 0.0 ELSE exp(bin * {math.log(O7.GAMMA)!r}::DOUBLE) END"
    by = lambda keys, name: f"{name} AS (SELECT {keys}rate, max(n) AS n, min(CASE WHEN up >= n * 0.25 THEN v END) AS q1, min(CASE WHEN up >= n * 0.75 THEN v END) AS q3 FROM (SELECT *, {value} AS v, sum(c) OVER (PARTITION BY {keys}rate ORDER BY bin) AS up, sum(c) OVER (PARTITION BY {keys}rate) AS n FROM (SELECT {keys}rate, bin, sum(c) AS c FROM k GROUP BY ALL)) GROUP BY ALL)"
    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {WORDS} AS ws,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
t AS (SELECT doc_id, i, array_to_string(ws[i : i + 2], ' ') AS k FROM w, unnest(range(1, len(ws) - 1)) u(i) WHERE len(ws) >= 3),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM t), unnest(range(i, i + 3)) u(j) WHERE c > 1 GROUP BY doc_id),
a AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
 len(lines) AS n_lines, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a),
x AS ({rates}),
k AS (SELECT lang, source, rate, CASE WHEN x > 0 THEN CAST(round(ln(x) / {math.log(O7.GAMMA)!r}::DOUBLE) AS INTEGER) ELSE -100000 END AS bin, count(*) AS c FROM x WHERE NOT base_failed GROUP BY ALL),
{by("lang, source, ", "own")}, {by("lang, ", "lng")}, {by("", "every")},
q AS (SELECT own.lang, own.source, own.rate, CASE WHEN own.n >= {least} THEN own.q1 WHEN lng.n >= {least} THEN lng.q1 ELSE every.q1 END AS q1, CASE WHEN own.n >= {least} THEN own.q3 WHEN lng.n >= {least} THEN lng.q3 ELSE every.q3 END AS q3
 FROM own JOIN lng ON own.lang = lng.lang AND own.rate = lng.rate JOIN every ON own.rate = every.rate),
o AS (SELECT doc_id, bool_or(coalesce(x > q3 + {reach}::DOUBLE * greatest(q3 - q1, s) OR (low AND x < q1 - {reach}::DOUBLE * greatest(q3 - q1, s)), false)) AS outside FROM x LEFT JOIN q ON x.lang = q.lang AND x.source = q.source AND x.rate = q.rate GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT outside AS kept FROM b JOIN o ON b.doc_id = o.doc_id"""


def repeated_bytes(size: int = O1.LENGTH) -> str:
    """Every string of `size` bytes and where it starts first. Texts are cut to pieces that overlap, as slicing a long value costs its length each time."""
    step = 400
    return f"""WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, k, x[k + 1 : k + {step + size - 1}] AS y, n FROM b, unnest(range(0, n, {step})) u(k)),
w AS (SELECT doc_id, k + j AS i, md5(y[j + 1 : j + {size}]) AS h FROM c, unnest(range(0, least({step}, n - k - {size - 1}))) v(j)),
o AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {size} THEN 0 ELSE 1 END AS new FROM o)),
r AS (SELECT doc_id, min(i) AS lo, max(i) + {size} AS hi FROM g GROUP BY doc_id, g),
z AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prev FROM r),
k AS (SELECT z.doc_id, count(*) AS n_spans, sum(hi - lo) AS gone, string_agg(hex(x[prev + 1 : lo]), '' ORDER BY lo) AS kept, max(hi) AS hi FROM z JOIN b ON z.doc_id = b.doc_id GROUP BY z.doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(CASE WHEN kept IS NULL THEN x ELSE unhex(kept || hex(x[hi + 1 : n])) END) AS kept_sha256 FROM b LEFT JOIN k ON b.doc_id = k.doc_id"""


def shards(count: int = O3.SHARDS, bits: int = O3.BITS) -> str:
    """Cells by rank, the Hilbert curve as a table of the rule, CRC-32 byte by byte."""
    n, last = 1 << bits, (1 << bits) - 1
    cells = ", ".join(str(O3.hilbert_index(x, y, z, bits)) for x in range(n) for y in range(n) for z in range(n))
    crc = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ 0xEDB88320 * (i & 1)
        crc.append(str(i))
    rank = lambda c: f"r_{c} AS (SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM documents WHERE {c} IS NOT NULL GROUP BY {c})"
    cell = lambda c: f"CAST(CASE WHEN d.{c} IS NULL THEN 0 WHEN r_{c}.r < {last} THEN r_{c}.r ELSE {last} END AS INTEGER)"
    return f"""WITH {rank("lang")}, {rank("source")},
a AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
 xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, ([{", ".join(crc)}]::BIGINT[])[xor(c & 255, x) + 1])), 4294967295) AS text_crc32,
 {cell("lang")} AS q_lang, {cell("source")} AS q_source FROM documents d LEFT JOIN r_lang ON d.lang = r_lang.lang LEFT JOIN r_source ON d.source = r_source.source),
b AS (SELECT *, CAST(least(floor(log2(size)) - 3, {last}) AS INTEGER) AS q_size FROM a),
c AS (SELECT *, ([{cells}]::INTEGER[])[(q_lang * {n} + q_source) * {n} + q_size + 1] AS curve FROM b),
g AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, size, doc_id) - 1 AS g, count(*) OVER () AS total FROM c),
s AS (SELECT *, CAST(g * {count} // total AS INTEGER) AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(g - (shard * total + {count - 1}) // {count} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve, q_lang, q_source, q_size FROM s"""


SQL = {"op1_suffix_dedup": repeated_bytes(), "op3_hilbert_shards": shards(), "op5_rlz_dedup": RLZ, "op7_quality_rules": rules()}
