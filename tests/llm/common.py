"""Small corpora with the awkward cases, and brute-force answers."""

import hashlib
import random
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed=0, n=60):
    """(doc_id, text, lang, source): copies, near copies, shared passages, repeats, nulls, empties, one long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices(["th", "er", "on", "é", "ß", "an", "Re", "in", "9", "ou"], k=rng.randrange(1, 4))) for _ in range(150)]
    text = lambda k: "".join(w + (".\n" if rng.random() < 0.08 else " ") for w in rng.choices(vocab, k=k))
    passage, line = text(70), text(25).replace("\n", " ")
    out = []
    for i in range(n):
        kind, t = rng.random(), text(rng.randrange(5, 150))
        if kind < 0.15 and out:
            t = rng.choice(out)
        elif kind < 0.3 and out:
            w = (rng.choice(out) or "x y").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind < 0.5:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        elif kind < 0.6:
            t = line + "\n" + t + line
        elif kind < 0.65:
            t = (text(12) + "\n") * 12
        elif kind < 0.7:
            t = None
        elif kind < 0.74:
            t = rng.choice(["", " ", "\n\t \n", "a", "\x0b\x0c\r"])
        elif kind < 0.78:
            t = "ab" * 150
        out.append(t)
    out.append(text(4000))
    out.append(" ".join(rng.choices(vocab, k=30)) + "   x " + "ΑΣ İ <|endoftext|> don't 12.5% 日本語 😀")
    return [(i * 3 + 1, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None])) for i, t in enumerate(out)]


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("spans", "doc", "bucket", "grp", "fp", "node", "h", "at", "size", "kept", "score", "n_words", "curve", "_bin", "pack", "_doc"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def stored(spark, tmp, rows, labels=(), benchmark=()):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "cast(length(text) as long) as n_chars")
    df.repartition(3).write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    return str(tmp)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def crc(i):
    return zlib.crc32(str(i).encode())


def brute_bytes(rows, size=100):
    """doc_id -> answer; of rows that share a doc_id the answers in order of the rows, in a list (unique ids: the one answer)."""
    places = sorted({(r[0], r[1] or "") for r in rows})
    first = {}
    for i, t in places:
        b = t.encode()
        for s in range(len(b) - size + 1):
            first.setdefault(b[s : s + size], (i, t, s))
    answer = {}
    for i, t in places:
        b = t.encode()
        gone, own = bytearray(len(b)), set()
        for s in range(len(b) - size + 1):
            w = b[s : s + size]
            if first[w][0] < i or w in own:
                gone[s : s + size] = b"\1" * size
            own.add(w)
        answer[i, t] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(b, gone) if not g)))
    return by_id(rows, answer)


def brute_words(rows, size=13):
    places = sorted({(r[0], r[1] or "") for r in rows})
    first, answer = {}, {}
    for i, t in places:
        w = WORD.findall(t)
        for s in range(len(w) - size + 1):
            first.setdefault(tuple(w[s : s + size]), i)
    for i, t in places:
        w = WORD.findall(t)
        gone = bytearray(len(w))
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < i:
                gone[s : s + size] = b"\1" * size
        kept = [x for x, g in zip(w, gone) if not g]
        answer[i, t] = (len(w), sum(gone), sha(" ".join(kept).encode()))
    return by_id(rows, answer)


def by_id(rows, answer):
    out = {}
    for i, t, *_ in rows:
        out.setdefault(i, []).append(answer[i, t or ""])
    return {i: v[0] if len(v) == 1 else sorted(v) for i, v in out.items()}


def answers(df, n):
    """doc_id -> the n columns after it; a sorted list where a doc_id has several rows."""
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1 : 1 + n])
    return {i: v[0] if len(v) == 1 else sorted(v) for i, v in out.items()}
