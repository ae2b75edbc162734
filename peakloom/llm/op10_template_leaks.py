"""Operator 10, benchmark decontamination by template canonicalisation. DataFrame functions only.

Numbers, names and units become typed placeholders, so a question with other numbers or names has the
same template. Windows of WINDOW template words of the documents are hash-joined with those of the
benchmark items; a window with fewer than LITERALS words that are no placeholders must have the item's
own fillings, so it is joined by its words as they stand. What stands in the
placeholders is compared too, for each alignment (the windows that lie equally far behind those of the
item) by itself: a filling of the item must go with one filling of the document; the document may have
equal fillings for different ones. Windows of a consistent alignment count, with those of further ones
that agree with it; windows without placeholders or with the item's own
fillings always count. A document leaks an item if, for any alignment, the windows counted cover COVER
of the item's words, or RUN words of it. Items shorter than a window are compared in windows of their own length, at least
SHORTEST words.

A name is a capitalised word after a word, digit or comma and a blank (so not at the start of a
sentence or line); a unit is a listed word or suffix after a number.

The documents' windows stream through a join with the windows of the benchmark, which is broadcast
only if it has no more than SMALL windows; beyond that Spark joins by shuffle. Nothing gathers the
documents of an item. Null texts, and texts shorter than the shortest window, match nothing; repeated
documents are each found; an empty benchmark finds nothing. Only doc_id, text, item_id are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

WINDOW, LITERALS, SHORTEST, COVER, RUN, SMALL = 8, 5, 5, 0.5, 13, 100_000
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"  # private use; taken out of texts first
#: Words that are units after a number.
UNITS = "km cm mm m mi kg g mg lb oz l ml s ms min h hr hour hours minute minutes second seconds day days week weeks month months year years percent dollar dollars euro euros cent cents inch inches foot feet mile miles meter meters metre metres litre litres liter liters gram grams kilogram kilograms degree degrees".split()


#: Between words; marks belong to letters, so a word stays one in lower case.
GAP = r"[^\p{L}\p{M}\p{N}%s]+"
#: Texts that may have a placeholder.
FILLED = r"[0-9]|[\p{L}\p{N},] \p{Lu}\p{Ll}"


def cut(text: Column, also: str = "") -> Column:
    """Words, with an empty one before the first or after the last where the text doesn't begin or end in a word."""
    return F.split(text, GAP % also)


def clean(text: Column) -> Column:
    return F.when(text.rlike(f"[{NUMBER}-{UNIT}]"), F.translate(text, NUMBER + NAME + UNIT, "   ")).otherwise(text)


def placed(text: Column) -> Column:
    """The text, cleaned, in lower case and with placeholders."""
    named = F.regexp_replace(text, r"(?<=[\p{L}\p{N},] )\p{Lu}\p{Ll}[\p{L}\p{M}\p{N}]*", NAME)
    numbered = F.regexp_replace(F.regexp_replace(named, "[0-9]+", NUMBER), f"({NUMBER} ?)({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\\p{{L}}\\p{{M}}\\p{{N}}])", f"$1{UNIT}")
    return F.lower(F.when(text.rlike(FILLED), numbered).otherwise(text))


def template_words(text: Column) -> Column:
    return F.array_remove(cut(placed(clean(text)), NUMBER + NAME + UNIT), "")


def is_slot(word: Column) -> Column:
    return word.rlike(f"[{NUMBER}{NAME}{UNIT}]")


def windows(df: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """key, h, at, size, slots (what fills the placeholders; null if there are none). h is of the words themselves where few are literal."""
    text = clean(F.col("text"))
    words = df.select(F.col(key).cast("long").alias(key), cut(placed(text), NUMBER + NAME + UNIT).alias("t"), F.when(text.rlike(FILLED), cut(F.lower(text))).alias("r"))
    out = None
    for size in sizes:
        at = F.when(F.size("t") >= size, F.sequence(F.lit(1), F.size("t") - (size - 1)))
        plain = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice("t", i, size)).alias("h"), i.alias("at"), F.lit(None).cast("array<string>").alias("slots")))  # noqa: B023
        slots = lambda i: F.filter(F.zip_with(F.slice("t", i, size), F.slice("r", i, size), lambda t, r: F.when(is_slot(t), r)), lambda x: x.isNotNull())  # noqa: B023, E731
        few = lambda w: F.size(w["slots"]) > size - min(LITERALS, size - 1)  # noqa: B023, E731
        h = lambda w: F.when(few(w), F.xxhash64(F.lit("as it stands"), F.slice("r", w["at"], size))).otherwise(F.xxhash64(F.slice("t", w["at"], size)))  # noqa: B023, E731
        full = F.transform(F.transform(at, lambda i: F.struct(i.alias("at"), slots(i).alias("slots"))), lambda w: F.struct(h(w).alias("h"), w["at"].alias("at"), w["slots"].alias("slots")))  # noqa: B023
        # explode_outer: for explode Spark would make all windows twice, to filter empty arrays first
        one = words.select(key, F.explode_outer(F.when(F.col("r").isNotNull(), full).otherwise(plain)).alias("w")).select(key, F.col("w.h").alias("h"), F.col("w.at").alias("at"), F.lit(size).alias("size"), F.col("w.slots").alias("slots"))
        out = one if out is None else out.unionByName(one)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, covered, item_words, consistent: a row per document and item it leaks."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("n", F.size(template_words(F.col("text")))).where(F.col("n") >= SHORTEST)
    sizes = [WINDOW, *sorted(r[0] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())]  # at most WINDOW - SHORTEST more
    index = None
    for size in sizes:
        own = items.where(F.col("n") >= WINDOW) if size == WINDOW else items.where(F.col("n") == size)
        part = windows(own.withColumn("text", F.regexp_replace("text", "^" + GAP % "" + "|" + GAP % "" + "$", "")), "item_id", [size])
        index = part if index is None else index.unionByName(part)
    index = index.withColumn("slots", F.when(F.size("slots") > 0, F.col("slots")))
    index = index.where("h is not null").select("h", "size", "item_id", F.col("at").alias("i_at"), F.col("slots").alias("i_slots"))
    small = index.limit(SMALL + 1).count() <= SMALL
    hit = windows(docs, "doc_id", sizes).join(F.broadcast(index) if small else index, ["h", "size"])
    pairs = F.when(F.col("i_slots").isNull(), F.array().cast("array<struct<i:string,d:string>>")).otherwise(F.transform(F.arrays_zip("i_slots", "slots"), lambda z: F.struct(z["i_slots"].alias("i"), z["slots"].alias("d"))))
    own = F.col("i_slots").isNull() | (F.col("i_slots") == F.col("slots"))
    # an alignment: its windows, those that always count, and its pairs of fillings
    runs = hit.groupBy("doc_id", "item_id", (F.col("at") - F.col("i_at")).alias("apart")).agg(
        F.array_sort(F.collect_set("i_at")).alias("at"), F.collect_set(F.when(own, F.col("i_at"))).alias("own_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(pairs)))).alias("pairs"), F.max("size").alias("size"),
    )
    consistent = lambda p: F.size(F.array_distinct(F.transform(p, lambda x: x["i"]))) == F.size(p)
    run = F.struct((-F.size("at")).alias("by"), "at", "pairs")  # equal copies once
    each = runs.groupBy("doc_id", "item_id").agg(
        F.array_distinct(F.flatten(F.collect_set("own_at"))).alias("own_at"), F.array_sort(F.collect_set(F.when(consistent(F.col("pairs")), run))).alias("runs"), F.max("size").alias("size"),
    )
    each = each.join(items.select("item_id", F.col("n").alias("item_words")), "item_id")
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda a: F.sequence(a, a + F.col("size") - 1)))))
    enough = lambda n: (n >= COVER * F.col("item_words")) | (n >= RUN)
    counted = lambda at, c: F.struct(covered(at).alias("covered"), F.size(at).alias("n_windows"), F.lit(c).alias("consistent"))
    with_own = lambda x: counted(F.array_union("own_at", x["at"]), True)
    both = lambda x, y: F.struct(F.array_union(x["at"], y["at"]).alias("at"), F.array_union(x["pairs"], y["pairs"]).alias("pairs"))
    grown = lambda x: F.aggregate("runs", F.struct(x["at"].alias("at"), x["pairs"].alias("pairs")), lambda acc, y: F.when(consistent(F.array_union(acc["pairs"], y["pairs"])), both(acc, y)).otherwise(acc))
    each = each.where(enough(covered(F.array_union("own_at", F.flatten(F.transform("runs", lambda x: x["at"]))))))
    one = each.withColumn("best", F.array_max(F.concat(F.array(counted(F.col("own_at"), False)), F.transform("runs", with_own), F.transform(F.slice("runs", 1, 1), lambda x: with_own(grown(x))))))
    best = F.when(enough(F.col("best.covered")), F.col("best")).otherwise(F.array_max(F.transform("runs", lambda x: with_own(grown(x)))))
    return one.withColumn("best", best).where(enough(F.col("best.covered"))).select("doc_id", "item_id", "best.n_windows", "best.covered", "item_words", "best.consistent")


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no item."""
    bad = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("_bad_id"), "left_anti")
