"""The query catalogue: every relational operator on the driver's tables, with the same result in SQL.

Roles: lineitem is the edge table (l_orderkey precursor, l_partkey fragment, l_suppkey run,
l_extendedprice intensity, l_discount correlation, l_quantity score), orders are clusters
(o_totalprice m/z, o_orderdate time), events are points in time, labels carry the decoy flag (toxic).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import joins as J
from ..operators import windows as W
from ..operators.containment import contained

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def secs(c: str):
    """Seconds since 1970 of a timestamp, as a double."""
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)


def day(c: str):
    return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(86_400_000_000)).cast("long")


SECS = "(epoch_us({}) / 1000000.0::DOUBLE)"
DAY = "CAST(floor(epoch_us({}) / 86400000000.0::DOUBLE) AS BIGINT)"
r4 = lambda c, n=4: F.round(c, n)


def decoys(spark, sf):
    """doc_id, p (a probability), decoy."""
    d = t(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000).cast("double") / 1000).alias("p"))
    return t(spark, sf, "labels").join(d, "doc_id").select("doc_id", "p", (F.col("toxic") == 1).alias("decoy"), "quality")


DECOYS = "SELECT l.doc_id, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS p, toxic = 1 AS decoy, quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 AND l_extendedprice > 20000 AND l_discount >= 0.05")
def q01_scan_filter_project(spark, sf):
    return t(spark, sf, "lineitem").where("l_quantity between 10 and 40 and l_extendedprice > 20000 and l_discount >= 0.05").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice AS m, o_totalprice * 1.00001 AS n FROM orders),
b AS (SELECT *, (m * 0.00052738 + 0.166015) - floor(m * 0.00052738 + 0.166015) AS up, (m * 0.00042565 + (0.00038210 - 0.1)) - floor(m * 0.00042565 + (0.00038210 - 0.1)) AS low, m - floor(m) AS x FROM a)
SELECT o_orderkey, round(abs(m - n) * 1e6 / n, 4) AS ppm, round((m - n) * 1e6 / n, 4) AS signed_ppm,
 round((2 * (m - 1.00727) - 2 * (m - 1.00727) * 10.0 / 1e6) / 2 + 1.00727, 4) AS shifted, round(x, 4) AS defect,
 CASE WHEN up > low THEN x >= low AND x <= up ELSE x >= low OR x <= up END AS in_range FROM b""")
def q02_ppm_scalars(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("m"), (F.col("o_totalprice") * 1.00001).alias("n"))
    return o.select("o_orderkey", r4(X.ppm("m", "n")).alias("ppm"), r4(X.signed_ppm("m", "n")).alias("signed_ppm"), r4(X.shifted_mz("m", F.lit(2), 10.0)).alias("shifted"), r4(X.mass_defect("m")).alias("defect"), X.in_defect_range("m", 0.1).alias("in_range"))


@query("""SELECT l_orderkey, round(sum(l_partkey * l_extendedprice * l_extendedprice) / sum(l_extendedprice * l_extendedprice), 4) AS target_mz,
 max(l_extendedprice) AS apex, min(l_extendedprice) AS low, round(max(l_extendedprice) / min(l_extendedprice), 4) AS snr FROM lineitem GROUP BY l_orderkey""")
def q03_weighted_centroid(spark, sf):
    i = F.col("l_extendedprice")
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(r4(F.sum(F.col("l_partkey") * i * i) / F.sum(i * i)).alias("target_mz"), F.max(i).alias("apex"), F.min(i).alias("low"), r4(F.max(i) / F.min(i)).alias("snr"))


@query("""WITH a AS (SELECT l_orderkey, l_returnflag AS iso, round(sum(l_extendedprice), 2) AS area, max(l_extendedprice) AS height,
 CAST(arg_max(l_partkey, struct_pack(i := l_extendedprice, k := -l_partkey)) AS BIGINT) AS apex_at FROM lineitem GROUP BY ALL)
SELECT *, round(height / max(height) OVER (PARTITION BY l_orderkey), 4) AS relative FROM a""")
def q04_area_height_apex(spark, sf):
    i = F.col("l_extendedprice")
    a = t(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("iso")).agg(r4(F.sum(i), 2).alias("area"), F.max(i).alias("height"), F.max_by("l_partkey", F.struct(i, -F.col("l_partkey"))).alias("apex_at"))
    return a.withColumn("relative", r4(F.col("height") / F.max("height").over(Window.partitionBy("l_orderkey"))))


@query("SELECT l_partkey, max(CASE WHEN l_quantity BETWEEN 10 AND 30 THEN l_extendedprice END) AS max_in_range FROM lineitem GROUP BY l_partkey")
def q05_conditional_max_range(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max(F.when(F.col("l_quantity").between(10, 30), F.col("l_extendedprice"))).alias("max_in_range"))


@query(f"""SELECT CAST(floor({SECS.format('ts')} / 600) AS BIGINT) AS scan, round(sum(value), 2) AS tic, max(value) AS base_peak,
 round(coalesce(sum(CASE WHEN value BETWEEN 10 AND 20 THEN value END), 0), 2) AS xic FROM events GROUP BY 1""")
def q06_tic_basepeak_xic(spark, sf):
    return t(spark, sf, "events").groupBy(F.floor(secs("ts") / 600).cast("long").alias("scan")).agg(r4(F.sum("value"), 2).alias("tic"), F.max("value").alias("base_peak"), r4(F.coalesce(F.sum(F.when(F.col("value").between(10, 20), F.col("value"))), F.lit(0.0)), 2).alias("xic"))


@query("""SELECT l_suppkey AS run, l_orderkey || '_' || CAST(l_linenumber % 3 AS VARCHAR) AS pep_key, max(l_discount) AS max_prob,
 arg_max(l_extendedprice, struct_pack(d := l_discount, k := -l_partkey, e := l_extendedprice)) AS mz_at_max, count(*) AS psms, count(DISTINCT l_partkey) AS proteins FROM lineitem GROUP BY ALL""")
def q07_psm_rollup(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("pep_key", X.ion_key("l_orderkey", F.col("l_linenumber") % 3))
    return li.groupBy(F.col("l_suppkey").alias("run"), "pep_key").agg(F.max("l_discount").alias("max_prob"), F.max_by("l_extendedprice", F.struct("l_discount", -F.col("l_partkey"), "l_extendedprice")).alias("mz_at_max"), F.count("*").alias("psms"), F.countDistinct("l_partkey").alias("proteins"))


@query("SELECT o_custkey, round(avg(o_totalprice), 6) AS mean_rt, round(stddev_pop(o_totalprice), 6) AS sd_rt, count(*) AS n FROM orders GROUP BY o_custkey")
def q08_mean_popsd(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(r4(F.avg("o_totalprice"), 6).alias("mean_rt"), r4(F.stddev_pop("o_totalprice"), 6).alias("sd_rt"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_partkey, l_orderkey, l_linenumber, l_discount, rank() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC) AS ms1_rank, count(*) OVER (PARTITION BY l_partkey) AS n,
 l_discount * l_discount * ln(l_extendedprice) AS s, l_extendedprice FROM lineitem), b AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY s DESC) AS fragment_rank FROM a)
SELECT l_partkey, l_orderkey, l_linenumber, CAST(ms1_rank AS BIGINT) AS ms1_rank, round(ms1_rank / CAST(n AS DOUBLE), 4) AS rank_score, CAST(fragment_rank AS BIGINT) AS fragment_rank
FROM b WHERE l_discount >= 0.02 AND ms1_rank <= 25 AND fragment_rank <= 3""")
def q09_edge_rank_filter(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("s", F.col("l_discount") * F.col("l_discount") * F.ln("l_extendedprice"))
    a = W.rank_share(li, ["l_partkey"], [F.desc("l_discount")], "ms1_rank")
    b = W.ranked(a, ["l_orderkey"], [F.desc("s")], "fragment_rank")
    return b.where("l_discount >= 0.02 and ms1_rank <= 25 and fragment_rank <= 3").select("l_partkey", "l_orderkey", "l_linenumber", "ms1_rank", r4(F.col("rank_score")).alias("rank_score"), "fragment_rank")


@query("""SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, round(l_extendedprice * l_discount, 4) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY round(l_extendedprice * l_discount, 4) DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def q10_best_hit_per_key(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("score", r4(F.col("l_extendedprice") * F.col("l_discount"), 4))
    return W.best(li, ["l_orderkey", "l_returnflag"], F.struct("score", -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey")), ["l_linenumber", "l_partkey", "score"])


def fdr_sql(floor: str) -> str:
    return f"""WITH d AS (SELECT doc_id, CASE WHEN decoy THEN p * 0.8::DOUBLE ELSE 0.2::DOUBLE + p * 0.8::DOUBLE END AS p, decoy FROM ({DECOYS})), r AS (SELECT *, sum(CASE WHEN decoy THEN 1 ELSE 0 END) OVER w AS neg, sum(CASE WHEN decoy THEN 0 ELSE 1 END) OVER w AS pos, lag(p) OVER (ORDER BY p DESC, doc_id) AS previous
 FROM d WINDOW w AS (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING)), h AS (SELECT coalesce(max(p), 0) AS threshold FROM r WHERE p < previous AND neg >= 0.05 * pos {floor})
SELECT doc_id, p, threshold FROM d, h WHERE p >= threshold AND NOT decoy"""


def lower_decoys(spark, sf):
    """Decoys score lower than targets, so a threshold lies in the middle."""
    p = F.col("p") * 0.8
    return decoys(spark, sf).select("doc_id", F.when(F.col("decoy"), p).otherwise(F.lit(0.2) + p).alias("p"), "decoy")


@query(fdr_sql("AND p >= 0.1"))
def q11_running_fdr_threshold(spark, sf):
    return W.fdr_filter(lower_decoys(spark, sf), "p", "decoy", "doc_id", 0.05).select("doc_id", "p", "threshold")


@query(fdr_sql(""))
def q12_running_fdr_no_floor(spark, sf):
    return W.fdr_filter(lower_decoys(spark, sf), "p", "decoy", "doc_id", 0.05, None).select("doc_id", "p", "threshold")


@query(f"""WITH b AS (SELECT CAST(floor(p * 100) AS BIGINT) AS bin, sum(CASE WHEN decoy THEN 0 ELSE 1 END) AS c, sum(CASE WHEN decoy THEN 1 ELSE 0 END) AS d FROM ({DECOYS}) GROUP BY 1)
SELECT bin, round(0.999999 * c / (c + d), 4) AS local_p, round(0.999999 * sum(c) OVER w / (sum(c) OVER w + sum(d) OVER w), 4) AS global_p FROM b WINDOW w AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)""")
def q13_cumulative_posterior(spark, sf):
    b = decoys(spark, sf).groupBy(F.floor(F.col("p") * 100).cast("long").alias("bin")).agg(F.sum((~F.col("decoy")).cast("long")).alias("c"), F.sum(F.col("decoy").cast("long")).alias("d"))
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # over bins, at most 101 rows
    k = F.lit(0.999999).cast("double")
    return b.select("bin", r4(k * F.col("c") / (F.col("c") + F.col("d"))).alias("local_p"), r4(k * F.sum("c").over(w) / (F.sum("c").over(w) + F.sum("d").over(w))).alias("global_p"))


FRAG_SCORES = "SELECT l_orderkey, l_partkey, round(sum(CASE WHEN l_discount > 0.03 AND l_quantity >= 5 THEN l_discount * l_extendedprice ELSE 0 END), 4) AS score, count(*) AS freq FROM lineitem GROUP BY ALL"


def frag_scores(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(r4(F.sum(F.when((F.col("l_discount") > 0.03) & (F.col("l_quantity") >= 5), F.col("l_discount") * F.col("l_extendedprice")).otherwise(0.0)), 4).alias("score"), F.count("*").alias("freq"))


@query(f"SELECT l_orderkey, l_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) AS n FROM ({FRAG_SCORES}) WHERE score > 0) WHERE n <= 3")
def q14_topn_fragments(spark, sf):
    return W.top_k(frag_scores(spark, sf).where("score > 0"), ["l_orderkey"], [F.desc("score"), F.asc("l_partkey")], 3).select("l_orderkey", "l_partkey", "score")


@query("""WITH s AS (SELECT p_brand, l_partkey, round(sum(l_extendedprice * l_discount), 4) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, l_partkey) AS n FROM s WHERE score > 0)
SELECT p_brand, count(*) AS n_peptides, round(sum(score), 2) AS abundance FROM r WHERE n <= 6 GROUP BY p_brand""")
def q15_topn_peptides_sum(spark, sf):
    part = t(spark, sf, "part").select("p_partkey", "p_brand")
    s = t(spark, sf, "lineitem").groupBy("l_partkey").agg(r4(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("score")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return W.top_k(s.where("score > 0"), ["p_brand"], [F.desc("score"), F.asc("l_partkey")], 6).groupBy("p_brand").agg(F.count("*").alias("n_peptides"), r4(F.sum("score"), 2).alias("abundance"))


@query("""WITH runs AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem), f AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS freq FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, freq FROM f, runs WHERE freq > n * 0.25""")
def q16_frequency_filter(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("freq")).crossJoin(F.broadcast(li.agg(F.countDistinct("l_suppkey").alias("n")))).where("freq > n * 0.25").select("l_partkey", "freq")


@query(f"""WITH s AS ({FRAG_SCORES}), good AS (SELECT l_orderkey, l_partkey, score, 1 AS pass FROM s WHERE score > 2500),
low AS (SELECT l_orderkey, l_partkey, score, 2 AS pass FROM s WHERE score > 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM good)) SELECT * FROM good UNION ALL SELECT * FROM low""")
def q17_fallback_scores(spark, sf):
    s = frag_scores(spark, sf).select("l_orderkey", "l_partkey", "score")
    good = s.where("score > 2500").withColumn("pass", F.lit(1))
    low = s.where("score > 0").join(good.select("l_orderkey").distinct(), "l_orderkey", "left_anti").withColumn("pass", F.lit(2))
    return good.unionByName(low)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS n FROM lineitem WHERE l_discount > 0.03),
p AS (SELECT l_suppkey, l_orderkey, sum(l_extendedprice) AS a FROM r WHERE n <= 3 GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY a DESC, l_orderkey) AS n FROM p)
SELECT l_suppkey, round(avg(a), 6) AS abundance FROM q WHERE n <= 6 GROUP BY l_suppkey""")
def q18_topn_mean_abundance(spark, sf):
    top = W.top_k(t(spark, sf, "lineitem").where("l_discount > 0.03"), ["l_suppkey", "l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_linenumber")], 3)
    p = top.groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_extendedprice").alias("a"))
    return W.top_k(p, ["l_suppkey"], [F.desc("a"), F.asc("l_orderkey")], 6).groupBy("l_suppkey").agg(r4(F.avg("a"), 6).alias("abundance"))


@query("SELECT p_brand, round(sum(l_extendedprice) / max(n_theo), 5) AS ibaq FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT p_brand AS b, count(*) AS n_theo FROM part GROUP BY 1) ON b = p_brand GROUP BY p_brand")
def q19_ibaq_ratio(spark, sf):
    part = t(spark, sf, "part").select("p_partkey", "p_brand")
    sums = t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("s")).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("s").alias("s"))
    return sums.join(part.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand").select("p_brand", r4(F.col("s") / F.col("n"), 5).alias("ibaq"))


@query("""WITH a AS (SELECT l_partkey, l_linenumber, l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_suppkey, l_partkey) AS rel FROM lineitem)
SELECT l_partkey, l_linenumber, round(sqrt(avg(rel)), 4) AS intensity, count(*) AS n FROM a GROUP BY ALL""")
def q20_max_normalize_sqrt_mean(spark, sf):
    a = t(spark, sf, "lineitem").select("l_partkey", "l_linenumber", (F.col("l_extendedprice") / F.max("l_extendedprice").over(Window.partitionBy("l_suppkey", "l_partkey"))).alias("rel"))
    return a.groupBy("l_partkey", "l_linenumber").agg(r4(F.sqrt(F.avg("rel"))).alias("intensity"), F.count("*").alias("n"))


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median_height, CAST(CASE WHEN count(*) > 10 THEN list_sort(list(o_totalprice), 'DESC')[5] ELSE -1 END AS DOUBLE) AS fifth
FROM orders GROUP BY o_orderpriority""")
def q21_median_height(spark, sf):
    o = t(spark, sf, "orders")
    mid = o.groupBy("o_orderpriority").agg(r4(F.percentile("o_totalprice", 0.5)).alias("median_height"), F.count("*").alias("_c"))
    fifth = W.top_k(o.select("o_orderpriority", "o_totalprice", "o_orderkey"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("_f"))
    return mid.join(fifth, "o_orderpriority").select("o_orderpriority", "median_height", F.when(F.col("_c") > 10, F.col("_f")).otherwise(-1.0).alias("fifth"))


@query("""WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) - min(o_totalprice) AS span FROM orders), b AS (SELECT o_orderkey, CAST(ceil((o_totalprice - lo) / 1000) AS BIGINT) AS bin, o_custkey FROM orders, m),
w AS (SELECT bin, sum(o_custkey) AS width FROM b GROUP BY bin) SELECT o_orderkey, b.bin FROM b JOIN w ON b.bin = w.bin WHERE width <= 60000""")
def q22_contaminant_bins(spark, sf):
    o = t(spark, sf, "orders")
    b = o.crossJoin(F.broadcast(o.agg(F.min("o_totalprice").alias("lo")))).select("o_orderkey", "o_custkey", F.ceil((F.col("o_totalprice") - F.col("lo")) / 1000).cast("long").alias("bin"))
    return b.join(b.groupBy("bin").agg(F.sum("o_custkey").alias("width")).where("width <= 60000").select("bin"), "bin").select("o_orderkey", "bin")


PARTS = "SELECT p_partkey, 100 * p_retailprice AS mz FROM part"


def parts(spark, sf):
    return t(spark, sf, "part").select("p_partkey", (100 * F.col("p_retailprice")).alias("mz"))


@query(f"SELECT o_orderkey, p_partkey, round(abs(o_totalprice - mz) * 1e6 / mz, 3) AS ppm FROM orders JOIN ({PARTS}) ON abs(o_totalprice - mz) * 1e6 / mz <= 20")
def q23_band_join_ppm(spark, sf):
    j = J.ppm_join(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), parts(spark, sf), "o_totalprice", "mz", 20)
    return j.select("o_orderkey", "p_partkey", r4(X.ppm("o_totalprice", "mz"), 3).alias("ppm"))


@query(f"""WITH e AS (SELECT event_id, user_id, {SECS.format('ts')} AS s, event_type FROM events), c AS (SELECT user_id AS u, min(s) AS lo, max(s) AS hi, CAST(floor(s / 7200) AS BIGINT) AS cid FROM (SELECT * FROM e WHERE event_type = 'click') GROUP BY user_id, floor(s / 7200)),
m AS (SELECT event_id, cid, s >= lo AND s <= hi AS tight FROM (SELECT * FROM e WHERE event_type = 'error') x JOIN c ON user_id = u AND s >= lo - 3600 AND s <= hi + 3600),
a AS (SELECT *, bool_or(tight) OVER (PARTITION BY event_id) AS any_tight FROM m) SELECT event_id, cid, tight FROM a WHERE tight OR NOT any_tight""")
def q24_tight_first_band_join(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", secs("ts").alias("s"), "event_type")
    c = e.where("event_type = 'click'").groupBy("user_id", F.floor(F.col("s") / 7200).cast("long").alias("cid")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    c = c.withColumn("wlo", F.col("lo") - 3600).withColumn("whi", F.col("hi") + 3600)
    m = J.range_join(e.where("event_type = 'error'"), c, "s", "wlo", "whi", 7200, ["user_id"])
    return J.tight_first(m.withColumn("tight", F.col("s").between(F.col("lo"), F.col("hi"))), ["event_id"], F.col("tight")).select("event_id", "cid", "tight")


SPANS = f"SELECT user_id, event_type, CAST(floor({SECS.format('ts')} / 172800) AS BIGINT) AS k, min({SECS.format('ts')}) AS lo, max({SECS.format('ts')}) AS hi FROM events GROUP BY ALL"


@query(f"""WITH i AS ({SPANS}), a AS (SELECT user_id, k AS ka, lo AS alo, hi AS ahi FROM i WHERE event_type = 'click' AND hi > lo), b AS (SELECT user_id AS u, k AS kb, lo AS blo, hi AS bhi FROM i WHERE event_type = 'view' AND hi > lo)
SELECT user_id, ka, kb, round(CASE WHEN blo <= alo AND bhi >= ahi THEN 1.0::DOUBLE ELSE (least(ahi, bhi) - greatest(alo, blo)) / (ahi - alo) END, 4) AS overlap FROM a JOIN b ON user_id = u AND alo <= bhi AND blo <= ahi WHERE least(ahi, bhi) > greatest(alo, blo)""")
def q25_interval_overlap_join(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_type", secs("ts").alias("s"))
    i = e.groupBy("user_id", "event_type", F.floor(F.col("s") / 172800).cast("long").alias("k")).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("hi > lo")
    a = i.where("event_type = 'click'").select("user_id", F.col("k").alias("ka"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = i.where("event_type = 'view'").select("user_id", F.col("k").alias("kb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    j = J.overlap_join(a, b, "alo", "ahi", "blo", "bhi", 172800, ["user_id"]).where("least(ahi, bhi) > greatest(alo, blo)")
    return j.select("user_id", "ka", "kb", r4(X.overlap_of_first("alo", "ahi", "blo", "bhi")).alias("overlap"))


@query(f"SELECT o_orderkey, p_partkey FROM orders JOIN ({PARTS}) ON o_totalprice BETWEEN mz - 2 AND mz + 3")
def q26_range_containment_join(spark, sf):
    w = parts(spark, sf).select("p_partkey", (F.col("mz") - 2).alias("lo"), (F.col("mz") + 3).alias("hi"))
    return J.range_join(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), w, "o_totalprice", "lo", "hi", 5).select("o_orderkey", "p_partkey")


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {SECS.format('ts')} AS s FROM events) SELECT a.event_id, max(b.s) AS previous FROM (SELECT * FROM e WHERE event_type = 'error') a
LEFT JOIN (SELECT user_id AS u, s FROM e WHERE event_type = 'click') b ON a.user_id = b.u AND b.s < a.s GROUP BY a.event_id""")
def q27_asof_backward(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", secs("ts").alias("s"))
    left, right = e.where("event_type = 'error'").select("event_id", "user_id", "s"), e.where("event_type = 'click'").select("user_id", F.col("s").alias("previous"))
    return J.asof_join(left, right, "s", "previous", [], ["user_id"], strict=True).select("event_id", "previous")


@query("""WITH k AS (SELECT DISTINCT CAST(p_size AS DOUBLE) - 0.5::DOUBLE AS key FROM part) SELECT l_orderkey, l_linenumber, l_partkey, coalesce((SELECT min(key) FROM k WHERE key >= l_quantity), (SELECT max(key) FROM k)) AS key,
coalesce((SELECT min(key) FROM k WHERE key >= l_quantity), (SELECT max(key) FROM k)) * 2 AS val FROM lineitem""")
def q28_asof_ceiling_else_last(spark, sf):
    k = t(spark, sf, "part").select((F.col("p_size").cast("double") - 0.5).alias("key"), (F.col("p_size").cast("double") * 2 - 1).alias("val")).distinct()
    return J.ceiling_lookup(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), k, "l_quantity", "key", ["val"]).select("l_orderkey", "l_linenumber", "l_partkey", "key", "val")


@query("""WITH c AS (SELECT o_custkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_orderkey, o_totalprice, v, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(o_totalprice - v), v) AS n
FROM orders JOIN c ON o_custkey = k WHERE o_orderstatus = 'O') SELECT o_orderkey, v AS nearest FROM a WHERE n = 1""")
def q29_nearest_match(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    left = o.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")
    right = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_totalprice").alias("nearest"))
    return J.nearest_join(left, right, "o_totalprice", "nearest", ["o_custkey"]).where("nearest is not null").select("o_orderkey", "nearest")


@query(f"""WITH m AS (SELECT p_partkey, arg_max(o_orderkey, struct_pack(a := o_custkey, b := o_orderkey)) AS best, max(o_custkey) AS score, count(o_orderkey) AS n FROM ({PARTS}) LEFT JOIN orders ON abs(o_totalprice - mz) <= 1.5 GROUP BY p_partkey)
SELECT p_partkey, best, coalesce(CAST(score AS DOUBLE), 1e-12) AS score, n FROM m""")
def q30_left_outer_best_match(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    j = J.band_join(parts(spark, sf), o, "mz", "o_totalprice", 1.5, how="left")
    m = j.groupBy("p_partkey").agg(F.max_by("o_orderkey", F.struct("o_custkey", "o_orderkey")).alias("best"), F.max("o_custkey").alias("score"), F.count("o_orderkey").alias("n"))
    return m.select("p_partkey", "best", F.coalesce(F.col("score").cast("double"), F.lit(1e-12)).alias("score"), "n")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def q31_semi_join_reference(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 400000").select("o_custkey")
    return t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n, 'identified' AS origin FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey)
SELECT * FROM a UNION ALL SELECT c_custkey, 0, 'mapped' FROM customer WHERE c_custkey NOT IN (SELECT k FROM a)""")
def q32_anti_join_upsert(spark, sf):
    a = t(spark, sf, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("identified"))
    return J.upsert_missing(a, t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("n"), F.lit("mapped").alias("origin")), ["k"])


@query("""WITH u AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS tier, min(l_partkey) AS v FROM lineitem GROUP BY ALL)
SELECT k, arg_min(tier, tier) AS tier, arg_min(v, tier) AS v FROM u GROUP BY k""")
def q33_key_union_priority(spark, sf):
    li = t(spark, sf, "lineitem")
    tiers = [li.where(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("k")).agg(F.lit(i).alias("tier"), F.min("l_partkey").alias("v")) for i, f in enumerate("ANR")]
    return J.union_first(tiers, ["k"]).select("k", "tier", "v")


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus <> 'O'")
def q34_intersect_runs(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.where("l_linestatus = 'O'").select("l_partkey", "l_suppkey").intersect(li.where("l_linestatus <> 'O'").select("l_partkey", "l_suppkey"))


@query("""WITH a AS (SELECT CAST(l_suppkey % 12 AS BIGINT) AS run, l_partkey AS k, CAST(min(l_quantity) AS DOUBLE) AS rt FROM lineitem GROUP BY ALL),
s AS (SELECT x.run AS run_a, y.run AS run_b, count(*) AS n, sum(x.rt) AS sx, sum(y.rt) AS sy, sum(x.rt * y.rt) AS sxy, sum(x.rt * x.rt) AS sxx, sum(y.rt * y.rt) AS syy FROM a x JOIN a y ON x.k = y.k AND x.run < y.run GROUP BY ALL)
SELECT run_a, run_b, n, sx, sy, sxy, sxx, syy, CASE WHEN n * sxx > sx * sx THEN round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) + 0.0 END AS slope FROM s""")
def q35_run_pair_regression(spark, sf):
    a = t(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 12).alias("run"), F.col("l_partkey").alias("k")).agg(F.min("l_quantity").alias("rt"))
    # runs of a key as one array: at most the number of runs, so pairs come without a join
    g = a.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("run", "rt"))).alias("r"))
    pairs = g.select(F.explode(F.flatten(F.transform("r", lambda x, i: F.transform(F.filter(F.col("r"), lambda y: y["run"] > x["run"]), lambda y: F.struct(x["run"].alias("a"), y["run"].alias("b"), x["rt"].alias("x"), y["rt"].alias("y")))))).alias("p")).select("p.*")
    s = pairs.groupBy(F.col("a").alias("run_a"), F.col("b").alias("run_b")).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    return s.withColumn("slope", F.expr("case when n * sxx > sx * sx then round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) + 0.0D end"))


@query(f"""WITH e AS (SELECT CAST(floor({SECS.format('ts')} / 3600) AS BIGINT) AS bin, event_type, max(value) AS v FROM events GROUP BY ALL), p AS (SELECT a.event_type AS ta, b.event_type AS tb, a.v AS x, b.v AS y FROM e a JOIN e b ON a.bin = b.bin AND a.event_type < b.event_type),
s AS (SELECT ta, tb, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM p GROUP BY ALL)
SELECT ta, tb, round(CASE WHEN n < 6 OR n * sxx <= sx * sx OR n * syy <= sy * sy OR n * sxy <= sx * sy THEN 0 ELSE (n * sxy - sx * sy) * (n * sxy - sx * sy) / ((n * sxx - sx * sx) * (n * syy - sy * sy)) END, 4) AS r2 FROM s""")
def q36_coelution_r2(spark, sf):
    e = t(spark, sf, "events").groupBy(F.floor(secs("ts") / 3600).cast("long").alias("bin"), "event_type").agg(F.max("value").alias("v"))
    p = e.select("bin", F.col("event_type").alias("ta"), F.col("v").alias("x")).join(e.select("bin", F.col("event_type").alias("tb"), F.col("v").alias("y")), "bin").where("ta < tb")
    s = p.groupBy("ta", "tb").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    return s.select("ta", "tb", F.expr("round(case when n < 6 or n * sxx <= sx * sx or n * syy <= sy * sy or n * sxy <= sx * sy then 0D else (n * sxy - sx * sy) * (n * sxy - sx * sy) / ((n * sxx - sx * sx) * (n * syy - sy * sy)) end, 4)").alias("r2"))


@query(f"""WITH e AS (SELECT event_id, user_id, CAST(floor({SECS.format('ts')}) AS BIGINT) AS s, value FROM events)
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 7200 PRECEDING AND 7200 FOLLOWING), 4) AS local_mean, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 7200 PRECEDING AND 7200 FOLLOWING) AS n FROM e""")
def q37_local_residual_mean(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", F.floor(secs("ts")).cast("long").alias("s"), "value")
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-7200, 7200)
    return e.select("event_id", r4(F.avg("value").over(w)).alias("local_mean"), F.count("*").over(w).alias("n"))


@query(f"""WITH e AS (SELECT event_id, user_id, {SECS.format('ts')} AS s, value FROM events), l AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 1800 THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM l) SELECT user_id, session, count(*) AS n, round(max(s) - min(s), 3) AS span, max(value) AS apex FROM g GROUP BY ALL""")
def q38_sessionize_gaps(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", secs("ts").alias("s"), "value")
    return W.sessions(e, ["user_id"], "s", "event_id", 1800).groupBy("user_id", "session").agg(F.count("*").alias("n"), r4(F.max("s") - F.min("s"), 3).alias("span"), F.max("value").alias("apex"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS n FROM lineitem), i AS (SELECT k, n, n - dense_rank() OVER (PARTITION BY k ORDER BY n) AS g FROM d)
SELECT k, min(n) AS first, max(n) AS last, count(*) AS length FROM i GROUP BY k, g HAVING count(*) >= 2""")
def q39_consecutive_islands(spark, sf):
    d = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("n")).distinct()
    return W.islands(d, ["k"], "n").groupBy("k", "island").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("length")).where("length >= 2").select("k", "first", "last", "length")


@query("""WITH e AS (SELECT event_id, user_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, user_id, value FROM e WHERE value > a AND value > b""")
def q40_local_extrema(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf, "events").select("event_id", "user_id", "value", F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("b")).where("value > a and value > b").select("event_id", "user_id", "value")


RUNS = list(range(4))


@query("SELECT l_partkey, " + ", ".join(f"round(sum(CASE WHEN l_suppkey % 4 = {r} THEN l_extendedprice END), 2) AS run{r}_intensity, count(CASE WHEN l_suppkey % 4 = {r} THEN 1 END) AS run{r}_n" for r in RUNS) + " FROM lineitem GROUP BY l_partkey")
def q41_run_matrix_pivot(spark, sf):
    p = t(spark, sf, "lineitem").withColumn("run", F.concat(F.lit("run"), F.col("l_suppkey") % 4)).groupBy("l_partkey").pivot("run", [f"run{r}" for r in RUNS]).agg(F.round(F.sum("l_extendedprice"), 2).alias("intensity"), F.count(F.lit(1)).alias("n"))
    return p.select("l_partkey", *[c for r in RUNS for c in (F.col(f"run{r}_intensity"), F.coalesce(f"run{r}_n", F.lit(0)).alias(f"run{r}_n"))])


@query(f"""WITH c AS (SELECT o_orderkey AS k, o_totalprice AS mass, {DAY.format('o_orderdate')} AS rt FROM orders)
SELECT a.k AS light, b.k AS heavy, round(abs(b.mass - (a.mass + 112.0995)), 4) AS error FROM c a JOIN c b ON abs(a.rt - b.rt) <= 30 AND abs(b.mass - (a.mass + 112.0995)) <= 5""")
def q42_mass_shift_pairs(spark, sf):
    o = t(spark, sf, "orders")
    a = o.select(F.col("o_orderkey").alias("light"), (F.col("o_totalprice") + 112.0995).alias("want"), day("o_orderdate").alias("rt_a"))
    b = o.select(F.col("o_orderkey").alias("heavy"), F.col("o_totalprice").alias("mass"), day("o_orderdate").alias("rt_b"))
    return J.band_join(a, b, "want", "mass", 5.0).where(F.abs(F.col("rt_a") - F.col("rt_b")) <= 30).select("light", "heavy", r4(F.abs(F.col("mass") - F.col("want"))).alias("error"))


@query(f"""WITH c AS (SELECT o_orderkey AS k, o_custkey AS cust, o_totalprice AS mass FROM orders)
SELECT a.k AS a, b.k AS b, i.k AS intact, round(i.mass - (a.mass + b.mass + 112.0995), 4) AS error FROM c a JOIN c b ON a.cust = b.cust AND (a.mass < b.mass OR (a.mass = b.mass AND a.k < b.k)) JOIN c i ON i.cust = a.cust AND abs(i.mass - (a.mass + b.mass + 112.0995)) <= 500""")
def q43_triple_sum_match(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("mass"))
    # pairs within a customer's co-eluting clusters, then the intact one by a band on the sum
    pairs = o.select("cust", F.col("k").alias("a"), F.col("mass").alias("ma")).join(o.select("cust", F.col("k").alias("b"), F.col("mass").alias("mb")), "cust").where("ma < mb or (ma = mb and a < b)")
    want = pairs.withColumn("want", F.col("ma") + F.col("mb") + 112.0995)
    return J.band_join(want, o.select("cust", F.col("k").alias("intact"), "mass"), "want", "mass", 500.0, ["cust"]).select("a", "b", "intact", r4(F.col("mass") - F.col("want")).alias("error"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def q44_substring_containment(spark, sf):
    return contained(t(spark, sf, "documents").select("doc_id", "text"), t(spark, sf, "benchmark").select("item_id", "text")).select("item_id", "doc_id")


@query("""SELECT s_suppkey, regexp_extract(s_name, '^([^#]+)#', 1) AS head, s_name || '_' || CAST(s_nationkey AS VARCHAR) AS key, (starts_with(s_name, 'Sup') OR ends_with(s_name, '7')) AS decoy,
CAST(len(regexp_extract_all(upper(s_name), '[KR][^P]')) AS INTEGER) AS cleavages, array_to_string(list_transform(string_split(s_name, '#'), lambda x: x || '(N)'), ';') AS mods FROM supplier""")
def q45_key_and_decoy_strings(spark, sf):
    s = t(spark, sf, "supplier")
    mods = F.transform(F.split("s_name", "#"), lambda x: F.struct(x.alias("name"), F.lit("N").alias("site")))
    return s.select("s_suppkey", F.regexp_extract("s_name", "^([^#]+)#", 1).alias("head"), X.ion_key("s_name", "s_nationkey").alias("key"), (F.col("s_name").startswith("Sup") | F.col("s_name").endswith("7")).alias("decoy"), X.missed_cleavages(F.upper("s_name")).alias("cleavages"), X.modification_text(mods).alias("mods"))


@query(f"""SELECT quality, CAST(count(CASE WHEN NOT decoy AND p < 0.5 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN decoy AND p < 0.5 THEN 1 END), 0) AS r_factor, max(CASE WHEN decoy THEN p END) AS max_decoy, round((max(p) - min(p)) / count(*), 6) AS cycle FROM ({DECOYS}) GROUP BY quality""")
def q46_r_factor_counts(spark, sf):
    low = F.col("p") < 0.5
    return decoys(spark, sf).groupBy("quality").agg(F.try_divide(F.count_if(~F.col("decoy") & low).cast("double"), F.count_if(F.col("decoy") & low)).alias("r_factor"), F.max(F.when(F.col("decoy"), F.col("p"))).alias("max_decoy"), r4((F.max("p") - F.min("p")) / F.count("*"), 6).alias("cycle"))


@query("""WITH q AS (SELECT vec_id AS a, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id AS b, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS y FROM embeddings)
SELECT a, b, round(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 4) AS dot FROM q, e WHERE list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) > 0.5""")
def q47_spectrum_similarity(spark, sf):
    """Every hundredth spectrum against all: the queries are a stated set, sent to all tasks in blocks of bounded size."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    e = t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("n", dot(F.col("v"), F.col("v")))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), F.col("v").alias("x"), F.col("n").alias("nx"))
    near = lambda both: both.withColumn("dot", dot(F.col("x"), F.col("y")) / F.sqrt(F.col("nx") * F.col("ny"))).where("dot > 0.5").select("a", "b", r4(F.col("dot")).alias("dot"))
    return J.in_blocks(e.select(F.col("vec_id").alias("b"), F.col("v").alias("y"), F.col("n").alias("ny")), q, near)


@query(f"""WITH d AS ({DECOYS}), s AS (SELECT count(*) AS n, 0.9 * stddev_pop(p) / pow(count(*), 0.2) AS h FROM d), c AS (SELECT CAST(floor(p * 1000) AS BIGINT) AS k, count(*) AS m FROM d GROUP BY 1), g AS (SELECT unnest(range(0, 51)) AS i)
SELECT i AS bin, round(sum(m * exp(-0.5 * pow((i / 50.0::DOUBLE - (k + 0.5) / 1000.0::DOUBLE) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 4) AS density FROM g, c, s GROUP BY i""")
def q48_density_grid(spark, sf):
    """Kernel density of the probabilities, binned to 1000 first: the grid meets bins, not rows."""
    d = decoys(spark, sf)
    s = d.agg(F.count("*").alias("n"), (0.9 * F.stddev_pop("p") / F.pow(F.count("*"), F.lit(0.2))).alias("h"))
    c = d.groupBy(F.floor(F.col("p") * 1000).cast("long").alias("k")).agg(F.count("*").alias("m"))
    g = spark.range(51).select(F.col("id").alias("bin"))
    j = c.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(g))
    z = (F.col("bin") / 50.0 - (F.col("k") + 0.5) / 1000.0) / F.col("h")
    return j.groupBy("bin").agg(r4(F.sum(F.col("m") * F.exp(-0.5 * z * z)) / (F.first("n") * F.first("h") * F.sqrt(2 * F.pi()))).alias("density"))
