"""Mixing sources to target weights by hash-threshold histograms.

A document's hash stands for its place in its source. Words are summed by source and hash bucket; the running sum finds the
bucket where a source's budget ends, which alone is summed again in finer buckets, and last by single hashes. What remains is one
hash per source: documents up to it are taken once more than the others. Documents are never sorted, and what is
summed for a source has at most `1 << BITS` rows a level.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; rows with the same id in a source share a
hash and are taken or left together; a source without words has target 0; without rows the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
BITS = 12  #: of the hash, that each of the first two levels tells apart
HASH_BITS = 60
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2  #: of all sizes; of a source's own size


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text; a null id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (skey, source, source_size), a row for each source; adds target by filling to one level: min(most * size, level * weight)."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_key = W.orderBy(F.col("full"), F.col("source").asc_nulls_last())
    before, after = by_key.rowsBetween(W.unboundedPreceding, -1), by_key.rowsBetween(0, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    out = out.withColumn("full", F.col("cap") / F.col("weight")).withColumn("budget", share * F.sum("source_size").over(every))
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") < F.col("full"), F.struct("full", "level"))).over(every)["level"]
    return out.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("skey", "source_size", "target")


def thresholds(slim: DataFrame, sources: DataFrame) -> DataFrame:
    """skey, source_size, target, base (times that every document is taken) and last (hash up to which one more time)."""
    base = F.when(F.col("target") >= F.col("source_size"), F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    plan = sources.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    edge, shift = plan.select("skey", "rest", F.lit(0).cast("long").alias("prefix")), HASH_BITS
    for _ in range(2):
        shift -= BITS
        sums = _in_edge(slim, edge, shift + BITS).groupBy("skey", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"))
        running = W.partitionBy("skey").orderBy("b")
        sums = sums.join(edge, "skey").withColumn("before", F.sum("words").over(running) - F.col("words"))
        at = F.max(F.when(F.col("before") <= F.col("rest"), F.struct("b", "before")))
        found = sums.groupBy("skey").agg(at.alias("at"), F.max("rest").alias("rest"))
        edge = found.select("skey", (F.col("rest") - F.col("at.before")).alias("rest"), F.col("at.b").alias("prefix"))
    sums = _in_edge(slim, edge, shift).groupBy("skey", "h").agg(F.sum("size").alias("words"))
    running = W.partitionBy("skey").orderBy("h")
    sums = sums.join(edge, "skey").withColumn("before", F.sum("words").over(running) - F.col("words"))
    last = sums.groupBy("skey").agg(F.max(F.when(F.col("rest") - F.col("before") >= F.col("words") / 2, F.col("h"))).alias("within"), F.max(F.shiftleft("prefix", shift)).alias("low"))
    return plan.join(last, "skey", "left").select("skey", "source_size", "target", "base", F.coalesce("within", F.col("low") - 1, F.lit(-1)).alias("last"))


def _in_edge(slim: DataFrame, edge: DataFrame, shift: int) -> DataFrame:
    """The rows whose hash starts with their source's prefix."""
    return slim.join(edge.select(F.col("skey"), F.col("prefix")), "skey").where(F.shiftright("h", shift) == F.col("prefix")).drop("prefix")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs (doc_id, text, source)."""
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    slim = stored(docs.select("doc_id", skey.alias("skey"), words_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")), "mix")
    sizes = slim.groupBy("skey").agg(F.sum("size").alias("source_size")).withColumn("source", F.expr("if(skey = 'n', null, substr(skey, 2))"))
    sources = stored(targets(sizes), "mix-sources")
    cut = stored(thresholds(slim, sources), "mix-cut")
    taken = F.col("size") * (F.col("base") + (F.col("h") <= F.col("last")).cast("long"))
    return slim.join(cut, "skey").select("doc_id", "size", "source_size", "target", taken.alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, CAST(cap AS DOUBLE) / weight AS full_at, 1.5::DOUBLE * CAST((SELECT sum(source_size) FROM s) AS BIGINT) AS budget FROM w),
l AS (SELECT *, (budget - CAST(coalesce(sum(cap) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(weight) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM f),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, full_at) FROM l WHERE level < full_at), 'inf'::DOUBLE) * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN target >= source_size THEN CAST(floor(target / greatest(source_size, 1)) AS BIGINT) ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - words AS before FROM g),
x AS (SELECT c.source, max(c.h) AS last FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
    WHERE b.target - b.base * b.source_size - c.before >= CAST(c.words AS DOUBLE) / 2 GROUP BY c.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, b.source_size, b.target,
    CAST(d.size * (b.base + CASE WHEN d.h <= coalesce(x.last, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
