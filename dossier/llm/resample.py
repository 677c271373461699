"""Importance resampling towards a target: documents are drawn by how much likelier their features are in the target than in the corpus.

A word is a run of characters other than ASCII ones that are no letter or digit, A-Z lower-cased. Features are all runs of 1 to `longest` consecutive words of a text, counted with repeats and dealt to `buckets`
buckets by the CRC-32 of their bytes, words joined by one space. Each task maps its distinct words to ids in a dictionary of bounded size (a corpus-wide one would have to be shuffled to every word), writes n-grams as
tuples of ids, hashes the bytes of each distinct tuple once and joins the buckets and counts back to its texts. Two histograms of `buckets` cells leave the tasks, nothing else.

A null or empty text, or one without words, has no features and weight 0. Texts of any length are read whole. Repeated rows are rows of their own and draw the same score; ties go to the smaller doc_id, then to the
smaller number of features and weight. An empty corpus gives no rows, an empty target leaves all gains to the corpus's counts. A null doc_id is hashed as an empty one and is the smallest. Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, shuffle_parts, stored

BUCKETS = 10_000
#: Words and tuples that a task's dictionary holds before it starts anew.
MOST_KNOWN = 1 << 20

#: To lower case, and a space for every byte that is in no word.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Dictionary:
    """Ids of words, and the bucket of each tuple of ids that was met."""

    def __init__(self, buckets: int, most: int = MOST_KNOWN):
        self.buckets, self.most = buckets, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.words: list[bytes] = []
        self.known: dict[tuple[int, ...], int] = {}

    def encode(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > self.most or len(self.known) > self.most:
            self.clear()
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > len(self.words):
            self.words = list(self.ids)
        return ids

    def bucket(self, key: tuple[int, ...]) -> int:
        """The bucket of a tuple, whose bytes are put together and hashed when it is first met."""
        b = self.known.get(key)
        if b is None:
            b = self.known[key] = zlib.crc32(b" ".join([self.words[i] for i in key])) % self.buckets
        return b


def features(texts: list[bytes], dictionary: Dictionary, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the text of each feature, and the number of words of each text."""
    split = [t.translate(_FOLD).split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    ids = dictionary.encode([w for words in split for w in words])
    of = np.repeat(np.arange(len(texts)), n)
    found, texts_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    codes, wide = ids, max(len(dictionary.words), 1)
    for k in range(1, longest + 1):
        if k > 1:
            _, codes = np.unique(codes, return_inverse=True)  # the tuples of k - 1 words by rank, so that a tuple's code fits 64 bits
            codes = codes[:-1] * wide + ids[k - 1 :]
            within = of[k - 1 :] == of[: len(of) - k + 1]
        else:
            within = np.ones(len(ids), bool)
        if not len(codes):
            break
        at = np.flatnonzero(within)
        _, first, back = np.unique(codes[at], return_index=True, return_inverse=True)
        tuples = zip(*[ids[at[first] + j].tolist() for j in range(k)], strict=True)
        found.append(np.fromiter(map(dictionary.bucket, tuples), np.int64, len(first))[back])
        texts_of.append(of[at])
    return np.concatenate(found), np.concatenate(texts_of), n


def histogram(docs: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """Features by bucket. A task sends one row a bucket."""
    import pyarrow as pa

    def run(batches):
        dictionary, sums = Dictionary(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(features(as_bytes(batch.column(0)), dictionary, longest)[0], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    sums = np.zeros(buckets, np.int64)
    for r in rows:
        sums[r.bucket] = r.n
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the smoothed shares of each bucket, floored."""
    k, S, T = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + k) / ((s + 1.0) * (T + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def fit(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """The gains of all buckets, from all texts of both."""
    return gains(histogram(docs, buckets, longest), histogram(target, buckets, longest))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_features, weight (the mean gain of the features, floored) and n_words of each document."""
    import pyarrow as pa

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        dictionary = Dictionary(len(shared.value))
        for batch in batches:
            texts = as_bytes(batch.column(1))
            bucket, of, n_words = features(texts, dictionary, longest)
            n, total = np.bincount(of, minlength=len(texts)), np.zeros(len(texts), np.int64)
            np.add.at(total, of, shared.value[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.int64()), pa.array(n_words, pa.int64())], ["doc_id", "n_features", "weight", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_features long, weight long, n_words long")


def with_score(weighed: DataFrame, seed: int = 2024) -> DataFrame:
    """With score: the weight and Gumbel noise that only the seed and doc_id decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """scored, stored, with rank: the place among the drawn documents, null for the others.

    Scores are whole numbers of some hundred thousand values at most, so counts by score tell where the draw ends, and only rows from there on are sorted, over all tasks. A task's rows are numbered within it and the counts of
    the tasks before it are added.
    """
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    by_score = sorted(((r.score, r.n) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    k = percent * sum(n for _, n in by_score) // 100
    low, above = None, 0
    for score, n in by_score:
        if above >= k:
            break
        low, above = score, above + n
    none = F.lit(None).cast("long")
    if low is None:
        return scored.withColumn("rank", none)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc(), F.col("weight").asc()]
    part = scored.where(able & (F.col("score") >= low)).repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    part = stored(part.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "drawn")
    before, start = [], 0
    for r in part.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a task
        before.append((r.part, start))
        start += r.n
    place = part.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part").withColumn("rank", F.col("before") + F.col("place") + 1)
    ranked = place.select(*scored.columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return scored.where(~(able & (F.col("score") >= low))).withColumn("rank", none).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    scored = stored(with_score(weigh(docs, fit(docs, target, buckets, longest), longest), seed), "weights")
    return draw(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 as its definition has it: a table of the 256 bytes, made by eight steps each, then one step a byte of each distinct word.
ORACLE_SQL = r"""WITH RECURSIVE steps AS (SELECT range AS b, 0 AS i, range::BIGINT AS c FROM range(256) UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE i = 8),
tok AS (SELECT d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
occ AS (SELECT d, unnest(w) AS word FROM tok),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
words AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM occ UNION SELECT word FROM target)),
buckets AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: (strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 2 AS BIGINT), 1)) - 1)),
  lambda c, y: xor(c >> 8, t[CAST(xor(c & 255, y) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket FROM words, crc),
s AS (SELECT bucket, count(*) AS n FROM occ JOIN buckets USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM target JOIN buckets USING (word) GROUP BY 1),
total AS (SELECT (SELECT count(*) FROM occ)::DOUBLE AS s, (SELECT count(*) FROM target)::DOUBLE AS t),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (total.s + 10000) / ((s.n::DOUBLE + 1) * (total.t + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), total),
of AS (SELECT d, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM occ JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY d),
rows AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, substr(sha256('2024:' || doc_id), 1, 8) AS x FROM tok LEFT JOIN of USING (d)),
hashed AS (SELECT *, list_reduce(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(x, CAST(i AS BIGINT), 1)) - 1)::BIGINT), lambda a, b: a * 16 + b)::DOUBLE AS h FROM rows),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= k THEN place END AS rank FROM placed"""
