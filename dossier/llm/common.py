"""What the corpus operators share: storage in the cluster's shared folder, word hashing, bucketed blobs.

Words are maximal runs of bytes other than space and \\x09-\\x0D of the UTF-8 text.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on: its arrays stay in a processor's cache.
CHUNK_BYTES = 1 << 17
#: Bytes of an Arrow batch, about; a longer row is a batch by itself.
BATCH_LIMIT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, as in tests, a new one, but only if all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="dossier-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get by their bytes, unless the session does. Spark's default counts rows only, so 10,000 long texts would be one batch."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(ARROW_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, so that lost executors cost no more than one step.

    What discard() hasn't deleted before goes when the application ends.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "_stored_at", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def place_of(*key: str | Column) -> Column:
    """A row's place in a random order: 63 bits of a hash of its key."""
    return F.xxhash64(*key).bitwiseAND(F.lit(2**63 - 1))


def bound(n: int, k: int, least: int | None = None) -> int:
    """A place below which k of n rows lie, with so much room that fewer are as good as impossible; above the least place that there is."""
    room = k + 8 * math.sqrt(k) + 16
    return max(2**63 - 1 if n <= room else int(2**63 * (room / n)), (least if least is not None else -1) + 1)


def least(df: DataFrame, k: int, *key: str) -> DataFrame:
    """The k rows of the least places, ties by key: a random sample that doesn't depend on partitions, empty only if df is.

    Rows are filtered by place first, so no task sorts more than about k.
    """
    place = place_of(*key)
    n, low = df.agg(F.count("*"), F.min(place)).first()
    some = df if n <= k else df.where(place < bound(n, k, low))
    return some.orderBy(place, *key).limit(k)


def least_values(df: DataFrame, k: int, key: str) -> DataFrame:
    """The k distinct values of the column key that have the least places, ties by value. A value that many rows share is combined before it is shuffled, and counts once."""
    place = place_of(key)
    n, low = df.agg(F.approx_count_distinct(key, 0.05), F.min(place)).first()
    some = df.where(place < bound(int(0.75 * n), k, low))  # five standard deviations of the count are allowed for
    return some.select(key).distinct().orderBy(place, key).limit(k)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64), _P, np.uint64))])
    return _powers


def hash_words(texts: list[bytes], lower: bool = False, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words start (one entry more than there are texts)."""
    words, offsets, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for a, b in chunks(texts):
        w, o = _hash_words(texts[a:b], lower, breaks)
        words.append(w)
        offsets.append(o[1:] + n)
        n += len(w)
    return np.concatenate(words), np.concatenate(offsets)


def _hash_words(texts: list[bytes], lower: bool = False, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        buf = _LOWER[buf]
    gap = breaks.take(buf)
    table = np.where(breaks, np.uint64(0), _BYTE)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.searchsorted(starts, ends_of_texts)]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    spans = np.diff(np.append(starts, len(buf)))
    place = np.arange(starts[0], len(buf), dtype=np.int32) - np.repeat(starts.astype(np.int32), spans)
    longest = int((ends - starts).max())
    value = table.take(buf[starts[0] :]) * _power_table(longest + 1).take(place, mode="clip")
    return mix(np.add.reduceat(value, starts - starts[0])), offsets


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, made by doubling; empty if there are fewer than k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, have, span = np.zeros(n, np.uint64), 0, words, 1
    power = np.full(1, _Q)  # an array, since its products wrap around
    scale = np.ones(1, np.uint64)
    while span <= k:
        if k & span:
            out = out + have[done : done + n] * scale
            done += span
            scale = scale * power
        if span * 2 <= k:
            have = have[: len(have) - span] + have[span:] * power
            power = power * power
        span *= 2
    return mix(out)


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; nulls become empty."""
    import pyarrow as pa

    return [b if b is not None else b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary value."""
    return np.array([a.nbytes for a in arrays], np.uint32).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(blobs: list[bytes], *kinds) -> list[np.ndarray]:
    """The arrays of many packed values, each joined to one."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        at = 4 * len(kinds)
        for part, kind, n in zip(parts, kinds, np.frombuffer(blob, np.uint32, len(kinds)), strict=True):
            part.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at))
            at += n
    return [np.concatenate(p) for p in parts]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def text_keys(text: str | Column = "text") -> list[Column]:
    """Two columns, k1 and k2, that name a text by 128 bits of its hash; null where it is null."""
    t = (F.col(text) if isinstance(text, str) else text).cast("string")
    return [F.when(t.isNotNull(), F.xxhash64(*seed, t)).alias(name) for name, seed in (("k1", []), ("k2", [F.lit(7), F.length(t)]))]


def batched(batches, most: int):
    """Joins Arrow batches to ones of about so many bytes, and splits larger ones by rows."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += batch.nbytes * part.num_rows // max(batch.num_rows, 1)
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_groups(batches, most: int):
    """Arrow tables of about so many bytes whose rows come sorted by the first column; rows with one value of it are never parted."""
    import pyarrow as pa

    held = None
    for t in batched(batches, most):
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        first = t.column(0).to_numpy()
        other = np.flatnonzero(first != first[-1])
        end = int(other[-1]) + 1 if len(other) else 0
        if end:
            yield t.slice(0, end)
        held = t.slice(end)
    if held is not None:
        yield held


def free_name(df: DataFrame, name: str) -> str:
    """The name, with so many underscores before it that df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = "_" + name
    return name


def row_keys(df: DataFrame) -> list[Column]:
    """Two columns, r1 and r2, that name a row by 128 bits of a hash of all its columns. Only rows alike in all of them share it."""
    every = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat_ws("", *[F.when(c.isNull(), "0").otherwise("1") for c in every])
    return [F.xxhash64(*seed, nulls, *every).alias(name) for name, seed in (("r1", []), ("r2", [F.lit(11)]))]


#: Bits of a member table for each key that it holds; its size at most, 16 MB.
KEY_BITS, MOST_KEY_BITS = 16, 1 << 27


def members(keys: DataFrame, n: int) -> Column:
    """A condition on k1 and k2 that holds for all of the n keys (k1, k2) and for few others: a Bloom filter of at most MOST_KEY_BITS bits.

    It is bounded, so with very many keys it lets more others through; what follows must join exactly.
    """
    import pandas as pd

    m = 1 << min(max(16, (n * KEY_BITS).bit_length()), MOST_KEY_BITS.bit_length() - 1)
    places = F.array(*[F.pmod(F.xxhash64("k1", "k2", F.lit(i)), F.lit(m)) for i in range(4)])
    words = keys.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    got = words.toArrow()
    table = np.zeros(m >> 6, np.uint64)
    table[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    def may_be(a, b, c, d):
        found = np.ones(len(a), bool)
        for p in (a, b, c, d):
            x = p.to_numpy()
            found &= (shared.value[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) > 0
        return pd.Series(found)

    may_be.__annotations__ = dict.fromkeys(("a", "b", "c", "d", "return"), pd.Series)
    return F.pandas_udf(may_be, "boolean")(*[F.pmod(F.xxhash64("k1", "k2", F.lit(i)), F.lit(m)) for i in range(4)])
