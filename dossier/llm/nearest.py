"""Approximate nearest neighbours by randomly rotated one-bit codes (Gao and Long, 2024), reranked exactly.

Every vector is scaled to length 1, rotated by one random orthogonal matrix (after zeros that fill it up to LEAST_BITS) and kept as the signs of its components, packed to 64-bit words, with two
scalars: what corrects the code's inner products, and the error that they then have. A query, rotated alike, is cut into BITS bit planes; an inner product
is estimated by counting the bits that a code shares with each plane. The error of cutting the query (ROUNDING standard deviations of it) is added to the bounds. With EPSILON = 3 the bounds fail for a vector about
once in four hundred times.

Codes are made of all rows, in blocks; queries come in blocks too, and each block of queries meets each block of codes twice. Full vectors aren't in them. First the
FIRST * k rows of the largest estimates are looked up and scored exactly, which gives each query a score that its k-th nearest reaches at least. Then all rows whose upper bound
reaches that score are looked up and scored, by the true cosine in double precision. Nothing is fitted and no list is capped.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; vectors meet only those of their own dimension; a query doesn't
find rows with its own id; identical query rows are answered once, identical candidates count each; without candidates a query gives no rows; further columns change nothing. Vectors of very large or very small
components are scaled by a power of two, which leaves cosines as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pack, shuffle_parts, stored, unpack

BLOCK, MOST_IN_BLOCK, QUERIES = 4096, 65536, 512
LEAST_BITS = 512  #: of a code
BITS = 4  #: of a query's component
ROUNDING = 5.0  #: standard deviations of the error that cutting a query makes, which are allowed for
FIRST = 4
EPSILON = 3.0
SEED = 11
CODES = (np.int64, np.uint64, np.float32, np.float32)
ASKED = (np.int64, np.int64, np.float64, np.uint64, np.float32, np.float32, np.float32)
_rotations: dict[int, np.ndarray] = {}


def length(d: int) -> int:
    """Bits of a code: short vectors are filled up with zeros before they are rotated, as the error falls with the root of the length."""
    return max(d, LEAST_BITS)


def rotation(d: int) -> np.ndarray:
    """The first d columns of a random orthogonal matrix, the same everywhere."""
    if d not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(SEED + d).normal(size=(length(d), d)))
        _rotations[d] = q * np.sign(np.diag(r))
    return _rotations[d]


def rotated(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None] @ rotation(vectors.shape[1]).T


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (bits.ndim - 1) + [(0, -packed.shape[-1] % 8)])).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, correction scalars and error widths of the rows."""
    x = rotated(vectors)
    d = x.shape[1]
    factor = np.abs(x).sum(axis=1) / np.sqrt(d)
    width = EPSILON * np.sqrt(np.maximum(1 - factor**2, 0) / np.maximum(factor**2, 1e-12) / max(d - 1, 1))
    return words(x > 0), factor.astype(np.float32), (width + 1e-5).astype(np.float32)


def planes(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the rotated queries (rows x BITS x words), the value of 0, that of a step, and the sum of the values."""
    x = rotated(queries)
    low = x.min(axis=1)
    step = np.maximum((x.max(axis=1) - low) / (2**BITS - 1), 1e-12)
    cut = np.rint((x - low[:, None]) / step[:, None]).astype(np.int64)
    total = low * x.shape[1] + step * cut.sum(axis=1)
    bits = (cut[:, None, :] >> np.arange(BITS)[None, :, None]) & 1
    return words(bits.astype(bool)), low.astype(np.float32), step.astype(np.float32), total.astype(np.float32)


def estimates(codes: np.ndarray, factor: np.ndarray, width: np.ndarray, plane: np.ndarray, low: float, step: float, total: float, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of one query with the codes of d bits, and how far they may be off, from packed bits."""
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    shared = np.bitwise_count(codes[:, None, :] & plane[None]).sum(axis=2, dtype=np.int64) @ (1 << np.arange(BITS))
    return (2 * (low * ones + step * shared) - total) / np.sqrt(d) / factor, width + ROUNDING * step / np.sqrt(12) / factor + 1e-5


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v (floats as they are, else doubles) and dim of the rows that take part."""
    floats = vectors.schema[column].dataType.simpleString() == "array<float>"
    v = F.col(column) if floats else F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim")).where("vec_id is not null and v is not null").where(fine)
    if floats:  # their squares are no trouble in double precision
        return rows
    largest = F.array_max(F.transform("v", F.abs))
    power = F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(largest)).cast("double"))))
    return rows.withColumn("v", F.when(largest.between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x * power)))


def _matrix(column, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    return (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy().reshape(n, -1)


def _blocks(rows: DataFrame, least: int, most: int, make, name: str) -> DataFrame:
    """dim, block, blocks and the packed rows of each block; blocks are dealt by a hash of the row."""
    n = F.count("*")
    sizes = rows.groupBy("dim").agg(F.ceil(n / F.greatest(F.lit(least), F.least(F.lit(most), n / 64))).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(sizes), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col("blocks")).cast("int"))

    def join(group: pa.Table) -> pa.Table:
        return pa.table({"dim": group.column("dim")[:1], "block": group.column("block")[:1], "blocks": group.column("blocks")[:1], "data": pa.array([pack(*make(group))], pa.binary())})

    return stored(dealt.groupBy("dim", "block").applyInArrow(join, "dim int, block int, blocks int, data binary"), name)


def _index(group: pa.Table) -> tuple:
    ids = group.column("vec_id").to_numpy()
    return ids, *encode(_matrix(group.column("v"), len(ids)))


def _asked(group: pa.Table) -> tuple:
    ids = group.column("vec_id").to_numpy()
    return ids, group.column("qh").to_numpy(), group.column("reach").to_numpy(), *planes(_matrix(group.column("v"), len(ids)))


def candidates(index: DataFrame, asked: DataFrame, first: int | None) -> DataFrame:
    """query_id, qh, dim, vec_id and estimate of the codes that each query takes from each block: those of the first largest estimates, or, without
    first, all whose upper bounds reach the query's reach."""
    counts = index.groupBy("dim").agg(F.max("blocks").alias("n"))
    sent = asked.select("dim", F.col("block").alias("asking"), F.col("data").alias("asked")).join(F.broadcast(counts), "dim").select("dim", "asking", "asked", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    both = index.select("dim", "block", "data").join(sent, ["dim", "block"]).repartition(shuffle_parts(index.sparkSession), "dim", "block", "asking").select("dim", "data", "asked")

    def run(batches):
        for batch in batches:
            for dim, data, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, codes, factor, width = unpack([data], *CODES)
                qid, qh, reach, plane, low, step, total = unpack([block], *ASKED)
                codes, plane = codes.reshape(len(ids), -1), plane.reshape(len(qid), BITS, -1)
                rows, found, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                for i in range(len(qid)):
                    estimate, off = estimates(codes, factor, width, plane[i], float(low[i]), float(step[i]), float(total[i]), length(dim))
                    other = ids != qid[i]
                    if first is None:
                        at = np.flatnonzero(other & (estimate + off >= reach[i]))
                    else:
                        at = np.flatnonzero(other)
                        at = at[np.argpartition(-estimate[at], first)[:first]] if len(at) > first else at
                    rows.append(np.full(len(at), i))
                    found.append(ids[at])
                    value.append(estimate[at])
                row = np.concatenate(rows)
                yield pa.record_batch([pa.array(qid[row]), pa.array(qh[row]), pa.array(np.full(len(row), dim, np.int32)), pa.array(np.concatenate(found)), pa.array(np.concatenate(value))], ["query_id", "qh", "dim", "vec_id", "estimate"])

    return both.mapInArrow(run, "query_id long, qh long, dim int, vec_id long, estimate double")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def best(found: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, qh, rank, vec_id and score of each query's k best of the found, by exact cosines, ties to smaller ids."""
    pairs = found.select("query_id", "qh", "dim", "vec_id").distinct().join(base, ["vec_id", "dim"])
    pairs = pairs.join(queries.select(F.col("vec_id").alias("query_id"), "qh", F.col("v").alias("q")), ["query_id", "qh"])
    score = _dot(F.col("v"), F.col("q")) / (F.sqrt(_dot(F.col("v"), F.col("v"))) * F.sqrt(_dot(F.col("q"), F.col("q"))))
    order = W.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "vec_id")
    scored = pairs.select("query_id", "qh", "vec_id", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "qh", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of vectors (vec_id, embedding) for each row of queries, which are as vectors."""
    base, asked = valid(vectors), valid(queries).dropDuplicates(["vec_id", "v"]).withColumn("qh", F.xxhash64("v"))
    index = _blocks(base, BLOCK, MOST_IN_BLOCK, _index, "nearest-index")
    blank = _blocks(asked.withColumn("reach", F.lit(0.0)), QUERIES, QUERIES, _asked, "nearest-queries")
    order = W.partitionBy("query_id", "qh").orderBy(F.col("estimate").desc(), "vec_id")
    first = candidates(index, blank, FIRST * k).withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST * k)
    reach = best(first, base, asked, k).groupBy(F.col("query_id").alias("vec_id"), "qh").agg(F.when(F.count("*") >= k, F.min("score")).alias("reach"))
    known = asked.join(stored(reach, "nearest-reach"), ["vec_id", "qh"], "left").withColumn("reach", F.coalesce("reach", F.lit(-10.0)) - F.lit(1e-6))
    found = candidates(index, _blocks(known, QUERIES, QUERIES, _asked, "nearest-known"), None)
    return best(found, base, asked, k).select("query_id", "rank", "vec_id", "score")
