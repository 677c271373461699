"""Phrases whose words stand together more often than chance has it, by language.

A text is lower-cased in A-Z and parted at `[.,;:!?\\x0A-\\x0D]` into pieces, these at spaces and tabs into words. Phrases are runs of 2 to `longest` words within a piece. They are found in four readings of the texts:

1. a count-min sketch of single words and pairs, 2. one of longer runs all of whose pairs reach `least` in the first: upper bounds, so that nothing frequent is missed;
3. the phrases whose bounds reach `least`, written out: the candidates; 4. automata of the candidates, whose steps are whole words, count all matches, overlapping ones included.
Sums over all tasks are exact counts, and what is under `least` goes. What tasks send is packed: blocks of a sketch, phrases by bucket, counts by block; blocks are added as they stream through a task. The sketch has cells in proportion to the texts, so that
as small a share of it reaches `least` in much text as in little. Automata are sorted arrays, some 16 bytes a candidate; where the candidates need more than a bounded number of bytes, there is another reading for each further set.

A null or empty text has no words, a null language is `und`. Any length is read whole, repeated rows count each, an empty table gives no rows, further columns are ignored; ties of scores go to the larger count, then to the
lesser phrase in the order of its UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, chunks, discard, mix, shuffle_parts, stored

#: Cells of each of the sketch's two rows, at least and at most, bytes of text for each, and cells of a block that is added at a time, at least and at most.
CELLS, MOST_CELLS, CELL_BYTES = 1 << 23, 1 << 28, 160
BLOCK, MOST_BLOCK = 1 << 14, 1 << 16
#: Hashes that a task counts before it sends them.
HELD_HASHES = 1 << 22
#: Bytes of candidates in one set of automata.
AUTOMATA_BYTES = 64 << 20
#: Phrases a task remembers having written, and bytes of them that it packs together.
MOST_WRITTEN, HELD_BYTES = 1 << 20, 8 << 20

#: Bytes of pieces that one step works on: its arrays stay in a processor's cache.
STEP = 1 << 17

#: To lower case, a space for a tab and a line feed for every end of a piece.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_END = b"\n"
_RNG = np.random.default_rng(20250711)
_VALUES = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[[10, 32]] = 0
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_P = 0x9E3779B97F4A7C15
#: Powers of an odd number and of its inverse, from the zeroth.
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 2 * STEP)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (_P, pow(_P, -1, 1 << 64))]
    return _powers


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def steps(texts: list[bytes]):
    """Folded texts, joined, in parts of about STEP bytes that end where pieces do."""
    for a, b in chunks(texts, STEP):
        whole, at = _END.join(texts[a:b]), 0
        while len(whole) - at > 2 * STEP and (end := whole.find(_END, at + STEP)) >= 0:
            yield whole[at:end]
            at = end + 1
        yield whole[at:]


class Words:
    """The words of folded pieces of one language: where they stand, which piece each is in, and hashes of their runs."""

    def __init__(self, text: bytes, lang: str):
        self.text, self.seed = text, _seed(lang)
        at = np.frombuffer(text, np.uint8)
        values = _VALUES.take(at)
        gap = np.ones(len(at) + 2, bool)
        np.equal(values, 0, out=gap[1:-1])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        if len(self.starts):
            self.piece = np.searchsorted(np.flatnonzero(at == 10), self.starts)
            power, inverse = _power_tables(len(at))
            values *= power[: len(at)]
            self.hashes = mix(np.add.reduceat(values, self.starts) * inverse[self.starts])
        else:
            self.piece, self.hashes = self.starts, np.zeros(0, np.uint64)

    def runs(self, longest: int):
        """(k, where each run of k words starts, its hash) for k from 1; runs lie within a piece."""
        grams = self.hashes
        for k in range(1, longest + 1):
            if k > 1:
                grams = mix(grams[:-1] * _Q + self.hashes[k - 1 :])
            if not len(grams):
                return
            at = np.flatnonzero(self.piece[k - 1 :] == self.piece[: len(self.piece) - k + 1])
            yield k, at, mix(grams[at] ^ self.seed)

    def phrase(self, start: int, k: int) -> bytes:
        return b" ".join([self.text[a:b] for a, b in zip(self.starts[start : start + k].tolist(), self.ends[start : start + k].tolist(), strict=True)])


def folded(batch) -> dict[str, list[bytes]]:
    """The texts of a batch (lang, text), by language."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
        by_lang.setdefault("und" if lang is None else lang, []).append(text.translate(_FOLD))
    return by_lang


def worded(batches):
    """(lang, Words) of all batches, step by step."""
    for batch in batches:
        for lang, texts in folded(batch).items():
            for text in steps(texts):
                yield lang, Words(text, lang)


def cells(hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """The cell of each hash in either row."""
    return [(hashes & np.uint64(n - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(n - 1)).astype(np.int64) + n]


def reaches(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both cells of each hash reached the threshold."""
    n = len(bits) * 4
    a, b = cells(hashes, n)
    return ((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1).astype(bool)


def longer_runs(words: Words, longest: int, bits: np.ndarray):
    """As runs(), from 3 words on, of those alone whose pairs all reach the threshold."""
    good = None
    for k, at, hashes in words.runs(longest):
        if k == 2:
            good = np.zeros(len(words.starts), np.int64)
            good[at[reaches(bits, hashes)]] = 1
            good = np.concatenate([[0], np.cumsum(good)])
        elif k > 2:
            keep = good[at + k - 1] - good[at] == k - 1
            yield k, at[keep], hashes[keep]


def _blob(at: np.ndarray, counts: np.ndarray, block: int) -> bytes:
    """A block of small counts: the places and values of those over zero if they are few, else all, compressed."""
    if len(at) * 16 < block:
        return b"s" + at.astype(np.uint16).tobytes() + counts.tobytes()
    whole = np.zeros(block, np.uint8)
    whole[at] = counts
    return b"d" + zlib.compress(whole.tobytes(), 1)


def _add(total: np.ndarray, blob: bytes) -> None:
    if blob[:1] == b"d":
        total += np.frombuffer(zlib.decompress(blob[1:]), np.uint8)
    else:
        n = (len(blob) - 1) // 3
        total[np.frombuffer(blob, np.uint16, n, 1)] += np.frombuffer(blob, np.uint8, n, 1 + 2 * n)


def sketch(texts: DataFrame, least: int, runs, n: int = CELLS) -> np.ndarray:
    """Bits of the cells that reach `least` when the runs (of Words) of all texts (lang, text) are counted into them.

    Counts stop at `top`, which is as good as the threshold: a task sends a byte a cell at most.
    """
    import pyarrow as pa

    top, block = min(least, 255), min(max(BLOCK, n >> 9), MOST_BLOCK, n)

    def packed(held):
        some, many = (np.concatenate(x) for x in zip(*held, strict=True))
        for at in cells(some, n):
            keys = np.sort(at.astype(np.uint64) << np.uint64(8) | many)
            at = (keys >> np.uint64(8)).astype(np.int64)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            sums = np.minimum(np.add.reduceat((keys & np.uint64(255)).astype(np.int64), first), top).astype(np.uint8)
            at = at[first]
            used = np.unique(at // block)
            edges = np.append(np.searchsorted(at, used * block), len(at))
            for i in range(0, len(used), 64):
                blobs = [_blob(at[x:y] - j * block, sums[x:y], block) for j, x, y in zip(used[i : i + 64].tolist(), edges[i:].tolist(), edges[i + 1 :].tolist())]
                yield pa.record_batch([pa.array(used[i : i + 64], pa.int64()), pa.array(blobs, pa.binary())], ["block", "counts"])

    def count(batches):
        held, size = [], 0
        for _, words in worded(batches):
            for _, _, hashes in runs(words):
                some, many = np.unique(hashes, return_counts=True)
                held.append((some, np.minimum(many, top).astype(np.uint64)))
                size += len(some)
            if size > HELD_HASHES:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for j, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = totals.setdefault(j, np.zeros(block, np.uint16))
                _add(total, blob)
                np.minimum(total, top, out=total)
        yield pa.record_batch([pa.array(list(totals), pa.int64()), pa.array([np.packbits(t >= top, bitorder="little").tobytes() for t in totals.values()], pa.binary())], ["block", "bits"])

    counted = texts.mapInArrow(count, "block long, counts binary").repartition(shuffle_parts(texts.sparkSession), "block")
    bits = np.zeros((2 * n // block, block // 8), np.uint8)
    for r in counted.mapInArrow(add, "block long, bits binary").toLocalIterator():  # a row a block
        bits[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits.ravel()


def candidates(texts: DataFrame, least: int, longest: int, n: int = CELLS) -> DataFrame:
    """(lang, phrase, words) of all runs of 1 to `longest` words whose upper bounds reach `least`, each once: a superset of the frequent ones."""
    import pyarrow as pa

    spark = texts.sparkSession
    short = spark.sparkContext.broadcast(sketch(texts, least, lambda words: words.runs(2), n))
    long = spark.sparkContext.broadcast(sketch(texts, least, lambda words: longer_runs(words, longest, short.value), n)) if longest > 2 else None

    buckets = 4 * shuffle_parts(spark)

    def write(batches):
        written: set[int] = set()
        held: dict[tuple[str, int], list[bytes]] = {}
        size = 0

        def packed():
            keys = list(held)
            for i in range(0, len(keys), 1 << 12):
                part = keys[i : i + (1 << 12)]
                yield pa.record_batch([pa.array([x for x, _ in part], pa.string()), pa.array([x for _, x in part], pa.int32()), pa.array([zlib.compress(_END.join(held[x]), 1) for x in part], pa.binary())], ["lang", "bucket", "phrases"])

        for lang, words in worded(batches):
            levels = [(k, at, h, short) for k, at, h in words.runs(2)] + ([(k, at, h, long) for k, at, h in longer_runs(words, longest, short.value)] if long else [])
            for k, at, hashes, table in levels:
                keep = reaches(table.value, hashes)
                some, first = np.unique(hashes[keep], return_index=True)
                for h, start in zip(some.tolist(), at[keep][first].tolist(), strict=True):
                    if h not in written:
                        written.add(h)
                        held.setdefault((lang, h % buckets), []).append(phrase := words.phrase(start, k))
                        size += len(phrase)
            if len(written) > MOST_WRITTEN or size > HELD_BYTES:
                yield from packed()
                held, size = {}, 0
                if len(written) > MOST_WRITTEN:
                    written.clear()
        yield from packed()

    def once(batches):
        every: dict[str, set[bytes]] = {}
        for batch in batches:
            for lang, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                every.setdefault(lang, set()).update(zlib.decompress(blob).split(_END))
        for lang, phrases in every.items():
            found = list(phrases)
            for i in range(0, len(found), 1 << 14):
                part = found[i : i + (1 << 14)]
                yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([x.count(b" ") + 1 for x in part], pa.int32())], ["lang", "phrase", "words"])

    packed = texts.mapInArrow(write, "lang string, bucket int, phrases binary").repartition(shuffle_parts(spark), "bucket")
    return packed.mapInArrow(once, "lang string, phrase string, words int")


def automaton(phrases) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """(words, own, levels) of phrases (an Arrow array, each once), whose first words' phrases are all there.

    A state of the first level is a word's number, own says which words are phrases by themselves. A state of a further level is the place of its key in that level: the state of all but its last word, and that word's number.
    A phrase whose beginning is none isn't frequent and is left out.
    """
    import pyarrow.compute as pc

    parts = pc.split_pattern(phrases, " ")
    numbered = parts.flatten().dictionary_encode()
    ids, starts, sizes = numbered.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy()[:-1], pc.list_value_length(parts).to_numpy()
    starts = starts - parts.offsets[0].as_py()
    own = np.zeros(len(numbered.dictionary), bool)
    own[ids[starts[sizes == 1]]] = True
    levels: list[np.ndarray] = []
    for k in range(2, int(sizes.max()) + 1):
        at = starts[sizes == k]
        state = ids[at]
        for j, level in enumerate(levels, 1):
            state, found = follow(level, state, ids[at + j])
            at = at[found]
        levels.append(np.unique(state << 32 | ids[at + k - 1]))
    return _END.join(as_bytes(numbered.dictionary)), own, levels


def follow(level: np.ndarray, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states that states of the level before go to by words, where there are such, and for which there are."""
    key = state << 32 | word
    at = np.searchsorted(level, key)
    found = np.flatnonzero(np.append(level, -1)[at] == key)
    return at[found], found


def count_matches(texts: DataFrame, automata: dict[str, tuple[bytes, np.ndarray, list[np.ndarray]]], least: int, with_words: bool) -> DataFrame:
    """(lang, phrase, n): the matches of the phrases of each language's automaton in its texts, summed, from `least` on; and, under an empty phrase, all words."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(automata)  # of AUTOMATA_BYTES or so

    def scan(batches):
        numbers, sums, totals = {}, {}, {}
        for batch in batches:
            for lang, some in folded(batch).items():
                words, own, levels = shared.value.get(lang, (b"", np.zeros(0, bool), []))
                if lang not in numbers:
                    numbers[lang] = {w: i for i, w in enumerate(words.split(_END))} | {b"": -2, _END: -3}
                    sums[lang] = [np.zeros(len(x), np.int64) for x in (own, *levels)]
                number, n = numbers[lang].get, sums[lang]
                for text in steps(some):
                    ids = np.fromiter(map(number, text.replace(_END, b" \n ").split(b" "), repeat(-1)), np.int64)
                    ids = ids[ids != -2]
                    if with_words:
                        totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(ids != -3))
                    ids = np.append(ids, np.full(len(levels), -3))
                    at = np.flatnonzero(ids >= 0)
                    state = ids[at]
                    np.add.at(n[0], state, 1)
                    for j, level in enumerate(levels, 1):
                        known = ids[at + j] >= 0
                        at, state = at[known], state[known]
                        state, found = follow(level, state, ids[at + j])
                        at = at[found]
                        np.add.at(n[j], state, 1)
        for lang, n in totals.items():
            yield pa.record_batch([pa.array([lang]), pa.array([-1]), pa.array([np.int64(n).tobytes()], pa.binary())], ["lang", "block", "counts"])
        for lang, n in sums.items():
            if lang in shared.value:
                n[0][~shared.value[lang][1]] = 0
            every = np.concatenate(n)
            for i in range(0, len(every), BLOCK):
                if every[i : i + BLOCK].any():
                    yield pa.record_batch([pa.array([lang]), pa.array([i // BLOCK]), pa.array([zlib.compress(every[i : i + BLOCK].tobytes(), 1)], pa.binary())], ["lang", "block", "counts"])

    def add(batches):
        totals: dict[str, int] = {}
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, block, blob in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if block < 0:
                    totals[lang] = totals.get(lang, 0) + int(np.frombuffer(blob, np.int64)[0])
                else:
                    n = np.frombuffer(zlib.decompress(blob), np.int64)
                    sums[lang, block] = sums[lang, block] + n if (lang, block) in sums else n
        for lang, n in totals.items():
            yield pa.record_batch([pa.array([lang]), pa.array([""]), pa.array([n], pa.int64())], ["lang", "phrase", "n"])
        texts_of = {lang: shared.value[lang][0].decode().split("\n") for lang in {x for x, _ in sums}}
        for (lang, block), n in sums.items():
            levels, words, at = shared.value[lang][2], texts_of[lang], np.flatnonzero(n >= least)
            first = np.cumsum([0, len(words), *map(len, levels)])
            phrases = []
            for state in (block * BLOCK + at).tolist():
                k = int(np.searchsorted(first, state, "right")) - 1
                state -= int(first[k])
                last = []
                for level in levels[:k][::-1]:
                    key = int(level[state])
                    last.append(words[key & 0xFFFFFFFF])
                    state = key >> 32
                phrases.append(" ".join([words[state], *last[::-1]]))
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(phrases, pa.string()), pa.array(n[at], pa.int64())], ["lang", "phrase", "n"])

    packed = texts.mapInArrow(scan, "lang string, block long, counts binary").repartition(shuffle_parts(texts.sparkSession), "lang", "block")
    return packed.mapInArrow(add, "lang string, phrase string, n long")


def cells_for(texts: DataFrame) -> int:
    """Cells of a sketch's row, a power of two, in proportion to the texts."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(CELLS, 1 << (size // CELL_BYTES).bit_length()), MOST_CELLS)


def counts(texts: DataFrame, least: int, longest: int, n: int | None = None, automata_bytes: int = AUTOMATA_BYTES) -> DataFrame:
    """(lang, phrase, n) of all runs of 1 to `longest` words that stand in their language's texts `least` times or more, and, under an empty phrase, of all words. Stored."""
    import pyarrow.compute as pc

    found = candidates(texts, least, longest, cells_for(texts) if n is None else n)
    found = stored(found, "candidates")
    size = found.agg(F.sum(F.octet_length("phrase") + 2)).first()[0] or 0
    sets = max(1, -(-size // automata_bytes))
    found = found.withColumn("set", F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 1)), F.lit(sets)))
    parts = []
    for i in range(sets):
        some = found.where(F.col("set") == i).select("lang", "phrase").toArrow().combine_chunks()  # of automata_bytes or so
        automata = {lang: automaton(some.filter(pc.equal(some["lang"], lang))["phrase"].combine_chunks()) for lang in some["lang"].unique().to_pylist()}
        got = count_matches(texts, automata, least, i == 0)
        parts.append(stored(got, "counts"))
    discard(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_first(df: DataFrame, k: int, key: str, order: list[Column], salt: Column) -> DataFrame:
    """The first k rows of each key with their rank: first of each of 64 parts of a key, then of what these leave."""
    some = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(64)))
    some = some.withColumn("__n", F.row_number().over(W.partitionBy(key, "__salt").orderBy(*order))).where(F.col("__n") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= k).drop("__salt", "__n")


def score(counted: DataFrame, share: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases, from the counts of all frequent runs."""
    frequent = counted.where(F.col("phrase") != "").withColumn("w", F.split("phrase", " "))
    totals = counted.where(F.col("phrase") == "").select("lang", F.col("n").alias("n_words"))
    phrases = frequent.where(F.size("w") > 1).withColumnRenamed("n", "a")
    text = lambda start, size: F.array_join(F.slice("w", start, size), " ")

    lengths = F.sequence(F.lit(2), F.size("w") - 1)
    within = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: text(i, k))))
    covering = phrases.where(F.size("w") > 2).select("lang", "a", F.explode(F.array_distinct(within)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(covering, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")

    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("first"), text(F.col("k") + 1, F.size("w")).alias("rest"))
    part = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals.withColumnRenamed("n_words", "n"), "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", (F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n")).cast("decimal(34,0)")).cast("decimal(38,0)")).withColumn("low", (whole("l") * whole("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("top div low"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("m")).select("lang", "phrase", "m.*")
    return rank_first(worst, most, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], F.col("phrase")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, most: int = 2000, cells: int | None = None, automata_bytes: int = AUTOMATA_BYTES) -> DataFrame:
    """The best `most` phrases of each language's documents."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return score(counts(texts, least, longest, cells, automata_bytes), share, most)


ORACLE_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM runs, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w)),
total AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY 1),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS n FROM grams GROUP BY 1, 2 HAVING count(*) >= 100),
long AS (SELECT lang, n, string_split(phrase, ' ') AS w FROM f WHERE k > 2),
inside AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(n) AS longer FROM long, range(1, 5) AS a(i), range(2, 5) AS b(j) WHERE j < len(w) AND i + j - 1 <= len(w) GROUP BY 1, 2),
kept AS (SELECT f.lang, f.phrase, f.n AS a, string_split(f.phrase, ' ') AS w FROM f LEFT JOIN inside USING (lang, phrase) WHERE f.k > 1 AND (longer IS NULL OR 100 * longer < 100 * f.n)),
cuts AS (SELECT kept.*, j, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:], ' ') AS q FROM kept, range(1, 5) AS c(j) WHERE j < len(w)),
scored AS (SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, t.n, j, CAST(1000::HUGEINT * c.a * t.n // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q JOIN total t ON t.lang = c.lang),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS first FROM scored) WHERE first = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
