"""N-gram Jaccard join: links documents whose sets of word 5-grams have a Jaccard similarity of at least THRESHOLD.

1. Every document becomes the set of its 5-grams' 64-bit hashes (A-Z lower-cased); documents with the same set are one node.
2. Rare first: grams are ordered by document frequency, then hash. The frequencies come from a counting table over all
   documents, whose size follows the number of grams up to 16 MB (grams that share a cell share its sum; any order gives right results, a rarer-first one fewer candidates).
3. A node indexes its prefix, its first n - ceil(0.75 n) + 1 grams; two similar nodes share a prefix gram. Index entries are shuffled and sorted by
   gram, and read as a stream; pairs pass the length and positional filters there.
4. Suffix filter: every node has a signature, a bit for each of about n cells of the hashes, which says whether the cell holds an odd number of its grams. Two
   sets differ in at least as many grams as their signatures do in bits; pairs that differ in too many go.
5. Each pair that is left is verified once, on whole texts. A text travels once to all pairs of which it is the lesser node.

Large groups: a gram with more than SMALL nodes doesn't give pairs. Its nodes become members of the group of one hub, the least of them (many
grams of a family of near copies have one hub, so the family is one group). A group is cut into blocks of about BLOCK nodes and BLOCK_GRAMS grams,
and every two blocks (and every block with itself) meet in one task: first by signatures, and nodes that have no possible partner there go no further; the others
meet on whole texts, where the sets' exact intersections give all links. A task sends
each node's number of links, and a spanning forest of them for the components, not the pairs. A pair of nodes that are in several
groups counts in that of the least hub only, and one that is in any isn't verified as a pair besides, so each link counts once.
Grams so frequent that one task shouldn't read all their entries (HOT, and far above the mean of the table) are salted, and get their hub afterwards.

Texts that are to be verified are picked from the documents by a member table of bounded size, then joined by 128 bits of their hash: the same plan whatever the size.

Defined cases: with fewer than 5 words the whole sequence is the one gram; without words (null and empty texts, white space only) the set is empty, linked with
nothing, not with other empty ones either; repeated rows have one set. A null id counts as larger than all others. Very long texts are sets like others. Further columns change nothing, whatever
their names. Nodes are named by 63 bits of a hash of their set: two of 1e9 different sets share a name with a chance of 1 in 18.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, discard, free_name, gram_hash, hash_words, members as keys_among, mix, ranges, row_keys, stored, text_keys, whole_groups

GRAM = 5
NUMERATOR, DENOMINATOR = 3, 4  #: of the threshold, 0.75
LEAST_BITS, MOST_BITS = 18, 24  #: of the counting table
TABLE_PARTS, FAN_IN = 256, 256  #: pieces that it is summed in; tasks whose pieces are summed at once
SMALL = 4  #: nodes of a gram that are paired directly
HOT = 100_000  #: entries of a gram from which it is salted, if they are MEANS times the mean of the table's cells
MEANS = 4
BLOCK = 2000  #: nodes of a block of a group, about; a task holds two blocks
BLOCK_GRAMS = 1 << 20  #: grams of a block, about
BATCH_BYTES = 2 << 20
PAIR, MEMBER, HOT_GRAM = 0, 1, 2
EDGE, DEGREE = 0, 1


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct gram hashes of each text."""
    words, offsets = hash_words(texts, lower=True)
    grams = gram_hash(words, GRAM)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= GRAM:
            out.append(np.unique(grams[a : b - GRAM + 1]))
        elif b > a:
            out.append(mix(np.full(1, int(gram_hash(words[a:b], b - a)[0]) ^ (b - a), np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(grams: np.ndarray) -> int:
    """A set's name: 63 bits of a hash of it."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) >> 1


def _cell(grams: np.ndarray, cells: int) -> np.ndarray:
    return (grams & np.uint64(cells - 1)).astype(np.int64)


def table_bits(grams: int) -> int:
    """Of the counting table for so many grams: about 16 of them a cell, within bounds."""
    return min(max(grams.bit_length() - 4, LEAST_BITS), MOST_BITS)


def frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """The counting table, 2**bits sums over all documents, as levels (8 to each doubling), and the mean of its cells.

    Tasks' tables are summed in pieces, FAN_IN tasks at a time, so no group holds more than that many pieces, or one for that many tasks.
    """
    size = (1 << bits) // TABLE_PARTS

    def count(batches):
        cells = np.zeros(1 << bits, np.uint32)
        for t in batched(batches, BATCH_BYTES):
            found, n = np.unique(_cell(np.concatenate(sets_of(as_bytes(t.column(0)))), len(cells)), return_counts=True)
            cells[found] += n.astype(np.uint32)
        slot = TaskContext.get().partitionId() // FAN_IN
        for i, part in enumerate(np.split(cells, TABLE_PARTS)):
            if part.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([slot], pa.int32()), pa.array([_small(part)], pa.binary())], ["part", "slot", "data"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint64)
        for column in group.column("data").iterchunks():
            for x in column:
                total += _wide(x.as_py(), size)
        return pa.table({"part": group.column("part")[:1], "slot": group.column("slot")[:1], "data": pa.array([_small(np.minimum(total, 2**32 - 1))], pa.binary())})

    kind = "part int, slot int, data binary"
    parts = docs.select(F.col("text").cast("string")).where("text is not null").mapInArrow(count, kind).groupBy("part", "slot").applyInArrow(add, kind).groupBy("part").applyInArrow(add, kind)
    table = np.zeros((TABLE_PARTS, size), np.uint32)
    for r in parts.collect():
        table[r["part"]] = _wide(r["data"], size)
    return level(table.ravel()), float(table.mean())


def level(count: np.ndarray) -> np.ndarray:
    return np.minimum(8 * np.log2(np.maximum(count, 1)), 255).astype(np.uint8)


def _small(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype(next(k for k in (np.uint8, np.uint16, np.uint32) if x.max() <= np.iinfo(k).max)).tobytes(), 1)


def _wide(x: bytes, n: int) -> np.ndarray:
    x = zlib.decompress(x)
    return np.frombuffer(x, f"u{len(x) // n}").astype(np.uint64)


def signature(grams: np.ndarray) -> bytes:
    """For each of about n cells of the hashes whether it holds an odd number of grams, as bits."""
    bits = max(64, 1 << (len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams >> np.uint64(24) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 > 0, bitorder="little").tobytes()


def folded(x: int, bits: int, to: int) -> int:
    """A signature of fewer bits."""
    while bits > to:
        bits //= 2
        x = x & ((1 << bits) - 1) ^ x >> bits
    return x


def room(na, nb):
    """In how many grams two sets of these sizes may differ and still be similar."""
    return na + nb - 2 * -(-NUMERATOR * (na + nb) // (NUMERATOR + DENOMINATOR))


def may_be_similar(na: int, a: bytes, nb: int, b: bytes) -> bool:
    """The suffix filter, by sizes and signatures."""
    bits = min(len(a), len(b)) * 8
    x, y = (folded(int.from_bytes(s, "little"), len(s) * 8, bits) for s in (a, b))
    return (x ^ y).bit_count() <= room(na, nb)


def with_partners(size: np.ndarray, signatures: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which nodes have one on the other side that they may be similar to."""
    order = np.argsort(size, kind="stable")
    size, left, right = size[order], left[order], right[order]
    bits = np.array([len(signatures[i]) * 8 for i in order])
    found = np.zeros(len(size), bool)
    for level in np.unique(bits):
        rows = np.flatnonzero((bits == level) | (bits == 2 * level))  # a similar set has at most a third more grams
        fold = np.frombuffer(b"".join(folded(int.from_bytes(signatures[order[i]], "little"), int(bits[i]), int(level)).to_bytes(level // 8, "little") for i in rows), np.uint64).reshape(len(rows), -1)
        last = np.searchsorted(size[rows], size[rows] * DENOMINATOR // NUMERATOR, side="right")
        for i in np.flatnonzero(bits[rows] == level).tolist():
            others = rows[i + 1 : last[i]]
            ok = (left[rows[i]] & right[others]) | (right[rows[i]] & left[others])
            ok &= np.bitwise_count(fold[i + 1 : last[i]] ^ fold[i]).sum(axis=1, dtype=np.int64) <= room(size[rows[i]], size[others])
            if ok.any():
                found[rows[i]] = True
                found[others[ok]] = True
    out = np.zeros(len(size), bool)
    out[order] = found
    return out


def prefix(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rarest grams of a set, rarest first, of which a similar set must have one."""
    n = len(grams)
    keep = n - -(-NUMERATOR * n // DENOMINATOR) + 1
    return grams[np.lexsort((grams, table[_cell(grams, len(table))]))[:keep]]


def index(texts: list[bytes], table: np.ndarray, most: float) -> tuple[np.ndarray, ...]:
    """Index entries of the texts' sets: gram, node, set size and place in the order (in one number), and salt (0 if the gram isn't hot)."""
    sets = {}
    for s in sets_of(texts):
        if len(s):
            sets.setdefault(node_of(s), s)
    first = [prefix(s, table) for s in sets.values()]
    sizes = np.array([len(p) for p in first], np.int64)
    gram = np.concatenate([np.zeros(0, np.uint64), *first])
    node = np.repeat(np.fromiter(sets, np.int64, len(sets)), sizes)
    size = np.repeat(np.array([len(s) for s in sets.values()], np.int64), sizes)
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in sizes)])
    count = 2.0 ** (table[_cell(gram, len(table))] / 8)
    salt = np.where(count >= most, 1 + node % np.maximum(2 * count / most, 1).astype(np.int64), 0)
    return gram.view(np.int64), node, size << 32 | place, salt.astype(np.int32)


def fits(na, nb, ia, ib):
    """Length and positional filter: sizes of two sets and the places of a shared gram, the first that they share."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    need = -(-NUMERATOR * (na + nb) // (NUMERATOR + DENOMINATOR))
    return (DENOMINATOR * small >= NUMERATOR * large) & (1 + np.minimum(na - ia - 1, nb - ib - 1) >= need)


def probe(gram: np.ndarray, node: np.ndarray, at: np.ndarray, salt: np.ndarray, few: int = SMALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What entries sorted by gram and node give: pairs (kind PAIR), nodes of hubs' groups (MEMBER: hub, node) and nodes of hot grams (HOT_GRAM: gram, node)."""
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1]) | (salt[1:] != salt[:-1])
    gram, node, size, place, hot = gram[new], node[new], at[new] >> 32, at[new] & (2**32 - 1), salt[new] > 0
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, int)
    count = np.diff(np.append(start, len(gram)))
    mine, rank = np.repeat(np.arange(len(start)), count), np.arange(len(gram)) - np.repeat(start, count)
    many = count[mine] > few
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    for gap in range(1, few):  # all pairs of small groups
        at = np.flatnonzero(~many & ~hot & (rank + gap < count[mine]))
        a.append(at)
        b.append(at + gap)
    a, b = np.concatenate(a), np.concatenate(b)
    ok = fits(size[a], size[b], place[a], place[b])
    pair = np.unique(np.stack([node[a[ok]], node[b[ok]]], axis=1), axis=0)
    at = np.flatnonzero(many & ~hot)  # one hub for large ones: the least node
    member = np.unique(np.stack([node[start[mine[at]]], node[at]], axis=1), axis=0)
    kept = np.stack([gram[hot], node[hot]], axis=1)
    every = np.concatenate([pair, member, kept])
    return np.repeat(np.array([PAIR, MEMBER, HOT_GRAM], np.int32), [len(pair), len(member), len(kept)]), every[:, 0].copy(), every[:, 1].copy()


def found(docs: DataFrame, table: np.ndarray, mean: float) -> DataFrame:
    """kind, a and b of all that grams give (see probe). Entries are sorted by Spark, which spills, and read as a stream; a task holds a batch and the entries of one gram."""
    few, most, shared = SMALL, max(HOT, MEANS * mean), docs.sparkSession.sparkContext.broadcast(table)

    def send(batches):
        for t in batched(batches, BATCH_BYTES):
            yield pa.record_batch([pa.array(x) for x in index(as_bytes(t.column(0)), shared.value, most)], ["gram", "node", "at", "salt"])

    def deal(batches):
        for t in whole_groups(batches, BATCH_BYTES):
            yield pa.record_batch([pa.array(x) for x in probe(*(t.column(i).to_numpy() for i in range(4)), few)], ["kind", "a", "b"])

    sent = docs.select("text").where("text is not null").mapInArrow(send, "gram long, node long, at long, salt int")
    return stored(sent.repartition("gram", "salt").sortWithinPartitions("gram", "node").mapInArrow(deal, "kind int, a long, b long"), "jaccard-found")


def nodes(docs: DataFrame) -> DataFrame:
    """docs without text, and node, n (set size) and signature of every row; node and signature are null for empty sets."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        for t in batched(batches, BATCH_BYTES):
            sets = sets_of(as_bytes(t.column("text")))
            names, marks = ([make(s) if len(s) else None for s in sets] for make in (node_of, signature))
            yield pa.record_batch([*(_one(t.column(c)) for c in others), pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary())], [*others, "node", "n", "signature"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{kinds}, node long, n long, signature binary")


def _one(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def suffix_filter(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures, in marks (node, n, signature), leave it open whether they are similar."""
    left, right = (marks.select(F.col("node").alias(x), F.struct("n", "signature").alias(f"s{x}")) for x in "ab")

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [may_be_similar(x["n"], x["signature"], y["n"], y["signature"]) for x, y in zip(a, b, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "jaccard-pairs")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes, a < b, that are similar, by texts (node, text). Each a is read once, before its partners."""
    own = pairs.select("a").distinct().select("a", F.lit(-1).cast("long").alias("b"), F.col("a").alias("node"))
    rows = own.unionByName(pairs.select("a", "b", F.col("b").alias("node"))).join(texts, "node").select("a", "b", "text")

    def run(batches):
        last, mine = None, np.zeros(0, np.uint64)
        for t in batched(batches, BATCH_BYTES):
            a, b, sets, out = t.column(0).to_pylist(), t.column(1).to_pylist(), sets_of(as_bytes(t.column(2))), []
            for x, y, s in zip(a, b, sets, strict=True):
                if y < 0:
                    last, mine = x, s
                elif x == last:
                    shared = len(np.intersect1d(mine, s, assume_unique=True))
                    if shared * DENOMINATOR >= NUMERATOR * (len(mine) + len(s) - shared):
                        out.append((x, y))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return stored(rows.repartition("a").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long"), "jaccard-links")


def meet(node: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], lower: list[list[int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links between left and right nodes, and every node's number of these links.

    Where all are both left and right, each pair counts once. lower: a node's other hubs under the group's; pairs that share one count there.
    """
    n, size = len(node), np.array([len(x) for x in sets], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    _, gram = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    held, count = np.repeat(np.arange(n), size)[np.argsort(gram, kind="stable")], np.bincount(gram)
    first = np.cumsum(count) - count
    holders: dict[int, list[int]] = {}
    for i, hubs in enumerate(lower):
        for h in hubs:
            holders.setdefault(h, []).append(i)
    elsewhere = {h: np.array(x) for h, x in holders.items()}
    degree, comp, forest = np.zeros(n, np.int64), np.arange(n), []
    for i in np.flatnonzero(left).tolist():
        own = gram[at[i] : at[i + 1]]
        share = np.bincount(held[ranges(first[own], count[own])], minlength=n)
        ok = right & (share * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (size[i] + size))
        ok &= np.arange(n) > i if right[i] else True
        if not ok.any():
            continue
        for h in lower[i]:
            ok[elsewhere[h]] = False
        near = np.flatnonzero(ok)
        degree[i] += len(near)
        degree[near] += 1
        for j in near[comp[near] != comp[i]].tolist():
            if comp[j] != comp[i]:
                forest.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return [(int(min(node[i], node[j])), int(max(node[i], node[j]))) for i, j in forest], degree


def blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """hub, node, x, y and mine of all members (hub, node): a row for every two blocks x <= y that the node meets others in; its own is mine."""
    known = members.join(sizes, "node")
    groups = known.groupBy("hub").agg(F.count("*").alias("many"), F.sum("n").alias("grams")).where("many > 1")
    groups = groups.select("hub", F.ceil(F.greatest(F.col("many") / BLOCK, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    dealt = known.join(groups, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine"), "blocks")
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("hub", "node", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine")


def possible(members: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of blocks() whose node may be similar to one of the others there, by marks (node, n, signature)."""
    rows = blocks(members, marks.select("node", "n")).join(marks, "node").select("hub", "x", "y", "node", "mine", "n", "signature")

    def run(group: pa.Table) -> pa.Table:
        size, x, y, mine = (group.column(c).to_numpy() for c in ("n", "x", "y", "mine"))
        return group.select(["hub", "x", "y", "node", "mine"]).filter(pa.array(with_partners(size, group.column("signature").to_pylist(), mine == x, mine == y)))

    return stored(rows.groupBy("hub", "x", "y").applyInArrow(run, "hub long, x int, y int, node long, mine int"), "jaccard-possible")


def within(rows: DataFrame, hubs: DataFrame, texts: DataFrame) -> DataFrame:
    """All links within groups, of rows as possible() gives them: a forest of them (kind EDGE: a, b) and numbers of links (DEGREE: node, number)."""
    rows = rows.join(hubs, "node").withColumn("hubs", F.expr("filter(hubs, h -> h < hub)")).join(texts, "node")

    def run(group: pa.Table) -> pa.Table:
        node, x, y, mine = (group.column(c).to_numpy() for c in ("node", "x", "y", "mine"))
        forest, degree = meet(node, mine == x, mine == y, sets_of(as_bytes(group.column("text"))), group.column("hubs").to_pylist())
        some = np.flatnonzero(degree)
        a, b = [e[0] for e in forest] + node[some].tolist(), [e[1] for e in forest] + degree[some].tolist()
        return pa.table({"kind": pa.array([EDGE] * len(forest) + [DEGREE] * len(some), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(rows.groupBy("hub", "x", "y").applyInArrow(run, "kind int, a long, b long"), "jaccard-within")


def components(links: DataFrame) -> DataFrame:
    """node and comp (the least node that links reach) of every node of links (a, b).

    Each round every node joins its least neighbour, and links between the joined are kept; nodes that still have links at least halve.
    """
    edges, comp = stored(links.select("a", "b").where("a <> b").distinct(), "jaccard-edges"), None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("node"), "p"), "jaccard-parents")
        before = comp
        if comp is None:
            comp = stored(parent.select("node", F.col("p").alias("comp")), "jaccard-comps")
        else:
            comp = stored(comp.join(parent.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "jaccard-comps")
            discard(before)
        to_a, to_b = (parent.select(F.col("node").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        rest = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        old, edges = edges, stored(rest, "jaccard-edges")
        discard(old, parent)
    discard(edges)
    return comp if comp is not None else links.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the wanted nodes (node, k1, k2), from docs (k1, k2, text). Copies of a text are combined before they are shuffled."""
    some = docs.select("k1", "k2", "text").where("text is not null").where(keys_among(wanted.select("k1", "k2"), wanted.count()))
    return stored(some.groupBy("k1", "k2").agg(F.any_value("text").alias("text")).join(wanted, ["k1", "k2"]).select("node", "text"), "jaccard-texts")


def classes(docs: DataFrame, *keep) -> DataFrame:
    """doc_id, n, node (null for an empty set), comp, component_id, n_links, and the columns keep of every row of docs (doc_id, text)."""
    docs = docs.select(*text_keys(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    every = stored(nodes(docs), "jaccard-nodes")
    first = [F.min("k1").alias("k1"), F.min_by("k2", "k1").alias("k2"), F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("signature").alias("signature")]
    node_table = stored(every.where("node is not null").groupBy("node").agg(*first), "jaccard-sets")  # a row for each set, however many copies it has
    grams = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = found(docs, *frequencies(docs, table_bits(grams)))
    hot = got.where(f"kind = {HOT_GRAM}").select("a", F.col("b").alias("node"))
    hot = hot.join(hot.groupBy("a").agg(F.min("node").alias("hub")), "a").select("hub", "node")
    members = stored(got.where(f"kind = {MEMBER}").select(F.col("a").alias("hub"), F.col("b").alias("node")).unionByName(hot).distinct(), "jaccard-members")
    hubs = stored(members.groupBy("node").agg(F.collect_set("hub").alias("hubs")), "jaccard-hubs")
    of_a, of_b = (hubs.select(F.col("node").alias(x), F.col("hubs").alias(f"h{x}")) for x in "ab")
    pairs = got.where(f"kind = {PAIR}").select("a", "b").distinct().join(of_a, "a", "left").join(of_b, "b", "left")
    pairs = stored(pairs.where("not coalesce(arrays_overlap(ha, hb), false)").select("a", "b"), "jaccard-candidates")
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    marks = stored(node_table.select("node", "n", "signature").join(met, "node", "left_semi"), "jaccard-marks")
    close, near = suffix_filter(pairs, marks), possible(members, marks)
    wanted = close.select(F.explode(F.array("a", "b")).alias("node")).unionByName(near.select("node")).distinct()
    wanted = stored(wanted.join(node_table.select("node", "k1", "k2"), "node"), "jaccard-wanted")
    texts = texts_of(docs, wanted)
    links, groups = verify(close, texts), within(near, hubs, texts)
    comp = components(links.unionByName(groups.where(f"kind = {EDGE}").select("a", "b")))
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n")).unionByName(groups.where(f"kind = {DEGREE}").select(F.col("a").alias("node"), F.col("b").alias("n")))
    degree = ends.groupBy("node").agg(F.sum("n").alias("n_links"))
    named = node_table.select("node", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_node = stored(named.join(lowest, "comp").join(degree, "node", "left").select("node", "comp", "component_id", "n_links"), "jaccard-classes")
    discard(got, members, hubs, pairs, marks, close, near, wanted, texts, links, groups, comp, node_table)
    out = every.drop("k1", "k2", "signature").join(by_node, "node", "left")
    return out.withColumns({"component_id": F.coalesce("component_id", "doc_id"), "n_links": F.coalesce("n_links", F.lit(0))})


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach) and n_links (different sets that its own is linked to, all of them) of every row of docs."""
    return classes(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the row with the least id stays, with all its columns (of several, that whose columns have the least hash); so do all rows with an empty set."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")
    stay = classes(docs, *row_keys(docs)).where("node is not null").groupBy("comp").agg(F.min(order).alias("row")).select("row.r1", "row.r2")
    r1, r2 = free_name(docs, "r1"), free_name(docs, "r2")
    words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(words).withColumns(dict(zip((r1, r2), row_keys(docs), strict=True)))
    kept = keyed.join(stay.withColumnsRenamed({"r1": r1, "r2": r2}), [r1, r2], "left_semi").dropDuplicates([r1, r2])
    return kept.select(*docs.columns).unionByName(docs.where(~words))
