"""Substring dedup by seed and extend: every word under a repeated run of at least WINDOW words is removed.

1. Seeds are winnowed anchors: of each window of WINDOW words, the SEED-word gram with the least hash (all places of it). Windows alike have the same anchor at the same place, so
   a repeat of WINDOW words holds a common anchor. Documents are joined on anchors: each batch of documents sends each of its anchors once, and those that stand elsewhere
   too are live.
2. Only live anchors are extended, in the documents that hold them. Extended both ways, by o words to the left and the rest to the right, for every o that
   keeps the anchor the least, an anchor gives the windows around it, about 14 in a row. An extension is a match if it stands elsewhere with the same anchor. Anchor and window are
   compared as two values, 64 and 63 bits.
3. The matches of a document that touch or overlap join to its maximal repeats, and the words under them go.

Hot passages: a batch of documents sends each of its distinct anchors, and each of its distinct windows, once, with a mark if it repeats within the batch; what repeats
there is known at once. So however many documents hold a passage, an anchor has at most one row a batch. Rows are sorted by Spark, which spills, and
read as a stream. Texts are named by 128 bits of their hash: equal texts lose the same words, so they are extended once.

Defined cases: a null or empty text has no words, and one of under WINDOW words loses none; both occurrences of a repeat go, in the same
document too; repeated rows are repeats of each other; very long texts are read whole; further columns change nothing, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, discard, free_name, gram_hash, hash_words, members, mix, pack, ranges, stored, text_keys, unpack, whole_groups

WINDOW, SEED = 35, 8
BATCH_BYTES = 2 << 20
ONCE, AGAIN, KNOWN = 0, 1, 2  #: an anchor that stands once in its batch, one that repeats there, and a live one


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, by doubling."""
    n, have, span = len(x) - width + 1, x, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    return np.minimum(have[:n], have[width - span : width - span + n])


def runs(places: np.ndarray, *alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive places with the same values start (as positions in places), and their lengths."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.diff(places) != 1
    for a in alike:
        cut |= a[1:] != a[:-1]
    start = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return start, np.diff(np.append(start, len(places)))


def anchors(words: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document of each word, the hashes of grams, and the anchor of each window; 0 where a window crosses documents. All empty without windows."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(words) < window:
        return doc, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    seed = min(SEED, window)
    grams = np.maximum(gram_hash(words, seed), np.uint64(1))
    least = sliding_min(grams, window - seed + 1)
    return doc, grams, np.where(doc[: len(least)] == doc[window - 1 :], least, np.uint64(0))


def seeds(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and the numbers of their texts, one for each place where an anchor stands."""
    doc, grams, anchor = anchors(*hash_words(texts), window)
    if not len(anchor):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad = np.full(window - min(SEED, window), ~np.uint64(0))
    most = ~sliding_min(np.concatenate([pad, ~anchor, pad]), len(pad) + 1)  # of the anchors of the windows around a gram
    at = np.flatnonzero(most == grams)
    return grams[at], doc[at]


def extensions(texts: list[bytes], live: list[np.ndarray], whole: np.ndarray, window: int = WINDOW):
    """The windows around live anchors, each of a batch once: (anchor, text, first window, packed windows) by run; and what is known to repeat: (text, first window, number).

    live: of each text, its live anchors, sorted. whole: texts that stand elsewhere as they are. A packed window's last bit says that it repeats.
    """
    words, offsets = hash_words(texts)
    doc, _, anchor = anchors(words, offsets, window)
    if not len(anchor):
        return [], []
    every = np.repeat(np.arange(len(live)), [len(x) for x in live])
    alive = np.zeros(len(anchor), bool)
    if len(every):
        # a false hit of these hashes of text and anchor only sends windows that nothing matches
        alive = np.isin(mix(anchor ^ mix(doc[: len(anchor)].astype(np.uint64))), mix(np.concatenate(live) ^ mix(every.astype(np.uint64))))
    at = np.flatnonzero((anchor > 0) & (alive | whole[doc[: len(anchor)]]))
    if not len(at):
        return [], []
    hashes = gram_hash(words, window)[at] >> np.uint64(1) << np.uint64(1)
    order = np.lexsort((hashes, anchor[at]))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (anchor[at][order][1:] != anchor[at][order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    count = np.bincount(which)
    again = (count[which] > 1) | whole[doc[at]]
    marked = np.zeros(len(count), bool)
    marked[which[again]] = True
    here = at[again]
    start, length = runs(here, doc[here])
    known = list(zip(doc[here[start]].tolist(), (here[start] - offsets[doc[here[start]]]).tolist(), length.tolist(), strict=True))
    sent = np.sort(order[new])  # the first of each
    packed = hashes[sent] | marked[which[sent]]
    place = at[sent]
    start, length = runs(place, anchor[place], doc[place])
    head = place[start]
    out = [(a, d, s, packed[i : i + n].tobytes()) for a, d, s, i, n in zip(anchor[head].view(np.int64).tolist(), doc[head].tolist(), (head - offsets[doc[head]]).tolist(), start.tolist(), length.tolist(), strict=True)]
    return out, known


def matches(anchor: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of windows with whole groups of anchors: run, place in it and number of the windows that stand elsewhere too, as runs."""
    length = np.array([len(b) // 8 for b in blobs], np.int64)
    window = np.frombuffer(b"".join(blobs), np.uint64)
    run = np.repeat(np.arange(len(length)), length)
    place = ranges(np.zeros(len(length), np.int64), length)
    mark, hashes = (window & np.uint64(1)).astype(np.int64), window >> np.uint64(1)
    order = np.lexsort((hashes, anchor[run]))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (anchor[run][order][1:] != anchor[run][order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    twice = np.flatnonzero((np.bincount(which)[which] > 1) | (np.bincount(which, mark)[which] > 0)) if len(which) else np.zeros(0, np.int64)
    begin, n = runs(place[twice], run[twice])
    head = twice[begin]
    return run[head], place[head], n


def live_anchors(docs: DataFrame, window: int) -> DataFrame:
    """k1, k2 and live (anchors that stand elsewhere too) of the texts of docs (k1, k2, text) that hold any."""

    def send(batches):
        for t in batched(batches, BATCH_BYTES):
            k1, k2 = t.column(0).to_numpy(), t.column(1).to_numpy()
            anchor, doc = seeds(as_bytes(t.column(2)), window)
            value, first, which, count = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[which] > 1)
            pair = np.unique(which[again] * t.num_rows + doc[again]) if len(again) else np.zeros(0, np.int64)
            known, holder = value[pair // max(t.num_rows, 1)].view(np.int64), pair % max(t.num_rows, 1)
            value = value.view(np.int64)
            columns = [
                np.concatenate([value, known ^ k1[holder]]), np.concatenate([value, known]), np.concatenate([k1[doc[first]], k1[holder]]), np.concatenate([k2[doc[first]], k2[holder]]),
                np.concatenate([np.where(count > 1, AGAIN, ONCE), np.full(len(known), KNOWN)]).astype(np.int32),
            ]
            yield pa.record_batch([pa.array(c) for c in columns], ["part", "anchor", "k1", "k2", "kind"])

    def join(batches):
        for t in whole_groups(batches, BATCH_BYTES):
            anchor, kind = t.column("anchor").to_numpy(), t.column("kind").to_numpy()
            asked = np.flatnonzero(kind != KNOWN)
            _, which, count = np.unique(anchor[asked], return_inverse=True, return_counts=True)
            keep = kind == KNOWN
            keep[asked] = (count[which] > 1) | (kind[asked] == AGAIN) if len(asked) else False
            yield from t.select(["k1", "k2", "anchor"]).filter(pa.array(keep)).to_batches()

    sent = docs.select("k1", "k2", "text").mapInArrow(send, "part long, anchor long, k1 long, k2 long, kind int")
    found = sent.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(join, "k1 long, k2 long, anchor long")
    return stored(found.groupBy("k1", "k2").agg(F.collect_set("anchor").alias("live")), "substring-live")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """k1, k2 and spans (packed first windows and numbers of windows) of the texts of docs (text) that hold repeats; see text_keys()."""
    docs = docs.select(*text_keys(), F.col("text").cast("string").alias("text")).where("text is not null")
    live = live_anchors(docs, window)
    some = docs.where(members(live.select("k1", "k2"), live.count())).groupBy("k1", "k2").agg(F.any_value("text").alias("text"), F.count("*").alias("n"))

    def send(batches):
        for t in batched(batches, BATCH_BYTES):
            k1, k2 = t.column(0).to_numpy(), t.column(1).to_numpy()
            anchors = [np.array(x, np.int64).view(np.uint64) for x in t.column(3).to_pylist()]
            sent, known = extensions(as_bytes(t.column(2)), anchors, t.column(4).to_numpy() > 1, window)
            holder = [r[1] for r in sent] + [r[0] for r in known]
            columns = [
                pa.array([r[0] for r in sent] + k1[[r[0] for r in known]].tolist(), pa.int64()), pa.array(k1[holder], pa.int64()), pa.array(k2[holder], pa.int64()),
                pa.array([r[2] for r in sent] + [r[1] for r in known], pa.int32()), pa.array([0] * len(sent) + [r[2] for r in known], pa.int32()),
                pa.array([r[3] for r in sent] + [b""] * len(known), pa.binary()),
            ]
            yield pa.record_batch(columns, ["anchor", "k1", "k2", "start", "known", "windows"])

    def join(batches):
        for t in whole_groups(batches, BATCH_BYTES):
            anchor, k1, k2, start, known = (t.column(c).to_numpy() for c in ("anchor", "k1", "k2", "start", "known"))
            run, place, n = matches(anchor, t.column("windows").to_pylist())
            sure = np.flatnonzero(known)
            row, first, number = np.concatenate([run, sure]), np.concatenate([start[run] + place, start[sure]]), np.concatenate([n, known[sure]])
            order = np.lexsort((k2[row], k1[row]))
            row, first, number = row[order], first[order].astype(np.uint32), number[order].astype(np.uint32)
            a, b = k1[row], k2[row]
            edges = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]]) if len(a) else np.zeros(1, int)
            spans = [pack(first[x:y], number[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch([pa.array(a[edges[:-1]], pa.int64()), pa.array(b[edges[:-1]], pa.int64()), pa.array(spans, pa.binary())], ["k1", "k2", "spans"])

    sent = some.join(live, ["k1", "k2"]).select("k1", "k2", "text", "live", "n").mapInArrow(send, "anchor long, k1 long, k2 long, start int, known int, windows binary")
    found = sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(join, "k1 long, k2 long, spans binary")
    out = stored(found.groupBy("k1", "k2").agg(F.collect_list("spans").alias("spans")), "substring-repeats")
    discard(live)
    return out


def maximal(spans: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the maximal repeats of a text: its repeated windows, joined where they overlap or touch."""
    start, n = unpack(spans, np.uint32, np.uint32)
    order = np.argsort(start, kind="stable")
    first = start[order].astype(np.int64)
    reach = np.maximum.accumulate(first + n[order] + window - 1) if len(first) else first
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return first[at], reach[np.append(at[1:], len(first)) - 1] if len(at) else reach


def covered(n_words: int, spans: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Which words lie under a repeat."""
    gone = np.zeros(n_words, bool)
    for a, b in zip(*(x.tolist() for x in maximal(spans, window)), strict=True):
        gone[a:b] = True
    return gone


def _with_repeats(docs: DataFrame, window: int) -> DataFrame:
    """docs with a further column at its end: spans (null without repeats). Texts that hold none are told by a member table, and aren't shuffled."""
    found = repeats(docs, window)
    k1, k2, spans = (free_name(docs, x) for x in ("k1", "k2", "spans"))
    may = F.coalesce(members(found.select("k1", "k2"), found.count()), F.lit(False))
    keyed = docs.withColumns(dict(zip(("k1", "k2"), text_keys(), strict=True))) if (k1, k2) == ("k1", "k2") else None
    if keyed is None:  # docs has columns of these names
        names = [f"c{i}" for i in range(len(docs.columns))]
        plain = docs.toDF(*names)
        keyed = plain.withColumns(dict(zip(("k1", "k2"), text_keys(names[docs.columns.index("text")]), strict=True)))
    kept = [c for c in keyed.columns if c not in ("k1", "k2")]
    some = keyed.where(may).join(found.withColumnRenamed("spans", spans), ["k1", "k2"], "left").select(*kept, spans)
    rest = keyed.where(~may).select(*kept, F.lit(None).cast("array<binary>").alias(spans))
    return some.unionByName(rest).toDF(*docs.columns, spans)


def _kept(text: bytes | None, spans, window: int) -> tuple[int, int, bytes]:
    words = (text or b"").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = covered(len(words), spans, window)
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            got = [_kept(t, s, window) for t, s in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in got], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_repeats(docs, window).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeats taken out of text (kept words joined by one space) and n_chars, if there, counted again.

    Texts without repeats stay as they are; a row that loses all its words goes.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for i, (t, s) in enumerate(zip(as_bytes(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                if s:
                    texts[i] = _kept(t, s, window)[2].decode()
                keep.append(not s or texts[i] != "")
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=names).filter(pa.array(keep, pa.bool_()))

    out = _with_repeats(docs, window).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
