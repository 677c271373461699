"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of the training texts by block-max WAND.

The index's terms are the items' word 5-grams, so that items of one template, which share nearly all their words, are told apart by what is their own.
The items (a bounded block of them at a time, MAX_ITEMS) make an inverted index whose impacts are divided by the item's threshold, so that one
threshold, 1, holds for all. An item's threshold is its full score less its heaviest quarter of distinct grams: a passage that holds
three quarters of them can't score less, so retrieval loses nothing that verification would keep. Passages are windows of twice as many words as the
longest item has, one every item length, so that every place where an item can stand lies within one. Items are ordered so that alike ones
(same commonest gram, similar length) are neighbours, and cut into groups; a group in which the largest impacts of a passage's grams sum to less
than 1 needs no search. In the others WAND finds the items, skipping by the group's and the blocks' maxima.

Verification: at least OVERLAP of the item's word 5-grams stand in the passage, and at least PART of those of its question and of its
answer (split at the last question mark, or in the middle). The answer's grams are those of its own words, whether the question has them too or not;
an answer of fewer than 5 words is a single gram.

Words are lower-cased (A-Z) and parted by white space and ASCII punctuation. Defined cases: an item without words matches nothing; one of fewer than
5 words is a single gram; null and empty texts match nothing; repeated rows match alike; items alike match each. Repeated item
ids are told apart only by what they match. Very long texts are searched whole, passage by passage; further columns change nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, as_bytes, batched, gram_hash, hash_words, ranges

GRAM = 5
OVERLAP, PART = 0.75, 0.5
K1, B = 1.2, 0.75
BLOCK = 32  #: postings of a block
GROUP, MAX_GROUPS = 8, 64  #: items of a group, more if that made more groups than these
MAX_ITEMS = 20_000  #: items in one index; more are searched in as many passes as it takes
BATCH_BYTES = 2 << 20
ENTRIES = 1 << 20  #: entries of passages whose bounds are summed at a time
BREAKS = _SPACE.copy()
BREAKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


@dataclass
class Index:
    """Terms have entries, one a group of items that holds the term; entries have postings, in blocks."""

    ids: list[int]
    terms: np.ndarray  #: sorted names of all grams
    sizes: list[int]  #: words of a gram
    groups: int
    entries: np.ndarray  #: first entry of each term
    group: np.ndarray  #: of each entry
    most: np.ndarray  #: largest impact of each entry
    postings: np.ndarray  #: first posting of each entry
    items: np.ndarray  #: of each posting
    impacts: np.ndarray  #: of each posting
    grams: list[tuple[np.ndarray, np.ndarray, int]]  #: of each item: grams that start in the question, the others, words of a gram
    answers: list[tuple[np.ndarray, int]]  #: of each item: grams of the answer's own words, words of a gram
    longest: int


def _grams(words: np.ndarray) -> tuple[np.ndarray, int]:
    k = min(GRAM, len(words))
    return (np.unique(gram_hash(words, k)), k) if k else (np.zeros(0, np.uint64), GRAM)


def _named(grams: np.ndarray, k: int) -> np.ndarray:
    """Grams of different sizes get different names."""
    return grams + np.uint64(k)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values starts."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def build(items: list[tuple[int, bytes]]) -> Index:
    words, offsets = hash_words([t for _, t in items], lower=True, breaks=BREAKS)
    each = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    keep = [i for i, w in enumerate(each) if len(w)]
    counts = [np.unique(_named(gram_hash(w, k), k), return_counts=True) for w, k in ((each[i], min(GRAM, len(each[i]))) for i in keep)]
    sizes = np.array([len(t) for t, _ in counts], np.int64)
    terms, term, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in counts)]), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    commonest = [int(t[np.argmax(df[t])]) for t in np.split(term, ends[:-1])] if keep else []
    order = sorted(range(len(keep)), key=lambda i: (commonest[i], len(each[keep[i]])))
    place = np.empty(len(keep), np.int64)
    place[order] = np.arange(len(keep))
    owner = np.repeat(np.arange(len(keep)), sizes)
    tf = np.concatenate([np.zeros(0, np.int64), *(n for _, n in counts)])
    length = np.array([max(1, len(each[i]) - GRAM + 1) for i in keep])
    idf = np.log(1 + (len(keep) - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / length.mean())[owner])) if keep else tf.astype(float)
    for a, b in zip(ends - sizes, ends, strict=True):
        heavy = np.sort(impact[a:b])
        present = len(heavy) - int((1 - OVERLAP) * len(heavy))  # at least one gram
        impact[a:b] *= (1 + 1e-9) / heavy[:present].sum()
    size = max(GROUP, -(-len(keep) // MAX_GROUPS))
    item = place[owner]
    by_term = np.lexsort((item, term))
    term, item, impact = term[by_term], item[by_term], impact[by_term]
    first = _edges(term, item // size)
    grams, answers = [], []
    for w, text in ((each[keep[i]], items[keep[i]][1]) for i in order):
        cut = len(hash_words([text[: text.rfind(b"?") + 1]], lower=True, breaks=BREAKS)[0])
        cut = cut if 0 < cut < len(w) else (len(w) + 1) // 2
        whole, k = _grams(w)
        n = len(w) - k + 1
        begin = np.unique(gram_hash(w, k)[: max(1, min(cut, n - 1))]) if n > 1 else whole
        grams.append((begin, np.setdiff1d(whole, begin) if n > 1 else whole, k))
        answers.append(_grams(w[cut:]))
    return Index(
        [items[keep[i]][0] for i in order],
        terms,
        sorted({k for *_, k in grams}),
        -(-len(keep) // size),
        np.searchsorted(term[first], np.arange(len(terms) + 1)),
        item[first] // size,
        np.maximum.reduceat(impact, first) if len(first) else impact,
        np.append(first, len(item)),
        item,
        impact,
        grams,
        answers,
        max((len(each[i]) for i in keep), default=1),
    )


def wand(index: Index, entries: list[int]) -> list[tuple[int, float]]:
    """All items of a group whose impacts for some terms sum to 1 or more, by block-max WAND; entries are those of the terms in the group."""
    lists = []  # item under the cursor, cursor, bound, items, impacts, largest impact of each block
    for e in entries:
        a, b = index.postings[e], index.postings[e + 1]
        items, impacts = index.items[a:b].tolist(), index.impacts[a:b].tolist()
        lists.append([items[0], 0, float(index.most[e]), items, impacts, [max(impacts[i : i + BLOCK]) for i in range(0, len(impacts), BLOCK)]])
    found = []
    while lists:
        lists.sort(key=lambda x: x[0])
        bound, pivot = 0.0, -1
        for n, x in enumerate(lists):
            bound += x[2]
            if bound >= 1:
                pivot = n
                break
        if pivot < 0:
            break
        item = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
            pivot += 1
        blocks, ends = 0.0, []
        for x in lists[: pivot + 1]:
            x[1] = bisect_left(x[3], item, x[1])
            if x[1] < len(x[3]):
                b = x[1] // BLOCK  # the block where the item would be, or one that lies after it
                blocks += x[5][b]
                ends.append(x[3][min(len(x[3]), (b + 1) * BLOCK) - 1])
        if blocks >= 1:
            score = sum(x[4][x[1]] for x in lists[: pivot + 1] if x[1] < len(x[3]) and x[3][x[1]] == item)
            if score >= 1:
                found.append((item, score))
            target = item + 1
        else:
            target = min(ends, default=item) + 1
            if pivot + 1 < len(lists):
                target = min(target, lists[pivot + 1][0])
            target = max(target, item + 1)
        left = []
        for n, x in enumerate(lists):
            if n <= pivot:
                x[1] = bisect_left(x[3], target, x[1])
                if x[1] == len(x[3]):
                    continue
                x[0] = x[3][x[1]]
            left.append(x)
        lists = left
    return found


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, list[tuple[int, float]]]]:
    """Passages with the items that score 1 or more in them, for sorted pairs of passage and term. Bounds are summed for some ENTRIES, and a passage, at a time."""
    counts = np.diff(index.entries)[term]
    before = np.cumsum(counts) - counts
    starts = _edges(passage)
    edges = [*starts[_edges(before[starts] // ENTRIES)].tolist(), len(passage)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        entry = ranges(index.entries[term[a:b]], counts[a:b])
        key = np.repeat(passage[a:b] - passage[a], counts[a:b]) * index.groups + index.group[entry]
        enough = np.bincount(key, index.most[entry]) >= 1 - 1e-9
        some = np.flatnonzero(enough[key])
        some = some[np.argsort(key[some], kind="stable")]
        key, entry = key[some], entry[some]
        ends = [*_edges(key).tolist(), len(key)]
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            found = wand(index, entry[i:j].tolist())
            if found:
                yield int(passage[a] + key[i] // index.groups), found


def search(index: Index, texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
    """Verified matches: text, item's number, largest score, overlaps of question and answer (of the best passage)."""
    if not index.ids:
        return []
    words, offsets = hash_words(texts, lower=True, breaks=BREAKS)
    if not len(words):
        return []
    step, sizes = max(index.longest, GRAM), np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), sizes)
    per_doc = -(-sizes // step)
    base = np.concatenate([[0], np.cumsum(per_doc)])
    pairs, n = [], len(index.terms)
    for k in index.sizes:
        named = _named(gram_hash(words, k), k)
        term = np.minimum(np.searchsorted(index.terms, named), n - 1)
        at = np.flatnonzero(index.terms[term] == named)
        at = at[doc[at] == doc[at + k - 1]]
        segment, term = base[doc[at]] + (at - offsets[doc[at]]) // step, term[at]
        inner = segment > base[doc[at]]
        pairs += [segment * n + term, (segment[inner] - 1) * n + term[inner]]  # a passage is a segment and the next
    pair = np.unique(np.concatenate(pairs))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p, found in retrieve(index, pair // n, pair % n) if len(pair) else ():
        d = int(np.searchsorted(base, p, side="right") - 1)
        start = int(offsets[d] + (p - base[d]) * step)
        here = words[start : min(start + 2 * step, int(offsets[d + 1]))]
        known: dict[int, np.ndarray] = {}
        for item, score in found:
            (question, rest, k), (answer, ka) = index.grams[item], index.answers[item]
            for n_words in {k, ka} - known.keys():
                known[n_words] = gram_hash(here, n_words)
            q, r, a = np.isin(question, known[k]), np.isin(rest, known[k]), np.isin(answer, known[ka])
            share = (q.sum() + r.sum()) / (len(q) + len(r))
            in_answer = float(a.mean()) if len(a) else 1.0  # an empty part is fulfilled
            if share >= OVERLAP and q.mean() >= PART and in_answer >= PART:
                best[d, item] = max(best.get((d, item), (0.0, 0.0, 0.0)), (float(score), float(q.mean()), in_answer))
    return [(d, item, *x) for (d, item), x in best.items()]


def indexes(benchmark: DataFrame):
    """One index for each block of at most about MAX_ITEMS items of benchmark (item_id, text)."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = max(1, -(-items.count() // MAX_ITEMS))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield build(sorted(((r[0], r[1].encode()) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (BM25 over the item's threshold), question_overlap and answer_overlap of every leak in docs (doc_id, text)."""
    out = None
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    for index in indexes(benchmark):

        def run(batches, index=index):
            for t in batched(batches, BATCH_BYTES):
                got = search(index, as_bytes(t.column(1)))
                ids = t.column(0).take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.record_batch([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array([index.ids[g[1]] for g in got], pa.int64()), *(pa.array([g[i] for g in got], pa.float64()) for i in (2, 3, 4))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        part = docs.mapInArrow(run, f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no test item."""
    place = docs.columns.index("text")
    for index in indexes(benchmark):

        def run(batches, index=index):
            for batch in batches:
                for t in batched([batch], BATCH_BYTES):
                    leaked = {g[0] for g in search(index, as_bytes(t.column(place)))}
                    yield from t.filter(pa.array([i not in leaked for i in range(t.num_rows)], pa.bool_())).to_batches()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
