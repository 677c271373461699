"""Toxicity: non-negative positive-unlabelled learning of a linear classifier over words.

Learns from confirmed toxic documents and unlabelled ones: the risk of the negatives is that of the unlabelled less what
positives contribute to it by the class prior, and is held at zero or above (Kiryo et al., 2017). Trained in numpy on the driver
from bounded samples; scores are worked out in Arrow batches over whole texts.

Defined cases: a null or empty text has no words and gets the score of the bias; repeated ids in labels count once, as
toxic if any row says so; without a confirmed toxic document every score is the prior. Rows are scored one by one, so repeated rows
and further columns change nothing; of a very long text all words count for its score, though training leaves it out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, as_bytes, chunks, hash_words, least

#: Bytes that part words here: white space, digits and ASCII punctuation.
BREAKS = _SPACE.copy()
BREAKS[:65] = True
BREAKS[91:97] = True
BREAKS[123:128] = True


@dataclass
class Params:
    max_positive: int = 4000  #: documents, at most, that training takes of the confirmed toxic ones
    max_unlabelled: int = 8000  #: and of the others; both are those with the least hashes of the id
    max_chars: int = 20_000  #: of a document that training takes, so that the driver holds a bounded number of words
    max_words: int = 4096  #: words with a weight
    min_documents: int = 3  #: confirmed toxic documents that must hold a word
    min_z: float = 4.0  #: how far a word's rate among positives must stand from that among the unlabelled
    epochs: int = 400
    rate: float = 0.05
    l2: float = 1e-5


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  #: sorted hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability-like scores from 0 to 1, one for each text."""
        out = [np.zeros(0)]
        for a, b in chunks(texts):
            doc, word = _hits(texts[a:b], self.words)
            out.append(self.bias + np.bincount(doc, self.weights[word], b - a) if len(word) else np.full(b - a, self.bias))
        return _sigmoid(np.concatenate(out))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _hits(texts: list[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a text's number and the place in words of a word that it has."""
    h, offsets = hash_words(texts, lower=True, breaks=BREAKS)
    if not len(words) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = np.flatnonzero(words[at] == h)
    doc = np.searchsorted(offsets, hit, side="right") - 1
    pair = np.unique(doc * len(words) + at[hit])
    return pair // len(words), pair % len(words)


def _word_sets(docs: DataFrame, ids: DataFrame, most: int, p: Params) -> list[np.ndarray]:
    """The distinct word hashes of the documents with these ids, of at most so many that aren't longer than p.max_chars."""

    def words(batches):
        for batch in batches:
            h, o = hash_words(as_bytes(batch.column(0)), lower=True, breaks=BREAKS)
            yield pa.record_batch([pa.array([np.unique(h[x:y]).tobytes() for x, y in zip(o[:-1], o[1:], strict=True)], pa.binary())], ["words"])

    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= p.max_chars).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    return [np.frombuffer(x, np.uint64) for x in sorted(bytes(r[0]) for r in least(short, most, "doc_id", "text").select("text").mapInArrow(words, "words binary").collect())]


def nnpu(xp: tuple, xu: tuple, n_words: int, prior: float, p: Params) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk with the sigmoid loss, whose bound keeps a wrong prior from
    pulling unlabelled documents over. xp, xu: (document, word, number of documents)."""
    theta = np.zeros(n_words + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def z(x):
        return np.bincount(x[0], theta[x[1]], x[2]) + theta[-1]

    def gradient(x, per_doc):
        return np.append(np.bincount(x[1], per_doc[x[0]], n_words), per_doc.sum())

    for t in range(1, p.epochs + 1):
        zp, zu = z(xp), z(xu)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.mean(su) - prior * np.mean(sp)
        toward_p = gradient(xp, prior * sp * (1 - sp) / xp[2])
        g, from_negative = -toward_p, gradient(xu, su * (1 - su) / xu[2]) - toward_p
        g = g + from_negative if negative >= 0 else -from_negative
        g[:-1] += p.l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(documents: DataFrame, labels: DataFrame, params: Params | None = None) -> Model:
    """documents (doc_id, text) to learn from; labels (doc_id, toxic): rows with toxic = 1 are confirmed, all others unlabelled.

    The prior is the share of toxic among the labelled.
    """
    p = params or Params()
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id is not null and toxic is not null")
    counts = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (counts[1] + 1) / (counts[0] + 2)
    toxic = marks.where("toxic = 1").select("doc_id")
    pos = _word_sets(docs, least(toxic, p.max_positive, "doc_id"), p.max_positive, p)
    unl = _word_sets(docs, least(docs.select("doc_id").join(toxic, "doc_id", "left_anti"), p.max_unlabelled, "doc_id"), p.max_unlabelled, p)
    bias_only = Model(bias=float(np.log(prior / (1 - prior))))
    if not pos or not unl:
        return bias_only
    seen_p, n_p = np.unique(np.concatenate(pos), return_counts=True)
    seen_u, n_u = np.unique(np.concatenate(unl), return_counts=True)
    at = np.minimum(np.searchsorted(seen_u, seen_p), max(len(seen_u) - 1, 0))
    in_u = np.where(seen_u[at] == seen_p, n_u[at], 0) if len(seen_u) else np.zeros(len(seen_p))
    rate = (n_p + in_u + 1) / (len(pos) + len(unl) + 2)
    gap = (n_p / len(pos) - in_u / len(unl)) / np.sqrt(rate * (1 - rate) * (1 / len(pos) + 1 / len(unl)))
    keep = np.flatnonzero((n_p >= p.min_documents) & (gap >= p.min_z))
    keep = np.sort(keep[np.argsort(-gap[keep], kind="stable")[: p.max_words]])
    if not len(keep):
        return bias_only
    words = seen_p[keep]

    def matrix(sets):
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate(sets)
        at = np.minimum(np.searchsorted(words, every), len(words) - 1)
        hit = words[at] == every
        return doc[hit], at[hit], len(sets)

    weights, bias = nnpu(matrix(pos), matrix(unl), len(words), prior, p)
    return Model(words, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.scores(as_bytes(batch.column(1))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = model.scores(as_bytes(batch.column(place))) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id, mod: int, rest: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit_on_folds(documents: DataFrame, labels: DataFrame, params: Params | None = None) -> Model:
    """A model from the rows whose crc32(doc_id) mod 5 is not 0; their labels and texts only."""
    return fit(documents.where(~held_out(F.col("doc_id"), 5, 0)), labels.where(~held_out(F.col("doc_id"), 5, 0)), params)
