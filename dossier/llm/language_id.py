"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's UTF-8 bytes are read in windows of WINDOW bytes, all of them. In each window one network runs forwards and one backwards; a softmax
over both states labels every byte with language probabilities, and a document's probabilities are their means over all its bytes.

Training takes a bounded sample: of each language the Params.per_language documents of the least hashes, and from each a few
windows spread over the whole text.

Defined cases: `und` with score 0 for a null text, one without a letter, or if nothing was learned; with one learned language it is always that.
Ties go to the language first in code-point order. Rows are judged one by one, whole, however long, so repeated rows and further columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, bound, place_of

WINDOW = 128
BATCH = 512  #: windows that are read at once


@dataclass
class Params:
    per_language: int = 600  #: documents
    windows: int = 4  #: of each document
    length: int = 48  #: bytes of a training window
    hidden: int = 8  #: units of each direction
    steps: int = 260
    batch: int = 384
    rate: float = 0.02
    seed: int = 7


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    #: forwards, backwards: (input table with biases 256 x 3H, recurrent weights H x 3H, its biases 3H); output (2H x C, C)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean language probabilities over the bytes of each text; zeros for an empty one."""
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts], np.int64)
        if len(self.languages) == 1:
            return (sizes > 0).astype(float)[:, None]
        count = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), count)
        padded = np.frombuffer(b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, count, strict=True)), np.uint8).reshape(-1, WINDOW)
        left = sizes[owner] - WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        for a in range(0, len(owner), BATCH):
            part = padded[a : a + BATCH].T
            mask = (np.arange(WINDOW)[:, None] < left[a : a + BATCH][None, :])[..., None].astype(np.float32)
            np.add.at(sums, owner[a : a + BATCH], (_forward(self.weights, part, mask)[0] * mask).sum(axis=0))
        return sums / np.maximum(sizes, 1)[:, None]


def _cell_states(w: dict, way: str, x: np.ndarray, mask: np.ndarray, keep: bool):
    """Hidden states T x B x H of one direction; with keep, all that backpropagation needs."""
    table, u, c = w[f"{way}x"], w[f"{way}u"], w[f"{way}c"]
    size = u.shape[0]
    h, states, saved = np.zeros((x.shape[1], size), np.float32), np.empty((*x.shape, size), np.float32), []
    for t in range(len(x)) if way == "f" else reversed(range(len(x))):
        a, g = table[x[t]], h @ u + c
        gates = 0.5 * np.tanh(0.5 * (a[:, : 2 * size] + g[:, : 2 * size])) + 0.5
        z, r = gates[:, :size], gates[:, size:]
        n = np.tanh(a[:, 2 * size :] + r * g[:, 2 * size :])
        if keep:
            saved.append((t, h, z, r, n, g[:, 2 * size :]))
        h = (n + z * (h - n)) * mask[t]
        states[t] = h
    return states, saved


def _forward(w: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    hf, sf = _cell_states(w, "f", x, mask, keep)
    hb, sb = _cell_states(w, "b", x, mask, keep)
    size = hf.shape[-1]
    logits = hf @ w["o"][:size] + hb @ w["o"][size:] + w["oc"]
    logits -= logits.max(axis=-1, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(axis=-1, keepdims=True)
    return p, hf, hb, sf, sb


def _gradients(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
    p, hf, hb, sf, sb = _forward(w, x, mask, keep=True)
    total, size = float(mask.sum()), hf.shape[-1]
    right = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), axis=-1)
    loss = float(-(np.log(np.maximum(right, 1e-9)) * mask).sum() / total)
    d = p.copy()
    d[:, np.arange(len(y)), y] -= 1
    d *= mask / np.float32(total)
    flat = d.reshape(-1, d.shape[-1])
    g = {"o": np.concatenate([hf.reshape(-1, size).T @ flat, hb.reshape(-1, size).T @ flat]), "oc": flat.sum(axis=0)}
    for way, saved, out in (("f", sf, w["o"][:size]), ("b", sb, w["o"][size:])):
        u, into = w[f"{way}u"], d @ out.T
        du, dc, dx = np.zeros_like(u), np.zeros_like(w[f"{way}c"]), np.zeros_like(w[f"{way}x"])
        back = np.zeros_like(into[0])
        for t, h, z, r, n, gn in reversed(saved):
            dh = (back + into[t]) * mask[t]
            dan = dh * (1 - z) * (1 - n * n)
            daz, dar = dh * (h - n) * z * (1 - z), dan * gn * r * (1 - r)
            dg = np.concatenate([daz, dar, dan * r], axis=1)
            du += h.T @ dg
            dc += dg.sum(axis=0)
            np.add.at(dx, x[t], np.concatenate([daz, dar, dan], axis=1))
            back = dh * z + dg @ u.T
        g |= {f"{way}x": dx, f"{way}u": du, f"{way}c": dc}
    return g, loss


def train(windows: list[tuple[str, bytes]], p: Params) -> Model:
    """windows: (language, up to p.length bytes). Languages are drawn equally often; Adam with clipped gradients."""
    languages = sorted({lang for lang, _ in windows})
    if len(languages) < 2:
        return Model(languages)
    rng, h, c = np.random.default_rng(p.seed), p.hidden, len(languages)
    by = [[b for lang, b in windows if lang == one] for one in languages]
    x = [np.frombuffer(b"".join(b.ljust(p.length, b"\0") for b in each), np.uint8).reshape(-1, p.length) for each in by]
    sizes = [np.array([len(b) for b in each]) for each in by]
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    w = {f"{way}{k}": v for way in "fb" for k, v in (("x", normal(256, 3 * h, scale=0.3)), ("u", normal(h, 3 * h, scale=h**-0.5)), ("c", np.zeros(3 * h, np.float32)))}
    w |= {"o": normal(2 * h, c, scale=0.3), "oc": np.zeros(c, np.float32)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, p.steps + 1):
        y = rng.integers(0, c, p.batch)
        pick = [rng.integers(0, len(x[k])) for k in y]
        batch = np.stack([x[k][i] for k, i in zip(y, pick, strict=True)]).T
        length = np.array([sizes[k][i] for k, i in zip(y, pick, strict=True)])
        g, _ = _gradients(w, batch, (np.arange(p.length)[:, None] < length)[..., None].astype(np.float32), y)
        norm = float(np.sqrt(sum((a.astype(np.float64) ** 2).sum() for a in g.values())))
        rate = p.rate * min(1.0, 3 * (1 - step / (p.steps + 1)))
        for k, a in g.items():
            a = a * min(1.0, 1.0 / max(norm, 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, w)


def fit(documents: DataFrame, params: Params | None = None) -> Model:
    """documents (doc_id, text, lang) to learn from; rows without text or lang are left out."""
    p = params or Params()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    place = place_of("doc_id", "text")
    share = F.lit(0).cast("long")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("low")).collect()
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(bound(r["n"], p.per_language, r["low"]))).otherwise(share)

    def cut(batches):
        for batch in batches:
            out = []
            for text, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                n = min(p.windows, -(-len(text) // p.length))
                for i in range(n):
                    at = (len(text) - p.length) * i // max(n - 1, 1) if len(text) > p.length else 0
                    out.append((lang, text[at : at + p.length]))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.string()), pa.array([b for _, b in out], pa.binary())], ["lang", "window"])

    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id", "text"))
    picked = rows.where(place < share).withColumn("place", place).withColumn("rank", rank).where(F.col("rank") <= p.per_language)
    return train(sorted((r[0], bytes(r[1])) for r in picked.select("text", "lang").mapInArrow(cut, "lang string, window binary").collect()), p)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            texts, lettered = as_bytes(batch.column(1)), batch.column(2).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, ok in enumerate(lettered) if ok] if model.languages else []
            at = 0
            while at < len(rows):  # about 2 MB at once
                end, size = at, 0
                while end < len(rows) and (size < 1 << 21 or end == at):
                    size += len(texts[rows[end]])
                    end += 1
                p = model.probabilities([texts[i] for i in rows[at:end]])
                best = p.argmax(axis=1)
                for i, k, s in zip(rows[at:end], best.tolist(), p[np.arange(len(p)), best].tolist(), strict=True):
                    lang[i], score[i] = model.languages[k], min(max(s, 0.0), 1.0)
                at = end
            yield pa.record_batch([batch.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    return docs.select("doc_id", text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
