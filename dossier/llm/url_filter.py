"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for the rest.

Features of a URL: lengths, depth, digit ratio, character entropy, numbers of parameters, labels, hyphens and capitals, and statistics of its
suffix (last host label): how often its labelled URLs were blocked. The trees are grown in numpy on the driver
from a bounded sample of labelled URLs, with the logistic loss, over quantile bins; each class is sampled by itself and weighted to its share.

Labels: a table of (url, blocked) if there is one. Otherwise URLs are labelled weakly, by UNWANTED: those with one of its words as a part of a host label are bad, the others
good. The trees don't see words, only the features, so they also block hosts of other names that look alike. Rules are policy, not labels: they allow bad hosts too.

Defined cases: a null URL and one without `://` have an empty host and path, fit no rule and get the trees' verdict (a null URL that of the empty one); with labels of one class
only, or none, the trees are a constant (the class, or allow). URLs are judged one by one and whole, however long, so repeated rows and further columns change nothing; of a URL's labels the largest counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_values

# Words of host names that weak labels take for unwanted.
UNWANTED = ["casino", "bet", "bets", "betting", "poker", "pills", "pharma", "viagra", "adult", "porn", "xxx", "sex", "escort", "spam", "ads", "adserver", "track", "tracker", "clickbait", "warez", "crack", "keygen", "phishing", "malware"]
FEATURES = ("url length", "host length", "path length", "depth", "digit ratio", "entropy", "parameters", "host labels", "hyphens", "capitals", "fragment", "suffix rate")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Params:
    max_labelled: int = 10_000  #: URLs of each class that training takes, those with the least hashes
    held_out: int = 0  #: of 5 parts of the host names (by crc32 of the label before the suffix's), how many training leaves out
    trees: int = 40
    depth: int = 3
    bins: int = 32
    rate: float = 0.2
    l2: float = 1.0
    min_leaf: int = 5


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; otherwise empty."""
    host = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; otherwise empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://[^/?#]*+(/[^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The text of the longest fitting rule, and whether it blocks; null without one. Rules are a short list, compiled into the plan."""
    text, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, block = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.block)).otherwise(block)
    return text, block


def weak_label(host: Column) -> Column:
    """1 for a host with an unwanted word between dots and hyphens, else 0."""
    return host.rlike(r"(?:^|[.-])(?:" + "|".join(UNWANTED) + r")(?:[.-]|$)").cast("int")


def name_fold(host: Column) -> Column:
    """One of 5 folds of host names, alike for all hosts under the same three last labels, so that a name is wholly in one fold."""
    return F.crc32(F.substring_index(host, ".", -3).cast("binary")) % 5


def _suffix(url: str) -> str:
    host = re.match(r"(?s)^.*?://([^/?#]*)", url)
    return host[1].lower().rpartition(".")[2] if host else ""


def features(urls: list[str], suffix_rate: dict[str, float], otherwise: float) -> np.ndarray:
    out = np.zeros((len(urls), len(FEATURES)))
    for i, url in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", url)
        host, path, query, fragment = (x or "" for x in m.groups()) if m else ("", "", "", "")
        n = max(len(url), 1)
        counts = Counter(url).values()
        out[i] = (
            len(url), len(host), len(path), sum(1 for x in path.split("/") if x), sum(c.isdigit() for c in url) / n,
            -sum(c / n * math.log2(c / n) for c in counts), query.count("=") + query.count("&"), host.count(".") + 1 if host else 0,
            url.count("-"), sum(c.isupper() for c in url), len(fragment), suffix_rate.get(_suffix(url), otherwise),
        )
    return out


@dataclass
class Model:
    """Trees as arrays of (feature, cut, value) in heap order: node k has the children 2k+1 and 2k+2."""

    suffix_rate: dict[str, float] = field(default_factory=dict)
    otherwise: float = 0.0
    bias: float = -10.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 0

    def probability(self, urls: list[str | None]) -> np.ndarray:
        """That each URL is to be blocked."""
        x = features([u or "" for u in urls], self.suffix_rate, self.otherwise)
        return 1 / (1 + np.exp(-self.margin(x)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = feature[node] >= 0
                right = x[np.arange(len(x)), np.maximum(feature[node], 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            z += value[node]
        return z


def fit_arrays(urls: list[str], blocked: np.ndarray, p: Params, weight: np.ndarray | None = None) -> Model:
    """weight: of each URL, 1 by default."""
    w = np.ones(len(urls)) if weight is None else weight
    total = float((blocked * w).sum() / w.sum()) if len(urls) else 0.0
    n, hits = Counter(), Counter()
    for u, b, one in zip(urls, blocked.tolist(), w.tolist(), strict=True):
        n[_suffix(u)] += one
        hits[_suffix(u)] += one * b
    rate = {s: (hits[s] + total) / (n[s] + 1) for s in n}
    if not len(urls) or blocked.min() == blocked.max():
        return Model(rate, total, 10.0 if len(urls) and blocked.all() else -10.0)
    x, y = features(urls, rate, total), blocked.astype(float)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    model = Model(rate, total, float(np.log(total / (1 - total))), [], p.depth)
    z = np.full(len(x), model.bias)
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-z))
        g, h = w * (q - y), w * np.maximum(q * (1 - q), 1e-6)
        size = 2 ** (p.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(x), np.int64)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            value[k] = -p.rate * g[rows].sum() / (h[rows].sum() + p.l2)
            if k < 2**p.depth - 1 and len(rows) >= 2 * p.min_leaf and (best := _split(binned[rows], g[rows], h[rows], cuts, p)):
                feature[k], b = best
                cut[k] = cuts[feature[k]][b]
                node[rows] = 2 * k + 1 + (binned[rows, feature[k]] > b)
        model.trees.append((feature, cut, value))
        z = z + value[node]
    return model


def _split(binned, g, h, cuts, p: Params) -> tuple[int, int] | None:
    best, found = 1e-9, None
    whole = g.sum() ** 2 / (h.sum() + p.l2)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        size = len(c) + 1
        gs, hs, ns = (np.cumsum(np.bincount(binned[:, f], w, size))[:-1] for w in (g, h, np.ones(len(g))))
        gain = gs**2 / (hs + p.l2) + (g.sum() - gs) ** 2 / (h.sum() - hs + p.l2) - whole
        gain[(ns < p.min_leaf) | (len(g) - ns < p.min_leaf)] = -1
        if gain.max() > best:
            best, found = gain.max(), (f, int(gain.argmax()))
    return found


def fit(labelled: DataFrame, params: Params | None = None) -> Model:
    """labelled: (url, blocked). Of each class the params.max_labelled distinct URLs with the least hashes, weighted to the class's share of all."""
    p = params or Params()
    rows = labelled.select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("int").alias("blocked")).where("url is not null and blocked is not null")
    n = {r["blocked"]: r["n"] for r in rows.groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    label: dict[str, int] = {}
    for c in sorted(n):
        label |= {r.url: c for r in least_values(rows.where(F.col("blocked") == c), p.max_labelled, "url").collect()}
    urls = sorted(label)
    taken = Counter(label.values())
    share = {c: n[c] / taken[c] for c in taken}
    scale = sum(taken.values()) / max(sum(n.values()), 1)
    return fit_arrays(urls, np.array([label[u] for u in urls], bool), p, np.array([share[label[u]] * scale for u in urls]))


def fit_weakly(pages: DataFrame, params: Params | None = None) -> Model:
    """A model from the URLs of pages (url) and weak labels of their hosts."""
    p = params or Params()
    host = host_of(F.col("url").cast("string"))
    rows = pages.select(F.col("url").cast("string").alias("url"), host.alias("host")).where("host <> ''")
    return fit(rows.where(name_fold(F.col("host")) >= p.held_out).select("url", weak_label(F.col("host")).alias("blocked")), p)


def judge(pages: DataFrame, rules: list[Rule], model: Model | None = None, params: Params | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and probability (that the URL is bad, by the trees; null under a rule) of every row of pages (page_id, url).

    Without a model the trees learn from weak labels of these URLs.
    """
    url = F.col("url").cast("string")
    split = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, block = longest_rule(rules, F.col("host"), F.col("path"))
    split = split.withColumns({"rule": rule, "blocked": block})
    model = model or fit_weakly(pages, params)

    def run(batches):
        for batch in batches:
            url, ruled = batch.column("url").to_pylist(), batch.column("blocked").to_pylist()
            free = [i for i, r in enumerate(ruled) if r is None]
            p = dict(zip(free, model.probability([url[i] for i in free]).tolist(), strict=True)) if free else {}
            verdict = ["block" if (p[i] >= 0.5 if r is None else r) else "allow" for i, r in enumerate(ruled)]
            yield pa.record_batch([batch.column("page_id"), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(verdict), pa.array([p.get(i) for i in range(len(url))], pa.float64())], ["page_id", "host", "path", "rule", "verdict", "probability"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return split.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, probability double")
