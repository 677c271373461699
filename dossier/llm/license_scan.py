"""Licence scans: a trained paragraph classifier names the licence family, and templates confirm it.

Paragraphs are parted by blank lines, so notices wrapped over lines are whole. Each is scored in windows of 2 * STEP words, one every STEP words, so that whatever is no longer than
the longest template lies within one, and besides each of its lines by itself. A multinomial logistic regression over sparse word n-grams (1 and 2 words,
present or not) gives each family and the unknown class a probability; the temperature that divides its logits is set on held-out examples, so that
probabilities can be read as such. A prediction stands if its probability is at least MIN_PROBABILITY and the window holds at least MIN_COVERAGE of
the word pairs of one template of that family; otherwise the family is unknown.

TRIGGER follows from this: it is built from the templates until, of every template, the pairs without any trigger word are fewer than MIN_COVERAGE. A window without
one can't be confirmed, whatever its probability, so it isn't scored; nothing is lost.

Training runs on the driver, over the templates with words dropped and added, and a bounded sample of the corpus's own lines as unknown.
Scanning is one projection of built-in functions over whole texts: no shuffle, no Python on executors.

Defined cases: a null or empty text has no paragraphs and no licence; family is null where nothing was confirmed; of several confirmed windows the
one with the largest probability counts, lines before windows, ties to the first; repeated rows give the same; very long texts and lines are
windows like others; further columns change nothing.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least

# How notices of each family are usually worded.
TEMPLATES = {
    "AGPL": ["licensed under the GNU Affero General Public License version 3", "This program is free software you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache": ["Licensed under the Apache License Version 2.0", "you may not use this file except in compliance with the License You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0", "released under the terms of the Apache License 2.0"],
    "BSD": ["licensed under the BSD 3-Clause License", "released under the BSD license", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "available under the Creative Commons Attribution license"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "licensed under CC BY-NC-SA 4.0", "licensed under CC BY-NC-ND 4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC0": ["released under CC0 1.0 Universal public domain dedication", "To the extent possible under law the author has waived all copyright and related rights to this work", "dedicated to the public domain under CC0"],
    "GPL": ["This work is licensed under the GNU General Public License version 3", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "released under the GPL license version 2 or later"],
    "LGPL": ["licensed under the GNU Lesser General Public License version 2.1", "This library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Released under the MIT License", "licensed under the MIT license", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License v 2.0", "licensed under the Mozilla Public License 2.0"],
    "Proprietary": ["All rights reserved no part of this work may be reproduced without prior written permission", "Copyright all rights reserved unauthorized copying of this file is strictly prohibited"],
}
UNKNOWN = "unknown"
#: Notices that name no family, and mentions that are none.
OTHER = ["he lost his driving license last year", "the license fee was paid in march", "copyright law is a wide field", "she asked for permission to leave the room", "the warranty and the license of the shop ran out", "a dog license is needed in this town", "all rights were reserved for the members", "the band released a record under a new name", "the terms of the contract were published", "this file is a list of public places", "free of charge for any person under ten", "the public domain is discussed here"]
#: Beginnings of words, and whole words, by which notices are told first.
STEMS, WHOLE = ["licen", "copyright", "permission", "permitted", "redistribut"], ["cc0"]
WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
MIN_PROBABILITY, MIN_COVERAGE = 0.5, 0.6
#: What parts paragraphs.
BLANK = r"\n[ \t\r\f\x0B]*\n"


@dataclass
class Params:
    unknown: int = 1500  #: documents, those with the least hashes, of each of which training takes one line as an example of no licence
    max_words: int = 200  #: words that such a line is cut to
    copies: int = 30  #: of each template, with words dropped and added
    steps: int = 300
    rate: float = 0.5
    l2: float = 1e-4
    seed: int = 5


@dataclass
class Model:
    families: list[str]  #: the last one is UNKNOWN
    weights: dict[str, list[float]] = field(default_factory=dict)
    bias: list[float] = field(default_factory=list)
    temperature: float = 1.0


def words_of(paragraph: str) -> list[str]:
    return re.findall(WORD, paragraph.lower())


def grams_of(paragraph: str) -> list[str]:
    w = words_of(paragraph)
    return list(dict.fromkeys(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))


PAIRS = {family: [frozenset(g for g in grams_of(t) if " " in g) for t in texts] for family, texts in TEMPLATES.items()}


def coverage(paragraph: str, *families: str) -> float:
    """The largest share of the word pairs of a template of these families that the paragraph holds."""
    own = set(grams_of(paragraph))
    return max((len(pairs & own) / len(pairs) for f in families for pairs in PAIRS.get(f, [])), default=0.0)


def _pattern(stems: list[str], whole: list[str]) -> str:
    """A regexp for lower-cased texts with a word of these beginnings or one of these whole words, grouped by first letter so that it runs fast."""
    first: dict[str, list[str]] = {}
    for rest in [re.escape(x) for x in stems] + [re.escape(x) + "(?![a-z0-9])" for x in whole]:
        first.setdefault(rest[0], []).append(rest[1:])
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(first.items())) + ")"


def _trigger() -> str:
    """The pattern of STEMS and WHOLE with so many words of the templates, longest first, that no lower-cased text without any covers MIN_COVERAGE of a template."""
    whole = list(WHOLE)
    for template in (x for f in PAIRS.values() for x in f):
        words = sorted({w for g in template for w in g.split()}, key=lambda w: (w in ("cc",), len(w), w))
        while sum(not re.search(_pattern(STEMS, whole), g) for g in template) >= MIN_COVERAGE * len(template) - 1e-9:
            word = words.pop()
            whole += [] if re.search(_pattern(STEMS, whole), word) else [word]
    return _pattern(STEMS, whole)


TRIGGER = _trigger()
#: Words of the longest template, which is how far apart windows start.
STEP = max(len(words_of(t)) for texts in TEMPLATES.values() for t in texts)


def train(unknown: list[str], p: Params) -> Model:
    """unknown: paragraphs of the corpus; those that a template covers are left out."""
    rng = random.Random(p.seed)
    unknown = [u for u in unknown if coverage(u, *TEMPLATES) < 0.4] + OTHER * 5
    filler = sorted({w for u in unknown[:300] for w in words_of(u)})
    examples = [(u, UNKNOWN) for u in unknown]
    for family, texts in TEMPLATES.items():
        for text in texts:
            for n in range(p.copies):
                w = [x for x in text.split() if n < 3 or rng.random() > 0.06]
                extra = [rng.choice(filler) for _ in range(rng.choice((0, 0, 1, 3, 8, 16, 2 * STEP - min(len(w), STEP))))]
                cut = rng.randint(0, len(extra))
                examples.append((" ".join(extra[:cut] + w + extra[cut:]), family))
    rng.shuffle(examples)
    families = [*TEMPLATES, UNKNOWN]
    vocabulary = {g: i for i, g in enumerate(sorted({g for texts in (*TEMPLATES.values(), OTHER) for t in texts for g in grams_of(t)}))}
    x = np.zeros((len(examples), len(vocabulary)))
    for row, (text, _) in enumerate(examples):
        x[row, [vocabulary[g] for g in grams_of(text) if g in vocabulary]] = 1
    y = np.array([families.index(f) for _, f in examples])
    held = np.arange(len(examples)) % 5 == 0
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    seen, goal = x[~held], np.eye(len(families))[y[~held]]
    for step in range(p.steps):
        d = (_softmax(seen @ w + b) - goal) / len(seen)
        rate = 20 * p.rate / (1 + step / 100)
        w -= rate * (seen.T @ d + p.l2 * w)
        b -= rate * d.sum(axis=0)
    z = x[held] @ w + b
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    return Model(families, {g: [round(v, 6) for v in w[i].tolist()] for g, i in vocabulary.items()}, [round(v, 6) for v in b.tolist()], temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, params: Params | None = None) -> Model:
    """docs: (doc_id, text). Unknown paragraphs come from at most params.unknown documents, one of each, from a place that its hash chooses."""
    p = params or Params()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ids = least(docs.select("doc_id").where("doc_id is not null"), p.unknown, "doc_id").distinct()
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    one = F.try_element_at(lines, (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.size(lines), F.lit(1))) + 1).cast("int"))
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", F.slice(F.regexp_extract_all(one, F.lit(r"\S+"), 0), 1, p.max_words).alias("p")).where("p is not null")
    return train(sorted(" ".join(r.p) for r in least(rows.select("doc_id", F.array_join("p", " ").alias("j"), "p"), p.unknown, "doc_id", "j").collect()), p)


def _grams(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(w, pairs))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, family, probability, coverage and paragraph (from 0) of the best confirmed notice, and confirmed (families of all, sorted) of every row."""
    doubles = lambda values: F.array(*[F.lit(float(v)) for v in values])
    grams = sorted(model.weights)
    table = F.map_from_arrays(F.array(*map(F.lit, grams)), F.array(*[doubles(model.weights[g]) for g in grams]))
    known = F.array(*map(F.lit, grams))
    named = F.array(*map(F.lit, model.families))

    def covers(own: Column, family: Column) -> Column:
        out = F.lit(0.0)
        for name in model.families[:-1]:
            shares = []
            for t in TEMPLATES[name]:
                pairs = [g for g in grams_of(t) if " " in g]
                shares.append(F.size(F.array_intersect(own, F.array(*map(F.lit, pairs)))) / F.lit(len(pairs)))
            out = F.when(family == name, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(out)
        return out

    def windows(paragraph: Column, number: Column) -> Column:
        """The scored pieces of a paragraph: its lines of at most 2 * STEP words, then its windows."""
        piece = lambda single, w: F.struct(F.lit(single).alias("single"), number.alias("paragraph"), w.alias("words"))
        lines = F.transform(F.filter(F.split(paragraph, "\n"), lambda x: x.rlike(TRIGGER)), lambda x: piece(True, _words(x)))
        starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - STEP - 1, F.lit(0)), F.lit(STEP))
        moving = lambda w: F.transform(starts(w), lambda i: piece(False, F.slice(w, i + 1, F.lit(2 * STEP))))
        some = _let(_words(paragraph), lambda w: F.filter(moving(w), lambda x: F.exists(x["words"], lambda y: y.rlike(TRIGGER))))
        return F.concat(F.filter(lines, lambda x: F.size(x["words"]) <= 2 * STEP), some)

    text = F.lower(F.col("text").cast("string"))
    paragraphs = F.split(text, BLANK)
    found = F.flatten(F.transform(paragraphs, lambda x, i: F.when(x.rlike(TRIGGER), windows(x, i)).otherwise(F.array().cast("array<struct<single:boolean,paragraph:int,words:array<string>>>"))))
    rows = docs.select(F.col("doc_id"), F.when(text.rlike(TRIGGER), found).alias("lines"))
    step = F.transform("lines", lambda x: F.struct(x["single"].alias("single"), x["paragraph"].alias("paragraph"), F.array_intersect(_grams(x["words"]), known).alias("grams")))
    rows = rows.select("doc_id", step.alias("lines"))

    def logits(own: Column) -> Column:
        sums = F.aggregate(own, doubles(model.bias), lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
        return F.transform(sums, lambda z: z / F.lit(model.temperature))

    step = F.transform("lines", lambda x: F.struct(x["single"].alias("single"), x["paragraph"].alias("paragraph"), x["grams"].alias("grams"), logits(x["grams"]).alias("z")))
    rows = rows.select("doc_id", step.alias("lines"))

    def likely(z: Column) -> Column:
        top = F.array_max(z)
        return F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))

    step = F.transform("lines", lambda x: F.struct(x["single"].alias("single"), x["paragraph"].alias("paragraph"), x["grams"].alias("grams"), F.element_at(named, F.array_position(x["z"], F.array_max(x["z"])).cast("int")).alias("family"), likely(x["z"]).alias("probability")))
    rows = rows.select("doc_id", step.alias("lines"))
    step = F.transform("lines", lambda x: F.struct(x["single"].alias("single"), x["probability"].alias("probability"), (-x["paragraph"]).alias("before"), x["family"].alias("family"), covers(x["grams"], x["family"]).alias("coverage")))
    rows = rows.select("doc_id", F.filter(step, lambda x: (x["family"] != UNKNOWN) & (x["probability"] >= MIN_PROBABILITY) & (x["coverage"] >= MIN_COVERAGE)).alias("lines"))
    best = F.array_max("lines")
    confirmed = F.coalesce(F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["family"]))), F.array().cast("array<string>"))
    return rows.select("doc_id", best["family"].alias("family"), best["probability"].alias("probability"), best["coverage"].alias("coverage"), (-best["before"]).alias("paragraph"), confirmed.alias("confirmed"))
