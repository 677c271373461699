"""The pipeline on the smallest tables: stages take what they should, and leave columns and clean documents alone."""

import os
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from dossier.llm import common, decontamination, mixing, queries, toxicity

from .test_operators import SCHEMA, components, corpus, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        after = out.count()
        assert 0 < after <= before, name
        docs, before = out, after
    assert decontamination.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "size", "source_size", "target", "taken"]
    names = queries.queries()
    assert "pipeline" in names and {n.partition("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)}
    assert queries.oracle_sql().keys() <= names.keys()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def kept_clean(spark, rows):
    """By plain sums of weights of a text's words."""
    model = toxicity.fit_on_folds(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{SF}/labels.parquet"))
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))

    def score(text):
        names = {int(common.hash_words([w.encode()], lower=True)[0][0]) for w in set(re.findall(r"[A-Za-z\x80-\U0010ffff]+", text or ""))}
        return model.bias + sum(weight.get(n, 0.0) for n in names)

    return [r for r in rows if score(r[1]) < 0]


def kept_one(rows):
    """Of each component by all pairs the row with the least id; rows without words all."""
    least = {c for _, n, c in components(rows) if n}
    done, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if not words(r[1]):
            out.append(r)
        elif r[0] in least and r[0] not in done:
            done.add(r[0])
            out.append(r)
    return out


def kept_words(rows, window=35):
    count = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        if any(gone):
            text = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
            if text:
                out.append((r[0], text, r[2], r[3], len(text)))
        else:
            out.append((*r[:4], len(r[1]) if r[1] is not None else None))
    return out


def kept_untested(rows, items):
    """By every gram of every item in every text: whole items, and half of their questions and answers."""
    split = lambda t: re.findall(r"[^\x00-\x08\x0e-\x1f\x20\x09-\x0d!-/:-@\[-`{-~]+", t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    made = []
    for t in items:
        w = split(t or "")
        if not w:
            continue
        cut = len(split(t[: t.rfind("?") + 1]))
        cut = cut if 0 < cut < len(w) else (len(w) + 1) // 2
        k, a = min(5, len(w)), w[cut:]
        n = len(w) - k + 1
        question = {tuple(w[i : i + k]) for i in range(max(1, min(cut, n - 1)) if n > 1 else 1)}
        made.append((grams(w, k), question, k, grams(a, min(5, len(a))), min(5, len(a))))
    out = []
    for r in rows:
        w = split(r[1] or "")
        have = {k: grams(w, k) for k in range(1, 6)}
        if not any(len(whole & have[k]) >= 0.75 * len(whole) and len(q & have[k]) >= 0.5 * len(q) and (not a or len(a & have[ka]) >= 0.5 * len(a)) for whole, q, k, a, ka in made):
            out.append(r)
    return out


def test_run_is_brute_force(spark):
    """Every stage, on what its predecessor kept, against plain Python; the mix against SQL."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as bigint) as n_chars")
    rows = rows_of(docs)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = [lambda x: kept_clean(spark, x), kept_one, kept_words, lambda x: kept_untested(x, items)]
    before = len(rows)
    for (name, stage), expect in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        got = rows_of(stage(spark, spark.createDataFrame(rows, SCHEMA), SF))
        assert got == sorted(expect(rows), key=str), name
        rows = got
    assert 0 < len(rows) < before
    mixed = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, SCHEMA), SF)
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO docs VALUES (?, ?, ?, ?, ?)", rows)
    cursor = con.execute(mixing.ORACLE_SQL.format(documents="docs"))
    columns = [c[0] for c in cursor.description]
    assert np.allclose(np.array(sorted(cursor.fetchall()), float), np.array(sorted(tuple(r[c] for c in columns) for r in mixed.collect()), float))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, mixed.collect()))


def test_stages_on_odd_rows_and_none(spark):
    rows = corpus(21, 40)
    odd = spark.createDataFrame(rows + rows[:3] + [(None, None, None, None, None)] * 2, SCHEMA).selectExpr("*", "'mine' as k1", "1 as node")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and {r.k1 for r in out.collect()} == {"mine"}, name
        assert {1000, 1001, 1002} <= {r.doc_id for r in out.collect()}, name  # null, empty and blank texts stay
        empty = stage(spark, odd.limit(0), SF)
        assert empty.columns == odd.columns and empty.count() == 0, name
    mix = corpus_pipeline.STAGES[-1][1]
    assert mix(spark, odd, SF).count() == odd.count() and mix(spark, odd.limit(0), SF).count() == 0
