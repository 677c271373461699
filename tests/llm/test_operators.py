"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import time
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import common, decontamination, html_text, jaccard_join, language_id, license_scan, mixing, nearest, substring_dedup, toxicity, url_filter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def corpus(seed=0, n=60):
    """Random texts with copies, near copies, shared passages, and odd cases."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "sa") for b in ("ta", "vo", "xi", "ze", "pu")]
    text = lambda k: " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(k))
    passage, rows = text(50), []
    for i in range(n):
        t = text(rng.randrange(1, 120))
        if i % 5 == 0:
            t = f"{text(20)} {passage}\n{text(9)}"
        if i % 7 == 0 and rows:
            w = rng.choice(rows)[1].split()
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        if i % 11 == 0 and rows:
            t = rng.choice(rows)[1]
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    odd = [(1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, " \t\n", "en", None, 3), (1003, "one two", "en", "s0", 7), (1004, "ONE two", "en", "s0", 7), (1005, LONG, "en", "s1", len(LONG)), (None, "null id here", "en", "s1", 12), (1003, "one two", "en", "s0", 7)]
    return rows + odd


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def words(text):
    return WORD.findall((text or "").encode())


def shingles(text):
    w = words((text or "").encode().lower().decode() if text and text.isascii() else text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_word_hashes_follow_the_word_pattern():
    texts = [b"", b"  a b  c\n", b"x", "a\x1fb \x0bA \u00a0\u00e9".encode(), b""]
    hashes, offsets = common.hash_words(texts)
    assert np.diff(offsets).tolist() == [len(WORD.findall(t)) for t in texts]
    flat = [w for t in texts for w in WORD.findall(t)]
    assert {(flat[i] == flat[j]) == (hashes[i] == hashes[j]) for i in range(len(flat)) for j in range(len(flat))} == {True}
    grams = common.gram_hash(hashes, 3)
    assert len(grams) == len(hashes) - 2 and len(common.gram_hash(hashes, 99)) == 0


def components(rows):
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for j, x in enumerate(rows) if find(j) == find(i) and x[0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("small,hot,block", [(12, 100_000, 2000), (2, 100_000, 3), (2, 2, 3)])
def test_jaccard_join_is_brute_force(spark, monkeypatch, small, hot, block):
    for k, v in (("SMALL", small), ("HOT", hot), ("BLOCK", block)):
        monkeypatch.setattr(jaccard_join, k, v)
    rows = corpus(1)
    base = rows[3][1].split() + "a b c d e f g h i j k l m n o p".split()
    for i in range(25):  # a family of near copies of which not all pairs are similar
        w = list(base)
        for k in range(i % 4):
            w[(7 * i + 11 * k) % len(w)] = f"x{i}{k}"
        rows.append((2000 + i, " ".join(w), "en", "s0", 1))
    got = jaccard_join.join(frame(spark, rows)).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == components(rows)


@pytest.mark.parametrize("small,hot,block,grams", [(12, 100_000, 2000, 1 << 20), (2, 100_000, 3, 1 << 20), (2, 2, 2000, 100)])
def test_jaccard_join_counts_every_link(spark, monkeypatch, small, hot, block, grams):
    for k, v in (("SMALL", small), ("HOT", hot), ("BLOCK", block), ("BLOCK_GRAMS", grams)):
        monkeypatch.setattr(jaccard_join, k, v)
    rows, base = corpus(11), [f"b{i}" for i in range(60)]
    for i in range(45):  # one family whose members are mostly linked, in groups of several hubs
        w = list(base)
        for k in range(i % 3):
            w[(7 * i + 23 * k) % len(w)] = f"x{i}{k}"
        rows.append((2000 + i, " ".join(w), "en", "s0", 1))
    sets = [frozenset(shingles(r[1])) for r in rows]
    links = {a: sum(a != b and 100 * len(a & b) >= 75 * len(a | b) for b in set(sets) if b) if a else 0 for a in set(sets)}
    got = jaccard_join.join(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=str) == sorted(((r[0], len(s), links[s]) for r, s in zip(rows, sets, strict=True)), key=str)
    assert max(links.values()) > 12


def test_jaccard_join_of_nothing_and_one_of_each(spark):
    empty = frame(spark, [])
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0
    rows = corpus(2)
    docs = frame(spark, rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    least = {c for _, n, c in components(rows) if n}
    got = [r.doc_id for r in kept.collect()]
    assert set(got) - {None} == {r[0] for r in rows if r[0] in least or r[0] in (1000, 1001, 1002)} - {None}
    assert max(Counter(got).values()) == 1


def removed(rows, window=35):
    count = Counter()
    for r in rows:
        w = words(r[1])
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_is_brute_force(spark, monkeypatch):
    rows = corpus(3) + [(3000, " ".join(["same"] * 90), "en", "s0", 1), (3001, "tail " + " ".join(["same"] * 40), "en", "s0", 1)]
    docs = frame(spark, rows)
    assert sorted((tuple(r) for r in substring_dedup.digest(docs).collect()), key=str) == removed(rows)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 500)
    assert sorted((tuple(r) for r in substring_dedup.digest(docs.repartition(5)).collect()), key=str) == removed(rows)
    assert substring_dedup.digest(frame(spark, [])).count() == 0
    out = substring_dedup.remove(docs)
    assert out.columns == docs.columns and out.where("doc_id = 3000").count() == 0
    assert {r.doc_id: r.text for r in out.collect()}[1003] == "one two"


def test_decontamination_finds_whole_items_only(spark):
    rng = random.Random(4)
    text = lambda k: " ".join(f"t{rng.randrange(3000)}" for _ in range(k))
    items = [(i, text(rng.randrange(4, 60))) for i in range(40)] + [(50, "What is it? t1 t2 t3 t4 t5 t6 t7"), (51, None), (52, ""), (53, "lone")]
    rows = []
    for i in range(80):
        t = text(rng.randrange(5, 400))
        if i % 4 == 0:
            item = items[rng.randrange(41)][1]
            w = item.split()
            t = f"{text(rng.randrange(150))} {item}. {text(30)}" if i % 8 else f"{text(20)} {' '.join(w[: len(w) // 2])} {text(30)}"
        rows.append((i, t, "en", "s0", 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, LONG, "en", "s0", 0)]
    docs, bench = frame(spark, rows), frame(spark, items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    index = decontamination.build([(i, t.encode()) for i, t in items if t])
    want = set()
    for i, t, *_ in rows:
        w, _ = common.hash_words([(t or "").encode()], lower=True, breaks=decontamination.BREAKS)
        for item, (q, a, k) in zip(index.ids, index.grams, strict=True):
            g = common.gram_hash(w, k)
            q, a = np.isin(q, g), np.isin(a, g)
            if (q.sum() + a.sum()) / (len(q) + len(a)) >= 0.75 and q.mean() >= 0.5 and a.mean() >= 0.5:
                want.add((i, item))
    assert got == want and len(got) > 8
    kept = {r.doc_id for r in decontamination.drop_leaked(docs, bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in want}
    assert decontamination.matches(docs, frame(spark, [], "item_id long, text string")).count() == 0


def test_decontamination_of_quoted_and_short_answers():
    quoted = "the river Montone flows past the old town of Forli . Which river flows past it ? the river Montone flows past the old town of Forli"
    short = "Which river of the north flows past the old town of Forli in the plain ? The Montone"
    twice = "one two three four five six one two three four five six"
    index = decontamination.build([(i, t.encode()) for i, t in enumerate((quoted, short, twice))])
    parted = short.replace("?", "? Answer:")
    texts = [f"so {quoted} so", f"so {short} so", f"Question: {parted} so", f"so {twice} so", short.replace("The Montone", "no idea"), "nothing of it"]
    got = {(d, index.ids[i]) for d, i, *_ in decontamination.search(index, [t.encode() for t in texts])}
    assert got == {(0, 0), (1, 1), (2, 1), (3, 2)}


def test_wand_is_exhaustive_scoring():
    rng = random.Random(5)
    items = [(i, " ".join(f"v{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(3, 40))).encode()) for i in range(300)]
    index = decontamination.build(items)
    for _ in range(60):
        terms = sorted({*rng.sample(range(len(index.terms)), 40), *(t for i in rng.sample(range(300), 3) for t in np.searchsorted(index.terms, decontamination._named(index.grams[i][0], index.grams[i][2])).tolist())})
        sums, by_group = np.zeros(len(index.ids)), {}
        for e in (e for t in terms for e in range(index.entries[t], index.entries[t + 1])):
            by_group.setdefault(int(index.group[e]), []).append(e)
            for at in range(index.postings[e], index.postings[e + 1]):
                sums[index.items[at]] += index.impacts[at]
        found = {i for es in by_group.values() for i, _ in decontamination.wand(index, es)}
        assert found == set(np.flatnonzero(sums >= 1).tolist())
        got = {i for _, some in decontamination.retrieve(index, np.full(len(terms), 7), np.array(terms)) for i, _ in some}
        assert got == found


def templated(n, seed=6):
    rng = random.Random(seed)
    fill = lambda: [f"n{rng.randrange(50_000)}" for _ in range(4)]
    return ["In the year {} the town of {} on the river had how many mills ? The town of {} had as many as {} mills in that year".format(*fill()) for _ in range(n)]


def test_decontamination_of_templated_items_is_selective(monkeypatch):
    """Items that share all but four words: only those that stand in a text come to verification, and results are brute force's."""
    items = templated(1000)
    index = decontamination.build([(i, t.encode()) for i, t in enumerate(items)])
    rng, texts = random.Random(7), []
    for _ in range(12):
        some = rng.sample(items, rng.randrange(0, 20))
        texts.append(" . ".join([*some, *(" ".join(t.split()[: rng.randrange(8, 20)]) for t in rng.sample(items, 5))]))
    tried = []
    plain = decontamination.wand
    monkeypatch.setattr(decontamination, "wand", lambda *a: tried.append(plain(*a)) or tried[-1])
    for entries in (1 << 20, 50):
        monkeypatch.setattr(decontamination, "ENTRIES", entries)
        got = {(d, index.ids[i]) for d, i, *_ in decontamination.search(index, [t.encode() for t in texts])}
        want = set()
        for d, t in enumerate(texts):
            w, _ = common.hash_words([t.encode()], lower=True, breaks=decontamination.BREAKS)
            for item, (q, r, k), (a, ka) in zip(index.ids, index.grams, index.answers, strict=True):
                q, r, a = np.isin(q, common.gram_hash(w, k)), np.isin(r, common.gram_hash(w, k)), np.isin(a, common.gram_hash(w, ka))
                if (q.sum() + r.sum()) / (len(q) + len(r)) >= 0.75 and q.mean() >= 0.5 and a.mean() >= 0.5:
                    want.add((d, item))
        assert got == want and len(want) > 50
    assert sum(map(len, tried)) < 20 * len(want)


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (i % 50), None, f"s{i % 5}" if i % 6 else None, 0) for i in range(3000)] + [(None, "a b", None, "s1", 0), (5, None, None, "z", 0), (5, None, None, "z", 0)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sums = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        key = (r.source_size, r.target)
        sums[key] = sums.get(key, 0) + r.taken
    for (size, target), taken in sums.items():
        assert target <= 2 * size and abs(taken - target) <= 50
    assert abs(sum(t for _, t in sums) - 1.5 * sum(r["size"] for r in got)) < 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows)).collect()))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_toxicity_learns_from_confirmed_and_unlabelled(spark):
    rng = random.Random(6)
    clean = [f"c{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(clean) for _ in range(rng.randrange(20, 60))]
        w = [chr(97 + int(x[1:]) % 26) * 2 + chr(97 + int(x[1:]) // 26) for x in w]
        bad = i % 8 == 0
        if bad:
            for k in ("vile", "nasty", "foul"):
                w.insert(rng.randrange(len(w)), k)
        rows.append((i, " ".join(w), "en", "s0", 0))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    docs, marks = frame(spark, rows), frame(spark, labels, "doc_id long, toxic int")
    model = toxicity.fit_on_folds(docs, marks)
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(score[i] >= 0.5) == (i % 8 == 0) for i in score]) > 0.98
    odd = frame(spark, [(1, None, None, None, None), (2, "", None, None, None), (3, "x " * 5, None, None, None)]).selectExpr("*", "1 as score")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    none = toxicity.fit(frame(spark, []), frame(spark, [], "doc_id long, toxic int"))
    assert toxicity.score(odd, none).count() == 3


def test_urls_follow_rules_and_trees(spark):
    urls = ["http://www.example.com/en/1", "http://EXAMPLE.com/en/", "http://a.example.com/de/x", "https://b.c.net/es/3?q=/en/", "http://net/fr/", "http://x.org/?a=1#b", "nothing", None, "", "http://q.com", "http://a.com?x://y/z", "x://notexample.com/en/"]
    rule = url_filter.Rule
    rules = [rule("com", "/", False), rule("example.com", "/en/", True), rule("www.example.com", "/en/", False), rule("net", "/es/", True), rule("net", "/fr/", True)]
    got = {r.page_id: r for r in url_filter.judge(frame(spark, list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for i, url in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = max((r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.text), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, fit.text if fit else None)
        if fit:
            assert got[i].verdict == ("block" if fit.block else "allow")
        assert got[i].verdict in ("block", "allow")
    assert url_filter.judge(frame(spark, [], "page_id long, url string"), rules).count() == 0
    rng = random.Random(7)
    made = [f"http://{'-'.join('ab' for _ in range(4))}{rng.randrange(99999)}.xyz/{rng.randrange(10**9)}" if i % 2 else f"http://plain{i}.org/about/us" for i in range(400)]
    model = url_filter.fit_arrays(made[:300], np.arange(300) % 2 == 1, url_filter.Params())
    assert ((model.probability(made[300:]) >= 0.5) == (np.arange(100) % 2 == 1)).mean() > 0.95


def test_urls_are_judged_by_trees_from_weak_labels(spark):
    rng, rows = random.Random(14), []
    for i in range(2000):
        bad = i % 10 == 0
        name = f"{rng.choice(url_filter.UNWANTED)}-{rng.choice(('win', 'farm', 'zone'))}{rng.randrange(99)}" if bad else rng.choice(("garden", "museum", "review", "letters")) + rng.choice(("", "s", "land"))
        rows.append((i, f"http{rng.choice(('', 's'))}://{rng.choice(('www.', 'm.', ''))}{name}.example.org/{rng.choice(('en', 'de'))}/{rng.randrange(9999)}"))
    rows += [(3000, None), (3001, ""), (3002, "x" * 200_000), (3003, "http://" + "a-" * 50_000 + ".org/"), (1, rows[1][1])]
    pages = frame(spark, rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as blocked", "2 as path", "'y' as rule")
    got = url_filter.judge(pages, [url_filter.Rule("com", "/", False)]).collect()
    assert len(got) == len(rows) and {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    p = url_filter.Params(held_out=2)
    model = url_filter.fit_weakly(pages, p)
    host = url_filter.host_of(F.col("url"))
    held = pages.where((url_filter.name_fold(host) < p.held_out) & (host != "") & (F.length("url") < 1000)).select("url", url_filter.weak_label(host).alias("y")).collect()
    score = model.probability([r.url for r in held])
    bad = np.array([r.y == 1 for r in held])
    assert bad.sum() > 20 and (score[bad][:, None] > score[~bad][None, :]).mean() > 0.95
    again = url_filter.fit_weakly(pages.repartition(7).union(pages), p)
    assert np.allclose(again.probability([r.url for r in held]), score, atol=0.1)
    assert {r.verdict for r in url_filter.judge(pages.limit(0).unionByName(pages.where("page_id < 9 and page_id % 10 > 0")), []).collect()} == {"allow"}


def test_nearest_estimates_from_packed_bits():
    rng = np.random.default_rng(15)
    for d in (3, 24, 64, 100, 600):
        v, q = rng.normal(size=(500, d)), rng.normal(size=(7, d))
        codes, factor, width = nearest.encode(v)
        plane, low, step, total = nearest.planes(q)
        assert codes.dtype == np.uint64 and codes.shape == (500, -(-nearest.length(d) // 64))
        cosine = (v @ q.T / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(q, axis=1)).T
        signs = np.where(nearest.rotated(v) > 0, 1, -1) / np.sqrt(nearest.length(d))
        for i in range(7):
            estimate, off = nearest.estimates(codes, factor, width, plane[i], float(low[i]), float(step[i]), float(total[i]), nearest.length(d))
            plain = (signs * nearest.rotated(q)[i]).sum(axis=1) / factor
            assert np.all(np.abs(estimate - plain) <= off - width + 1e-4)
            assert (np.abs(estimate - cosine[i]) <= off).mean() >= 0.97


def test_nearest_in_double_precision(spark):
    rng = np.random.default_rng(16)
    big = [(i, (rng.normal(size=8) * 1e300).tolist()) for i in range(40)]
    tiny = [(100 + i, (rng.normal(size=9) * 1e-310).tolist()) for i in range(40)]
    close = [(200 + i, [1.0, 1.0 + i * 1e-9, 0.5]) for i in range(60)]
    rows = big + tiny + close
    vectors = frame(spark, rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as dim", "2 as v", "3 as score")
    got = {}
    for r in nearest.search(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == {0, 100, 200, 250} and all(len(x) == 5 for x in got.values())
    for q, found in got.items():
        a = np.array(dict(rows)[q], np.longdouble)
        every = []
        for i, b in rows:
            if i != q and len(b) == len(a):
                b = np.array(b, np.longdouble)
                every.append((float((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())), -i))
        for (i, s), (t, _) in zip(found, sorted(every, reverse=True), strict=False):
            assert abs(s - t) < 1e-14
    assert nearest.search(vectors, vectors.limit(0)).count() == 0


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + 0.7 * rng.normal(size=24)).astype(np.float32).tolist(), 0) for i in range(1200)]
    rows += [(1300 + i, rows[50][1], 0) for i in range(9)]
    rows += [(2000, None, 0), (2050, [0.0] * 24, 0), (2100, [float("nan")] * 24, 0), (2150, [1.0, None], 0), (2200, [], 0), (2250, [1.0, 2.0], 0), (2251, [2.0, 1.0], 0)]
    vectors = frame(spark, rows, "vec_id long, embedding array<float>, label int").drop("label").selectExpr("*", "1 as rank")
    got = {}
    for r in nearest.search(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.array([r[0] for r in rows[:1209]])
    v = np.array([r[1] for r in rows[:1209]], np.float32).astype(float)
    n, hits = np.sqrt((v * v).sum(axis=1)), 0
    queries = np.flatnonzero(ids % 50 == 0)
    for i in queries:
        s = (v * v[i]).sum(axis=1) / (n * n[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:5]
        hits += len({int(ids[j]) for j in order} & {a for a, _ in got[int(ids[i])]})
    assert hits / (5 * len(queries)) >= 0.95
    assert [a for a, _ in got[50]] == [1300, 1301, 1302, 1303, 1304]
    assert [a for a, _ in got[2250]] == [2251] and not {2000, 2050, 2100, 2150, 2200} & got.keys()
    assert nearest.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_language_network(spark):
    rng = np.random.default_rng(9)
    w = {f"{way}{k}": a for way in "fb" for k, a in (("x", rng.normal(0, 0.5, (256, 9))), ("u", rng.normal(0, 0.5, (3, 9))), ("c", rng.normal(0, 0.5, 9)))} | {"o": rng.normal(0, 0.5, (6, 3)), "oc": np.zeros(3)}
    x, y = rng.integers(0, 4, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    mask = (np.arange(6)[:, None] < np.array([6, 6, 3, 4, 1]))[..., None].astype(np.float32)
    g, _ = language_id._gradients(w, x, mask, y)
    for k, at in (("fx", (1, 2)), ("fu", (1, 4)), ("fc", (7,)), ("bx", (2, 8)), ("bu", (0, 0)), ("o", (3, 1)), ("oc", (2,))):
        old, loss = w[k][at], []
        for e in (0.01, -0.01):
            w[k][at] = old + e
            loss.append(language_id._gradients(w, x, mask, y)[1])
        w[k][at] = old
        assert abs((loss[0] - loss[1]) / 0.02 - g[k][at]) < 1e-5
    random.seed(9)
    word = {"aa": "the thing that which with", "bb": "der die das schön für", "cc": "le la été où que"}
    rows = [(i, " ".join(random.choice(word[lang].split()) for _ in range(1 + i % 60)), lang, "s", 0) for i in range(300) for lang in [sorted(word)[i % 3]]]
    model = language_id.fit(frame(spark, rows), language_id.Params(steps=120, batch=96))
    odd = [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "12 34", "aa", "s", 0), (903, "the thing " * 20_000, "aa", "s", 0)]
    got = {r.doc_id: r for r in language_id.predict(frame(spark, rows + odd), model).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.predict(frame(spark, rows[:3]), language_id.fit(frame(spark, []))).collect()} == {"und"}


def test_language_probabilities_are_brute_force():
    rng, h, c = np.random.default_rng(17), 3, 3
    w = {f"{way}{k}": a.astype(np.float32) for way in "fb" for k, a in (("x", rng.normal(0, 0.8, (256, 3 * h))), ("u", rng.normal(0, 0.8, (h, 3 * h))), ("c", rng.normal(0, 0.5, 3 * h)))} | {"o": rng.normal(0, 1, (2 * h, c)).astype(np.float32), "oc": rng.normal(0, 1, c).astype(np.float32)}
    model = language_id.Model(["a", "b", "c"], w)
    texts = [b"", b"x", bytes(rng.integers(0, 256, 127).astype(np.uint8)), bytes(rng.integers(0, 256, 300).astype(np.uint8))]
    got = model.probabilities(texts)

    def gru(way, data):
        state, out = np.zeros(h), []
        for byte in data:
            a, g = w[f"{way}x"][byte].astype(float), state @ w[f"{way}u"] + w[f"{way}c"]
            z, r = 1 / (1 + np.exp(-(a[:h] + g[:h]))), 1 / (1 + np.exp(-(a[h : 2 * h] + g[h : 2 * h])))
            n = np.tanh(a[2 * h :] + r * g[2 * h :])
            state = (1 - z) * n + z * state
            out.append(state)
        return out

    for text, p in zip(texts, got, strict=True):
        sums = np.zeros(c)
        for at in range(0, len(text), language_id.WINDOW):
            part = text[at : at + language_id.WINDOW]
            for f, b in zip(gru("f", part), gru("b", part[::-1])[::-1], strict=True):
                e = np.exp(np.concatenate([f, b]) @ w["o"] + w["oc"])
                sums += e / e.sum()
        assert np.allclose(p, sums / max(len(text), 1), atol=1e-4)
    assert language_id.Model(["b"], {}).probabilities([b"", b"x"]).tolist() == [[0.0], [1.0]]


def test_language_ties_repeats_and_clashes(spark):
    zero = {f"{way}{k}": np.zeros(n, np.float32) for way in "fb" for k, n in (("x", (256, 3)), ("u", (1, 3)), ("c", 3))} | {"o": np.zeros((2, 2), np.float32), "oc": np.zeros(2, np.float32)}
    docs = frame(spark, [(1, "text", "x", "s", 0), (1, "text", "x", "s", 0), (None, "more " * 50_000, None, None, None)]).selectExpr("*", "1 as lang_pred", "2 as score", "3 as place", "4 as rank")
    got = language_id.predict(docs, language_id.Model(["aa", "bb"], zero)).collect()
    assert [(r.lang_pred, round(r.score, 6)) for r in got] == [("aa", 0.5)] * 3
    assert language_id.predict(docs.limit(0), language_id.Model(["aa"], {})).count() == 0
    rows = [(i, f"word{i % 7} and {'xyz' * (i % 5)}", "aa" if i % 2 else "bb", "s", 0) for i in range(400)]
    p = language_id.Params(per_language=30, steps=3, batch=8)
    a, b = (language_id.fit(frame(spark, rows).repartition(n).selectExpr("*", "1 as place", "2 as rank"), p) for n in (1, 6))
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_toxicity_scores_are_brute_force(spark):
    rng = random.Random(18)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(clean) for _ in range(30)) + (" Vile,nasty FOUL!" if i % 6 == 0 else ""), "en", "s", 0) for i in range(900)]
    docs, marks = frame(spark, rows), frame(spark, [(i, int(i % 6 == 0)) for i in range(0, 900, 2)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    other = toxicity.fit(docs.repartition(7).selectExpr("*", "1 as toxic", "2 as score"), marks.repartition(3))
    assert np.array_equal(model.words, other.words) and np.allclose(model.weights, other.weights)
    odd = rows + [(5000, LONG + " vile nasty foul", "en", "s", 0), (5001, None, None, None, None), (5002, "", "en", "s", 0), (0, rows[0][1], "en", "s", 0)]
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    got = sorted(((r.doc_id, r.score) for r in toxicity.score(frame(spark, odd).selectExpr("*", "1 as words"), model).collect()), key=str)
    want = []
    for i, text, *_ in odd:
        words = set(re.findall(r"[A-Za-z\x80-\U0010ffff]+", text or ""))
        names = {int(common.hash_words([w.encode()], lower=True)[0][0]) for w in words}
        want.append((i, 1 / (1 + np.exp(-np.clip(model.bias + sum(weight.get(n, 0.0) for n in names), -30, 30)))))
    assert [x[0] for x in got] == [x[0] for x in sorted(want, key=str)] and len(weight) >= 3
    assert {i: round(s, 9) for i, s in got} == {i: round(float(s), 9) for i, s in want}


def test_samples_are_the_least_places(spark):
    df = frame(spark, [(i % 4000, str(i)) for i in range(6000)], "doc_id long, text string").repartition(7)
    a, b = (sorted(r.text for r in common.least(d, 50, "doc_id", "text").collect()) for d in (df, df.repartition(3)))
    place = {r.text: r.p for r in df.select("text", common.place_of("doc_id", "text").alias("p")).collect()}
    assert a == b == sorted(sorted(place, key=place.get)[:50])
    assert common.least(df.limit(0), 5, "doc_id").count() == 0 and common.least(df, 9000, "doc_id").count() == 6000
    same = frame(spark, [(1, "x")] * 500, "doc_id long, text string")
    assert common.least(same, 5, "doc_id", "text").count() == 5
    for n in (10**10, 10**13):
        assert 600 * 2**63 / n < common.bound(n, 600) < 2**63 - 1
    assert common.bound(10**10, 600, 2**62) == 2**62 + 1


def test_samples_of_values_count_each_once(spark):
    rows = frame(spark, [(f"u{i}",) for i in range(3000)] + [("hot",)] * 3000, "url string")
    place = {r.url: r.p for r in rows.select("url", common.place_of("url").alias("p")).distinct().collect()}
    want = sorted(place, key=lambda u: (place[u], u))
    for k in (1, 50, 400, 9000):
        assert [r.url for r in common.least_values(rows.repartition(5), k, "url").collect()] == want[:k]
    least = min(place, key=place.get)  # the value of the least place, in most rows
    hot = rows.unionByName(frame(spark, [(least,)] * 9000, "url string"))
    assert [r.url for r in common.least_values(hot, 50, "url").collect()] == want[:50]
    assert common.least_values(rows.limit(0), 5, "url").collect() == []


def test_arrow_batches_are_bounded_by_bytes(spark):
    common.bound_batches(spark)
    limit = spark.conf.get(common.BATCH_LIMIT)
    assert int(limit) == common.ARROW_BYTES
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(got) >= 8 and max(got) <= 2 * common.ARROW_BYTES
    spark.conf.set(common.BATCH_LIMIT, "1000000")  # what a session says stays
    common.bound_batches(spark)
    assert spark.conf.get(common.BATCH_LIMIT) == "1000000"
    spark.conf.set(common.BATCH_LIMIT, limit)


def test_member_tables_hold_all_their_keys(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"))
    other = spark.range(5000, 25000).select(F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"))
    held = common.members(keys, 5000)
    assert keys.where(held).count() == 5000 and other.where(held).count() < 500
    assert other.where(common.members(keys.limit(0), 0)).count() == 0


def test_intermediate_tables_and_their_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    kept = common.stored(spark.range(5), "kept")
    assert kept.count() == 5
    common.discard(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(kept._stored_at).count()


def test_clashing_names_repeats_and_long_texts(spark):
    docs = frame(spark, corpus(19, 30))
    clash = docs
    for c in ("k1", "k2", "r1", "r2", "spans", "node", "n", "comp", "at", "kind", "h", "size", "target", "live"):
        clash = clash.withColumn(c, F.lit(f"my {c}"))
    kept = jaccard_join.one_of_each(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in jaccard_join.one_of_each(docs).collect())
    assert all(r.k1 == "my k1" and r.r2 == "my r2" for r in kept.collect())
    out = substring_dedup.remove(clash)
    assert out.columns == clash.columns and {r.spans for r in out.collect()} == {"my spans"}
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in substring_dedup.remove(docs).collect())
    assert sorted(map(str, jaccard_join.join(clash).collect())) == sorted(map(str, jaccard_join.join(docs).collect()))
    assert sorted(map(str, substring_dedup.digest(clash).collect())) == sorted(map(str, substring_dedup.digest(docs).collect()))
    assert sorted(map(str, mixing.mix(clash).collect())) == sorted(map(str, mixing.mix(docs).collect()))
    items = frame(spark, [(1, " ".join(LONG.split()[100:130])), (1, " ".join(LONG.split()[100:130]))], "item_id long, text string")
    hits = decontamination.matches(clash.withColumn("item_id", F.lit(0)), items).collect()
    assert len(hits) == 2 and {r.doc_id for r in hits} == {1005}
    twice = decontamination.drop_leaked(clash.union(clash), items)
    assert twice.count() == 2 * (docs.count() - 1) and twice.columns == clash.columns
    assert decontamination.drop_leaked(clash.limit(0), items).count() == 0
    two = [(7, "a b c d e f", "en", "s0", 1), (7, "a b c d e f", "en", "s1", 1), (7, "a b c d e f", "en", "s1", 1)]
    assert [r.doc_id for r in jaccard_join.one_of_each(frame(spark, two)).collect()] == [7]


def test_suffix_filter_is_safe():
    rng = np.random.default_rng(20)
    kept = 0
    for _ in range(400):
        pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(2))
        if rng.random() < 0.5:
            b = np.unique(np.concatenate([a[: max(1, int(len(a) * 0.9))], b[:3]]))
        shared = len(np.intersect1d(a, b))
        ok = jaccard_join.may_be_similar(len(a), jaccard_join.signature(a), len(b), jaccard_join.signature(b))
        assert ok or not 4 * shared >= 3 * (len(a) + len(b) - shared)
        both = jaccard_join.with_partners(np.array([len(a), len(b)]), [jaccard_join.signature(x) for x in (a, b)], np.array([True, False]), np.array([False, True]))
        if 4 * shared >= 3 * (len(a) + len(b) - shared):
            assert both.all()
            kept += 1
        else:
            assert both.all() == (ok and 3 * max(len(a), len(b)) <= 4 * min(len(a), len(b)))
    assert kept > 50


def test_html_text(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class="cookie-notice">yes</div><main><h1>A &amp; B</h1><p>One\n two<br>three <b>fo</b>ur<p>five<script>var x="</p>"</script><aside>no</aside><form><input>q</form><ul><li>six<li>seven</ul><div id="comments"><p>said</div></main><footer>foot</footer>'
    broken = '<div class="ad"><p>buy<article><p>text here &lt;x&gt; and more words &am'
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", broken), (5, "u", "plain words only"), (6, "u", "<p>" + LONG)]
    pages = frame(spark, rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")
    got = {r.page_id: r for r in html_text.extract(pages, html_text.fit(pages)).collect()}
    assert got[1].text == "A & B\nOne two three four\nfive\nsix\nseven"
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == ("", "", "text here <x> and more words &am", "plain words only")
    assert got[6].text == LONG and got[6].n_chars == len(LONG)
    assert html_text.fit(pages.limit(0)).weights.keys() == {f".{w}" for w in html_text.OUTSIDE} and html_text.extract(pages.limit(0), html_text.Model()).count() == 0
    model = html_text.fit(pages)
    for clash in ("h", "page", "n_chars", "inside"):
        assert html_text.extract(pages.withColumn(clash, F.lit(1)), html_text.fit(pages.withColumn(clash, F.lit(1)))).count() == 6 and html_text.fit(pages.union(pages)).hides == model.hides


def test_html_text_keeps_the_articles_own_parts():
    own = '<h2 id="related-work">Related work</h2><section id="discussion"><p>We discuss it</p></section><header class="entry-header"><h1 class="header">Title here</h1></header><div class="entry-header">Lead text</div>'
    links = '<p>See <a href="/hidden-lake">hidden lake</a> <a href="/x?id=search">one</a> <a href=/x?id=search>two</a> <b title="A hidden gem" data-id="menu">gem</b></p>'
    out = '<div class="comments"><p>said</p></div><p hidden>secret</p><p ID = menu>links</p><div class="x ad">buy</div><p style=\'display: none\'>gone</p>'
    page = f'<body><div class="header">site</div><section class="related">more</section><article>{own}{links}{out}</article></body>'
    text = html_text.learn(html_text.counts_of(page)).text(page)
    assert text == "Related work\nWe discuss it\nTitle here\nLead text\nSee hidden lake one two gem"


def test_html_text_of_marked_pages():
    text = lambda page: html_text.Model().text(page)
    assert text("<article><!-- <script> was here --><p>kept text here</p></article>") == "kept text here"
    assert text('<article><h1 class="page-header">The title</h1><p>some words</p></article>') == "The title\nsome words"
    assert text('<article class="side-note lead"><section id="discussion"><p>Words of it</p></section></article>') == "Words of it"
    assert text('<article><p>Words of it</p><div class=ad><a href=http://x/>buy now</a> more</div><p>its end</p></article>') == "Words of it\nits end"
    assert text('<article><p>Words of it</p><div id="comments"><p>said</div><article class="comment">u</article><p>its end') == "Words of it\nits end"
    assert text("<head><title>t</title><p>No head end") == "No head end"
    assert text("<p>one two<script>a < b</SCRIPT ><p>three<!-->four<p>five<a title='x") == "one two\nthreefour\nfive"
    assert text("<main><h1>T</h1><article><p>in both</p></article></main><p>far more words outside of the content than inside") in ("T\nin both", "far more words outside of the content than inside")
    # names learned from labelled pages: seen outside only, and inside too
    pages = [f'<div class="wrap"><div class="teaser x{i % 3}">buy</div><article><div class="note">a b</div></article></div>' for i in range(30)]
    model = html_text.learn(sum((html_text.counts_of(p) for p in pages), Counter()))
    assert ".teaser" in model.hides and not {".note", ".wrap"} & model.hides
    assert model.text('<div class="wrap"><p>so many words that the run goes on</p><div class="teaser">gone</div><div class="note">kept as it holds more words than a tag counts</div></div>') == "so many words that the run goes on\nkept as it holds more words than a tag counts"
    assert model.text('<article><p>short</p><div class="teaser">gone</div><div class="note">kept</div></article>') == "short\nkept"


def test_html_text_keeps_whole_articles_without_comments():
    heavy = html_text.Model({"<div": -6.0, "</div": -6.0, "<ul": -6.0, "</ul": -6.0, "<p": -1.0})
    inner = '<div><h1>My Title</h1></div><div><p>Some words of the article</p></div>{}<div><p>Short last words.</p></div><div><ul><li>one</ul></div>'
    comments = "".join(f'<{tag} class="{c}"><p>I liked this article very much. Thank you for it.</p></{tag}>' for tag, c in (("div", "post-comments"), ("section", "user-comments"), ("ul", "x comment-item"), ("div", "widget-newsletter")))
    for mark in ("article", "main"):
        assert heavy.text(f"<body><div>menu</div><{mark}>{inner.format(comments)}</{mark}><p>foot</p>") == "My Title\nSome words of the article\nShort last words.\none"
    plain = html_text.Model().text(f'<div class="post no-comments"><p>words of a plain page that goes on for a while</p></div>{comments}')
    assert plain == "words of a plain page that goes on for a while"
    assert html_text.Model().text('<article><h2 class="comments-title">Comments on law</h2><p class="comment-note">kept text</p></article>') == "Comments on law\nkept text"


def test_html_text_of_deep_nesting_is_linear():
    began = time.process_time()
    deep = 60_000
    assert html_text.Model().text("<div>" * deep + "<b>" * deep + "inner words" + "</i>" * deep + "</b>" * deep + "</div>" * deep) == "inner words"
    assert time.process_time() - began < 20


def test_best_run_is_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        scores = [rng.choice((-3.0, -1.0, -0.5, 0.0, 1.0, 2.0, 4.0)) for _ in range(rng.randrange(0, 25))]
        a, b = html_text.best_run(scores)
        every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[a:b]) == max(0.0, max(every, default=0.0))
    words = ["<p>", "</p>", "a b", "<div class='ad'>", "</div>", "<article>", "</article>", "c", "<br>", "<nav>", "</nav>", "&lt;d"]
    for _ in range(200):
        page = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        tokens = list(html_text.tokens_of(page, html_text.Model().hides))
        scores = html_text.Model().scores(tokens)
        a, b = html_text.best_run(scores)
        assert sum(scores[a:b]) == pytest.approx(max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]))


def plain_scan(text, model):
    """What scan() gives for one text, worked out by itself: paragraph, lines and windows as loops, coverage from the templates' words, logits as sums."""
    word = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
    step = max(len(word.findall(t.lower())) for ts in license_scan.TEMPLATES.values() for t in ts)
    found = []
    for number, paragraph in enumerate(re.split(r"\n[ \t\r\f\x0b]*\n", (text or "").lower())):
        lines = [word.findall(x) for x in paragraph.split("\n")]
        every = word.findall(paragraph)
        pieces = [(1, x) for x in lines if len(x) <= 2 * step] + [(0, every[i : i + 2 * step]) for i in range(0, max(1, len(every) - step), step)]
        for single, w in pieces:
            grams = set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}
            z = [b + sum(model.weights[g][k] for g in grams if g in model.weights) for k, b in enumerate(model.bias)]
            e = np.exp((np.array(z) - max(z)) / model.temperature)
            k = int(np.argmax(e))
            if model.families[k] == "unknown" or e[k] / e.sum() < 0.5:
                continue
            for t in license_scan.TEMPLATES[model.families[k]]:
                u = word.findall(t.lower())
                pairs = {f"{a} {b}" for a, b in zip(u, u[1:])}
                if len(pairs & grams) / len(pairs) >= 0.6:
                    found.append((single, float(e[k] / e.sum()), -number, model.families[k]))
                    break
    return (max(found)[3], max(found)[1], sorted({x[3] for x in found})) if found else (None, None, [])


NOTICES = {
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms,\nwith or without modification, are permitted\nprovided that the following conditions\nare met:",
    "MIT": "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this\nsoftware and associated documentation files\n(the Software), to deal in it",
    "CC-BY-SA": "Text available under CC BY-SA 4.0",
    "Apache": "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\thttp://www.apache.org/licenses/LICENSE-2.0",
}


def test_licence_scan_is_plain_python(spark):
    rows = corpus(10, 40) + [(5000, "Some words\nReleased under the MIT License.\nmore", "en", "s", 0), (5001, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", "en", "s", 0), (5002, "He lost his license.\nthe license fee was paid", "en", "s", 0)]
    rows += [(6000 + i, f"Some words here\n\n{t}\n\nmore of it", "en", "s", 0) for i, t in enumerate(NOTICES.values())] + [(6099, "This program is free software: you can redistribute it and/or modify\n\nnothing", "en", "s", 0)]
    rows += [(6100, f"{LONG[:4000]} {NOTICES['GPL']} {LONG[:4000]}", "en", "s", 0), (6101, " ".join(["license"] * 500), "en", "s", 0), (5000, "twice Released under the MIT License.", "en", "s", 0)]
    docs = frame(spark, rows).selectExpr("*", "1 as family", "2 as lines", "3 as j")
    model = license_scan.fit(docs)
    got = sorted(license_scan.scan(docs, model).collect(), key=str)
    want = []
    for i, text, *_ in rows:
        family, p, every = plain_scan(text, model)
        want.append((i, family, p, every))
    assert len(got) == len(want)
    for r, w in zip(sorted(((r.doc_id, r.family, r.probability, r.confirmed) for r in got), key=lambda x: (str(x[0]), str(x[3]))), sorted(want, key=lambda x: (str(x[0]), str(x[3]))), strict=True):
        assert (r[0], r[1], r[3]) == (w[0], w[1], w[3]) and (w[2] is None or abs(r[2] - w[2]) < 1e-6)
    by = {r.doc_id: r for r in got}
    assert by[5002].family is None and by[1000].family is None and by[6099].family is None and by[6100].family == "GPL" and by[5001].confirmed == ["Apache", "CC-BY-NC"]
    assert [by[6000 + i].family for i in range(len(NOTICES))] == list(NOTICES)
    assert license_scan.scan(docs.limit(0), model).count() == 0 and license_scan.fit(docs.limit(0)).weights
    for texts in license_scan.PAIRS.values():  # no trigger, no confirmation
        assert all(sum(not re.search(license_scan.TRIGGER, g) for g in pairs) / len(pairs) < license_scan.MIN_COVERAGE for pairs in texts)


def test_licence_scan_on_held_out_notices(spark):
    """Notices as training never saw them (wrapped, inside other words, a few words changed), and lines of none."""
    rng, rows, want = random.Random(13), [], {}
    filler = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ta", "vo", "xi")] + "the of a to in is it for and or".split()
    some = lambda k: " ".join(rng.choice(filler) for _ in range(k))
    for i in range(600):
        family = rng.choice(list(license_scan.TEMPLATES)) if i % 2 else None
        if family:
            w = [x for x in rng.choice(license_scan.TEMPLATES[family]).split() if rng.random() > 0.05]
            width = rng.choice((4, 7, 99))
            body = some(rng.randrange(6)) + " " + "\n".join(" ".join(w[k : k + width]) for k in range(0, len(w), width)) + " " + some(rng.randrange(12))
        else:
            body = rng.choice(license_scan.OTHER) + " " + some(20) if i % 4 else " ".join(rng.sample(" ".join(t for ts in license_scan.TEMPLATES.values() for t in ts).split(), 25))
        rows.append((i, f"{some(30)}\n\n{body}\n\n{some(10)}", "en", "s", 0))
        want[i] = family
    model = license_scan.fit(frame(spark, corpus(10, 60)))
    got = {r.doc_id: (r.family, r.probability) for r in license_scan.scan(frame(spark, rows), model).collect()}
    named = [i for i in got if got[i][0]]
    right = [i for i in named if got[i][0] == want[i]]
    assert len(right) / len(named) >= 0.97, "precision"
    assert len(right) / sum(f is not None for f in want.values()) >= 0.85, "recall"
    assert abs(np.mean([got[i][1] for i in named]) - len(right) / len(named)) < 0.1, "calibration"
