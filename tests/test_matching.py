"""Dictionaries in texts, fragments and fuzzy names against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.operators import companies, dictionary, repair, resolve
from dossier.plans import queries


def test_a_second_query_of_a_name_is_refused():
    with pytest.raises(ValueError, match="already"):

        @queries.query()
        def summary_pivot(spark, d):
            return None


def edge(text, at):
    inside = lambda i: 0 <= i < len(text) and re.match(r"\w", text[i]) is not None
    return inside(at - 1) != inside(at)


def longest(text, patterns, edges):
    fits = []
    for key, place in patterns:
        at = (text or "").find(key) if key else -1
        while at >= 0:
            if not (edges and key.isascii()) or (edge(text, at) and edge(text, at + len(key))):
                fits.append((-len(key), place, key))
            at = text.find(key, at + 1)
    return min(fits)[2] if fits else None


@pytest.mark.parametrize("most", [1 << 20, 24])
@pytest.mark.parametrize("edges", [False, True])
def test_longest_keys_are_brute_force(spark, most, edges):
    rng = random.Random(most)
    word = lambda k, letters: "".join(rng.choice(letters) for _ in range(k))
    patterns = [(word(rng.randrange(1, 5), "ab上_-"), [rng.randrange(3), rng.randrange(9)]) for _ in range(40)] + [("", [0, 0]), ("a", [9, 9]), ("a", [1, 1]), ("naïve", [0, 1])]
    texts = [word(rng.randrange(0, 14), "ab上下_- ") for _ in range(60)] + [None, "", "a", "naïve", "a " * 3000 + "ab上b"]
    got = {r.text: r.key for r in dictionary.longest_keys(spark.createDataFrame([(t,) for t in texts * 2], "text string"), spark.createDataFrame(patterns, "key string, place array<long>"), edges, most).collect()}
    first = {}
    for key, place in patterns:
        first[key] = min(place, first.get(key, place))
    want = {t: longest(t, list(first.items()), edges) for t in texts if t}
    assert got == {t: k for t, k in want.items() if k is not None} and got


MAPPING = [
    (1, "派克流体机械(无锡)有限公司", "PARKER", "Parker"), (2, "派克流体控制有限公司", "PARKER", ""), (3, "派克流体传动（上海）有限公司-legris", "PARKER", "parker"), (4, "上海示例制冷有限公司", "示例", "AB"),
    (5, "上海示例制冷有限公司", "SECOND", "AB"), (6, "", "NONE", "x"), (7, None, "NONE", None), (8, "nan", "N", ""), (9, "示例空调设备有限公司(685)", "示例", None),
]


def test_cascade_with_keywords(spark):
    mapping = spark.createDataFrame(MAPPING, "pos long, name string, group_name string, short_name string")
    names = ["派克流体机械(无锡)有限公司", "北京派克流体工业公司", "上海示例制冷有限公司", "AB", "示例空调设备有限公司", "a Parker b", "something", None, "", "青岛派克流体控制有限公司"]
    got = {r.name: r.group_name for r in dictionary.map_to_group(spark.createDataFrame([(x,) for x in names], "name string"), mapping).collect()}
    assert got == {names[0]: "PARKER", names[1]: None, names[2]: "SECOND", "AB": "SECOND", names[4]: "示例", "a Parker b": "PARKER", "something": None, None: None, "": None, names[9]: "PARKER"}
    least = dictionary.keyword_rows(mapping, low=4, high=6)
    assert {(r.key, r.group_name) for r in least.collect()} == {("parker", "PARKER"), ("second", "SECOND"), ("派克流体", "PARKER")}  # a group's name of two characters is no keyword
    assert dictionary.map_to_group(spark.createDataFrame([(names[1],)], "name string"), mapping, least).first().group_name == "PARKER"
    files = spark.createDataFrame([("合同_派克流体机械（无锡）有限公司.pdf",), ("PARKER-1.pdf",), ("xparker.pdf",), ("parker合同.pdf",), ("x派克流体y.pdf",), (None,)], "file_name string")
    got = {r.file_name: r.group_name for r in dictionary.map_by_file(files, dictionary.known_names(mapping), least).collect()}
    assert list(got.values()).count("PARKER") == 3 and got["xparker.pdf"] is None and got["parker合同.pdf"] is None and got[None] is None
    empty = mapping.limit(0)
    assert dictionary.map_to_group(names := spark.createDataFrame([("a",)], "name string"), empty).first().group_name is None
    assert dictionary.map_to_group(names.limit(0), mapping).count() == 0


def test_fragments_are_brute_force(spark):
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("甲乙丙丁aB") for _ in range(rng.randrange(1, 5)))
    names = [(i, part() + rng.choice(["", "(", "（"]) + part() + rng.choice(["", ")", "）"]) + part()) for i in range(150)] + [(500, None), (501, "甲乙"), (502, "甲乙丙丁aB"), (503, "甲乙丙丁ab")]
    asked = [part() + rng.choice(["", "(", "（"]) + part() + rng.choice(["", ")", "）"]) for _ in range(120)] + [None, "", "((((", "甲乙丙丁", "乙(甲)丙", "q(甲)丙丁"]
    low = lambda x: x.replace("（", "(").replace("）", ")").lower()
    want = {}
    for f in asked:
        best = None
        if f and len(f) >= 4:
            tokens = [t.strip() for t in re.split("[()]", low(f)) if t.strip()]
            fits = [(len(n), -i, n) for i, n in names if n and len(n) >= 4 and (low(f) in low(n) or (len(tokens) >= 2 and all(t in low(n) for t in tokens)))]
            best = min(fits)[2] if fits else None
        want[f] = best
    got = {r.fragment: r.name for r in dictionary.by_fragment(spark.createDataFrame([(f,) for f in asked], "fragment string"), spark.createDataFrame(names, "pos long, name string")).collect()}
    assert got == want and any(want.values())


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_ratio_is_the_plain_one():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        assert resolve.lcs_ratio(a, b) == (200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100)


@pytest.mark.parametrize("threshold", [20.0, 55.0, 80.0, 92.0, 100.0])
def test_fuzzy_pairs_are_every_pair(spark, threshold):
    rng = random.Random(int(threshold))
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(0, 16))) for _ in range(40)]
    edit = lambda s: "".join(c for c in s if rng.random() > 0.1) + rng.choice(["", "x", "ab"])
    left, right = [*map(edit, base), "", None, "q"], [*base, *map(edit, base), "", None]
    cands = spark.createDataFrame([(i, c, f"g{i % 7}") for i, c in enumerate(right)], "pos long, name string, group_name string")
    asked = spark.createDataFrame([(a,) for a in left], "name string")
    pairs = {(r.name, r.candidate) for r in resolve.may_match(asked, cands, threshold).collect()}
    ratio = lambda a, b: 200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
    assert {(a, b) for a in left for b in right if a is not None and b is not None and ratio(a, b) >= threshold} <= pairs
    got = {r.name: (r.group_name, r.ratio) for r in resolve.fuzzy_group(asked, cands, threshold).collect()}
    for a in left:
        best = max(((ratio(a, b), -i) for i, b in enumerate(right) if a is not None and b is not None), default=(0, 0))
        assert got[a] == ((f"g{-best[1] % 7}", pytest.approx(best[0], abs=1e-6)) if best[0] >= threshold else (None, None)), a


def test_names_of_one_start_and_length_hardly_meet(spark):
    known = spark.range(1, 2001).select(F.col("id").alias("pos"), F.format_string("Supplier#%09d", "id").alias("name"))
    asked = known.select(F.concat("name", F.lit("x")).alias("name"))
    assert resolve.may_match(asked, known, resolve.CLOSE).count() < 2000 * 2000 // 100
    assert resolve.contained(asked.select(F.col("name").alias("text")), known.where("pos = 7")).count() == 1
    with pytest.raises(ValueError, match="over 0"):
        resolve.may_match(asked, known, 0)


def _below_generate(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [plan[i:] for i in range(len(plan)) if plan.startswith("Generate", i)]


def test_equal_rows_are_cut_up_once(spark):
    """One task sorted the n-grams of all rows of a small file."""
    rows = spark.createDataFrame([(i, f"东方重工机械{'甲乙'[i % 2]}有限公司", "G", "东方重工机") for i in range(40)] + [(50, "东方重工机械甲有限公司", "H", None)], "pos long, name string, group_name string, short_name string")
    got = resolve.keywords(rows, 5, 5, 3)
    assert {(r.keyword, r.group_name, r.n) for r in got.collect()} == {(k, "G", 20) for k in ("重工机械乙", "工机械乙有", "机械乙有限", "械乙有限公", "乙有限公司")}
    words = dictionary.keyword_rows(rows, 5, 5, 3)
    assert {(r.key, r.group_name, tuple(r.place)) for r in words.collect()} == {("重工机械乙", "G", (2, 0, 1, 0, 5, 3))}
    known = {r.key: (r.group_name, tuple(r.place)) for r in dictionary.known_names(rows).collect()}
    assert known["东方重工机械甲有限公司"] == ("H", (0, 0)) and known["东方重工机械乙有限公司"] == ("G", (1, 0))
    for df in (got, words, dictionary.known_names(rows)):
        found = _below_generate(df)
        assert found and all("Aggregate" in x for x in found[-1:])


def test_rules_meet_texts_without_a_join_on_what_all_texts_hold(spark):
    texts = spark.createDataFrame([(f"合同_{i}",) for i in range(9)] + [("合同书",), (None,)], "t string")
    table = spark.createDataFrame([(0, "合同", "a"), (1, "_", "b"), (2, "合同_8", "c"), (3, "合同", "d")], "pos long, pattern string, target string")
    got = repair.rule_match(texts, "t", table)
    assert {r.t: r.target for r in got.collect()} == {**{f"合同_{i}": "a" for i in range(8)}, "合同_8": "c", "合同书": "a", None: None}
    assert not _below_generate(got)


def test_classes_of_similar_names_stand_for_all_pairs(spark):
    """All pairs of names with the same characters grow with the square of a class."""
    names = [f"Supplier#{i:09d}" for i in range(300)] + ["甲（乙）", "甲(乙)", "", None, "x"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [tuple(r) for r in resolve.similar_classes(df, 0.8).collect()]
    head = {right: left for left, right, s in got if s == 1.0}
    classes = {}
    for n in filter(None, names):
        classes.setdefault(head.get(n, n), []).append(n)
    pairs = {(min(a, b), max(a, b)): 1.0 for c in classes.values() for a in c for b in c if a != b}
    pairs |= {(min(a, b), max(a, b)): s for left, right, s in got if s < 1.0 for a in classes[left] for b in classes[right]}
    want = {(r.left, r.right): r.similarity for r in resolve.similar_names(df, df, 0.8).collect()}
    assert pairs == want and len(got) < len(want) / 10


def test_companies_of_equal_documents_and_aliases(spark):
    """Every document met every alias of a key, so that rows grew with documents times aliases."""
    aliases = spark.createDataFrame([(i, f"Standard {9 - i}", "东方1厂") for i in range(9)] + [(20, "S", "北方重工")], "pos long, standard string, alias string")
    rows = [(i, "文本 东方1厂 内", "scan.pdf") for i in range(5)] + [(7, None, None), (8, "北方重工 和 东方1厂", None), (9, "", "北方重工.pdf")]
    docs = spark.createDataFrame(rows, "id long, text string, file_name string")
    got = {r.id: (r.company, r.alias, r.score) for r in companies.find(docs, aliases).collect()}
    assert got == {**{i: ("Standard 9", "东方1厂", 72) for i in range(5)}, 7: ("", "", 0), 8: ("Standard 9", "东方1厂", 72), 9: ("S", "北方重工", 95)}
    assert {r.id: r.score for r in companies.find_for_group(docs, aliases).collect()} == {**dict.fromkeys(range(5), 70), 7: 0, 8: 70, 9: 95}
    assert companies._firsts(aliases).count() == 2


def test_older_matching_sends_nothing_whole_to_all_tasks(spark):
    mapping = spark.createDataFrame([(1, "大华制造厂", "甲组一二", ""), (2, "东方贸易公司", "乙组", "东方短名"), (3, "大华制造厂二部", "丙组", None), (4, "xy", "丁组三四", "xy")], "pos long, name string, group_name string, short_name string")
    names = spark.createDataFrame([("大华制造厂",), ("我们的东方贸易公司",), ("大华制造",), ("东方短名",), ("甲组",), ("xy",), ("无关名字",), ("",)], "name string")
    got = companies.legacy_group(names, mapping)
    assert {r.name: r.group_name for r in got.collect()} == {"大华制造厂": "甲组一二", "我们的东方贸易公司": "乙组", "大华制造": "甲组一二", "东方短名": "乙组", "甲组": "甲组一二", "xy": "丁组三四", "无关名字": None, "": None}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
