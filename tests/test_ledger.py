"""The ledger's operators: registered queries against their SQL, invariants, sources, sinks and restartable runs."""

import glob
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from dossier.operators import merge, pages, repair, report, resolve, sinks
from dossier.functions import names as N
from dossier.plans import assembly, documents, matching, names, queries, records  # noqa: F401  (they register their queries)
from dossier.sources import ledger as source
from dossier.streaming import incremental

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    def one(v):
        if v is None or isinstance(v, float) and v != v:
            return ""
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_is_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert plain([r.asDict() for r in got.collect()], sorted(columns)) == plain(want, sorted(columns))


@needs_tables
def test_queries_without_sql_run(spark):
    for name in set(queries.QUERIES) - set(queries.ORACLE):
        assert queries.QUERIES[name](spark, SF).count() >= 0


@needs_tables
def test_invariants(spark):
    ledger = source.synthetic(spark, SF).cache()
    once = report.first_rows(ledger, "file_name")
    assert report.first_rows(once, "file_name").count() == once.count()
    fixed = repair.fix_years(ledger)
    assert repair.fix_years(fixed.drop("changed")).where("changed").count() == 0
    long = report.summary(ledger).agg(F.sum("total")).first()[0]
    wide = report.summary_pivot(ledger).agg(F.sum("total")).first()[0]
    assert abs(long - wide) < 1


def test_packets_start_at_appendices_and_titles(spark):
    kinds = ["TITLE_PAGE", "TERMS_PAGE", "APPENDIX_PAGE", "APPENDIX_PAGE", "TITLE_PAGE"]
    rows = spark.createDataFrame([("d", i, k, f"{k} text") for i, k in enumerate(kinds)], "doc_id string, page_no int, page_type string, text string")
    got = pages.packet_rows(rows).orderBy("start_page").collect()
    assert [(r.packet_id, r.start_page, r.end_page) for r in got] == [("packet_000", 0, 1), ("packet_001", 2, 3), ("packet_002", 4, 4)]


def test_matches_and_ties(spark):
    names = spark.createDataFrame([(0, "alpha", "A"), (1, "alphabet", "B"), (2, "ab", "C"), (3, "alphabex", "D")], "pos long, name string, group_name string")
    texts = spark.createDataFrame([("xx alphabet alphabex",), ("ab",), ("zzz",), (None,)], "text string")
    got = {r.text: r.group_name for r in resolve.longest_match(texts, names).collect()}
    assert got == {"xx alphabet alphabex": "B", "ab": "C", "zzz": None, None: None}
    asked = spark.createDataFrame([("alph",), ("bet",)], "fragment string")
    assert {r.fragment: r.name for r in resolve.shortest_holding(asked, names).collect()} == {"alph": "alpha", "bet": "alphabet"}
    assert resolve.lcs_ratio("abc", "abd") == pytest.approx(200 * 2 / 6) and resolve.lcs_ratio("", "") == 100


def test_fuzzy_match_is_every_pair(spark):
    asked = ["Xupplier#0001", "上海 Acme Trading", "Acme Tradinq", "q", "", None, "zzzz", "Xcme Trading"]
    known = ["Supplier#0001", "Supplier#0002", "Acme Trading", "Beta", "q", "Acme Trading"]
    got = {r.name: (r.candidate, r.ratio) for r in resolve.fuzzy_match(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame(list(enumerate(known)), "pos long, name string")).collect()}
    assert got.keys() == set(asked)
    for a in asked:
        best = max(known, key=lambda b: resolve.lcs_ratio(a or "", b))
        ratio = resolve.lcs_ratio(a or "", best)
        assert got[a] == ((best, pytest.approx(ratio, abs=1e-6)) if ratio >= 80 else (None, None)), a
    assert got["Xupplier#0001"][0] == "Supplier#0001" and got["上海 Acme Trading"][0] == "Acme Trading"


def test_names_that_clash_and_passes(spark):
    rows = spark.createDataFrame([(1, "f", "a.pdf"), (2, "f", "a.pdf"), (3, "f", "b"), (4, "f", "b")], "pos long, folder string, file_name string")
    assert [r.target for r in repair.unique_names(rows).orderBy("pos").collect()] == ["a.pdf", "a_1.pdf", "b", "b_1"]
    every = ["a.pdf", "a.pdf", "a_1.pdf", "a.pdf", "a_1.pdf", "a_1_1.pdf", "c", "c", "c_2", "c", ".x", ".x", "a.pdf"]
    taken, want = set(), []
    for name in every:  # one after another, as a file system would
        stem, dot, ending = name.rpartition(".")
        stem, ending = (stem, dot + ending) if dot else (name, "")
        n, target = 0, name
        while target in taken:
            n += 1
            target = f"{stem}_{n}{ending}"
        taken.add(target)
        want.append(target)
    rows = spark.createDataFrame([(i, "f", x) for i, x in enumerate(every)] + [(99, "g", "a.pdf")], "pos long, folder string, file_name string")
    assert [r.target for r in repair.unique_names(rows).orderBy("pos").collect()] == [*want, "a.pdf"]
    rows = spark.createDataFrame([(1, "f", None), (2, "f", None), (3, None, "a.pdf"), (4, None, "a.pdf")], "pos long, folder string, file_name string")
    assert [r.target for r in repair.unique_names(rows).orderBy("pos").collect()] == [None, None, "a.pdf", "a_1.pdf"]
    table = spark.createDataFrame([(0, "ab", "short"), (1, "abc", "long"), (2, "xbc", "same")], "pos long, pattern string, target string")
    asked = spark.createDataFrame([("abc",), ("ab",), ("zabc xbc",), (None,)], "t string")
    assert {r.t: r.target for r in repair.rule_match(asked, "t", table).collect()} == {"abc": "long", "ab": "short", "zabc xbc": "long", None: None}
    a, b = (spark.createDataFrame(x, "key long, amount double") for x in ([(1, 5.0), (2, 6.0)], [(2, 7.0), (3, 8.0)]))
    assert sorted(map(tuple, merge.merge_passes(a, b).collect())) == [(1, 5.0, False), (2, 7.0, True), (3, 8.0, True)]


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"one")
    (folder / "deep/b.PDF").write_bytes(b"one")
    (folder / "c.txt").write_bytes(b"no")
    got = source.scan_files(spark, str(folder)).collect()
    assert sorted(r.file_name for r in got) == ["a.pdf", "b.PDF"] and len({r.file_md5 for r in got}) == 1
    assert source.scan_files(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(ValueError, match="group_name"):
        resolve.checked_mapping(spark.createDataFrame([(1, "a")], "pos long, name string"))
    lines = [json.dumps({"pos": 1, "file_name": "x.pdf", "doc_type": "SRF", "detected_group": "g/h", "contract_total_amount": 5.0}), "{broken"]
    (tmp_path / "ledger.jsonl").write_text("\n".join(lines))
    ledger = source.read_jsonl(spark, str(tmp_path / "ledger.jsonl"))
    assert ledger.count() == 1
    sinks.write_per_group(ledger, str(tmp_path / "groups"))
    assert os.path.isdir(tmp_path / "groups/sheet=g_h")
    sinks.write_audit(ledger, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 1
    pages_ = spark.createDataFrame([("m1",), ("m2",)], "file_md5 string")
    cached = spark.createDataFrame([("m1", "old")], "file_md5 string, text string")
    out = source.read_through(pages_, cached, lambda rest: rest.withColumn("text", F.lit("new")))
    assert sorted(map(tuple, out.collect())) == [("m1", "old"), ("m2", "new")]


def test_runs_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    for n in range(2):
        (tmp_path / f"in/{n}.json").write_text(json.dumps({"k": n}))
        incremental.process_new(spark, str(tmp_path / "in"), "k long", target, check, lambda rows: rows.withColumn("twice", F.col("k") * 2)).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(0, 0), (1, 2)]


def test_similar_names_lose_no_pair(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef（）()") for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    words = sorted({*words, "上海示例", "示例上海"})
    df = spark.createDataFrame([(w,) for w in [*words, None]], "name string")

    def similarity(a, b):
        a, b = (set(x.replace("（", "(").replace("）", ")")) for x in (a, b))
        return len(a & b) / len(a | b) if a and b else 0.0

    for least in (0.5, 0.8, 1.0):
        got = {(r.left, r.right) for r in resolve.similar_names(df, df, least).collect()}
        assert got == {(a, b) for a in words for b in words if a < b and round(similarity(a, b), 6) >= least}


def test_names_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("\u3000（）",)], "raw string")
    c = F.col("raw")
    got = df.select(N.normal_text(c).alias("a"), N.legacy_company(c).alias("b"), N.legacy_key(c).alias("c"), N.is_bad_candidate(c).alias("bad"), N.has_chinese(c).alias("chinese"), N.is_chinese_company(c).alias("firm"), N.cleaned_ocr(c).alias("ocr"), N.date_problem(c).alias("date")).collect()
    assert [r.a for r in got] == ["", "", "", "()"] and all(r.b == "" and r.bad and not r.chinese and not r.firm for r in got)
    assert got[0].ocr == "" and got[1].date == "empty" and got[2].date == "no date"
    text = spark.createDataFrame([("A\u030a  b",), ("甲 方 ( 乙 ) c",)], "raw string")
    assert [tuple(r) for r in text.select(N.normal_text(c), N.compact_cjk(c)).collect()] == [("\u00c5 b", "A\u030a  b"), ("甲 方 ( 乙 ) c", "甲方(乙) c")]
