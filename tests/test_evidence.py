"""Dates by position, amounts on pages, and reports in folders."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from dossier.operators import candidates, evidence
from dossier.sources import reports


def dates_of(spark, *texts):
    rows = candidates.dates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), 2030).collect()
    return sorted((r.doc_id, r.line_no, r.value, r.label, r.score) for r in rows)


def test_dates_of_all_forms_and_over_two_lines(spark):
    texts = ["签订于2015年11\n 月11日", "日期 21.3.5", "no word 21.3.5", "on 2/09/14 issued", "x2/09/14 issued", "生效 202l.1. 8", "2021-13-40 then 2021/3/5", None, "", "2035-01-01 and 1989-01-01", "签字\n\n\n2020.1.2", "2020-01-02 2020.1.2"]
    assert dates_of(spark, *texts) == [
        (0, 0, "2015-11-11", "sign_date", 0.85), (1, 0, "2021-03-05", "date_generic", 0.7), (3, 0, "2014-02-09", "date_generic", 0.7), (5, 0, "2021-01-08", "effective_date", 0.55), (6, 0, "2021-03-05", "date_generic", 0.7),
        (10, 2, "2020-01-02", "sign_date", 0.85), (10, 3, "2020-01-02", "date_generic", 0.7), (11, 0, "2020-01-02", "date_generic", 0.7),
    ]
    assert all(date.fromisoformat(r[2]) for r in dates_of(spark, "日期 " + "21.3.5 " * 2000))
    assert dates_of(spark) == []


def test_amounts_near_a_bare_unit(spark):
    texts = spark.createDataFrame([(0, "it is 5000 元 in all, says the paper"), (1, "it is 5000 in all, says the paper"), (2, None)], "doc_id int, text string")
    assert {r.doc_id: r.score for r in candidates.amounts(texts).collect()} == {0: 0.8, 1: 0.6}


def test_pages_are_read_until_there_is_evidence(spark):
    rng = random.Random(3)
    pages = [(doc, page, rng.choice([None, 0.0, 1234.0, 50000.0]), rng.choice([None, "", "1,234 元", "total 50 000", "0"]), "x") for doc in range(60) for page in range(rng.randrange(0, 6))]
    wanted = [*range(50), 7, 7, None, 99]
    frame = spark.createDataFrame(pages, "doc_id long, page_no int, amount double, evidence string, sure string")
    seen = []

    def read(df):
        seen.append(df.count())
        return df

    got = {r.doc_id: tuple(r)[1:] for r in evidence.by_page(spark.createDataFrame([(i,) for i in wanted], "doc_id long"), frame, read).collect()}
    want, cost = {}, 0
    for doc in {*wanted}:
        best, n = None, 0
        for _, page, amount, text, _ in [p for p in pages if p[0] == doc and p[1] < 3]:
            n += 1
            sure = amount is not None and str(int(amount)) in (text or "").replace(",", "").replace(" ", "").replace(".", "")
            if amount is not None and (sure or best is None):
                best = (amount, text or "", page + 1, "high" if sure else "low")
            if sure:
                break
        cost += n
        want[doc] = (*(best or (None, "", 3, "low")), n)
    assert got == want and sum(seen) == cost < sum(p[1] < 3 and p[0] < 50 for p in pages)
    sure = spark.createDataFrame([(1, 0, 500.0, "500"), (1, 1, 600.0, "600")], "doc_id long, page_no int, amount double, evidence string")
    seen.clear()
    assert evidence.by_page(spark.createDataFrame([(1,)], "doc_id long"), sure, read).collect()[0].pages_read == 1 and len(seen) == 1
    assert evidence.by_page(spark.createDataFrame([], "doc_id long"), sure, read).count() == 0


def test_targets(spark):
    rows = spark.createDataFrame([(1, "SRF", None), (2, "SRF", 0.0), (3, "SRF", 5.0), (4, "项目合同", None), (5, None, None), (6, "采购合同", None)], "doc_id int, category string, amount double")
    assert {r.doc_id for r in evidence.targets(rows).collect()} == {1, 2, 6}
    assert {r.doc_id for r in evidence.targets(rows, rows.where("doc_id = 1")).collect()} == {2, 6}


def test_reports_in_folders_are_read_back(spark, tmp_path):
    base = str(tmp_path / "out")
    groups = ["A b", "上海 集团", "a+b", "x%y", "k=v"]
    rows = spark.createDataFrame([(g, i, float(i)) for i, g in enumerate(groups)], "group_name string, year int, amount double")
    reports.write(rows, base)
    reports.write(rows.select("group_name", "year", F.lit("only here").alias("note"), F.lit("no").alias("file")), base)
    plain = tmp_path / "out" / "plain"
    plain.mkdir()
    (plain / "one.json").write_text('{"year": 7, "group_name": "other"}\nnot a row\n')
    (plain / "notes.txt").write_text("nothing")
    read, rejected = reports.read(spark, base)
    assert sorted(read.columns) == ["amount", "file", "group_name", "note", "year"]
    assert sorted((r.group_name, r.year, r.amount, r.note) for r in read.where("note is null and amount is not null").collect()) == sorted((g, i, float(i), None) for i, g in enumerate(groups))
    assert sorted(r.group_name for r in read.where("note = 'only here'").collect()) == sorted(groups)
    assert [(r.group_name, r.year) for r in read.where("amount is null and note is null").collect()] == [("plain", 7)]
    assert [(r.group_name, r.line, r.file.endswith("plain/one.json")) for r in rejected.collect()] == [("plain", "not a row", True)]


def test_reports_of_many_folders_are_listed_and_opened_once(spark, tmp_path):
    base = str(tmp_path / "many")
    rows = spark.range(600).select(F.concat(F.lit("g"), (F.col("id") % 300).cast("string")).alias("group_name"), "id", (F.col("id") / 4).alias("amount"))
    reports.write(rows, base)
    assert sum(p.is_dir() for p in (tmp_path / "many").iterdir()) == 300
    spark.sparkContext.setJobGroup("many", "")
    tracker = spark.sparkContext.statusTracker()
    read, rejected = reports.read(spark, base)
    assert sorted(tuple(r) for r in read.select("group_name", "id", "amount").collect()) == sorted((f"g{i % 300}", i, i / 4) for i in range(600)) and rejected.count() == 0
    stages = {s for j in tracker.getJobIdsForGroup("many") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < sum(i.numTasks for i in map(tracker.getStageInfo, stages) if i) < 300  # a task a file lists them before


def test_folders_have_the_names_that_spark_gives(spark, tmp_path):
    groups = ["A b", "上海 集团", "a+b", "x%y", "k=v", "q\"#'*/:?\\{[]^}", "t\tn\nz", "", None, "_u", ".d", "é~!$&();,<>|@"]
    rows = spark.createDataFrame([(g, i, None if i % 2 else "line \n\"x\"") for i, g in enumerate(groups)], "group_name string, n int, t string")
    own, plain = str(tmp_path / "a b+c" / "own"), str(tmp_path / "plain")
    reports.write(rows, f"file:{own}")
    rows.write.partitionBy("group_name").json(plain)
    found = lambda d: sorted((p.parent.name, p.read_text(encoding="utf-8")) for p in (tmp_path / d).glob("*/part*.json"))
    merged = lambda d: {k: sorted(x for f, t in found(d) if f == k for x in t.split("\n")) for k, _ in found(d)}
    assert {k: [x for x in v if x] for k, v in merged("a b+c/own").items()} == {k: [x for x in v if x] for k, v in merged("plain").items()}
    read, _ = reports.read(spark, own)
    assert sorted((r.group_name, r.n) for r in read.collect()) == sorted((g or "__HIVE_DEFAULT_PARTITION__", i) for i, g in enumerate(groups))


def test_only_files_of_group_folders_are_reports(spark, tmp_path):
    for place, text in {"g/a.json": '{"v": 1}', "_h/a.json": '{"v": 2}', "stray.json": '{"v": 3}', "g/m=1/a.json": '{"v": 4}', "g/a.txt": '{"v": 5}', "g/.b.json": '{"v": 6}'}.items():
        (tmp_path / "in" / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / place).write_text(text + "\n")
    read, _ = reports.read(spark, str(tmp_path / "in") + "/")
    assert sorted((r.group_name, r.v) for r in read.collect()) == [("_h", 2), ("g", 1)]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.range(400).select(F.when(F.col("id") == 399, F.repeat(F.lit("x"), 300)).otherwise(F.concat(F.lit("g"), "id")).alias("group_name"), "id")
    with pytest.raises(Exception, match="Task failed|too long"):
        reports.write(rows, str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]
