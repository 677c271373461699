"""Budgets in sliding windows and results kept by content, over batches, restarts and failures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dossier.functions import columns as C
from dossier.operators import assemble
from dossier.sources import cache
from dossier.streaming import budget


def requests(n=200):
    rng = random.Random(1)
    return [(rng.choice("ab"), i, 1000 + rng.randrange(300), rng.randrange(0, 40)) for i in range(n)] + [("c", 500, 1000, 250), ("c", 501, 1000, 1), ("c", 502, 1061, 0)]


def granted(spark, rows, limit=100):
    return budget.grants(spark.createDataFrame([(p, i, float(t), n) for p, i, t, n in rows], "provider string, id long, at double, tokens long"), limit, 60.0).collect()


def test_no_window_exceeds_the_budget(spark):
    rows = requests()
    got = granted(spark, [*rows, (None, 1, 5, 5), ("d", 2, 5, -1)])
    assert sorted((r.provider, r.id, r.at, r.tokens) for r in got) == sorted((p, i, float(t), n) for p, i, t, n in rows)
    for p in "abc":
        own = sorted((r for r in got if r.provider == p), key=lambda r: (r.at, r.id))
        for k, r in enumerate(own):
            held = [(x.granted, x.tokens) for x in own[:k]]
            used = lambda now: sum(n for t, n in held if now - 60 < t <= now)  # noqa: B023,E731
            assert r.granted >= r.at and r.wait == r.granted - r.at and (used(r.granted) + r.tokens <= 100 or used(r.granted) == 0 and r.tokens > 100)
            begin = max([r.at, *(t for t, _ in held[-1:])])
            tried = [x for x in {begin, *(t + 60 for t, _ in held)} if begin <= x < r.granted]
            assert all(used(x) + r.tokens > 100 for x in tried)  # not a moment later than it must be
    assert granted(spark, []) == []


def test_stream_grants_what_a_batch_does(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, rows = "provider string, id long, time timestamp, tokens long", requests(60)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def put(part):
        spark.createDataFrame([(p, i, dt.datetime.fromtimestamp(t, dt.timezone.utc), n) for p, i, t, n in part], schema).coalesce(1).write.mode("append").json(source)

    def run():
        stream = spark.readStream.schema(schema).json(source).withWatermark("time", "600 seconds")
        budget.grant_stream(stream, 100, 60.0).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    try:
        put(rows[:30])
        run()
        put([*rows[30:], ("z", 999, 9999, 1)])
        run()  # a restart, and the watermark passes all but the last
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect() if r.provider != "z") == sorted(tuple(r) for r in granted(spark, rows))


def test_results_are_kept_once_whatever_fails(spark, tmp_path):
    path, source, checkpoint, schema = str(tmp_path / "cache"), str(tmp_path / "in"), str(tmp_path / "checkpoint"), "file_md5 string, pos long, result string"
    worked = spark.sparkContext.accumulator(0)
    assert cache.cached(spark, path, schema).count() == 0

    def work(fail):
        def result(md5):
            worked.add(1)
            if fail and md5 == fail:
                raise ValueError("broken document")
            return f"r-{md5}"

        return lambda df: df.withColumn("result", F.udf(result)("file_md5"))

    def put(rows):
        spark.createDataFrame(rows, "file_md5 string, pos long").coalesce(1).write.mode("append").json(source)

    def run(fail=None):
        cache.fill(spark.readStream.schema("file_md5 string, pos long").json(source), path, checkpoint, work(fail), schema).awaitTermination()

    put([("a", 2), ("a", 1), ("b", 3), (None, 4)])
    run()
    assert sorted(tuple(r) for r in cache.cached(spark, path, schema).collect()) == [("a", 1, "r-a"), ("b", 3, "r-b")]
    put([("a", 9), ("c", 5), ("d", 6)])
    with pytest.raises(Exception, match="broken document"):
        run("d")
    assert cache.cached(spark, path, schema).count() == 2
    before = worked.value
    run()
    want = [("a", 1, "r-a"), ("b", 3, "r-b"), ("c", 5, "r-c"), ("d", 6, "r-d")]
    assert sorted(tuple(r) for r in cache.cached(spark, path, schema).collect()) == want and worked.value == before + 2  # what was done isn't done again
    batch = spark.createDataFrame([("a", 9), ("c", 5), ("d", 6)], "file_md5 string, pos long")
    cache.upsert(batch, path, 1, work(None), schema)  # the same batch once more
    assert sorted(tuple(r) for r in cache.cached(spark, path, schema).collect()) == want


def test_first_valid_amount_and_flags(spark):
    rows = [(1, "contract_total_amount", "2019", ["x", "0", "12000", "700"]), (2, "contract_total_amount", "nil", ["12000"]), (3, "tax_rate", ".06", None), (4, "contract_total_amount", "0", []), (5, "sign_date", "2021年3月5日", None), (5, "is_primary_doc", "False", None), (6, "other", "x", None)]
    got = {r.doc_id: r for r in assemble.results(spark.createDataFrame(rows, "doc_id long, field string, value string, alternatives array<string>")).collect()}
    assert got[1].contract_total_amount == 12000 and got[1].flags == ["amount_invalid:contract_total_amount:looks like a year"] and got[1].refused[-1].endswith("not positive")
    assert got[2].contract_total_amount is None and got[2].flags == [] and got[3].tax_rate == "6%" and got[4].contract_total_amount is None and len(got[4].flags) == 1
    assert got[5].sign_date == "2021-03-05" and not got[5].is_primary_doc and got[6].is_primary_doc and got[6].currency == "CNY"
    assert assemble.results(spark.createDataFrame([], "doc_id long, field string, value string, alternatives array<string>")).count() == 0


def test_documents_are_put_together_without_sending_them_to_all_tasks(spark):
    pages = spark.createDataFrame([(1, "a.pdf", 1, "x" * 60), (1, "a.pdf", 0, None), (1, "a.pdf", 2, "y" * 120), (2, "b.pdf", 0, "thin"), (3, None, 0, None), (None, "c.pdf", 0, "z" * 90)], "doc_id long, file_name string, page_no int, text string")
    scans = spark.createDataFrame([(1, 0, "unread"), (2, 1, "late"), (2, 0, "early"), (4, 0, "no pages")], "doc_id long, page_no int, text string")
    docs = assemble.documents(pages, scans)
    got = {r.doc_id: (r.file_name, r.page_count, r.has_text_layer, r.text) for r in docs.collect()}
    assert got == {1: ("a.pdf", 3, True, "\n" + "x" * 60 + "\n" + "y" * 120), 2: ("b.pdf", 1, False, "early\nlate"), 3: (None, 1, False, None)}
    assert "Join" not in docs._jdf.queryExecution().toString()  # pages of small files were broadcast with their texts


def test_amounts_that_are_not_dotted_are_not_cast_as_empty_texts(spark):
    rows = spark.createDataFrame([("12000",), ("1.234",), ("123.45",), ("abc",), ("",), (None,), ("3万",), ("l2",), ("0.499",)], "x string").select("x", C.normalize_amount(F.col("x")).alias("v"))
    assert {r.x: r.v for r in rows.collect()} == {"12000": 12000.0, "1.234": 1234.0, "123.45": 123.45, "abc": None, "": None, None: None, "3万": 30000.0, "l2": 2.0, "0.499": 0.499}
    assert "cast(concat(" not in rows._jdf.queryExecution().analyzed().toString()  # a failed cast throws
