"""The queries of the corpus operators: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import collocations, decontamination, html_text, jaccard_join, language_id, license_scan, media, mixing, nearest, resample, substring_dedup, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, license_scan.fit(docs))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = url_filter.Rule
    rules = [rule("com", "/", False), rule("example.com", "/en/", True), rule("www.example.com", "/en/", False), rule("net", "/es/", True), rule("net", "/fr/", True)]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on_folds(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_jaccard_join": op1_jaccard_join,
        "op2_license_scan": op2_license_scan,
        "op3_url_filters": op3_url_filters,
        "op4_nearest": op4_nearest,
        "op5_language_id": op5_language_id,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_html_text": op7_html_text,
        "op8_decontamination": op8_decontamination,
        "op9_mixing": op9_mixing,
        "op10_toxicity": op10_toxicity,
        "op11_collocations": op11_collocations,
        "op12_resample": op12_resample,
        "op13_media": op13_media,
    }


def oracle_sql() -> dict[str, str]:
    """What SQL can say and run on whole tables in good time; the tests hold the others against brute force."""
    return {"op9_mixing": mixing.ORACLE_SQL.format(documents="documents"), "op11_collocations": collocations.ORACLE_SQL, "op12_resample": resample.ORACLE_SQL}
