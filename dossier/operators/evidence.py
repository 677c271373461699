"""Missing amounts looked for on pages, page by page, until each has evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C
from dossier.operators.assemble import _written


def targets(records: DataFrame, done: DataFrame | None = None, categories: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """The records (category, amount, key) of some categories whose amount is missing or 0, without those whose key stands in done (earlier results)."""
    some = records.where(F.col("category").isin(categories or rules.TARGETS) & C.filled(F.col("amount")).isNull())
    return some if done is None else some.join(done.select(key).distinct(), key, "left_anti")


def shown(amount: Column, evidence: Column) -> Column:
    """Whether the digits of an amount's whole part stand in its evidence, however they are grouped."""
    plain = F.regexp_replace(F.coalesce(evidence, F.lit("")), "[, .]", "")
    return F.coalesce(plain.contains(amount.cast("long").cast("string")), F.lit(False))


def by_page(wanted: DataFrame, pages: DataFrame, read: Callable[[DataFrame], DataFrame], max_pages: int = 3) -> DataFrame:
    """doc_id, amount, evidence, page (from 1), confidence and pages_read of each distinct doc_id of wanted.

    read() makes rows (doc_id, page_no, amount, evidence) of pages (doc_id, page_no from 0, ...), at a price; so only pages of targets without evidence are given to it, one page number a round,
    and each round's answer is stored. A round's targets are those that no earlier round had evidence for (shown()); when none is left, no page is read any more. Without evidence the first
    page's amount counts, with low confidence; without any, amount is null and page is max_pages. Several answers for a page count in order of evidence, amount and text. Null ids have no pages."""
    open_ = wanted.select("doc_id").distinct()
    every, rounds = open_, []
    for number in range(max_pages):
        if open_.isEmpty():
            break
        answers = read(pages.where(F.col("page_no") == number).join(open_, "doc_id", "left_semi"))
        got = _written(answers.select("doc_id", F.lit(number).alias("page_no"), F.col("amount").cast("double").alias("amount"), F.coalesce("evidence", F.lit("")).alias("evidence"), shown(F.col("amount"), F.col("evidence")).alias("sure")))
        rounds.append(got)
        open_ = open_.join(got.where("sure").select("doc_id"), "doc_id", "left_anti")
    none = every.select("doc_id", F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("boolean").alias("sure"))
    answers = none.where("false")
    for got in rounds:
        answers = answers.unionByName(got)
    answer = F.when(F.col("amount").isNotNull(), F.struct("amount", "evidence", "page_no", "sure"))
    best = F.min_by(answer, F.when(F.col("amount").isNotNull(), F.struct((~F.col("sure")).alias("a"), "page_no", "amount", "evidence")))
    per = answers.groupBy("doc_id").agg(best.alias("b"), F.count("page_no").alias("pages_read"))
    return every.join(per, "doc_id", "left").select(
        "doc_id", "b.amount", F.coalesce("b.evidence", F.lit("")).alias("evidence"), F.coalesce(F.col("b.page_no") + 1, F.lit(max_pages)).alias("page"),
        F.when(F.col("b.sure"), "high").otherwise("low").alias("confidence"), F.coalesce("pages_read", F.lit(0)).alias("pages_read"),
    )
