"""Pages of documents: what each page is, where packets start, and what a packet holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C


def page_type(text: Column, page_no: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: C.has_any(low, words, lower=True)
    n_words = F.regexp_count(low, F.lit(r"\S+"))
    return C.first_of([
        ((page_no == 0) & any_of(rules.TITLE_WORDS), "TITLE_PAGE"), (any_of(rules.SIGNATURE_WORDS), "SIGNATURE_PAGE"), (any_of(rules.ACCEPTANCE_WORDS), "ACCEPTANCE_PAGE"),
        ((page_no > 0) & any_of(rules.APPENDIX_WORDS), "APPENDIX_PAGE"), (any_of(rules.AMOUNT_WORDS), "AMOUNT_PAGE"), (any_of(rules.TABLE_WORDS), "TABLE_PAGE"), (n_words > 100, "TERMS_PAGE"),
    ], "UNKNOWN")


def packets(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, page_type) with packet, counted from 0: a title after another page or an appendix after text starts one."""
    w = W.partitionBy("doc_id").orderBy("page_no")
    kind, before = F.col("page_type"), F.lag("page_type").over(w)
    starts = ((kind == "TITLE_PAGE") & (before != "TITLE_PAGE")) | ((kind == "APPENDIX_PAGE") & ~before.isin("APPENDIX_PAGE", "TITLE_PAGE"))
    return pages.withColumn("packet", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def header_type(text: Column) -> Column:
    return C.first_of([(text.rlike(f"(?i){p}"), t) for p, t in rules.HEADERS], "UNKNOWN")


def packet_rows(pages: DataFrame) -> DataFrame:
    """One row a packet: its id, first and last page, type of its first page, document type by its first 2,000 characters, and title."""
    g = packets(pages).groupBy("doc_id", "packet").agg(
        F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page"), F.min_by("page_type", "page_no").alias("packet_type"),
        F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("texts"),
    )
    whole = F.array_join(F.transform("texts", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    lines = F.transform(F.slice(F.split(F.trim(F.coalesce(F.col("texts")[0]["text"], F.lit(""))), "\n"), 1, 5), lambda x: F.trim(x))
    title = F.substring(F.array_join(F.filter(lines, lambda x: x != ""), " "), 1, 200)
    return g.select("doc_id", F.format_string("packet_%03d", "packet").alias("packet_id"), "start_page", "end_page", "packet_type", header_type(F.substring(whole, 1, 2000)).alias("doc_type"), title.alias("title_hint"))


def text_layer(pages: DataFrame, least: float = 50) -> DataFrame:
    """Pages and whether a document has a text layer: so many characters a page on average."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars")).withColumn("has_text_layer", F.col("n_chars") / F.col("n_pages") >= least)


def leading_text(pages: DataFrame, n: int = 3) -> DataFrame:
    """The first n pages' texts, joined by newlines."""
    few = pages.where(F.col("page_no") < n).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return few.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _holds(low: Column, word: str) -> Column:
    if len(word) <= 3 and word.isascii() and word.isupper():
        return low.contains(word.lower()) & F.rlike(low, F.lit(f"(?:^|[^0-9a-z_]){word.lower()}(?:$|[^0-9a-z_])"))
    return low.contains(word.lower())


def detect_doc_type(text: Column, file_name: Column) -> Column:
    """By the first 15 lines, types in order; else by most keywords, the first type on ties; else by file name; else UNKNOWN."""
    def any_of(low):
        return C.first_of([(reduce(lambda a, b: a | b, [_holds(low, w) for w in words]), t) for t, words in rules.TYPE_WORDS])

    def most(low):
        scores = F.array(*[reduce(lambda a, b: a + b, [_holds(low, w).cast("int") for w in words]) for _, words in rules.TYPE_WORDS])
        return _let(scores, lambda s: F.when(F.array_max(s) > 0, F.element_at(F.array(*[F.lit(t) for t, _ in rules.TYPE_WORDS]), F.array_position(s, F.array_max(s)).cast("int"))))

    whole = F.lower(F.coalesce(text, F.lit("")))
    head = F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 15), "\n")
    return F.coalesce(_let(F.lower(head), any_of), _let(whole, most), _let(F.lower(F.coalesce(file_name, F.lit(""))), any_of), F.lit("UNKNOWN"))
