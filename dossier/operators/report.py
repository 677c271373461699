"""Reporting: which records of a ledger count, under which category, year and amount, and their sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C


def first_rows(df: DataFrame, *keys: str, order: str = "pos", last: bool = False) -> DataFrame:
    """One row a key: the first by order, or the last."""
    by = F.col(order).desc() if last else F.col(order).asc()
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(by))).where("__n = 1").drop("__n")


def category(file_name: Column, doc_type: Column) -> Column:
    return C.first_of([
        (C.has_any(file_name, rules.UPGRADE), "升级合同"),
        (C.has_any(file_name, rules.PURCHASE), "采购合同"),
        (C.has_any(file_name, rules.PROJECT), "项目合同"),
        (doc_type == "SRF", "SRF"),
        ((doc_type == "CONTRACT") & C.has_any(file_name, rules.MAINTENANCE), "维护合同"),
    ])


def best_amount() -> Column:
    return F.coalesce(*[C.filled(F.col(c)) for c, _ in rules.AMOUNTS])


def amount_source() -> Column:
    return C.first_of([(C.filled(F.col(c)).isNotNull(), label) for c, label in rules.AMOUNTS], "")


def inferred_year(year: Column, file_name: Column) -> Column:
    return F.coalesce(C.filled(year), C.group(file_name, "(20[0-9]{2})").try_cast("int"))


def service_period(start: Column, end: Column) -> Column:
    a, b = C.blank(start), C.blank(end)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" ~ "), b)).when(a.isNotNull(), F.concat(a, F.lit(" ~"))).when(b.isNotNull(), F.concat(F.lit("~ "), b)).otherwise("")


def typed(ledger: DataFrame) -> DataFrame:
    """The records that count: first of each file name, then without dropped types; with category, amount and year."""
    kept = first_rows(ledger, "file_name").where(~F.coalesce("doc_type", F.lit("UNKNOWN")).isin(rules.DROPPED_TYPES))
    return kept.withColumns({"category": category(F.col("file_name"), F.col("doc_type")), "amount": best_amount(), "amount_source": amount_source(), "year": inferred_year(F.col("report_year"), F.col("file_name"))})


def report_rows(ledger: DataFrame) -> DataFrame:
    """The report's projection, for all groups at once."""
    rows = typed(ledger).where(F.col("category").isNotNull())
    return rows.select(
        F.col("detected_group").alias("group_name"), F.coalesce("year", F.lit(0)).alias("year"), "category", F.coalesce(C.blank(F.col("detected_company")), F.lit("")).alias("company"), "amount", "amount_source",
        service_period(F.col("service_period_start"), F.col("service_period_end")).alias("service_period"), F.coalesce(C.version_of(F.col("file_name")), F.lit("")).alias("version"),
        F.concat(F.lit("/"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("/"), F.col("file_name")).alias("path"),
    )


def groups(ledger: DataFrame) -> DataFrame:
    return typed(ledger).select(F.col("detected_group").alias("group_name")).where(F.col("group_name").isNotNull() & ~F.col("group_name").isin(rules.SKIPPED_GROUPS)).distinct()


def summary(ledger: DataFrame) -> DataFrame:
    """Number and sum of amounts by group, year (0: unknown) and category."""
    rows = report_rows(ledger).where(F.col("amount").isNotNull() & ~F.col("group_name").isin(rules.SKIPPED_GROUPS))
    return rows.groupBy("group_name", "year", "category").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


def summary_pivot(ledger: DataFrame) -> DataFrame:
    """A row for each group and year, two columns for each category, and the total of all."""
    rows = report_rows(ledger).where(F.col("amount").isNotNull() & ~F.col("group_name").isin(rules.SKIPPED_GROUPS))
    wide = rows.groupBy("group_name", "year").pivot("category", rules.CATEGORIES).agg(F.count("amount").alias("n"), F.sum("amount").alias("sum"))
    named = {f"n_{i}": F.coalesce(F.col(f"`{c}_n`"), F.lit(0)) for i, c in enumerate(rules.CATEGORIES)} | {f"sum_{i}": F.round(F.col(f"`{c}_sum`"), 2) for i, c in enumerate(rules.CATEGORIES)}
    total = sum((F.coalesce(F.col(f"`{c}_sum`"), F.lit(0.0)) for c in rules.CATEGORIES), F.lit(0.0))
    return wide.select("group_name", "year", *[v.alias(k) for k, v in named.items()], F.round(total, 2).alias("total"))


def group_stats(ledger: DataFrame) -> DataFrame:
    """Rows, rows with an amount, and distinct companies of each group."""
    return report_rows(ledger).groupBy("group_name").agg(F.count("*").alias("n"), F.count("amount").alias("n_amount"), F.count_distinct("company").alias("n_company"))


def type_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.coalesce(C.blank(F.col("doc_type")), F.lit("UNKNOWN")).alias("doc_type")).agg(F.count("*").alias("n"))


def unmapped(ledger: DataFrame) -> DataFrame:
    """Groups that are named like one of their companies, with their size."""
    own = F.bool_or(F.col("detected_group") == F.col("detected_company")).alias("own")
    return ledger.groupBy("detected_group").agg(F.count("*").alias("n"), own).where("own").select(F.col("detected_group").alias("group_name"), "n")


def group_sizes(ledger: DataFrame) -> DataFrame:
    """How many groups have each number of records."""
    return ledger.groupBy("detected_group").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def ordered(rows: DataFrame) -> DataFrame:
    """Report rows as a reader gets them: by year (unknown first), category, company."""
    return rows.orderBy(F.coalesce("year", F.lit(0)), "category", F.coalesce("company", F.lit("")), "path")


def places(rows: DataFrame) -> DataFrame:
    """Report rows with their place among their group's, in that order."""
    order = [F.coalesce("year", F.lit(0)), F.col("category"), F.coalesce("company", F.lit("")), F.col("path"), F.col("pos")]
    return rows.withColumn("place", F.row_number().over(W.partitionBy("group_name").orderBy(*order)))


def first_seen(ledger: DataFrame) -> DataFrame:
    """Groups with the position where each appears first."""
    return ledger.groupBy(F.col("detected_group").alias("group_name")).agg(F.min("pos").alias("first_pos"))


def run_summary(ledger: DataFrame) -> DataFrame:
    """One row: records, those without error, with one, and without a group."""
    return ledger.agg(F.count("*").alias("total"), F.count_if(F.coalesce("error", F.lit("")) == "").alias("done"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"), F.count_if(F.coalesce(F.trim("detected_group"), F.lit("")) == "").alias("no_group"))


def summary_text(category, summary, file_name, period, duration, srf_number):
    """A report row's text: without a leading [..]; contracts with length and period in brackets, service requests with kind, number and period.

    A number over 30 characters or with three Chinese characters in a row is a misreading. Columns in, a Column out.
    """
    text = F.trim(F.regexp_replace(F.coalesce(summary, F.lit("")), r"^\[[^\]]+\]\s*", ""))
    has_period = F.coalesce(period, F.lit("")) != ""
    said = text.contains("服务期") | text.contains("至")
    parts = F.array_compact(F.array(F.when(F.coalesce(duration, F.lit("")) != "", F.concat(duration, F.lit("合同"))), F.when(has_period & ~said, F.concat(F.lit("维护期 "), period))))
    contract = F.when(F.size(parts) > 0, F.concat(text, F.lit("（"), F.array_join(parts, "；"), F.lit("）"))).otherwise(text)
    number = F.when((F.length(srf_number) <= 30) & ~srf_number.rlike("[一-龥]{3,}") & (srf_number != ""), srf_number)
    kind = C.first_of([(file_name.contains(k), v) for k, v in rules.SERVICE_KINDS], "服务")
    request = F.array_join(F.array_compact(F.array(kind, F.concat(F.lit("编号 "), number), F.when(has_period, F.concat(F.lit("服务期 "), period)))), "；")
    request = F.when(text != "", F.concat(text, F.lit("（"), request, F.lit("）"))).otherwise(request)
    return F.when(category.isin("维护合同", "项目合同", "升级合同"), contract).when(category == "SRF", request).otherwise(text)
