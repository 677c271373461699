"""Sinks: audit and per-group JSON, flat export rows, packets, and the widths that a sheet's columns need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C

WITH_AMOUNT = ["CONTRACT", "SRF", "PURCHASE_ORDER", "QUOTE"]


def flat_rows(ledger: DataFrame) -> DataFrame:
    """The export's projection: names made safe, folders, whether an amount is there."""
    has = F.col("doc_type").isin(WITH_AMOUNT) & F.coalesce(*[C.filled(F.col(c)) for c, _ in rules.AMOUNTS]).isNotNull()
    group = F.coalesce(C.blank(F.col("detected_group")), F.lit("未分组"))
    return ledger.select(
        "pos", "file_name", F.coalesce("doc_type", F.lit("UNKNOWN")).alias("doc_type"), group.alias("group_name"), F.translate(group, "/\\", "__").alias("sheet"), "report_year",
        F.when(F.coalesce(has, F.lit(False)), "是").otherwise("否").alias("has_amount"), F.concat_ws("/", C.safe_name(group), F.coalesce(F.col("report_year").cast("string"), F.lit("未知年份")), "file_name").alias("target_path"),
    )


#: Columns of the wide export and what stands in for a missing one.
WIDE = [
    ("report_year", None), ("detected_group", ""), ("detected_company", ""), ("detected_counterparty", ""), ("doc_type", ""), ("doc_subtype", ""), ("is_primary_doc", "否"), ("sign_date", ""), ("effective_date", ""),
    ("service_period_start", ""), ("service_period_end", ""), ("annual_maintenance_fee", None), ("tax_rate", ""), ("tax_included_amount", None), ("tax_excluded_amount", None), ("contract_total_amount", None),
    ("currency", "CNY"), ("po_number", ""), ("quote_number", ""), ("file_name", ""), ("file_path", ""), ("file_md5", ""), ("summary", ""), ("confidence_overall", 0.0), ("flags", ""), ("error", ""),
]


def wide_rows(ledger: DataFrame) -> DataFrame:
    """The 26 columns of the wide export: yes and no as words, confidence to three digits, flags joined; columns that a ledger lacks get their defaults."""
    def column(name, default):
        if name not in ledger.columns:
            return F.lit(default).cast("int" if name == "report_year" else "double" if default is None else "string" if isinstance(default, str) else "double")
        c = F.col(name)
        if name == "is_primary_doc":
            return F.when(c, "是").otherwise("否")
        if name == "confidence_overall":
            return F.bround(F.coalesce(c, F.lit(0.0)), 3)
        if name == "flags":
            return F.coalesce(F.array_join(c, "|"), F.lit(""))
        return c if default is None else F.coalesce(c, F.lit(default))

    return ledger.select("pos", *[column(n, x).alias(n) for n, x in WIDE])


def packet_rows(documents: DataFrame) -> DataFrame:
    """A row for each packet of documents (doc_id, file_name, group_name, packets), titles cut to 100 characters."""
    rows = documents.select("doc_id", "file_name", "group_name", F.explode("packets").alias("p"))
    return rows.select("doc_id", "file_name", "group_name", "p.packet_id", "p.start_page", "p.end_page", "p.packet_type", "p.doc_type", F.substring("p.title_hint", 1, 100).alias("title_hint"))


def legacy_rows(ledger: DataFrame) -> DataFrame:
    """The older export of each group: file, company, year (the unknown last), type, and an empty column for notes."""
    rows = ledger.select("pos", F.coalesce(C.blank(F.col("detected_group")), F.lit("未分组")).alias("group_name"), "file_name", "detected_company", "report_year", "doc_type", F.lit("").alias("notes"))
    return rows.orderBy("group_name", F.asc_nulls_last("report_year"), "pos")


def with_amount(ledger: DataFrame) -> DataFrame:
    return flat_rows(ledger).where("has_amount = '是'")


def column_widths(df: DataFrame, least: int = 2, most: int = 45) -> DataFrame:
    """column and width: the longest value's length plus a margin, up to a limit."""
    widths = df.agg(*[F.least(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)) + least, F.lit(most)).alias(c) for c in df.columns])
    return widths.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("width")) for c in df.columns])).alias("w")).select("w.*")


def write_audit(ledger: DataFrame, path: str) -> None:
    """A new version of the ledger as JSON Lines; older versions stay."""
    ledger.write.mode("errorifexists").json(path)


def write_per_group(ledger: DataFrame, path: str) -> None:
    """JSON Lines in one folder a group."""
    flat_rows(ledger).write.mode("errorifexists").partitionBy("sheet").json(path)


def append_progress(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
