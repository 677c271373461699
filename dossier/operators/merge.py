"""Joins between ledgers, reports, file inventories and passes of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_mismatches(report: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose report row and ledger record name different groups (其他 and empty ones aside)."""
    both = report.select("file_name", F.col("group_name").alias("reported")).join(ledger.select("file_name", F.col("detected_group").alias("recorded")), "file_name")
    return both.where((F.col("reported") != F.col("recorded")) & ~F.col("recorded").isin("", "其他")).distinct()


def sync(main: DataFrame, fixed: DataFrame, fields: list[str]) -> DataFrame:
    """Keys of main that fixed lacks, or the first field in which the two differ."""
    both = main.alias("m").join(fixed.withColumn("__there", F.lit(True)).alias("f"), "file_name", "left")
    first = F.coalesce(*[F.when(~F.col(f"m.{c}").cast("string").eqNullSafe(F.col(f"f.{c}").cast("string")), F.lit(c)) for c in fields])
    return both.withColumn("what", F.when(F.col("__there").isNull(), "missing").otherwise(first)).where("what is not null").select("file_name", "what")


def without_report(inventory: DataFrame, report: DataFrame) -> DataFrame:
    """Groups with files but no report row."""
    return inventory.select("group_name").distinct().join(report.select("group_name").distinct(), "group_name", "left_anti")


def location(ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """Where a record's file is: expected, same_group (another year), other_group or not_found; the best of all its places."""
    both = ledger.select("pos", "file_name", "detected_group", "report_year").join(inventory, "file_name", "left")
    same = F.col("group_name") == F.col("detected_group")
    rank = F.when(F.col("group_name").isNull(), 3).when(same & F.col("year").eqNullSafe(F.col("report_year")), 0).when(same, 1).otherwise(2)
    return both.groupBy("pos").agg(F.min(rank).alias("rank")).select("pos", F.element_at(F.array(*map(F.lit, ("expected", "same_group", "other_group", "not_found"))), F.col("rank") + 1).alias("status"))


def merge_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Amounts of two passes (key, amount): the second's counts where both have one."""
    a, b = first.select("key", F.col("amount").alias("a")), second.select("key", F.col("amount").alias("b"))
    return a.join(b, "key", "full_outer").select("key", F.coalesce("b", "a").alias("amount"), (F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("replaced"))


def not_rejected(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    """Rows of (group_name, amount, file_name) that fit no reject: same group and amount, and its text in the file name."""
    r = rejects.select(F.col("group_name").alias("rg"), F.col("amount").alias("ra"), F.col("part"))
    return rows.join(r, (F.col("group_name") == F.col("rg")) & (F.col("amount") == F.col("ra")) & F.expr("contains(file_name, part)"), "left_anti")


def apply_conflicts(ledger: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Companies replaced by what the last conflict row of the file's key says."""
    says = conflicts.groupBy("file_md5").agg(F.max_by("says", "pos").alias("__says"))
    return ledger.join(says, "file_md5", "left").withColumns({"changed": F.col("__says").isNotNull() & ~F.col("__says").eqNullSafe(F.col("detected_company")), "detected_company": F.coalesce("__says", "detected_company")}).drop("__says")


def todo(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets that no earlier run has processed."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def character_sets(df: DataFrame) -> DataFrame:
    """Key-set differences both ways of two columns' values: (side, value)."""
    a, b = df.select(F.col("a").alias("value")).distinct(), df.select(F.col("b").alias("value")).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
