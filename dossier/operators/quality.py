"""Data-quality checks: every rule is an element of an array, exploded to one row for each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C


def findings(df: DataFrame, keys: list[str], checks: list[tuple[str, Column]]) -> DataFrame:
    """keys and code of every check that holds."""
    codes = F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in checks]))
    return df.select(*keys, F.explode(codes).alias("code"))


def _year(df_year: str = "year") -> Column:
    return F.coalesce(F.col(df_year).cast("int"), F.lit(0))


def row_checks(vendors: list[str] = rules.VENDORS) -> list[tuple[str, Column]]:
    company, summary, version = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("company", "summary", "version"))
    major, named = C.group(version, "^V?([0-9]+)").try_cast("int"), C.group(summary, "([0-9]{4})年").try_cast("int")
    vendor = lambda c: C.has_any(F.lower(c), vendors, lower=True)
    year = _year()
    return [
        ("VENDOR_IN_COMPANY", vendor(company)), ("VENDOR_IN_SUMMARY", vendor(summary)),
        ("NOISE_IN_COMPANY", company.rlike(rules.VAT_NOISE)), ("NOISE_IN_SUMMARY", summary.rlike(rules.VAT_NOISE)),
        ("COMPANY_EMPTY", company == ""), ("CTYPE_PREFIX_IN_COMPANY", company.rlike(rules.TYPE_PREFIX)),
        ("COMPANY_IS_GROUP", (company != "") & ((company == F.col("group_name")) | (company == F.concat("group_name", F.lit("集团"))))),
        ("COMPANY_ENGLISH", C.mostly_english(company)),
        ("VERSION_V7_PRE2017", (major == 7) & (year > 0) & (year < 2017)), ("VERSION_V8_PRE2023", (major == 8) & (year > 0) & (year < 2023)),
        ("AMOUNT_EMPTY", F.col("amount").isNull()), ("SUMMARY_EMPTY", summary == ""),
        ("SUMMARY_YEAR_MISMATCH", (year > 0) & (F.abs(named - year) >= 2)),
        ("AMOUNT_SUSPICIOUS_LOW", F.col("category").isin("维护合同", "升级合同", "项目合同", "SRF") & (F.col("amount") > 0) & (F.col("amount") < 1000)),
    ]


def verify_checks(vendors: list[str] = rules.VENDORS) -> list[tuple[str, Column]]:
    company, summary, amount, year = F.trim(F.coalesce(F.col("company"), F.lit(""))), F.trim(F.coalesce(F.col("summary"), F.lit(""))), F.col("amount"), F.col("year")
    named, in_path = company != "", C.group(F.col("path"), "/([0-9]{4})/").try_cast("int")
    return [
        ("公司名为空", ~named), ("公司名是乙方", C.has_any(company, vendors)), ("公司名过短", named & (F.length(company) < 4)), ("公司名过长", F.length(company) > 50), ("公司名含前缀噪音", C.starts_any(company, rules.PREFIX_NOISE)),
        ("金额为负", amount < 0), ("金额过小(<100)", (amount > 0) & (amount < 100)), ("金额疑似年份", amount.between(2000, 2030)), ("金额疑似日期", amount.cast("string").rlike("^20[0-9]{2}\\.[0-9]{1,2}$")), ("金额异常大(>1亿)", amount > 1e8),
        ("年份为空", year.isNull()), ("年份不合理", ~year.between(2000, 2026)), ("年份与路径不一致", in_path != year),
        ("摘要为空", summary == ""), ("摘要含乙方名称", C.has_any(summary, vendors)), ("摘要过长(>200字)", F.length(summary) > 200),
    ]


def counts(issues: DataFrame) -> DataFrame:
    """Findings of each code, and whether the gate counts it as critical."""
    return issues.groupBy("code").agg(F.count("*").alias("n")).withColumn("critical", F.col("code").isin(rules.CRITICAL))


def samples(issues: DataFrame, n: int, order: str) -> DataFrame:
    """The first n findings of each code."""
    return issues.withColumn("rank", F.row_number().over(W.partitionBy("code").orderBy(order))).where(F.col("rank") <= n)


def worst_groups(issues: DataFrame, n: int = 20) -> DataFrame:
    """The n groups with most findings."""
    return issues.groupBy("group_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_name").limit(n)


PRIORITY = {"AMOUNT_EMPTY": "HIGH", "COMPANY_EMPTY": "HIGH", "SUMMARY_EMPTY": "HIGH", "VENDOR_IN_COMPANY": "HIGH", "COMPANY_IS_GROUP": "MEDIUM", "SUMMARY_YEAR_MISMATCH": "MEDIUM", "COMPANY_ENGLISH": "LOW"}


def review_queue(issues: DataFrame, priority: dict[str, str] = PRIORITY) -> DataFrame:
    """Findings with a priority (others LOW) and its place in the order HIGH, MEDIUM, LOW."""
    level = C.first_of([(F.col("code") == k, v) for k, v in priority.items()], "LOW")
    return issues.withColumn("priority", level).withColumn("place", C.first_of([(F.col("priority") == "HIGH", 0), (F.col("priority") == "MEDIUM", 1)], 2))


def ledger_checks() -> list[tuple[str, Column]]:
    """Checks of a record against the report row of its file and itself; expects the report's columns with the prefix r_."""
    first = F.coalesce(C.filled(F.col("contract_total_amount")), C.filled(F.col("tax_included_amount")), C.filled(F.col("tax_excluded_amount")), C.filled(F.col("annual_maintenance_fee")))
    company, there = F.trim(F.coalesce("detected_company", F.lit(""))), F.col("r_path").isNotNull()
    return [
        ("EXCEL_COMPANY_DIFF", there & (F.col("r_company") != company)), ("EXCEL_YEAR_DIFF", there & (F.col("r_year") != F.coalesce("report_year", F.lit(0)))), ("EXCEL_AMOUNT_DIFF", there & (F.abs(F.col("r_amount") - first) > 1)),
        ("COMPANY_EMPTY", company == ""), ("COMPANY_SHORT", (company != "") & (F.length(company) < 4)), ("AMOUNT_NEGATIVE", first < 0), ("AMOUNT_SMALL", (first > 0) & (first < 100)), ("AMOUNT_YEAR_LIKE", first.between(2000, 2030)), ("AMOUNT_HUGE", first > 1e8),
        ("YEAR_EMPTY", F.coalesce("report_year", F.lit(0)) == 0), ("YEAR_RANGE", ~F.col("report_year").between(2000, 2026)),
    ]


def full_audit(ledger: DataFrame, report: DataFrame) -> DataFrame:
    """file_name, pos, status and number of findings of every record; the report row of a file is its first by path and company."""
    r = report.groupBy(F.element_at(F.split("path", "/"), -1).alias("file_name")).agg(F.min(F.struct("path", "company", "year", "amount")).alias("r"))
    both = ledger.join(r, "file_name", "left").withColumns({f"r_{c}": F.col(f"r.{c}") for c in ("path", "company", "year", "amount")})
    found = F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in ledger_checks()]))
    return both.select("pos", "file_name", F.array_join(found, "|").alias("issues"), F.size(found).alias("issue_count"), F.when(F.size(found) == 0, "PASS").otherwise("FAIL").alias("status"))


def conflicts(ledger: DataFrame, least: float = 0.5) -> DataFrame:
    """Records whose file name says another company than the ledger, with the size of their group."""
    named = C.group(F.col("file_name"), "_([^_]+)_")
    rows = ledger.withColumns({"says": named, "similarity": F.round(C.char_similarity(named, F.coalesce("detected_company", F.lit(""))), 6)}).where(F.col("says").isNotNull() & (F.col("similarity") < least))
    sizes = ledger.groupBy(F.col("detected_group").alias("g")).agg(F.count("*").alias("group_size"))
    return rows.join(sizes, F.col("detected_group").eqNullSafe(F.col("g"))).select("pos", F.col("detected_group").alias("group_name"), "group_size", "file_name", "says", "similarity")


def ordered_conflicts(rows: DataFrame) -> DataFrame:
    """Conflicts, those of large groups first."""
    return rows.orderBy(F.desc("group_size"), "group_name", "file_name", "pos")


def cross_checks(vendors: list[str] = rules.VENDORS) -> list[tuple[str, Column]]:
    """What a file name says (says, says_version) against the record: another company, one where the record has none, a vendor where the file names nobody, another version, no amount."""
    company, version = F.trim(F.coalesce("detected_company", F.lit(""))), F.trim(F.coalesce("software_version", F.lit("")))
    says = F.col("says")
    return [
        ("COMPANY_MISMATCH", says.isNotNull() & (company != "") & (C.char_similarity(says, company) < 0.5)), ("COMPANY_MISSING_IN_AUDIT", says.isNotNull() & (company == "")),
        ("VENDOR_IN_AUDIT", says.isNull() & C.has_any(F.lower(company), vendors, lower=True)), ("VERSION_MISMATCH", F.col("says_version").isNotNull() & (version != "") & (F.col("says_version") != version)),
        ("AMOUNT_EMPTY", F.coalesce(*[C.filled(F.col(c)) for c, _ in rules.AMOUNTS]).isNull()),
    ]


def audit_examples(audit: DataFrame, n: int = 5) -> DataFrame:
    """Of full_audit(): kind of finding (before any colon), how often, and the first n file names by pos."""
    each = audit.select("pos", "file_name", F.explode(F.split("issues", "\\|")).alias("issue")).where("issue <> ''").select("pos", "file_name", F.substring_index("issue", ":", 1).alias("kind"))
    first = each.withColumn("k", F.row_number().over(W.partitionBy("kind").orderBy("pos"))).where(F.col("k") <= n)
    names = first.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "file_name"))), lambda x: x["file_name"]), "|").alias("examples"))
    return each.groupBy("kind").agg(F.count("*").alias("n")).join(names, "kind")


def misplaced_files(files: DataFrame, keywords: DataFrame) -> DataFrame:
    """Files (group_name, file_name) that hold none of their group's keywords (group_name, keyword); groups without keywords pass."""
    words = keywords.groupBy("group_name").agg(F.collect_set(F.lower("keyword")).alias("words"))
    both = files.join(words, "group_name")
    return both.where(~F.exists("words", lambda w: F.lower(F.col("file_name")).contains(w))).select("group_name", "file_name")
