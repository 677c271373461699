"""Fields by document type, and the texts that sum a record up. Patterns are data (rules.FIELDS); this holds how they are tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C


def first_pattern(text: Column, patterns: list[tuple[str, float]]) -> Column:
    """Struct of value and confidence of the first pattern that matches; null if none does."""
    found = []
    for pattern, confidence in patterns:
        value = F.trim(C.group(text, pattern))
        found.append(F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(confidence).alias("confidence"))))
    return F.coalesce(*found)


def fields(docs: DataFrame) -> DataFrame:
    """docs (doc_id, doc_type, text) as (doc_id, field, value, confidence): each type has its own patterns, and docs are read once."""
    each = lambda table: F.array(*[F.struct(F.lit(name).alias("field"), first_pattern(F.col("text"), patterns).alias("e")) for name, patterns in table.items()])
    rows = docs.where(F.col("doc_type").isin(list(rules.FIELDS)))
    found = rows.select("doc_id", F.explode(C.first_of([(F.col("doc_type") == kind, each(table)) for kind, table in rules.FIELDS.items()])).alias("f"))
    return found.where("f.e is not null").select("doc_id", "f.field", "f.e.value", "f.e.confidence")


def confidence(found: DataFrame) -> DataFrame:
    """The mean confidence of each document's fields."""
    return found.groupBy("doc_id").agg(F.round(F.avg("confidence"), 4).alias("confidence"), F.count("*").alias("n_fields"))


def currency(text: Column) -> Column:
    return C.first_of([(text.rlike(p), code) for code, p in rules.CURRENCIES])


def attachment_kind(text: Column, file_name: Column) -> Column:
    head, name = F.lower(F.substring(text, 1, 2000)), F.lower(file_name)
    return C.first_of([(C.has_any(head, words) | C.has_any(name, words), kind) for kind, words in rules.ATTACHMENTS], "其他附件")


def legacy_type(text: Column, file_name: Column) -> Column:
    """By file name, else by the first 500 characters, else by the whole text."""
    by = lambda t: C.first_of([(C.has_any(t, words), k) for k, words in rules.LEGACY_TYPES])
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(by(F.lower(F.coalesce(file_name, F.lit("")))), by(F.substring(low, 1, 500)), by(low), F.lit("其他"))


def installation_place(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_replace(F.trim(C.group(text, p)), "[，,；;。 ]+$", ""), F.lit("")) for p in rules.PLACES])


def company_names(text: Column) -> Column:
    """Distinct firms' names in a text, by pattern and place: without form labels, names under 4 characters or with over 4 digits."""
    found = F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in rules.NAMES]), lambda x: F.trim(x)))
    return F.filter(found, lambda x: (F.length(x) >= 4) & ~C.starts_any(F.lower(x), rules.LABEL_STARTS) & (F.regexp_count(x, F.lit("[0-9]")) <= 4))


def line_items(text: Column) -> Column:
    """Number of item lines, and the first three, joined."""
    items = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^[0-9]+[.\s]"))
    return F.struct(F.size(items).alias("n"), F.substring(F.array_join(F.slice(items, 1, 3), "; "), 1, 300).alias("first"))


def summary() -> Column:
    """One sentence on a record of the ledger, by its type."""
    company = F.coalesce(C.blank(F.col("detected_company")), F.lit("未知公司"))
    year, group = F.coalesce(F.col("report_year").cast("string"), F.lit("")), C.blank(F.col("detected_group"))
    amount = F.coalesce(*[C.filled(F.col(c)) for c in ("annual_maintenance_fee", "contract_total_amount", "tax_included_amount")])
    money = F.format_string("¥%,.2f", amount)
    prefix = F.when(group.isNotNull(), F.concat(F.lit("["), group, F.lit("] "))).otherwise("")
    start, end = C.blank(F.col("service_period_start")), C.blank(F.col("service_period_end"))
    period = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("，服务期 "), start, F.lit(" 至 "), end)).when(start.isNotNull(), F.concat(F.lit("，服务期自 "), start)).otherwise("")
    tail = lambda words: F.when(amount.isNotNull(), F.concat(F.lit(words), money)).otherwise("")
    kind = F.col("doc_type")
    return C.first_of([
        (kind == "CONTRACT", F.concat(prefix, F.lit("与"), company, F.lit("签订的"), year, F.lit("年度服务合同"), tail("，年度维护费 "), period)),
        (kind == "PURCHASE_ORDER", F.concat(prefix, year, F.lit("年 "), company, F.lit(" 采购订单"), tail("，总金额 "))),
        (kind == "QUOTE", F.concat(prefix, F.lit("向 "), company, F.lit(" 提供的"), year, F.lit("年报价单"), tail("，总额 "))),
        (kind == "PROPOSAL", F.concat(prefix, F.lit("为 "), company, F.lit(" 准备的"), year, F.lit("年项目建议书"))),
        (kind == "SRF", F.concat(prefix, company, F.lit(" 的"), year, F.lit("年服务需求表"))),
        (kind == "PAYMENT_NOTICE", F.concat(prefix, F.lit("向 "), company, F.lit(" 发出的付款通知"), tail("，金额 "))),
    ], "")


def legacy_confidence(score: Column, year: Column, date: Column, doc_type: Column, group: Column) -> Column:
    """The company's score, at most 90, and what else is known; at most 100."""
    extra = [(C.blank(year).isNotNull(), 5), (C.blank(date).isNotNull(), 3), (~doc_type.eqNullSafe(F.lit("其他")), 2), (C.blank(group).isNotNull(), 3)]
    return F.least(F.least(score, F.lit(90)) + sum((F.when(c, n).otherwise(0) for c, n in extra), F.lit(0)), F.lit(100))


def review_reason(company: Column, group: Column, year: Column, confidence_: Column, text: Column) -> Column:
    c, g = C.blank(company), C.blank(group)
    thin = text.isNull() | text.startswith("[") | (F.length(F.trim(text)) < 20)
    return F.concat_ws("；", F.when(c.isNull(), "未识别公司名"), F.when(c.isNotNull() & g.isNull(), "未匹配到集团"), F.when(C.blank(year).isNull(), "未识别年份"), F.when(confidence_ < 78, "置信度偏低"), F.when(thin, "文本提取不足"))


def legacy_number(text: Column, file_name: Column) -> Column:
    """A contract's number by label, else by a code in the file name; empty without one."""
    found = [F.nullif(F.regexp_replace(F.trim(C.group(text, p)), "[，,；; ]+$", ""), F.lit("")) for p in rules.LEGACY_NUMBERS]
    return F.coalesce(*found, *[C.group(file_name, p) for p in rules.LEGACY_STEMS], F.lit(""))


def legacy_fee(text: Column) -> Column:
    """The yearly fee with two decimals; empty without one."""
    value = F.coalesce(*[C.group(text, p) for p in rules.LEGACY_FEES])
    number = F.replace(value, F.lit(","), F.lit("")).try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.2f", number)).otherwise("")


def roles(texts: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, role and name: of the names in a document (doc_id, name), the one on the first line with a word of the role."""
    rows = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    low = F.lower("line")
    each = rows.select("doc_id", "line_no", "line", F.explode(F.array_compact(F.array(*[F.when(C.has_any(low, words), role) for role, words in rules.ROLES]))).alias("role"))
    hits = each.join(names, "doc_id").where(F.expr("contains(line, name)"))
    return hits.groupBy("doc_id", "role").agg(F.min_by("name", F.struct("line_no", "name")).alias("name"))


def distinct_in_order(items: Column) -> Column:
    """The first of all items alike but for case, in their order."""
    low = F.transform(items, lambda x: F.lower(x))
    kept = F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(low, F.lower(s["x"])) == s["i"] + 1)
    return F.transform(kept, lambda s: s["x"])
