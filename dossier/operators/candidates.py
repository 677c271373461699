"""Scored candidates from text: lines with their neighbours, amounts, dates, tax rates, and the choice of the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C
from dossier.operators.resolve import spread


#: What two lines joined must hold to be read as one.
HALVES = "[0-9]{4}年[0-9]{1,2}月|[0-9]{4}[-/.][0-9]{1,2}[-/.]"


def lines(texts: DataFrame, around: int = 2, following: bool = False) -> DataFrame:
    """texts (doc_id, text) as lines (doc_id, line_no, line, context): a line and its neighbours, joined by newlines; with the next line as following, if asked for."""
    every = texts.withColumn("__lines", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\n$", ""), "\n"))
    rows = every.select("doc_id", F.posexplode("__lines").alias("line_no", "line"), "__lines")
    start = F.greatest(F.col("line_no") - around, F.lit(0)) + 1
    size = F.col("line_no") + around + 2 - start
    more = [F.get("__lines", F.col("line_no") + 1).alias("following")] if following else []
    return rows.select("doc_id", "line_no", "line", F.array_join(F.slice("__lines", start, size), "\n").alias("context"), *more)


def label(context: Column, table: list[tuple[str, str]], otherwise: str) -> Column:
    return C.first_of([(context.rlike(p), name) for p, name in table], otherwise)


def amounts(texts: DataFrame) -> DataFrame:
    """doc_id, line_no, value, label and score of every amount of 100 or more; noise lines, addresses and references are skipped."""
    rows = lines(texts).where(F.col("line").rlike("[0-9][0-9OoIlSB,，. ]{2}") & ~F.col("line").rlike(rules.NOISE_LINE))
    found = F.regexp_extract_all("line", F.lit(r"[¥￥$€£]?\s*([0-9][0-9,，Oo Il]*+(?:\.[0-9]+)?+)(?!\s{0,3}[号室楼层栋]|\s*/[Vv])"), 1)
    bare = (F.length(F.trim("line")) < 15) & ~F.col("line").rlike("[元年月日￥¥$€£]|CNY|USD|EUR|RMB")
    score = C.first_of([(bare, 0.35), (F.col("line").rlike(rules.HIGH_CONTEXT), 0.95), (F.col("context").rlike(rules.HIGH_CONTEXT), 0.75), (F.col("context").rlike(rules.MEDIUM_CONTEXT), 0.8)], 0.6)
    # label and score depend on the line alone, so they are worked out once a line
    judged = rows.select("doc_id", "line_no", label(F.col("context"), rules.AMOUNT_LABELS, "amount_generic").alias("label"), score.alias("score"), found.alias("found"))
    each = judged.select("doc_id", "line_no", "label", "score", F.posexplode("found").alias("n", "raw")).withColumn("value", C.normalize_amount(F.col("raw")))
    return each.where(F.col("value") >= 100).select("doc_id", "line_no", "n", "value", "label", "score")


#: Forms of dates in the order in which they are tried: full ones, short years, a year's last digit read as a stroke, month first.
DATE_FORMS = [
    r"[0-9]{4}[-/.]\s*[0-9]{1,2}[-/.]\s*[0-9]{1,2}", r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日?", r"[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}", r"[0-9]{3}[/|lI][-/.][0-9]{1,2}[-/.]\s*[0-9]{1,2}",
    r"(?<![0-9A-Za-z_一-龥])[0-9]{1,2}/[0-9]{2}/[0-9]{2}(?![0-9A-Za-z_一-龥])",
]


#: What every form holds.
MAY_DATE = r"[0-9]{2}\s*[-/.年|lI]|[0-9]/[0-9]"


def dates(texts: DataFrame, last_year: int) -> DataFrame:
    """doc_id, line_no, value (ISO), label and score of the first of each date and label; last_year bounds the years from above.

    Lines are read first, then lines joined with the next one where that makes a date of two halves; those count for their first line. Dates with a year of two digits and
    without a label need a word for dates near them. Texts that are null or empty have no dates."""
    blanks = F.lit(" \t\n\x0b\f\r")
    both = F.concat(F.rtrim("line", blanks), F.ltrim("following", blanks))
    each = F.array(F.struct(F.lit(0).alias("stage"), F.col("line")), F.struct(F.lit(1).alias("stage"), F.when(both.rlike(HALVES), both).alias("line")))
    rows = lines(spread(texts), following=True).select("doc_id", "line_no", "context", F.inline(each)).where(F.col("line").rlike(MAY_DATE))
    found = F.flatten(F.array(*[F.regexp_extract_all("line", F.lit(f"({form})"), 1) for form in DATE_FORMS]))
    rows = rows.withColumn("found", found).where(F.size("found") > 0)
    name = label(F.col("context"), rules.DATE_LABELS, "date_generic")
    strong = F.col("context").rlike(rules.SIGNED)
    rows = rows.select("doc_id", "line_no", "stage", "found", name.alias("label"), F.col("context").rlike(rules.CONDITION).alias("condition"), strong.alias("strong"), F.col("context").rlike(rules.DATE_WORDS).alias("about_dates"))
    # within the array, so that each date is repaired and parsed once
    mended = F.transform("found", lambda x: F.struct(x.alias("raw"), C.repair_date(x).alias("fixed")))
    read = F.transform(mended, lambda x: F.struct(x["raw"].alias("raw"), x["fixed"].alias("fixed"), C.parse_date(x["fixed"]).alias("value")))
    each = rows.withColumn("found", read).select("*", F.posexplode("found").alias("n", "one")).select("*", "one.*")
    each = each.withColumn("label", F.when((F.col("label") == "sign_date") & F.col("condition"), "date_condition").otherwise(F.col("label")))
    short = F.col("raw").rlike("^[0-9]{2}[-/.]|^[0-9]{1,2}/[0-9]{2}/[0-9]{2}$")
    each = each.where(F.year("value").between(1990, last_year) & ~(short & (F.col("label") == "date_generic") & ~F.col("about_dates")))
    base = F.when(F.col("fixed") == F.col("raw"), 0.7).otherwise(0.55)
    score = F.when((F.col("label") == "sign_date") & F.col("strong"), F.least(base + 0.15, F.lit(0.95))).otherwise(base)
    first = F.row_number().over(W.partitionBy("doc_id", "value", "label").orderBy("stage", "line_no", "n"))
    return each.withColumns({"score": F.round(score, 2), "__n": first}).where("__n = 1").select("doc_id", "line_no", F.col("value").cast("string").alias("value"), "label", "score")


def tax_rates(texts: DataFrame) -> DataFrame:
    """doc_id, rate and score of the first of each rate in lines about tax, not about payment schedules."""
    rows = lines(texts, 1).where(F.col("context").rlike("(?i)税|tax|VAT") & ~F.col("line").rlike("(?i)付款|支付|预付|payment"))
    each = rows.select("doc_id", "line_no", "line", F.posexplode(F.regexp_extract_all("line", F.lit(r"([0-9]{1,2}(?:\.[0-9]+)?)\s*%"), 1)).alias("n", "raw")).withColumn("rate", F.col("raw").try_cast("double"))
    good = F.col("rate").isin([float(x) for x in rules.TAX_RATES]) | ((F.col("rate") != F.floor("rate")) & F.col("rate").between(3, 17))
    first = F.row_number().over(W.partitionBy("doc_id", "rate").orderBy("line_no", "n"))
    return each.where(good).withColumns({"score": F.when(F.col("line").rlike("(?i)税|tax|VAT"), 0.85).otherwise(0.65), "__n": first}).where("__n = 1").select("doc_id", "rate", "score")


def best(candidates: DataFrame, *keys: str, labels: list[str] | None = None) -> DataFrame:
    """The candidate with the largest score of each key, then the largest value, then the first; of the given labels if any is there."""
    wanted = F.col("label").isin(labels) if labels else F.lit(True)
    order = F.struct((~wanted).cast("int").alias("a"), (-F.col("score")).alias("b"), (-F.col("value")).alias("c"), "pos")
    return candidates.groupBy(*keys).agg(F.min_by(F.struct("value", "score", "label"), order).alias("m"), F.count("*").alias("n")).select(*keys, "m.*", "n")


def mode(values: DataFrame, *keys: str) -> DataFrame:
    """The commonest value of each key, the first seen on ties."""
    n = values.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return n.groupBy(*keys).agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "first")).alias("m")).select(*keys, "m.value", "m.n")


def first_valid(value: Column, field: Column, others: Column) -> Column:
    """The value if it is valid, else the first valid one of others (an array, best first)."""
    fine = F.filter(others, lambda x: C.amount_problem(x, field) == "")
    return F.when(C.amount_problem(value, field) == "", value).otherwise(F.get(fine, F.lit(0)))


def stitched(texts: DataFrame) -> DataFrame:
    """Lines of texts joined with the next one where that makes a date of two halves: doc_id, line_no (of the first) and line."""
    rows = texts.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    pairs = F.transform(F.slice("l", F.lit(1), F.greatest(F.size("l") - 1, F.lit(0))), lambda x, i: F.concat(F.regexp_replace(x, r"\s+$", ""), F.regexp_replace(F.get(F.col("l"), i + 1), r"^\s+", "")))
    each = rows.select("doc_id", F.posexplode(pairs).alias("line_no", "line"))
    return each.where(F.col("line").rlike(HALVES))


def ranked(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Candidates of several sources (doc_id, source, pos, value, ...), those of earlier sources first: source_rank and place in the document."""
    rank = C.first_of([(F.col("source") == s, i) for i, s in enumerate(order)], len(order))
    return candidates.withColumn("source_rank", rank).withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("source_rank", "pos")))


def evidence_amount(text: Column, low: float = 100, high: float = 1e8) -> Column:
    """The largest whole part of the numbers in a text that lie within bounds."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9,]+(?:\.[0-9]+)?)"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.array_max(F.transform(F.filter(numbers, lambda v: v.between(low, high)), lambda v: F.floor(v).cast("long")))


#: Field of a document of unknown type by kind of candidate, and what its score counts for.
UNKNOWN_FIELDS = [("company", "detected_company", 0.5), ("date", "sign_date", 0.5), ("amount", "contract_total_amount", 0.4)]


def unknown_fields(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, field, value and confidence of documents (doc_id) of unknown type: of each kind the candidate (doc_id, kind, pos, value, score) of the largest score, the first by pos on ties, and
    a flag that the type is unknown."""
    best = candidates.groupBy("doc_id", "kind").agg(F.min_by(F.struct("value", "score"), F.struct(-F.col("score"), "pos")).alias("b"))
    field = C.first_of([(F.col("kind") == k, name) for k, name, _ in UNKNOWN_FIELDS])
    share = C.first_of([(F.col("kind") == k, w) for k, _, w in UNKNOWN_FIELDS])
    rows = best.select("doc_id", field.alias("field"), F.col("b.value").alias("value"), F.round(F.col("b.score") * share, 6).alias("confidence")).where("field is not null")
    flags = documents.select("doc_id", F.lit("_flag_unknown_type").alias("field"), F.lit("UNKNOWN_DOC_TYPE").alias("value"), F.lit(1.0).alias("confidence"))
    return rows.unionByName(flags)
