"""A document's record from what was found in it: the first valid value of each field, the group that its name and its file's name give, and flags for whatever was refused.

Nothing stops at a document that can't be read: its row has nulls and a flag.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C
from dossier.operators import dictionary, extract

DATES = ["sign_date", "effective_date", "service_period_start", "service_period_end"]
TEXTS = ["detected_company", "detected_counterparty", "po_number", "quote_number", "software_version"]
MONEY = ["annual_maintenance_fee", "tax_included_amount", "tax_excluded_amount", "contract_total_amount"]
CURRENCIES = ["CNY", "USD", "EUR"]
UNGROUPED = "未分组"


def first_valid(numbers: Column, field: str, ranges: dict = rules.AMOUNT_RANGES) -> Column:
    """Struct of value and refused: the first of the numbers (an array, best first) that is valid for the field, and the flags of all numbers refused before it. Nulls are passed over."""
    name = F.lit(field)
    tried = F.transform(F.filter(numbers, lambda v: v.isNotNull()), lambda v: F.struct(v.alias("value"), C.amount_problem(v, name, ranges).alias("problem")))

    def chosen(x):
        at = F.array_position(F.transform(x, lambda y: y["problem"]), F.lit(""))
        before = F.slice(x, F.lit(1), F.when(at > 0, at.cast("int") - 1).otherwise(F.size(x)))
        return F.struct(F.get(x, at.cast("int") - 1)["value"].alias("value"), F.transform(before, lambda y: F.concat(F.lit(f"amount_invalid:{field}:"), y["problem"])).alias("refused"))

    return F.transform(F.array(tried), chosen)[0]  # a list of one, so that the numbers are judged once


def results(found: DataFrame) -> DataFrame:
    """One row a document of found (doc_id, field, value, alternatives): its fields as values, flags and refused.

    found has one row for each field of a document; of several the one of the least value counts. Dates are ISO, null if they can't be read. If a written amount isn't valid there is a flag, and the first valid alternative
    counts; refused has the flags of all amounts that were refused before it, alternatives included. A first value that is no amount at all leaves the field empty. A currency that isn't known is CNY, a document is a primary
    one unless a field says False.
    """
    every = [*TEXTS, *DATES, *MONEY, "tax_rate", "currency", "is_primary_doc", "attachment_subtype", "doc_subtype_hint"]
    none = F.array().cast("array<string>")
    entry = F.struct(C.blank(F.col("value")).alias("value"), F.coalesce("alternatives", none).alias("alternatives"))
    wide = found.groupBy("doc_id").agg(*[F.min(F.when(F.col("field") == f, entry)).alias(f) for f in every])
    value = lambda f: F.col(f)["value"]
    wide = wide.withColumns({f"__{f}": F.when(value(f).isNotNull(), F.transform(F.concat(F.array(value(f)), F.col(f)["alternatives"]), C.normalize_amount)) for f in MONEY})
    wide = wide.withColumns({f"__{f}": F.when(F.get(f"__{f}", F.lit(0)).isNotNull(), first_valid(F.col(f"__{f}"), f)) for f in MONEY})
    refused = [F.coalesce(F.col(f"__{f}")["refused"], none) for f in MONEY]
    known = F.upper(value("currency"))
    return wide.select(
        "doc_id", *[value(f).alias(f) for f in TEXTS], *[C.parse_date(value(f)).cast("string").alias(f) for f in DATES], C.normalize_tax_rate(value("tax_rate")).alias("tax_rate"), *[F.col(f"__{f}")["value"].alias(f) for f in MONEY],
        F.when(known.isin(CURRENCIES), known).otherwise("CNY").alias("currency"), (~F.coalesce(value("is_primary_doc") == "False", F.lit(False))).alias("is_primary_doc"),
        F.coalesce(value("attachment_subtype"), value("doc_subtype_hint")).alias("doc_subtype"), F.concat(*[F.slice(x, 1, 1) for x in refused]).alias("flags"), F.concat(*refused).alias("refused"),
    )


def checked_company(name: Column, vendors: list[str] = rules.VENDORS) -> Column:
    return C.company_problem(name, vendors)


def grouped(records: DataFrame, mapping: DataFrame, vendors: list[str] = rules.VENDORS) -> DataFrame:
    """records (doc_id, file_name, detected_company, flags, ...) with the company and detected_group settled.

    A refused company is dropped with a flag. A good one has the mapping's group, else, if it looks like a firm's name, is a group of its own; else it is dropped and the record is ungrouped. A group that the file's name gives
    wins, with a flag if there was another one. A record without a company takes the longest known name in the file's name, else the one that the first telling piece of it is a fragment of, else the first firm's name
    written there, each flagged.
    """
    keys = dictionary.known_names(mapping)
    words = dictionary.keyword_rows(mapping)
    rows = records.withColumn("__problem", F.when(F.col("detected_company").isNotNull(), checked_company(F.col("detected_company"), vendors)))
    asked = rows.where("__problem = ''").select(F.col("detected_company").alias("name")).distinct()
    by_name = dictionary.map_to_group(asked, mapping, words).select(F.col("name").alias("detected_company"), F.col("group_name").alias("__mapped"))
    rows = rows.join(by_name, "detected_company", "left")

    files = rows.select("file_name").where("file_name is not null").distinct()
    by_file = dictionary.map_by_file(files, keys, words).withColumnRenamed("group_name", "__by_file")
    named = dictionary.company_in_file(files, keys).select("file_name", F.col("name").alias("__known"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    pieces = files.select("file_name", F.posexplode(F.regexp_extract_all(stem, F.lit("([一-龥a-zA-Z][一-龥a-zA-Z0-9（）()]{3,})"), 1)).alias("at", "fragment"))
    whole = dictionary.by_fragment(pieces.select("fragment").distinct(), mapping.where(C.blank(F.col("group_name")).isNotNull()).select("pos", "name")).where(checked_company(F.col("name"), vendors) == "")
    fragment = pieces.join(whole, "fragment").groupBy("file_name").agg(F.min_by("name", "at").alias("__fragment"))
    first_name = F.get(F.filter(extract.company_names(stem), lambda x: (checked_company(x, vendors) == "") & C.is_clean_company(x)), F.lit(0))
    told = files.join(by_file, "file_name", "left").join(named, "file_name", "left").join(fragment, "file_name", "left").withColumn("__written", first_name)
    rows = rows.join(told.withColumn("__known", F.when(checked_company(F.col("__known"), vendors) == "", F.col("__known"))), "file_name", "left")

    problem, mapped, company = F.col("__problem"), F.col("__mapped"), F.col("detected_company")
    good = problem == ""
    own = good & mapped.isNull() & C.is_clean_company(company)
    from_text = F.when(good, F.coalesce(mapped, F.when(own, company).otherwise(UNGROUPED)))
    kept = F.when(good & (mapped.isNotNull() | own), company)
    conflict = F.col("__by_file").isNotNull() & from_text.isNotNull() & (from_text != UNGROUPED) & (from_text != F.col("__by_file"))
    known, written = F.col("__known"), F.col("__written")
    extra = F.array_compact(
        F.array(
            F.when(problem != "", F.concat(F.lit("company_invalid:"), problem)),
            F.when(conflict, F.concat(F.lit("group_conflict:ocr="), from_text, F.lit(",filename="), F.col("__by_file"))),
            F.when(kept.isNull(), F.when(known.isNotNull(), "company_from_filename_known").when(F.col("__fragment").isNotNull(), "company_from_filename_fragment").when(written.isNotNull(), "company_from_filename_regex")),
        )
    )
    settled = {"detected_group": F.coalesce(F.col("__by_file"), from_text), "detected_company": F.coalesce(kept, known, F.col("__fragment"), written), "flags": F.concat(F.coalesce("flags", F.array().cast("array<string>")), extra)}
    return rows.withColumns(settled).select(*records.columns, *[c for c in ["detected_group"] if c not in records.columns])


def dated(records: DataFrame) -> DataFrame:
    """records, whose dates are ISO, with dates of years out of range null and flagged, and report_year: of signing, else of effect, else of the service's start, else in the file name; the start's if over 2 years after signing."""
    bad = {f: ~F.year(F.col(f).try_cast("date")).between(1990, 2040) for f in DATES}
    problems = F.array_compact(F.array(*[F.when(bad[f], f"date_invalid:{f}:year out of range") for f in DATES]))
    rows = records.withColumns({"flags": F.concat("flags", problems), **{f: F.when(~bad[f], F.col(f)) for f in DATES}})
    named = C.group(F.col("file_name"), "(20[0-9]{2}|19[0-9]{2})").try_cast("int")
    sign, effect, start = (F.year(F.col(f).try_cast("date")) for f in ("sign_date", "effective_date", "service_period_start"))
    return rows.withColumn("report_year", F.when(start - sign > 2, start).otherwise(F.coalesce(sign, effect, start, F.when(named.between(1990, 2040), named))))


#: A record's field by the name that its pattern has.
RECORD_FIELDS = {"company": "detected_company", "buyer": "detected_company", "seller": "detected_counterparty", "service_start": "service_period_start", "service_end": "service_period_end", "fee": "annual_maintenance_fee", "total": "contract_total_amount", "amount": "contract_total_amount", "po_number": "po_number", "quote_number": "quote_number"}


def documents(pages: DataFrame, scans: DataFrame, least: float = 50) -> DataFrame:
    """One row a document of pages (doc_id, file_name, page_no, text): file_name, page_count, has_text_layer, text and doc_type.

    A document whose pages hold `least` characters on average is read from them, another one from its scans (doc_id, page_no, text). Pages follow their numbers, then their texts.
    """
    from dossier.operators.pages import detect_doc_type

    page = F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))
    own = pages.select("doc_id", "file_name", F.lit(True).alias("own"), page.alias("page"))
    each = own.unionByName(scans.select("doc_id", F.lit(None).cast("string").alias("file_name"), F.lit(False).alias("own"), page.alias("page"))).where("doc_id is not null")
    # pages and scans of a document meet once, so that no side is thought small enough, by the size of its files, to be sent to all tasks
    layer = each.groupBy("doc_id").agg(F.min("file_name").alias("file_name"), F.count_if("own").alias("page_count"), F.sum(F.when(F.col("own"), F.length("page.text"))).alias("n_chars"), *[F.collect_list(F.when(F.col("own") == x, F.col("page"))).alias(n) for n, x in (("pages", True), ("scans", False))])  # a document is one row
    layer = layer.where("page_count > 0").withColumn("has_text_layer", F.col("n_chars") / F.col("page_count") >= least)
    read = layer.withColumn("read", F.when(F.col("has_text_layer"), F.col("pages")).otherwise(F.col("scans")))
    rows = read.withColumn("text", F.when(F.size("read") > 0, F.array_join(F.transform(F.array_sort("read"), lambda x: x["text"]), "\n")))
    return rows.select("doc_id", "file_name", "page_count", "has_text_layer", "text", detect_doc_type(F.col("text"), F.col("file_name")).alias("doc_type"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="dossier-"))
    return context.getCheckpointDir()


def _written(df: DataFrame) -> DataFrame:
    """df from files in the shared folder, so that what follows starts from a table and a lost executor costs one step."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def records(pages: DataFrame, scans: DataFrame, mapping: DataFrame, alternatives: DataFrame | None = None, vendors: list[str] = rules.VENDORS) -> DataFrame:
    """From pages to records of the ledger: documents(), their types' fields, results(), grouped() and dated(), with the mean confidence of the fields.

    alternatives (doc_id, field, alternatives) holds further values of a record's fields, best first. A document without any text has an error, a flag and what its file's name gives.
    """
    docs = _written(documents(pages, scans))
    found = _written(extract.fields(docs.where("text is not null")))
    named = found.withColumn("field", C.first_of([(F.col("field") == k, v) for k, v in RECORD_FIELDS.items()])).where("field is not null")
    # what is joined by document grows with the documents: merged, never sent whole to all tasks
    if alternatives is None:
        named = named.withColumn("alternatives", F.lit(None).cast("array<string>"))
    else:
        named = named.join(alternatives.select("doc_id", "field", "alternatives").hint("merge"), ["doc_id", "field"], "left")
    none = F.array().cast("array<string>")
    lacking = F.col("lacking")
    rows = docs.withColumn("lacking", F.coalesce(F.trim("text"), F.lit("")) == "").drop("text").join(results(named).hint("merge"), "doc_id", "left")
    rows = rows.join(extract.confidence(found).select("doc_id", F.col("confidence").alias("confidence_overall")).hint("merge"), "doc_id", "left")
    rows = rows.withColumns({"error": F.when(lacking, "no text"), "flags": F.concat(F.coalesce("flags", none), F.when(lacking, F.array(F.lit("processing_error"))).otherwise(none)), "refused": F.coalesce("refused", none), "currency": F.coalesce("currency", F.lit("CNY")), "is_primary_doc": F.coalesce("is_primary_doc", F.lit(True))})
    return dated(grouped(_written(rows.drop("lacking")), _written(mapping.select("pos", "name", "group_name", "short_name")), vendors))
