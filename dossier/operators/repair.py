"""Repairs of a ledger, each a projection: rules in order see what earlier ones wrote. Files are moved by a plan, not here."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C
from dossier.functions import names as N
from dossier.operators import dictionary


def rename(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Values of a column replaced by a table (old, new); others stay."""
    out = df.join(table.select(F.col("old").alias(column), F.col("new").alias("__new")), column, "left")
    return out.withColumn(column, F.coalesce("__new", column)).drop("__new").select(*df.columns)


def first_replacement(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The first pair of which the text holds the left side replaces it."""
    return C.first_of([(text.contains(a), F.replace(text, F.lit(a), F.lit(b))) for a, b in pairs], text)


def rule_match(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """df with target: of the rules (pos, pattern, target) whose pattern the column contains, the longest, the first by pos on ties."""
    # one pattern can stand in every text, so texts and patterns don't meet by what they share
    hit = dictionary.longest_keys(df.select(F.col(column).alias("text")), table.select(F.col("pattern").alias("key"), F.array("pos").alias("place")))
    first = table.groupBy(F.col("pattern").alias("key")).agg(F.min_by("target", "pos").alias("target"))
    return df.join(hit.join(first, "key").select(F.col("text").alias(column), "target"), column, "left")


def fix_amounts(df: DataFrame, columns: list[str], small: float = 10) -> DataFrame:
    """Amounts like years are removed, negative ones lose their sign, totals under a limit are removed."""
    fixed = {}
    for c in columns:
        v = F.when(~((F.col(c) == F.floor(F.col(c))) & F.col(c).between(1990, 2035)) | F.col(c).isNull(), F.abs(F.col(c)))
        fixed[c] = F.when(v >= small, v) if c == "contract_total_amount" else v
    return df.withColumns(fixed)


def fix_years(df: DataFrame, low: int = 1995, high: int = 2026) -> DataFrame:
    """report_year becomes the file name's where that has one within bounds; changed says whether it did."""
    y = C.group(F.col("file_name"), "((?:19|20)[0-9]{2})").try_cast("int")
    y = F.when(y.between(low, high), y)
    return df.withColumn("__y", y).withColumns({"changed": F.col("__y").isNotNull() & ~F.col("__y").eqNullSafe(F.col("report_year")), "report_year": F.coalesce("__y", "report_year")}).drop("__y")


def staged(df: DataFrame, vendors: list[str] = rules.VENDORS) -> DataFrame:
    """Company and group made valid by ordered rules, with the trace of what was done (fixes)."""
    company, group = F.coalesce("detected_company", F.lit("")), F.coalesce("detected_group", F.lit(""))
    vendor = C.has_any(F.lower(company), vendors, lower=True)
    about, noise = company.startswith("关于"), F.length(company) > 60
    step = df.withColumn("__fix", C.first_of([(vendor, "vendor"), (about, "prefix"), (noise, "noise"), ((group == company) & (group != ""), "self_group")], ""))
    step = step.withColumns({
        "detected_group": C.first_of([(F.col("__fix") == "vendor", "内部文件"), (F.col("__fix") == "self_group", "其他")], F.col("detected_group")),
        "detected_company": C.first_of([(F.col("__fix") == "prefix", F.regexp_replace(company, "^关于", "")), (F.col("__fix") == "noise", "")], F.col("detected_company")),
    })
    bare = F.coalesce("detected_group", F.lit("")) == ""
    fixes = F.array_compact(F.array(F.nullif(F.col("__fix"), F.lit("")), F.when(bare, "default_group")))
    return step.withColumns({"fixes": F.array_join(fixes, "|"), "detected_group": F.when(bare, "其他").otherwise(F.col("detected_group"))}).drop("__fix")


def company_from_file(df: DataFrame) -> DataFrame:
    """The company named in the file name where the ledger's is missing, or is English and the other isn't."""
    named = C.group(F.col("file_name"), "_([^_]+)_")
    company = C.blank(F.col("detected_company"))
    take = named.isNotNull() & (company.isNull() | (C.mostly_english(company, 0.65) & ~C.mostly_english(named, 0.65)))
    return df.withColumn("detected_company", F.when(take, named).otherwise(F.col("detected_company")))


def unique_names(df: DataFrame) -> DataFrame:
    """Target names without clashes: by pos, a file whose name is taken in its folder gets _1, _2 and so on, whichever is free first.

    Only names of one root (the stem without numbers at its end) can clash, so folders are split by root. Where a root has one name, its files are numbered by a window; only roots with
    several names, one of them repeated, are worked through in order, as a sorted stream. A null name stays null.
    """
    parts = r"^(.*?)(?:_[0-9]+)*(\.[^.]*)?$"
    rooted = df.withColumn("__root", F.concat_ws("\n", F.regexp_extract("file_name", parts, 1), F.regexp_extract("file_name", parts, 2)))
    same, root = W.partitionBy("folder", "file_name"), W.partitionBy("folder", "__root")
    rooted = rooted.withColumns({"__same": F.count("*").over(same), "__nth": F.row_number().over(same.orderBy("pos")) - 1})
    several = (F.max("__same").over(root) > 1) & (F.min("file_name").over(root) != F.max("file_name").over(root))
    rooted = rooted.withColumn("__clash", F.coalesce(several, F.lit(False)))
    dot = F.length("file_name") - F.length(F.substring_index("file_name", ".", -1))
    numbered = F.when(dot > 0, F.concat(F.expr("left(file_name, length(file_name) - length(substring_index(file_name, '.', -1)) - 1)"), F.lit("_"), F.col("__nth"), F.lit("."), F.substring_index("file_name", ".", -1)))
    target = F.when(F.col("__nth") == 0, F.col("file_name")).otherwise(F.coalesce(numbered, F.concat("file_name", F.lit("_"), "__nth")))
    free = rooted.where(~F.col("__clash")).select(*df.columns, target.alias("target"))

    names = df.columns

    def run(batches):
        at, taken, after = None, set(), {}
        for batch in batches:
            out = []
            for key, name in zip(zip(batch["folder"].to_pylist(), batch["__root"].to_pylist(), strict=True), batch["file_name"].to_pylist(), strict=True):
                if key != at:
                    at, taken, after = key, set(), {}
                stem, dot, ending = name.rpartition(".")
                stem, ending = (stem, dot + ending) if dot else (name, "")
                target, n = name, after.get(name, 0)
                while target in taken:
                    n += 1
                    target = f"{stem}_{n}{ending}"
                after[name] = n
                taken.add(target)
                out.append(target)
            yield pa.record_batch([*(batch[c] for c in names), pa.array(out, pa.string())], names=[*names, "target"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ordered = rooted.where("__clash").select(*df.columns, "__root").repartition("folder", "__root").sortWithinPartitions("folder", "__root", "pos")
    return free.unionByName(ordered.mapInArrow(run, f"{kinds}, target string"))


def exact_fixes(df: DataFrame, fixes: DataFrame) -> DataFrame:
    """Companies set by exact file name (file_name, company): in the summary too, and a flag of a group conflict goes."""
    both = df.join(fixes.select("file_name", F.col("company").alias("__company")), "file_name", "left")
    old, new = F.coalesce("detected_company", F.lit("")), F.col("__company")
    summary = F.when(new.isNotNull() & (old != "") & F.col("summary").contains(old), F.replace(F.col("summary"), old, new)).otherwise(F.col("summary"))
    return both.withColumns({"summary": summary, "flags": F.when(new.isNotNull(), without_flags(F.col("flags"), "group_conflict")).otherwise(F.col("flags")), "detected_company": F.coalesce(new, "detected_company")}).select(*df.columns)


def without_flags(flags: Column, word: str) -> Column:
    return F.filter(flags, lambda f: ~f.contains(word))


def shown_flags(flags: Column, words: list[str]) -> Column:
    """The flags that hold one of the words, joined."""
    return F.array_join(F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda f: C.has_any(f, words)), "; ")


def without_prefix(name: Column, prefixes: list[str] = rules.NAME_PREFIXES) -> Column:
    """Without the longest of the prefixes that it starts with, once."""
    either = "|".join(sorted(prefixes, key=lambda p: (-len(p), p)))
    return F.trim(F.regexp_replace(name, f"^(?:{either})", ""))


def company_from_name(df: DataFrame, named: Column, vendors: list[str] = rules.VENDORS) -> DataFrame:
    """The company that the file names, in place of a vendor, of words that are no name, or of an English name if the other isn't; the summary follows. reason says which."""
    company = F.trim(F.coalesce("detected_company", F.lit("")))
    wrong = N.is_vendor(F.lower(company), vendors) | N.is_vendor_shaped(company) | company.rlike(rules.NO_COMPANY)
    reason = C.first_of([((company != "") & wrong, F.when(named != company, "VENDOR_OR_NOISE")), (C.mostly_english(company, 0.65, 1), F.when(~C.mostly_english(named, 0.65, 1), "EN_TO_CN"))])
    rows = df.withColumns({"reason": F.when(named.isNotNull(), reason), "__old": company, "__new": named})
    summary = F.when(F.col("reason").isNotNull() & F.col("summary").contains(F.col("__old")), F.replace(F.col("summary"), F.col("__old"), F.col("__new"))).otherwise(F.col("summary"))
    return rows.withColumns({"summary": summary, "detected_company": F.when(F.col("reason").isNotNull(), F.col("__new")).otherwise(F.col("detected_company"))}).drop("__old", "__new")


def company_by_group(df: DataFrame, named: Column) -> DataFrame:
    """The company that the file names where that holds the group's name (without 集团, two characters or more) and the ledger's doesn't."""
    token = F.trim(F.replace(F.coalesce("detected_group", F.lit("")), F.lit("集团"), F.lit("")))
    take = named.isNotNull() & (F.length(token) >= 2) & named.contains(token) & ~F.coalesce("detected_company", F.lit("")).contains(token)
    return df.withColumn("detected_company", F.when(F.coalesce(take, F.lit(False)), named).otherwise(F.col("detected_company")))


def move_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """pos, source and target folder (group and year; no year for 其他 and 内部文件) of the records whose folder changes."""
    return before.select("pos", _folder().alias("source")).join(after.select("pos", _folder().alias("target")), "pos").where("source <> target")


def year_moves(df: DataFrame) -> DataFrame:
    """move_plan() of the year repair, in one pass: both folders of a record stand in its row."""
    rows = fix_years(df.withColumn("__year", F.col("report_year")))
    return rows.select("pos", _folder("__year").alias("source"), _folder().alias("target")).where("source <> target")


def _folder(year: str = "report_year") -> Column:
    g = C.safe_name(F.col("detected_group"), "未分组")
    return F.when(F.col("detected_group").isin("其他", "内部文件"), g).otherwise(F.concat(g, F.lit("/"), F.coalesce(F.col(year).cast("string"), F.lit("未知年份"))))
