"""Finding a document's company: by aliases in file name and text, then by names written there, in layers of falling scores.

aliases is (pos, standard, alias): every standard name is also an alias of itself, and pos is the order in which they are tried. Substring matches are
joined on shared n-grams (resolve.contained), so that texts don't meet every alias.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C
from dossier.functions import names as N
from dossier.operators import resolve
from dossier.operators.assemble import _written
from dossier.operators.resolve import spread

LAYERS = [("file", 92, 88), ("bilingual", 90, 84), ("context", 86, 80), ("general", 68, 60)]


def _keyed(aliases: DataFrame, vendors: list[str]) -> DataFrame:
    key = F.lower(N.legacy_company(F.col("alias")))
    return aliases.select("pos", "standard", "alias", key.alias("key")).where("key <> ''").withColumn("vendor", N.is_vendor(F.col("key"), vendors))


def _firsts(aliases: DataFrame) -> DataFrame:
    """Of the aliases with one key the first by pos: what all of them are found in is that one's."""
    key = F.lower(N.legacy_company(F.col("alias")))
    return aliases.select("pos", "standard", "alias").groupBy(key.alias("key")).agg(F.min_by(F.struct("pos", "standard", "alias"), "pos").alias("a")).select("a.*")


def _contents(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Documents (id, text, file_name) of equal text and file name once, under one of their ids, and what gives all of them what is found for that one."""
    first = docs.groupBy("text", "file_name").agg(F.min("id").alias("id"))

    def given(found: DataFrame) -> DataFrame:
        each = first.join(found, "id").select(F.col("text").alias("__text"), F.col("file_name").alias("__file"), "company", "alias", "score")
        rows = docs.join(each, F.col("text").eqNullSafe(F.col("__text")) & F.col("file_name").eqNullSafe(F.col("__file")), "left")
        return rows.select("id", F.coalesce("company", F.lit("")).alias("company"), F.coalesce("alias", F.lit("")).alias("alias"), F.coalesce("score", F.lit(0)).alias("score"))

    return resolve.spread(first, "text", "file_name"), given


def _mutual(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (key, name) of which one contains the other."""
    one = resolve.contained(keys.select(F.col("key").alias("text")), names.select("name")).select(F.col("text").alias("key"), "name")
    other = resolve.contained(names.select(F.col("name").alias("text")), keys.select(F.col("key").alias("name"))).select(F.col("name").alias("key"), F.col("text").alias("name"))
    return one.unionByName(other).distinct()


def match_alias(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """candidates (candidate) with standard: that of the first alias that is, contains or lies in the candidate; null without one."""
    asked = candidates.select("candidate").distinct().withColumn("key", F.lower(N.legacy_company(F.col("candidate")))).where("key <> ''")
    known = _keyed(_firsts(aliases), [])
    pairs = _mutual(asked.select("key").distinct(), known.select(F.col("key").alias("name")).distinct())
    hit = asked.join(pairs, "key").join(known.select(F.col("key").alias("name"), "pos", "standard"), "name").groupBy("candidate").agg(F.min_by("standard", "pos").alias("standard"))
    return candidates.join(hit, "candidate", "left")


def alias_hits(docs: DataFrame, aliases: DataFrame, vendors: list[str] = rules.VENDORS, file_key=None) -> DataFrame:
    """id, pos, standard, alias, vendor, in_file and in_text of every alias that a document (id, text, file_name) holds."""
    known = _keyed(aliases, vendors)
    keys = known.select(F.col("key").alias("name")).distinct()
    each = docs.select("id", (F.lower(N.legacy_company(F.col("file_name"))) if file_key is None else file_key).alias("f"), F.lower(N.legacy_company(F.col("text"))).alias("t"))
    found = None
    for column, place in (("f", "in_file"), ("t", "in_text")):
        texts = each.select("id", F.col(column).alias("text"))
        one = texts.join(resolve.contained(texts, keys), "text").select("id", "name", F.lit(place).alias("place"))
        found = one if found is None else found.unionByName(one)
    both = found.groupBy("id", "name").agg(F.bool_or(F.col("place") == "in_file").alias("in_file"), F.bool_or(F.col("place") == "in_text").alias("in_text"))
    return both.join(known.withColumnRenamed("key", "name"), "name").select("id", "pos", "standard", "alias", "vendor", "in_file", "in_text")


def _best(score, least: float):
    """The best hit of a group, the first by pos on ties, if it reaches the least score."""
    fits = (score > 0) & (score >= least)
    return F.min_by(F.when(fits, F.struct(F.col("standard").alias("company"), "alias", score.cast("int").alias("score"))), F.when(fits, F.struct(-score, F.col("pos"))))


def _choice(docs: DataFrame, steps: DataFrame) -> DataFrame:
    """id with the company, alias and score of its first step; empty and 0 without one. steps: (id, step, company, alias, score)."""
    got = steps.groupBy("id").agg(F.min_by(F.struct("company", "alias", "score"), "step").alias("g"))
    return docs.select("id").join(got, "id", "left").select("id", F.coalesce("g.company", F.lit("")).alias("company"), F.coalesce("g.alias", F.lit("")).alias("alias"), F.coalesce("g.score", F.lit(0)).alias("score"))


def written(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, layer, company, alias and score of the names written in each layer: the first that an alias knows (of the file name's the first only), else the first."""
    lists = [("file", N.names_in_file(F.col("file_name"))), ("bilingual", N.names_bilingual(F.col("text"))), ("context", N.names_by_context(F.col("text"))), ("general", N.names_in(F.coalesce("text", F.lit(""))))]
    each = F.array(*[F.struct(F.lit(name).alias("layer"), found.alias("names")) for name, found in lists])
    rows = docs.select("id", F.explode(each).alias("l")).select("id", "l.layer", F.posexplode("l.names").alias("i", "candidate")).where("layer <> 'file' or i = 0")
    rows = match_alias(rows, aliases)
    pick = rows.groupBy("id", "layer").agg(F.min_by(F.struct("standard", "candidate"), F.struct(F.col("standard").isNull(), "i")).alias("p"))
    known = F.col("p.standard").isNotNull()
    score = C.first_of([((F.col("layer") == n) & known, a) for n, a, _ in LAYERS] + [(F.col("layer") == n, b) for n, _, b in LAYERS])
    return pick.select("id", "layer", F.coalesce("p.standard", "p.candidate").alias("company"), F.col("p.candidate").alias("alias"), score.alias("score"))


def find(docs: DataFrame, aliases: DataFrame, vendors: list[str] = rules.VENDORS) -> DataFrame:
    """id, company, alias and score (empty and 0 if nothing was found) of every document (id, text, file_name).

    In turn: aliases in file name (95) and text (70), vendors' less 80, from 75 on; names in the file name; in bilingual contracts; by context; aliases in the text (72) from 50
    on; any name in the text.
    """
    aliases = _firsts(aliases)
    docs, given = _contents(docs)
    less = F.when(F.col("vendor"), 80).otherwise(0)
    first = _best(F.when(F.col("in_file"), 95).otherwise(0) + F.when(F.col("in_text"), 70).otherwise(0) - less, 75)
    later = _best(F.when(F.col("in_text"), 72).otherwise(0) - less, 50)
    hits = alias_hits(docs, aliases, vendors).groupBy("id").agg(first.alias("first"), later.alias("later"))
    by_alias = hits.select("id", F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("first").alias("b")), F.struct(F.lit(4).alias("step"), F.col("later").alias("b")))).alias("s")).select("id", "s.step", "s.b.*").where("company is not null")
    step = C.first_of([(F.col("layer") == n, i) for i, n in ((1, "file"), (2, "bilingual"), (3, "context"), (5, "general"))])
    return given(_choice(docs, by_alias.unionByName(written(docs, aliases).select("id", step.alias("step"), "company", "alias", "score"))))


def find_for_group(docs: DataFrame, aliases: DataFrame, vendors: list[str] = rules.VENDORS) -> DataFrame:
    """As find(), for one group: aliases in the file's stem (95), else in the text (70), from 70 on; the file name's first name (80); the first by context (70); a piece
    of the stem that an alias holds (60)."""
    aliases = _firsts(aliases)
    docs, given = _contents(docs)
    stem = F.regexp_replace(F.col("file_name"), r"(?<=.)\.[^.]*$", "")
    score = F.when(F.col("in_file"), 95).otherwise(70) - F.when(F.col("vendor"), 80).otherwise(0)
    first = alias_hits(docs, aliases, vendors, F.translate(F.lower(stem), "（）", "()")).groupBy("id").agg(_best(score, 70).alias("b")).select("id", "b.*").where("company is not null")
    lists = docs.select("id", F.get(N.names_in_file(F.col("file_name")), F.lit(0)).alias("f"), F.get(N.names_by_context(F.col("text"), parties=False), F.lit(0)).alias("c"))
    by_name = lists.select("id", F.coalesce("f", "c").alias("company"), F.coalesce("f", "c").alias("alias"), F.when(F.col("f").isNotNull(), 80).otherwise(70).alias("score")).where("company is not null")
    pieces = docs.select("id", F.posexplode(F.split(stem, r"[_\s\-·]+")).alias("i", "part")).where(F.length("part") >= 4).withColumn("text", F.translate(F.lower("part"), "（）", "()")).where(~N.is_vendor(F.col("text"), vendors))
    known = _keyed(aliases, vendors)
    inside = resolve.contained(known.select(F.col("key").alias("text")), pieces.select(F.col("text").alias("name")).distinct()).select(F.col("text").alias("key"), F.col("name").alias("text"))
    by_piece = pieces.join(inside, "text").join(known.select("key", "pos", "standard"), "key").groupBy("id").agg(F.min_by(F.struct("standard", "part"), F.struct("i", "pos")).alias("p")).select("id", F.col("p.standard").alias("company"), F.col("p.part").alias("alias"), F.lit(60).alias("score"))
    each = [df.select("id", F.lit(i).alias("step"), "company", "alias", "score") for i, df in enumerate((first, by_name, by_piece))]
    return given(_choice(docs, each[0].unionByName(each[1]).unionByName(each[2])))


def prefer_chinese(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """found (id, company, alias) with shown: the company if it is Chinese, else its alias if that is, else the first Chinese standard name that an alias match gives, else the company."""
    chinese = aliases.where(N.has_chinese(F.col("standard")))
    matched = match_alias(found.select(F.col("company").alias("candidate")).distinct(), chinese).select(F.col("candidate").alias("company"), "standard")
    shown = C.first_of([(N.has_chinese(F.col("company")), F.col("company")), (N.has_chinese(F.col("alias")), F.col("alias"))], F.coalesce("standard", "company"))
    return found.join(matched, "company", "left").select("id", "company", "alias", shown.alias("shown"))


def legacy_group(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """names (name) with group_name by the older matching: equal names (cities aside) or aliases, then names that contain each other (4 characters or more), then
    aliases and group names that do; within each the first group by its least pos. mapping: (pos, name, group_name, short_name)."""
    n = F.col("name")
    groups = mapping.groupBy("group_name").agg(F.min("pos").alias("place"))
    asked = _written(spread(names.select("name").distinct(), "name").withColumns({"key": N.legacy_key(n), "bare": N.legacy_key(N.legacy_city(n))}).where("key <> ''"))
    forms = F.array(*[F.struct(F.lit(kind).alias("kind"), k.alias("k")) for kind, k in (("firm", N.legacy_key(n)), ("bare", F.when(N.legacy_key(n) != "", N.legacy_key(N.legacy_city(n)))), ("short", N.legacy_key(F.col("short_name"))), ("title", N.legacy_key(F.col("group_name"))))])
    each = spread(mapping.select("name", "short_name", "group_name").distinct(), "name").select("group_name", F.explode(forms).alias("f")).select("group_name", "f.*").where("k <> '' and (kind in ('firm', 'bare') or length(k) >= 4)")
    known = _written(each.distinct())

    # texts and names are put into their forms once; what grows with the mapping is merged, never sent whole to all tasks
    tried = asked.select("name", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("k")) for kind, c in (("firm", "key"), ("bare", "bare"), ("short", "key"))])).alias("t")).select("name", "t.*").where("k <> ''")
    equal = tried.join(known.hint("merge"), ["kind", "k"]).select("name", "group_name", F.lit(0).alias("rank"))
    within = known.where("kind <> 'bare' and length(k) >= 4")
    long, few = F.length("key") >= 4, F.length("key") < 4
    pairs = _mutual(asked.where(long).select("key").distinct(), within.select(F.col("k").alias("name")).distinct())
    pairs = pairs.unionByName(_mutual(asked.where(few).select("key").distinct(), within.where("kind = 'title'").select(F.col("k").alias("name")).distinct()))
    rank = F.when(F.col("kind") == "firm", 1).otherwise(2).alias("rank")
    inside = pairs.withColumnRenamed("name", "k").join(within.hint("merge"), "k").where(long | (F.col("kind") == "title")).select("key", "group_name", rank).distinct()
    hits = equal.unionByName(asked.select("name", "key").join(inside.hint("merge"), "key").select("name", "group_name", "rank"))
    best = hits.join(groups.hint("merge"), "group_name").groupBy("name").agg(F.min_by("group_name", F.struct("rank", "place")).alias("group_name"))
    return names.join(best.hint("merge"), "name", "left")


def choose_group(asked: DataFrame, groups: DataFrame) -> DataFrame:
    """asked (answer) with group_name: by its number in sorted order (from 1), by its name, or the only one that contains it or lies in it; null otherwise. groups: (group_name).

    Numbers are given by a sort of the group names, of which there are few."""
    from pyspark.sql import Window as W

    numbered = groups.select("group_name").distinct().withColumn("n", F.row_number().over(W.orderBy("group_name")))
    answers = asked.select("answer").distinct().withColumn("key", F.trim("answer"))
    by_number = answers.where(F.col("key").rlike("^[0-9]+$")).join(numbered, F.col("key").try_cast("int") == F.col("n")).select("answer", "group_name", F.lit(0).alias("rank"))
    words = answers.where(~F.col("key").rlike("^[0-9]+$") & (F.col("key") != ""))
    by_name = words.join(numbered, F.col("key") == F.col("group_name")).select("answer", "group_name", F.lit(1).alias("rank"))
    near = words.join(_mutual(words.select("key").distinct(), numbered.select(F.col("group_name").alias("name"))).withColumnRenamed("name", "group_name"), "key")
    only = near.groupBy("answer").agg(F.min("group_name").alias("group_name"), F.count("*").alias("c")).where("c = 1").select("answer", "group_name", F.lit(2).alias("rank"))
    best = by_number.unionByName(by_name).unionByName(only).groupBy("answer").agg(F.min_by("group_name", "rank").alias("group_name"))
    return asked.join(best, "answer", "left")
