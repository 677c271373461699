"""Many patterns in many texts: an automaton of a dictionary of checked size goes over each text once and gives the longest pattern in it.

Patterns are (key, place, ...): key is what must stand in the text, place an array of numbers that says which comes first on ties of length. A dictionary of up to `most` bytes is one automaton that every task gets; a larger
one is parted by hash into sets of that size, each goes over the texts by itself, and the best of all sets counts, so that the result is the same at any size.

Null and empty texts, and empty keys, match nothing. Repeated texts are looked at once. Ties go to the least place, then to the least key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C
from dossier.functions import names as N
from dossier.operators.resolve import spread

#: Bytes of keys in one automaton, which takes some fifty times as much.
DICTIONARY_BYTES = 4 << 20
ENDINGS = ["有限公司", "有限责任公司", "股份有限公司", "集团", "控股"]
#: N-grams that say nothing about a group.
NO_KEYWORDS = ["有限公司", "有限责任", "股份有限", "有限责任公司", "股份有限公司", "集团", "控股", "中国", "上海", "北京", "广州", "深圳", "天津", "无锡", "成都", "武汉", "南京", "杭州", "沈阳"]


def _word_edge(text: str, at: int) -> bool:
    """Whether a word begins or ends before a place in the text."""
    inside = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    return inside(at - 1) != inside(at)


def _scan(texts: DataFrame, keys: list[tuple[str, list[int]]], edges: bool) -> DataFrame:
    """text, key and place of each text's longest key. edges: keys of ASCII characters must begin and end where words do."""
    import ahocorasick
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        automaton = ahocorasick.Automaton()
        for key, place in shared.value:
            automaton.add_word(key, (-len(key), place, key, edges and key.isascii()))
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                best = None
                for end, hit in automaton.iter(text) if shared.value and text else ():
                    if (best is None or hit < best) and not (hit[3] and not (_word_edge(text, end + 1 + hit[0]) and _word_edge(text, end + 1))):
                        best = hit
                if best:
                    found.append((text, best[2], best[1]))
            yield pa.record_batch([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.int64()))], ["text", "key", "place"])

    return texts.select("text").mapInArrow(run, "text string, key string, place array<long>")


def longest_keys(texts: DataFrame, patterns: DataFrame, edges: bool = False, most: int = DICTIONARY_BYTES) -> DataFrame:
    """text and key of every distinct text (text) in which one of the patterns (key, place) stands: the longest one, the first by place on ties."""
    distinct = texts.select("text").where(F.length("text") > 0).distinct()
    keys = patterns.where(F.length("key") > 0).groupBy("key").agg(F.min(F.col("place").cast("array<long>")).alias("place"))
    size = keys.agg(F.sum(F.octet_length("key") + 1)).first()[0] or 0
    sets = max(1, -(-size // most))
    parts = None
    for i in range(sets):
        some = [(r.key, list(r.place)) for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(sets)) == i).toLocalIterator()]  # of `most` bytes or so
        part = _scan(distinct, some, edges)
        parts = part if parts is None else parts.unionByName(part)
    if sets == 1:
        return parts.select("text", "key")
    return parts.groupBy("text").agg(F.min_by("key", F.struct(-F.length("key"), "place", "key")).alias("key"))


# -- what a mapping (pos, name, group_name, short_name) gives to look for ------------------------------------------------


def _rows(mapping: DataFrame) -> DataFrame:
    """The mapping's usable rows, equal ones once with how many (n) there are and where the first and the last stand (pos, last), with the place at which their group first stands."""
    rows = mapping.where(C.blank(F.col("name")).isNotNull() & C.blank(F.col("group_name")).isNotNull()).select("pos", "name", "group_name", C.blank(F.col("short_name")).alias("short"))
    rows = rows.groupBy("name", "group_name", "short").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"), F.count("*").alias("n"))
    return rows.join(rows.groupBy("group_name").agg(F.min("pos").alias("group_pos")), "group_name")


def known_names(mapping: DataFrame) -> DataFrame:
    """(key, group_name, place): names as they are, in their normal forms, without codes and without cities. A key stands where it first came and has the group that came last."""
    n = F.col("name")
    plain, bare = N.without_code(n), C.strip_city(n)
    forms = F.array(n, C.normalize_company(n), plain, C.normalize_company(plain), bare, N.without_code(bare), C.normalize_company(N.without_code(bare)))
    once = mapping.where(C.blank(n).isNotNull() & C.blank(F.col("group_name")).isNotNull()).groupBy("name", "group_name").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"))  # equal rows are put into their forms once
    each = spread(once, "name").select("pos", "last", "group_name", F.posexplode(forms).alias("form", "key")).where(F.length("key") > 0)
    return each.groupBy("key").agg(F.max_by("group_name", F.struct("last", "form")).alias("group_name"), F.array(F.min(F.struct("pos", "form"))["pos"], F.min(F.struct("pos", "form"))["form"].cast("long")).alias("place"))


def keyword_rows(mapping: DataFrame, low: int = 5, high: int = 8, least: int = 3) -> DataFrame:
    """(key, group_name, place), lower-cased: groups' names of three characters or more, then such short names of ASCII characters, then n-grams that stand in names of one group only, `least` times or more.

    N-grams are taken from names and short names without codes and endings, if at least 0.6 of their characters are Chinese. A key counts for what gives it first; a short name has the group that came last.
    """
    rows = _rows(mapping)
    own = rows.select(F.lower("group_name").alias("key"), "group_name", F.array(F.lit(0), F.col("group_pos")).alias("place")).where(F.length("group_name") >= 3)

    forms = rows.where("short is not null").select("pos", "last", "group_name", F.posexplode(F.array("short", C.normalize_company(F.col("short")))).alias("form", "alias"))
    alias = forms.groupBy("alias").agg(F.max_by("group_name", F.struct("last", "form")).alias("group_name"), F.min(F.struct("pos", "form")).alias("first"))
    key = F.lower(F.trim("alias"))
    short = alias.select(key.alias("key"), "group_name", F.array(F.lit(1), F.col("first.pos"), F.col("first.form").cast("long")).alias("place")).where((F.length("key") >= 3) & ~F.col("key").rlike(r"[^\x00-\x7F]"))

    written = spread(rows, "name").select("pos", "n", "group_pos", "group_name", F.posexplode(F.array(C.normalize_company(F.col("name")), F.col("short"))).alias("form", "text")).where("text is not null")
    core = F.trim(N.without_code(F.col("text")))
    core = C.first_of([(core.endswith(e), F.substring(core, F.lit(1), F.length(core) - len(e))) for e in ENDINGS], core)
    starts = lambda k: F.when(F.length("core") >= k, F.transform(F.sequence(F.lit(1), F.length("core") - k + 1), lambda i: F.struct(k.cast("long").alias("k"), i.cast("long").alias("i"), F.substring(F.col("core"), i, k).alias("gram")))).otherwise(F.array().cast("array<struct<k:bigint,i:bigint,gram:string>>"))
    # texts that several rows give are cut up once, for the first row by pos and form
    texts = written.withColumn("core", core).groupBy("group_name", "core").agg(F.min(F.struct("group_pos", "pos", "form")).alias("first"), F.sum("n").alias("n"))
    grams = spread(texts, "core").select("first.*", "group_name", "n", F.explode(F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), starts))).alias("g"))
    chinese = F.length(F.regexp_replace("g.gram", "[^一-龥]", ""))
    grams = grams.where(~F.col("g.gram").isin(NO_KEYWORDS) & (chinese >= 0.6 * F.length("g.gram")))
    place = F.array(F.lit(2), F.col("group_pos"), F.col("pos"), F.col("form").cast("long"), F.col("g.k"), F.col("g.i"))
    shared = grams.groupBy(F.col("g.gram").alias("gram")).agg(F.min("group_name").alias("group_name"), F.max("group_name").alias("other"), F.sum("n").alias("n"), F.min(place).alias("place"))
    shared = shared.where((F.col("group_name") == F.col("other")) & (F.col("n") >= least)).select(F.lower("gram").alias("key"), "group_name", "place")

    return own.unionByName(short).unionByName(shared).groupBy("key").agg(F.min_by("group_name", "place").alias("group_name"), F.min("place").alias("place"))


def _given(df: DataFrame, column: str, text: Column, hits: DataFrame, *more: str) -> DataFrame:
    """df with the columns more of the hits for its text."""
    return df.withColumn("__text", text).join(hits.select(F.col("text").alias("__text"), *more), "__text", "left").drop("__text")


def map_by_keyword(names: DataFrame, keywords: DataFrame, most: int = DICTIONARY_BYTES) -> DataFrame:
    """names (name) with group_name: that of the longest keyword (key, group_name, place) in the name's lower-cased normal form."""
    text = F.lower(C.normalize_company(F.col("name")))
    hits = longest_keys(names.select(text.alias("text")), keywords, most=most).join(keywords.select("key", "group_name"), "key")
    return _given(names, "name", text, hits, "group_name")


def _file_text(column: str) -> Column:
    return F.lower(F.translate(F.col(column), "（）", "()"))


def company_in_file(files: DataFrame, known: DataFrame, least: int = 5, most: int = DICTIONARY_BYTES) -> DataFrame:
    """files (file_name) with name and group_name of the longest known name (key, group_name, place) of `least` characters or more that stands in the file's name, whatever its case and kind of brackets."""
    keys = known.where(F.length("key") >= least).select("key", "group_name", "place", F.lower("key").alias("low"))
    hits = longest_keys(files.select(_file_text("file_name").alias("text")), keys.select(F.col("low").alias("key"), "place"), most=most)
    first = keys.groupBy("low").agg(F.min_by(F.struct("key", "group_name"), F.struct("place", "key")).alias("m"))
    hits = hits.join(first, hits["key"] == first["low"]).select("text", F.col("m.key").alias("name"), F.col("m.group_name").alias("group_name"))
    return _given(files, "file_name", _file_text("file_name"), hits, "name", "group_name")


def map_by_file(files: DataFrame, known: DataFrame, keywords: DataFrame, least: int = 5, most: int = DICTIONARY_BYTES) -> DataFrame:
    """files (file_name) with group_name: that of a known name in the file's name, else of the longest keyword there; ASCII keywords must stand as words."""
    hits = longest_keys(files.select(_file_text("file_name").alias("text")), keywords, edges=True, most=most).join(keywords.select("key", "group_name"), "key").withColumnRenamed("group_name", "__by_keyword")
    both = _given(company_in_file(files, known, least, most), "file_name", _file_text("file_name"), hits, "__by_keyword")
    return both.withColumn("group_name", F.coalesce("group_name", "__by_keyword")).drop("__by_keyword", "name")


# -- fragments --------------------------------------------------------------------------------------------------------

GRAM = 4


def _form(column: str) -> Column:
    return F.lower(F.translate(F.col(column), "（）", "()"))


def _grams(text: Column, k: Column) -> Column:
    return F.when(F.length(text) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, k)))).otherwise(F.array().cast("array<string>"))


def holding_all(names: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, text): the texts of names (text) that hold all of the parts (an array) of each row of parts (id, parts).

    Texts are indexed by their substrings of up to GRAM characters. Each row is looked up under the one of its parts' n-grams that the fewest texts have; its other parts are tested on what that gives.
    A row with an n-gram that no text has is dropped at once.
    """
    indexed = names.select("text").where(F.length("text") > 0).distinct().select("text", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: _grams(F.col("text"), k)))).alias("gram"))
    asked = parts.select("id", "parts", F.explode(F.array_distinct(F.flatten(F.transform("parts", lambda p: _grams(p, F.least(F.length(p), F.lit(GRAM))))))).alias("gram"))
    wanted = asked.select("gram").distinct()
    index = indexed.join(wanted, "gram", "left_semi")
    frequency = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(frequency, "gram", "left").groupBy("id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.first("parts").alias("parts"))
    return rarest.join(index, "gram").where(F.forall("parts", lambda p: F.contains(F.col("text"), p))).select("id", "text")


def by_fragment(fragments: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """fragments (fragment) with the shortest of names (pos, name) that contains the fragment, or, where brackets part it in two pieces or more, all of its pieces; the last by pos on ties.

    Case and kind of brackets don't matter. Fragments and names under `least` characters match nothing. All pieces must stand in a name in either case, so names are looked up by these.
    """
    low = _form("fragment")
    pieces = F.array_distinct(F.filter(F.transform(F.split(low, "[()]"), lambda x: F.trim(x)), lambda x: x != ""))
    n_pieces = F.size(F.filter(F.transform(F.split(low, "[()]"), lambda x: F.trim(x)), lambda x: x != ""))
    asked = fragments.where(F.length("fragment") >= least).select("fragment").distinct().select("fragment", low.alias("low"), F.when(F.size(pieces) > 0, pieces).otherwise(F.array(low)).alias("parts"), n_pieces.alias("n_pieces"))
    known = names.where(F.length("name") >= least).select("pos", "name", _form("name").alias("text"))
    pairs = holding_all(known, asked.select(F.col("fragment").alias("id"), "parts")).withColumnRenamed("id", "fragment")
    pairs = pairs.join(asked.select("fragment", "low", "n_pieces"), "fragment").where((F.col("n_pieces") >= 2) | F.expr("contains(text, low)"))
    best = known.groupBy("text").agg(F.min_by(F.struct("name", "pos"), F.struct(F.length("name"), -F.col("pos"))).alias("m"))
    hit = pairs.join(best, "text").groupBy("fragment").agg(F.min_by("m.name", F.struct(F.length("m.name"), -F.col("m.pos"))).alias("name"))
    return fragments.join(hit, "fragment", "left")


# -- the whole cascade --------------------------------------------------------------------------------------------------


def alias_rows(mapping: DataFrame) -> DataFrame:
    """(key, group_name): short names as they are and in their normal form; the last row of a key wins."""
    rows = _rows(mapping).where("short is not null").select("last", "group_name", F.posexplode(F.array("short", C.normalize_company(F.col("short")))).alias("form", "key"))
    return rows.groupBy("key").agg(F.max_by("group_name", F.struct("last", "form")).alias("group_name"))


def map_to_group(names: DataFrame, mapping: DataFrame, keywords: DataFrame | None = None, most: int = DICTIONARY_BYTES) -> DataFrame:
    """names (name) with group_name: by the known names, by the short names, by the known names once more without the city, and, for what is left, by the longest keyword in it; null if none fits."""
    n, bare = F.col("name"), C.strip_city(F.col("name"))
    forms = F.array(n, C.normalize_company(n), n, C.normalize_company(n), bare, C.normalize_company(bare))
    tried = names.select("name").where("name is not null").distinct().select("name", F.posexplode(forms).alias("step", "key")).withColumn("kind", F.when(F.col("step").isin(2, 3), 1).otherwise(0))
    every = known_names(mapping).select("key", "group_name", F.lit(0).alias("kind")).unionByName(alias_rows(mapping).withColumn("kind", F.lit(1)))
    hit = tried.join(every, ["kind", "key"]).groupBy("name").agg(F.min_by("group_name", "step").alias("group_name"))
    rest = names.select("name").where("name is not null").distinct().join(hit.select("name"), "name", "left_anti")
    by_word = map_by_keyword(rest, keyword_rows(mapping) if keywords is None else keywords, most).where("group_name is not null")
    return names.join(hit.unionByName(by_word), "name", "left")
