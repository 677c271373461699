"""Queries that look for a mapping's names and keywords in names, file names and fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import dictionary, resolve
from dossier.plans.queries import _norm, _strip, quoted, query, table

_LETTERS, _SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥金木水火土"
_CORE = f"concat(translate(substr(p_brand, 7), '12345', '东南西北中'), translate(p_type, '{_LETTERS}', '{_SIGNS}'))"
#: A mapping of 200,000 rows a scale: Chinese names by brand, some with cities, codes and short names.
_KNOWN = f"""SELECT CAST(p_partkey AS bigint) AS pos, concat({_CORE}, CASE p_partkey % 4 WHEN 0 THEN '有限公司' WHEN 1 THEN '（上海）有限公司' WHEN 2 THEN '-legris' ELSE '股份有限公司' END) AS name,
p_brand AS group_name, CASE p_partkey % 5 WHEN 0 THEN concat('Ax', CAST(p_size AS string), ' ') WHEN 1 THEN substr({_CORE}, 1, 7) ELSE '' END AS short_name FROM part"""
_ASKED = f"""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN concat('新', substr({_CORE}, 1, 8), '贸易') WHEN 1 THEN concat('re ', lower(p_brand), ' x') WHEN 2 THEN concat('拟ax', CAST(p_size AS string), '采购')
WHEN 3 THEN concat('青岛', {_CORE}, '有限公司') WHEN 4 THEN concat({_CORE}, '-legris') ELSE p_name END AS name FROM part"""
_FILES = f"""SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN concat('维护合同_', {_CORE}, '（上海）有限公司_2021.pdf') WHEN 1 THEN concat('SRF ', p_brand, '.pdf') WHEN 2 THEN concat('AX', CAST(p_size AS string), ' quote.pdf') WHEN 3 THEN concat('合同AX', CAST(p_size AS string), '.pdf')
WHEN 4 THEN concat('a_ax', CAST(p_size AS string), '-1.pdf') ELSE concat('报价单_', substr({_CORE}, 1, 9), '.pdf') END AS file_name FROM part"""

_CODE = lambda x: f"trim(regexp_replace({x}, '(?:[-_][A-Za-z]+(?:\\([0-9]+\\))?|\\([0-9]{{3,}}\\))$', ''))"
_EXACT = f"""m AS ({_KNOWN}), e0 AS (SELECT pos, 0 AS form, name AS key, group_name FROM m UNION ALL SELECT pos, 1, {_norm('name')}, group_name FROM m UNION ALL SELECT pos, 2, {_CODE('name')}, group_name FROM m UNION ALL SELECT pos, 3, {_norm(_CODE('name'))}, group_name FROM m
UNION ALL SELECT pos, 4, {_strip('name')}, group_name FROM m UNION ALL SELECT pos, 5, {_CODE(_strip('name'))}, group_name FROM m UNION ALL SELECT pos, 6, {_norm(_CODE(_strip('name')))}, group_name FROM m),
exact AS (SELECT key, arg_max(group_name, pos * 10 + form) AS group_name, min(pos * 10 + form) AS place FROM e0 WHERE key <> '' GROUP BY 1)"""
_ENDS = lambda x: "CASE " + " ".join(f"WHEN ends_with({x}, '{e}') THEN substr({x}, 1, length({x}) - {len(e)})" for e in dictionary.ENDINGS) + f" ELSE {x} END"
_KEYWORDS = f"""{_EXACT}, g AS (SELECT group_name, min(pos) AS gp FROM m GROUP BY 1),
a0 AS (SELECT pos * 10 AS p, short_name AS alias, group_name FROM m WHERE trim(short_name) <> '' UNION ALL SELECT pos * 10 + 1, {_norm('short_name')}, group_name FROM m WHERE trim(short_name) <> ''),
a1 AS (SELECT alias, arg_max(group_name, p) AS group_name, min(p) AS p FROM a0 GROUP BY 1),
w0 AS (SELECT pos, gp, group_name, 0 AS form, {_CODE(_norm('name'))} AS t FROM m JOIN g USING (group_name) UNION ALL SELECT pos, gp, group_name, 1, {_CODE('short_name')} FROM m JOIN g USING (group_name) WHERE trim(short_name) <> ''),
w AS (SELECT *, {_ENDS('t')} AS core FROM w0), s0 AS (SELECT *, substr(core, CAST(i AS BIGINT), CAST(k AS BIGINT)) AS gram FROM w, range(5, 9) AS a(k), range(1, 60) AS b(i) WHERE i + k - 1 <= length(core)),
s1 AS (SELECT gram, min(group_name) AS group_name, min([2, gp, pos, form, k, i]) AS place FROM s0 WHERE gram NOT IN ({quoted(dictionary.NO_KEYWORDS)}) AND length(regexp_replace(gram, '[^一-龥]', '', 'g')) >= 0.6 * length(gram) GROUP BY 1 HAVING min(group_name) = max(group_name) AND count(*) >= 3),
k0 AS (SELECT lower(group_name) AS key, group_name, [0, gp] AS place FROM g WHERE length(group_name) >= 3 UNION ALL SELECT lower(trim(alias)), group_name, [1, p] FROM a1 WHERE length(trim(alias)) >= 3 AND NOT regexp_matches(alias, '[^\\x00-\\x7F]') UNION ALL SELECT lower(gram), group_name, place FROM s1),
k AS (SELECT key, arg_min(group_name, place) AS group_name, min(place) AS place FROM k0 GROUP BY 1)"""
_FILE_TEXT = "lower(translate(file_name, '（）', '()'))"


def _known(spark, d):
    return spark.sql(_KNOWN.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))


def _of_part(spark, d, sql):
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))


@query(f"WITH {_KEYWORDS} SELECT key, group_name FROM k")
def keyword_rows(spark, d):
    return dictionary.keyword_rows(_known(spark, d)).select("key", "group_name")


@query(f"""WITH {_KEYWORDS}, q AS ({_ASKED}), al AS (SELECT alias, group_name FROM a1),
t AS (SELECT DISTINCT name, {_norm('name')} AS n, {_strip('name')} AS s FROM q), hit AS (SELECT name, arg_min(k.group_name, {{'a': -length(key), 'b': k.place}}) AS group_name FROM t JOIN k ON contains(lower(n), key) GROUP BY 1)
SELECT id, q.name, coalesce(e1.group_name, e2.group_name, al1.group_name, al2.group_name, e3.group_name, e4.group_name, hit.group_name) AS group_name FROM q JOIN t USING (name) LEFT JOIN exact e1 ON e1.key = q.name LEFT JOIN exact e2 ON e2.key = n
LEFT JOIN al al1 ON al1.alias = q.name LEFT JOIN al al2 ON al2.alias = n LEFT JOIN exact e3 ON e3.key = s LEFT JOIN exact e4 ON e4.key = {_norm('s')} LEFT JOIN hit ON hit.name = q.name""")
def map_keyword(spark, d):
    return dictionary.map_to_group(_of_part(spark, d, _ASKED), _known(spark, d))


@query(f"""WITH {_EXACT}, f AS ({_FILES}), h AS (SELECT file_name, arg_min({{'n': key, 'g': group_name}}, {{'a': -length(key), 'b': place, 'c': key}}) AS h FROM f JOIN exact ON length(key) >= 5 AND contains({_FILE_TEXT}, lower(key)) GROUP BY 1)
SELECT file_name, h.n AS name, h.g AS group_name FROM f LEFT JOIN h USING (file_name)""")
def company_in_file(spark, d):
    return dictionary.company_in_file(_of_part(spark, d, _FILES), dictionary.known_names(_known(spark, d)))


@query(f"""WITH {_KEYWORDS}, f AS ({_FILES}), h AS (SELECT file_name, arg_min(group_name, {{'a': -length(key), 'b': place, 'c': key}}) AS g FROM f JOIN exact ON length(key) >= 5 AND contains({_FILE_TEXT}, lower(key)) GROUP BY 1),
r AS (SELECT file_name, arg_min(group_name, {{'a': -length(key), 'b': place}}) AS g FROM f JOIN k ON contains({_FILE_TEXT}, key) AND (regexp_matches(key, '[^\\x00-\\x7F]') OR regexp_matches({_FILE_TEXT}, '(?:^|[^\\p{{L}}\\p{{N}}_])' || replace(key, '#', '[#]') || '(?:$|[^\\p{{L}}\\p{{N}}_])')) GROUP BY 1)
SELECT file_name, coalesce(h.g, r.g) AS group_name FROM f LEFT JOIN h USING (file_name) LEFT JOIN r USING (file_name)""")
def map_file_name(spark, d):
    known = _known(spark, d)
    return dictionary.map_by_file(_of_part(spark, d, _FILES), dictionary.known_names(known), dictionary.keyword_rows(known))


_PIECES = f"""SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN substr({_CORE}, 3, 6) WHEN 1 THEN concat(substr({_CORE}, 1, 5), '（上海）') WHEN 2 THEN concat(substr({_CORE}, 4, 4), '(', substr({_CORE}, 9, 3), ')有限') WHEN 3 THEN concat('有限(', substr({_CORE}, 1, 2), ')') ELSE substr(p_name, 1, 3) END AS fragment FROM part"""


@query(f"""WITH m AS ({_KNOWN}), f AS ({_PIECES}), p AS (SELECT fragment, lower(translate(fragment, '（）', '()')) AS low FROM f WHERE length(fragment) >= 4), t AS (SELECT *, list_filter(list_transform(regexp_split_to_array(low, '[()]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM p),
n AS (SELECT pos, name, lower(translate(name, '（）', '()')) AS low FROM m WHERE length(name) >= 4),
h AS (SELECT fragment, arg_min(name, {{'a': length(name), 'b': -pos}}) AS name FROM t JOIN n ON contains(n.low, t.low) OR (len(parts) >= 2 AND len(list_filter(parts, lambda x: contains(n.low, x))) = len(parts)) GROUP BY 1) SELECT fragment, name FROM f LEFT JOIN h USING (fragment)""")
def fragment_tokens(spark, d):
    return dictionary.by_fragment(_of_part(spark, d, _PIECES), _known(spark, d))


@query()
def fuzzy_groups(spark, d):
    part = table(spark, d, "part")
    asked = part.select(F.concat(F.expr("substr(p_name, 1, length(p_name) - 1)"), F.lit("e")).alias("name")).distinct()
    return resolve.fuzzy_group(asked, part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_brand").alias("group_name")), 85.0)
