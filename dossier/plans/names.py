"""Queries on names and texts: what a name means in its older forms, what a text holds, and which company a document belongs to. Inputs vary by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C
from dossier.functions import names as N
from dossier.operators import candidates, companies
from dossier.plans.queries import LEDGER, has, ledger, query, quoted, table

# -- inputs -----------------------------------------------------------------------------------------------------------

#: Customers' names in twelve odd forms; TAB, NL, WIDE and ACUTE stand for these characters.
_RAW = """SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN concat('示 例 ', CAST(c_custkey AS string), ' 厂（ 青岛 ）有 限 公 司') WHEN 1 THEN concat('  ＡＢ１＂', c_name, 'WIDE（上海）Co., Ltd.') WHEN 2 THEN concat('青岛北京', c_name, '集团有限公司-legris')
WHEN 3 THEN concat('上海示例', CAST(c_custkey AS string), '软件科技有限公司(685)') WHEN 4 THEN concat('cafeACUTE', 'TAB', 'TAB', c_name, '_维护期2020 有限公司') WHEN 5 THEN concat('《', c_mktsegment, '》【甲】', c_name, '公司(3家)') WHEN 6 THEN CASE WHEN c_custkey % 24 = 6 THEN '有限公司' ELSE concat('示例机械', CAST(c_custkey % 9 AS string), '股份公司') END WHEN 7 THEN concat(c_name, '_20210315_cn.pdf')
WHEN 8 THEN concat('示例某某', CAST(c_custkey % 5 AS string), '有限公司') WHEN 9 THEN concat('大连天津示例（大连）', c_name, '有限责任公司 升级') WHEN 10 THEN concat('‘', c_mktsegment, '’ “', c_name, '” Limited', 'NL', 'NL', 'x') ELSE concat('上海飞升', CAST(c_custkey % 3 AS string), '软件有限公司 Vendor Example') END AS raw FROM customer"""
_MARKS = [("TAB", "chr(9)", "char(9)"), ("WIDE", "'　'", "'　'"), ("ACUTE", "chr(769)", "char(769)"), ("NL", "chr(10)", "char(10)")]


def _text(sql: str, duck: bool) -> str:
    for word, for_duck, for_spark in _MARKS:
        sql = sql.replace(f"'{word}'", for_duck if duck else for_spark)
    # the marks within longer texts
    return sql.replace("WIDE", "　").replace("ACUTE", "\u0301")


def _rows(spark, d, sql, **tables):
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in tables.values():
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(_text(sql, False), **{name: table(spark, d, name) for name in tables.values()})


RAW = f"raw AS ({_text(_RAW, True)})"


def _raw(spark, d):
    return _rows(spark, d, _RAW, a="customer")


# -- SQL for the same forms, in terms of engine without lookaround ----------------------------------------------------


def _strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _legacy_text(x):
    return _strip(f"regexp_replace(regexp_replace(translate(coalesce({x}, ''), '　（）【】〈〉《》', ' ()[]()'), '[ \\t]+', ' ', 'g'), '\\n+', chr(10), 'g')")


def _compact(x):
    out = f"translate(coalesce({x}, ''), '（）〈〉', '()()')"
    for _ in range(2):  # a removal can't make room for another kind, so twice is enough for neighbours that overlap
        for a, b in (("[一-龥]", "[一-龥]"), ("[一-龥]", "[()]"), ("[()]", "[一-龥]")):
            out = f"regexp_replace({out}, '({a})\\s+({b})', '\\1\\2', 'g')"
    return out


def _company(x):
    out = f"regexp_replace(regexp_replace({_legacy_text(x)}, '\\s+', '', 'g'), '[-_－—].*$', '')"
    for tail in ("\\([0-9]+家\\)$", "\\([0-9]+\\)$", "(?i)(?:维护|项目|外包|升级|SRF|报价单|合同)$"):
        out = f"regexp_replace({out}, '{tail}', '')"
    edge = N.EDGE_MARKS.replace("'", "''")
    return f"trim(trim({out}, '{edge}'), '()')"


def _key(x):
    return f"lower(regexp_replace(translate(coalesce({x}, ''), '（）【】〈〉《》　', '()[]() '), '\\s+', '', 'g'))"


def _city(x):
    for city in N.LEGACY_CITIES:
        x = f"regexp_replace(regexp_replace({x}, '\\({city}\\)|（{city}）', '', 'g'), '^{city}', '')"
    return _strip(x)


def _is_vendor(low):
    return has(f"replace({low}, ' ', '')", [v.lower().replace(" ", "") for v in rules.VENDORS])


def _bad_form(x):
    return f"""(length({x}) < 4 OR {x} IN ({quoted(N.NO_NAMES)}) OR regexp_matches({x}, '^[()（）一-龥]{{0,3}}(?:有限公司|有限责任公司|集团|公司)$') OR {_is_vendor(f"lower({x})")} OR {has(f"replace(lower({x}), ' ', '')", N.FORM_WORDS)})"""


_WIDE = N.WIDE.replace("'", "''")
_NARROW = N.NARROW.replace("'", "''")


@query(f"WITH {RAW} SELECT id, " + _strip(f"translate(regexp_replace(translate(nfc_normalize(raw), '{_WIDE}', '{_NARROW}'), '[ \\t]+', ' ', 'g'), '‘’“”', '''''\"\"')") + " AS text FROM raw")
def text_normalize(spark, d):
    return _raw(spark, d).select("id", N.normal_text(F.col("raw")).alias("text"))


@query(f"WITH {RAW} SELECT id, {_legacy_text('raw')} AS text FROM raw")
def legacy_text(spark, d):
    return _raw(spark, d).select("id", N.legacy_text(F.col("raw")).alias("text"))


@query(f"WITH {RAW} SELECT id, {_compact('raw')} AS text FROM raw")
def cjk_compact(spark, d):
    return _raw(spark, d).select("id", N.compact_cjk(F.col("raw")).alias("text"))


@query(f"WITH {RAW} SELECT id, {_company('raw')} AS name FROM raw")
def legacy_company(spark, d):
    return _raw(spark, d).select("id", N.legacy_company(F.col("raw")).alias("name"))


@query(f"WITH {RAW} SELECT id, {_key('raw')} AS name FROM raw")
def legacy_key(spark, d):
    return _raw(spark, d).select("id", N.legacy_key(F.col("raw")).alias("name"))


@query(f"WITH {RAW} SELECT id, {_city('raw')} AS name FROM raw")
def legacy_city(spark, d):
    return _raw(spark, d).select("id", N.legacy_city(F.col("raw")).alias("name"))


@query(f"WITH {RAW} SELECT id, " + _strip("regexp_replace(raw, '(?:[-_][A-Za-z]+(?:\\([0-9]+\\))?|\\([0-9]{3,}\\))$', '')") + " AS name FROM raw")
def internal_code(spark, d):
    return _raw(spark, d).select("id", N.without_code(F.col("raw")).alias("name"))


@query(f"WITH {RAW} SELECT id, " + _strip("replace(replace(raw, '" + "', ''), '".join(rules.VENDORS) + "', '')") + " AS name FROM raw")
def vendor_strip(spark, d):
    return _raw(spark, d).select("id", N.without_vendors(F.col("raw")).alias("name"))


_TAIL = "(?i)(?:[0-9]{4}[.\\-_]?[0-9]{1,2}[.\\-_]?[0-9]{1,2}.*|维护期.*|有效期.*|[0-9]{4}[年.\\-_].*|_cn|_en|\\.pdf)$"
_T = "raw"
for _ in range(3):
    _T = f"trim(regexp_replace({_T}, '{_TAIL}', ''), ' _-&.')"


@query(f"WITH {RAW} SELECT id, {_T} AS name FROM raw WHERE NOT contains(raw, chr(10))")
def tail_strip(spark, d):
    return _raw(spark, d).where(~F.col("raw").contains("\n")).select("id", N.without_tail(F.col("raw")).alias("name"))


@query(f"""WITH {RAW}, n AS (SELECT *, {_company('raw')} AS form FROM raw) SELECT id, {has('lower(raw)', N.MARKERS)} AS marker, {_bad_form('form')} AS bad, NOT {has('raw', N.PROMPT_PARTS)} AND NOT {_bad_form('form')} AS trusted, regexp_matches(raw, '[一-龥]') AS chinese,
regexp_matches(raw, '(?i)^(?:上海|Shanghai)[^，,。]{{1,6}}[升维纬禾茵开达][^，,。]{{0,10}}(?:信息|软件|科技|技术|咨询|Information|Software)') AS shaped,
length(raw) >= 6 AND regexp_matches(raw, '^[一-龥]') AND regexp_matches(raw, '(?:有限公司|股份公司)$') AND NOT {has('lower(raw)', rules.VENDORS, lower=True)} AND NOT regexp_matches(raw, '{N.PLACEHOLDERS}') AS company FROM n""")
def name_checks(spark, d):
    c = F.col("raw")
    return _raw(spark, d).select("id", N.has_marker(c).alias("marker"), N.is_bad_candidate(c).alias("bad"), N.is_model_company(c).alias("trusted"), N.has_chinese(c).alias("chinese"), N.is_vendor_shaped(c).alias("shaped"), N.is_chinese_company(c).alias("company"))


# -- lines, versions, years -------------------------------------------------------------------------------------------

_PAGED = "SELECT doc_id, concat(coalesce(text, ''), 'NL', CASE doc_id % 4 WHEN 0 THEN '第 3 页 共 9 页' WHEN 1 THEN ' - 7 - ' WHEN 2 THEN 'Page 2 of 5' ELSE '4 / 8' END, 'NL', substr(coalesce(text, ''), 1, 30)) AS text FROM documents"
_PAGE = "(?i)^\\s*(?:第\\s*[0-9]+\\s*页\\s*(?:共\\s*[0-9]+\\s*页)?|-\\s*[0-9]+\\s*-|page\\s+[0-9]+\\s*(?:of\\s+[0-9]+)?|[0-9]+\\s*/\\s*[0-9]+)?\\s*$"


@query(f"""WITH p AS ({_text(_PAGED, True)}), l AS (SELECT doc_id, text, unnest(string_split(regexp_replace(text, '\\r\\n', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n', chr(10), 'g'), chr(10)), 1) AS i, row_number() OVER () AS r FROM p),
k AS (SELECT *, {_strip('line')} AS key FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, key ORDER BY i) AS n FROM k WHERE NOT regexp_matches({_strip('line')}, '{_PAGE}'))
SELECT p.doc_id, coalesce((SELECT string_agg(line, chr(10) ORDER BY i) FROM f WHERE f.doc_id = p.doc_id AND f.text = p.text AND n = 1), '') AS text FROM p""")
def ocr_clean(spark, d):
    return _rows(spark, d, _PAGED, a="documents").select("doc_id", N.cleaned_ocr(F.col("text")).alias("text"))


_VERSIONS = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('Formware财务 V', CAST(o_custkey % 9 AS string), '.1 说明') WHEN 1 THEN concat('系统 v', CAST(o_custkey % 7 AS string), '.0.', CAST(o_custkey % 4 AS string)) WHEN 2 THEN concat('12 V5.', CAST(o_custkey % 10 AS string), ' end') WHEN 3 THEN concat('版本：  第', CAST(o_custkey % 5 AS string), '版，后') WHEN 4 THEN concat('x9V5.1') ELSE 'none' END AS text, CASE o_orderkey % 5 WHEN 0 THEN 'ware V2.0.pdf' ELSE '合同.pdf' END AS file_name FROM orders"
_BOTH = "(file_name || chr(10) || substr(text, 1, 1500))"
_V = "V[0-9]+\\.[0-9]+(?:\\.[0-9]+)?"


def _two(word):
    return f"CASE WHEN regexp_matches({_BOTH}, '(?i)({word})\\s*({_V})') THEN regexp_extract({_BOTH}, '(?i)({word})\\s*({_V})', 1) || ' ' || regexp_extract({_BOTH}, '(?i)({word})\\s*({_V})', 2) END"


@query(f"""WITH v AS ({_VERSIONS}) SELECT id, coalesce({_two(rules.PRODUCT + '[一-龥A-Za-z]*')}, {_two('[一-龥A-Za-z]{2,20}')}, nullif(regexp_extract({_BOTH}, '(?i)(?:^|[^0-9A-Za-z_一-龥])({_V})(?:$|[^0-9A-Za-z_一-龥])', 1), ''), nullif({_strip("regexp_extract(text, '版本[：:]\\s*([^\\n，,]{1,20})', 1)")}, ''), '') AS version FROM v""")
def software_version(spark, d):
    return _rows(spark, d, _VERSIONS, a="orders").select("id", N.software_version(F.col("text"), F.col("file_name")).alias("version"))


_FILES = "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN concat('合同_19', CAST(o_custkey % 90 + 10 AS string), '_', CAST(o_orderdate AS string)) WHEN 1 THEN concat('no 2099 ', substr(CAST(o_orderdate AS string), 1, 4), '年3月') WHEN 2 THEN concat('a20', CAST(o_custkey % 60 + 10 AS string), '.', CAST(o_custkey % 12 AS string), '.1') WHEN 3 THEN concat('2031 b20', CAST(o_custkey % 30 + 10 AS string), '_1_2') WHEN 4 THEN concat('20', CAST(o_custkey % 90 + 10 AS string), '.6月') WHEN 5 THEN concat(CAST(o_custkey AS string), '20', CAST(o_custkey % 90 + 10 AS string), '年') ELSE 'none' END AS file_name FROM orders"
_DATED = ", ".join(f"(SELECT y FROM (SELECT TRY_CAST(nullif(regexp_extract(file_name, '(20[0-9]{{2}}){rest}', 1), '') AS INT) AS y) WHERE y BETWEEN 1995 AND 2026)" for rest in ("年[0-9]{1,2}月", "\\.[0-9]{1,2}\\.[0-9]{1,2}", "\\.[0-9]{1,2}月", "_[0-9]{1,2}_[0-9]{1,2}", "年"))


@query(f"""WITH f AS ({_FILES}) SELECT id, coalesce({_DATED}, list_filter(list_transform(regexp_extract_all(file_name, '(?:19|20)[0-9]{{2}}'), lambda y: CAST(y AS INT)), lambda y: y BETWEEN 1995 AND 2026)[1]) AS file_year,
list_filter(list_transform(regexp_extract_all(file_name, '20[0-9]{{2}}'), lambda y: CAST(y AS INT)), lambda y: y BETWEEN 2000 AND 2030)[1] AS bounded_year FROM f""")
def file_years(spark, d):
    return _rows(spark, d, _FILES.replace("CAST(o_orderdate AS string)", "CAST(CAST(o_orderdate AS date) AS string)"), a="orders").select("id", N.file_year(F.col("file_name")).alias("file_year"), N.bounded_year(F.col("file_name")).alias("bounded_year"))


_DATES = "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderdate AS string) WHEN 1 THEN concat('18', CAST(o_custkey % 90 + 10 AS string), '-02-03') WHEN 2 THEN '' WHEN 3 THEN '2021-13-40' WHEN 4 THEN 'soon' ELSE concat(CAST(2035 + o_custkey % 12 AS string), '/5/6') END AS text FROM orders"


@query("WITH t AS (" + _DATES.replace("CAST(o_orderdate AS string)", "CAST(CAST(o_orderdate AS DATE) AS string)") + """), y AS (SELECT *, year(CAST(coalesce(try_strptime(text, '%Y-%m-%d'), try_strptime(text, '%Y/%m/%d')) AS DATE)) AS y FROM t)
SELECT id, CASE WHEN text = '' THEN 'empty' WHEN y IS NULL THEN 'no date' WHEN y NOT BETWEEN 1990 AND 2040 THEN 'year out of range' ELSE '' END AS problem FROM y""")
def date_problems(spark, d):
    return _rows(spark, d, _DATES.replace("CAST(o_orderdate AS string)", "CAST(CAST(o_orderdate AS date) AS string)"), a="orders").select("id", N.date_problem(F.col("text")).alias("problem"))


_DUE = "SELECT o_orderkey AS doc_id, concat(CASE o_orderkey % 5 WHEN 0 THEN '签署 不晚于 ' WHEN 1 THEN '签署日期：' WHEN 2 THEN 'Authorized before May ' WHEN 3 THEN '优惠期 签订 ' ELSE '生效 截止 ' END, CAST(CAST(o_orderdate AS date) AS string)) AS text FROM orders"


@query(f"WITH t AS ({_DUE}) SELECT doc_id, 0 AS line_no, regexp_extract(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS value, CASE doc_id % 5 WHEN 1 THEN 'sign_date' WHEN 4 THEN 'effective_date' ELSE 'date_condition' END AS label, CASE doc_id % 5 WHEN 1 THEN 0.85 ELSE 0.7 END::DOUBLE AS score FROM t")
def date_conditions(spark, d):
    return candidates.dates(_rows(spark, d, _DUE, a="orders"), 2030)


# -- candidates and companies -----------------------------------------------------------------------------------------

_DOCS = """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN concat('合同 甲方：示例', CAST(c_custkey % 40 AS string), '贸易有限公司，地址 x') WHEN 1 THEN concat('THIS IS BY AND BETWEEN: Acme', CAST(c_custkey % 30 AS string), ' Trading Co., Ltd. and 乙方示例有限公司') WHEN 2 THEN concat('合同双方：大华', CAST(c_custkey % 25 AS string), '集团 与 某方')
WHEN 3 THEN concat('报告 北方', CAST(c_custkey % 35 AS string), '重工公司 完') WHEN 4 THEN concat('Client: Beta', CAST(c_custkey % 9 AS string), ' Systems Limited; 客户 本') WHEN 5 THEN concat('文本 东方', CAST(c_custkey % 50 AS string), '厂 内') WHEN 6 THEN 'vendorexample 文本' ELSE '没有名字' END AS text,
CASE c_custkey % 5 WHEN 0 THEN concat('维护合同 示例', CAST(c_custkey % 45 AS string), '贸易有限公司.pdf') WHEN 1 THEN concat('东方', CAST(c_custkey % 60 AS string), '厂.pdf') WHEN 2 THEN 'scan.pdf' WHEN 3 THEN concat('资料_大华', CAST(c_custkey % 25 AS string), '.v2.pdf') ELSE concat('南洋', CAST(c_custkey % 15 AS string), '集团 报价.pdf') END AS file_name FROM customer"""
_ALIASES = """SELECT s_suppkey AS pos, CASE s_suppkey % 4 WHEN 0 THEN concat('示例', CAST(s_suppkey AS string), '贸易有限公司') WHEN 1 THEN concat('东方', CAST(s_suppkey AS string), '厂') WHEN 2 THEN concat('大华', CAST(s_suppkey AS string), '集团') ELSE concat('Acme', CAST(s_suppkey AS string)) END AS standard, CASE s_suppkey % 3 WHEN 0 THEN concat('Beta', CAST(s_suppkey % 9 AS string), ' Systems') WHEN 1 THEN concat('Vendor Example ', CAST(s_suppkey AS string)) ELSE concat('北方', CAST(s_suppkey AS string), '重工') END AS short_name FROM supplier"""
_EACH = f"s AS ({_ALIASES}), al AS (SELECT 2 * pos AS pos, standard, standard AS alias FROM s UNION ALL SELECT 2 * pos + 1, standard, short_name FROM s), a AS (SELECT *, lower({_company('alias')}) AS key FROM al), d AS ({_DOCS})"


def _docs(spark, d):
    return _rows(spark, d, _DOCS, a="customer")


def _aliases(spark, d):
    s = _rows(spark, d, _ALIASES, a="supplier")
    return s.select((2 * F.col("pos")).cast("long").alias("pos"), "standard", F.col("standard").alias("alias")).unionByName(s.select((2 * F.col("pos") + 1).cast("long").alias("pos"), "standard", F.col("short_name").alias("alias")))


def _good(found):
    """SQL: normalised good names of a list, each once whatever its case."""
    names = f"list_filter(list_transform({found}, lambda x: {_company('x')}), lambda c: {has('lower(c)', N.MARKERS)} AND NOT {_bad_form(_company('c'))})"
    return f"(SELECT coalesce(list(nm ORDER BY i) FILTER (rn = 1), []) FROM (SELECT nm, i, row_number() OVER (PARTITION BY lower(nm) ORDER BY i) AS rn FROM (SELECT unnest({names}) AS nm, generate_subscripts({names}, 1) AS i)))"


def _all(x, pattern):
    return f"regexp_extract_all({x}, '{pattern}', 1)"


_SP, _FS, _EN = N.SPAN, N.FILE_SPAN, N.ENGLISH_ENDING
_CH = "|".join(N.CHINESE_ENDINGS)


def _spans(x, span):
    return "flatten([" + ", ".join(_all(x, f"(?i)({span}{{4,{180 if e == _EN else 160}}}?(?:{e}))") for e in (*N.CHINESE_ENDINGS, _EN)) + "])"


_STEM = "CASE WHEN strpos(file_name, '.') > 1 THEN regexp_replace(file_name, '\\.[^.]*$', '') ELSE file_name END"
_BLOCK = "regexp_extract(text, '(?is)BY AND BETWEEN[:：\\s]*(.{0,1000}.{0,200})', 1)"
_PARTIES = "regexp_extract(text, '(?s)合同双方[：:\\s]*(.{0,400})', 1)"
_CONTEXT = "flatten([" + ", ".join(_all("text", f"(?i){w}[：:\\s]*({_SP}{{4,180}}?(?:{e}))") for w, e in (("客户", _CH), ("甲方", _CH), ("Client", _EN))) + "MORE])"
_LISTS = f"""l AS (SELECT id, text, file_name, {_good(_spans('st', _FS))} AS file, {_good(f"list_concat({_all('bl', f'(?i)({_FS}{{4,180}}?(?:{_EN}))')}, {_all('bl', f'({_SP}{{4,160}}?(?:{_CH}))')})")} AS bilingual,
{_good(_CONTEXT.replace("MORE", ", " + _all('pa', f'({_SP}{{4,160}}?(?:{_CH}))')))} AS context, {_good(_CONTEXT.replace('MORE', ''))} AS plain_context, {_good(_spans('text', _SP))} AS general FROM (SELECT *, {_compact(_legacy_text(_STEM))} AS st, {_BLOCK} AS bl, {_PARTIES} AS pa FROM d))"""


def _joined(x):
    return f"array_to_string({x}, '|')"


@query(f"WITH {_EACH}, {_LISTS} SELECT id, {_joined('file')} AS file, {_joined('bilingual')} AS bilingual, {_joined('context')} AS context, {_joined('plain_context')} AS plain_context, {_joined('general')} AS general FROM l")
def company_candidates(spark, d):
    text, name = F.col("text"), F.col("file_name")
    lists = {"file": N.names_in_file(name), "bilingual": N.names_bilingual(text), "context": N.names_by_context(text), "plain_context": N.names_by_context(text, parties=False), "general": N.names_in(text)}
    return _docs(spark, d).select("id", *[F.array_join(v, "|").alias(k) for k, v in lists.items()])


@query(f"WITH {_EACH}, {_LISTS}, c AS (SELECT DISTINCT unnest(general) AS candidate FROM l), k AS (SELECT candidate, lower({_company('candidate')}) AS key FROM c), m AS (SELECT k.candidate, arg_min(a.standard, a.pos) AS standard FROM k JOIN a ON a.key <> '' AND k.key <> '' AND (contains(a.key, k.key) OR contains(k.key, a.key)) GROUP BY 1) SELECT c.candidate, m.standard FROM c LEFT JOIN m USING (candidate)")
def alias_match(spark, d):
    found = _docs(spark, d).select(F.explode(N.names_in(F.col("text"))).alias("candidate")).distinct()
    return companies.match_alias(found, _aliases(spark, d))


_HITS = f"""k AS (SELECT id, lower({_company('file_name')}) AS f, lower({_company('text')}) AS t, lower(translate({_STEM}, '（）', '()')) AS stem FROM d), v AS (SELECT *, {_is_vendor('key')} AS vendor FROM a WHERE key <> ''),
h AS (SELECT id, pos, standard, alias, vendor, contains(f, key) AS in_f, contains(t, key) AS in_t, contains(stem, key) AS in_s FROM k JOIN v ON contains(f, key) OR contains(t, key) OR contains(stem, key)),
x AS (SELECT id, layer, unnest(names) AS candidate, generate_subscripts(names, 1) AS i FROM (SELECT id, 'file' AS layer, file[1:1] AS names FROM l UNION ALL SELECT id, 'bilingual', bilingual FROM l UNION ALL SELECT id, 'context', context FROM l UNION ALL SELECT id, 'general', general FROM l)),
ck AS (SELECT DISTINCT candidate, lower({_company('candidate')}) AS key FROM x), mm AS (SELECT ck.candidate, arg_min(v.standard, v.pos) AS standard FROM ck JOIN v ON ck.key <> '' AND (contains(v.key, ck.key) OR contains(ck.key, v.key)) GROUP BY 1),
w AS (SELECT id, layer, arg_min({{'s': standard, 'c': candidate}}, {{'a': standard IS NULL, 'b': i}}) AS p FROM x LEFT JOIN mm USING (candidate) GROUP BY 1, 2)"""
_SCORES = "CASE WHEN p.s IS NOT NULL THEN {0} ELSE {1} END"
_STEPS = " UNION ALL ".join(
    [f"SELECT id, 0 AS step, b.s AS company, b.a AS alias, b.n AS score FROM (SELECT id, arg_min({{'s': standard, 'a': alias, 'n': n}}, {{'a': -n, 'b': pos}}) AS b FROM (SELECT *, 95 * CAST(in_f AS INT) + 70 * CAST(in_t AS INT) - 80 * CAST(vendor AS INT) AS n FROM h) WHERE n > 0 GROUP BY 1) WHERE b.n >= 75"]
    + [f"SELECT id, {step}, coalesce(p.s, p.c), p.c, {_SCORES.format(known, other)} FROM w WHERE layer = '{layer}'" for step, layer, known, other in ((1, "file", 92, 88), (2, "bilingual", 90, 84), (3, "context", 86, 80), (5, "general", 68, 60))]
    + ["SELECT id, 4, b.s, b.a, b.n FROM (SELECT id, arg_min({'s': standard, 'a': alias, 'n': n}, {'a': -n, 'b': pos}) AS b FROM (SELECT *, 72 * CAST(in_t AS INT) - 80 * CAST(vendor AS INT) AS n FROM h) WHERE n > 0 GROUP BY 1) WHERE b.n >= 50"]
)
_FOUND = f"steps AS ({_STEPS}), g AS (SELECT id, arg_min({{'company': company, 'alias': alias, 'score': score}}, step) AS g FROM steps GROUP BY 1), found AS (SELECT d.id, coalesce(g.g.company, '') AS company, coalesce(g.g.alias, '') AS alias, CAST(coalesce(g.g.score, 0) AS INT) AS score FROM d LEFT JOIN g USING (id))"


@query(f"WITH {_EACH}, {_LISTS}, {_HITS}, {_FOUND} SELECT * FROM found")
def company_find(spark, d):
    return companies.find(_docs(spark, d), _aliases(spark, d))


_GROUP_STEPS = f"""SELECT id, 0 AS step, b.s AS company, b.a AS alias, b.n AS score FROM (SELECT id, arg_min({{'s': standard, 'a': alias, 'n': n}}, {{'a': -n, 'b': pos}}) AS b FROM (SELECT *, CASE WHEN in_s THEN 95 WHEN in_t THEN 70 ELSE 0 END - 80 * CAST(vendor AS INT) AS n FROM h) WHERE n > 0 GROUP BY 1) WHERE b.n >= 70
UNION ALL SELECT id, 1, file[1], file[1], 80 FROM l WHERE len(file) > 0 UNION ALL SELECT id, 2, plain_context[1], plain_context[1], 70 FROM l WHERE len(plain_context) > 0
UNION ALL SELECT id, 3, b.s, b.p, 60 FROM (SELECT id, arg_min({{'s': standard, 'p': part}}, {{'a': i, 'b': pos}}) AS b FROM (SELECT id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT id, regexp_split_to_array({_STEM}, '[_\\s\\-·]+') AS parts FROM d)) JOIN v ON length(part) >= 4 AND NOT {_is_vendor("translate(lower(part), '（）', '()')")} AND contains(v.key, translate(lower(part), '（）', '()')) GROUP BY 1)"""


@query(f"WITH {_EACH}, {_LISTS}, {_HITS}, steps AS ({_GROUP_STEPS}), g AS (SELECT id, arg_min({{'company': company, 'alias': alias, 'score': score}}, step) AS g FROM steps GROUP BY 1) SELECT d.id, coalesce(g.g.company, '') AS company, coalesce(g.g.alias, '') AS alias, CAST(coalesce(g.g.score, 0) AS INT) AS score FROM d LEFT JOIN g USING (id)")
def company_find_group(spark, d):
    return companies.find_for_group(_docs(spark, d), _aliases(spark, d))


_KNOWN = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN concat('Acme', CAST(c_custkey % 90 AS string), ' Ltd') WHEN 1 THEN concat('示例', CAST(c_custkey % 40 AS string), '厂') WHEN 2 THEN concat('Beta', CAST(c_custkey % 9 AS string), ' Systems') ELSE c_name END AS company, CASE c_custkey % 3 WHEN 0 THEN concat('东方', CAST(c_custkey % 50 AS string), '厂') ELSE 'x' END AS alias FROM customer"


@query(f"WITH {_EACH}, found AS ({_KNOWN}), fk AS (SELECT DISTINCT company, lower({_company('company')}) AS key FROM found), cm AS (SELECT fk.company, arg_min(a.standard, a.pos) AS standard FROM fk JOIN a ON a.key <> '' AND fk.key <> '' AND regexp_matches(a.standard, '[一-龥]') AND (contains(a.key, fk.key) OR contains(fk.key, a.key)) GROUP BY 1) SELECT id, company, alias, CASE WHEN regexp_matches(company, '[一-龥]') THEN company WHEN regexp_matches(alias, '[一-龥]') THEN alias ELSE coalesce(standard, company) END AS shown FROM found LEFT JOIN cm USING (company)")
def chinese_name(spark, d):
    return companies.prefer_chinese(_rows(spark, d, _KNOWN, a="customer"), _aliases(spark, d))


_GROUPS = "SELECT s_suppkey AS pos, CASE s_suppkey % 4 WHEN 0 THEN concat('示例', CAST(s_suppkey AS string), '贸易（青岛）有限公司') WHEN 1 THEN concat('青岛东方', CAST(s_suppkey AS string), '厂') WHEN 2 THEN concat('大华', CAST(s_suppkey AS string), ' Group') ELSE concat('Acme', CAST(s_suppkey AS string)) END AS name, concat('组', n_name) AS group_name, CASE WHEN s_suppkey % 3 = 0 THEN concat('短名 ', CAST(s_suppkey AS string)) ELSE '' END AS short_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_ASKED = "SELECT DISTINCT CASE c_custkey % 6 WHEN 0 THEN concat('示例', CAST(c_custkey % 60 AS string), '贸易有限公司') WHEN 1 THEN concat('东方', CAST(c_custkey % 80 AS string), '厂') WHEN 2 THEN concat('《大华', CAST(c_custkey % 50 AS string), '》group 上海') WHEN 3 THEN concat('acme', CAST(c_custkey % 90 AS string), ' ltd') WHEN 4 THEN concat('短名', CAST(c_custkey % 99 AS string)) ELSE concat('组', c_mktsegment, 'FRANCE') END AS name FROM customer"


@query(f"""WITH m AS ({_GROUPS}), gp AS (SELECT group_name, min(pos) AS place FROM m GROUP BY 1), q AS ({_ASKED}), k AS (SELECT name, {_key('name')} AS key, {_key(_city('name'))} AS bare FROM q),
mk AS (SELECT group_name, {_key('name')} AS c, {_key(_city('name'))} AS b, {_key('short_name')} AS s, {_key('group_name')} AS g FROM m),
h AS (SELECT k.name, mk.group_name, CASE WHEN (c <> '' AND (key = c OR (bare <> '' AND bare = b))) OR (length(s) >= 4 AND key = s) THEN 0 WHEN length(key) >= 4 AND length(c) >= 4 AND (contains(c, key) OR contains(key, c)) THEN 1
WHEN (length(s) >= 4 AND length(key) >= 4 AND (contains(s, key) OR contains(key, s))) OR (length(g) >= 4 AND (contains(g, key) OR contains(key, g))) THEN 2 END AS rank FROM k JOIN mk ON key <> ''),
r AS (SELECT name, arg_min(group_name, {{'a': rank, 'b': place}}) AS group_name FROM h JOIN gp USING (group_name) WHERE rank IS NOT NULL GROUP BY 1) SELECT q.name, r.group_name FROM q LEFT JOIN r USING (name)""")
def legacy_group(spark, d):
    return companies.legacy_group(_rows(spark, d, _ASKED, a="customer"), _rows(spark, d, _GROUPS, a="supplier", b="nation"))


_ANSWERS = "SELECT concat(' ', CAST(n_nationkey AS string), ' ') AS answer FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT concat('in ', n_name) FROM nation UNION ALL SELECT substr(n_name, 1, 3) FROM nation UNION ALL SELECT r_name FROM region"


@query(f"""WITH a AS (SELECT DISTINCT answer FROM ({_ANSWERS})), g AS (SELECT n_name AS group_name, row_number() OVER (ORDER BY n_name) AS n FROM nation), k AS (SELECT answer, trim(answer) AS key FROM a),
c AS (SELECT answer, min(group_name) AS group_name FROM k JOIN g ON contains(key, group_name) OR contains(group_name, key) WHERE NOT regexp_matches(key, '^[0-9]+$') GROUP BY 1 HAVING count(*) = 1)
SELECT k.answer, CASE WHEN regexp_matches(key, '^[0-9]+$') THEN n.group_name ELSE coalesce(e.group_name, c.group_name) END AS group_name FROM k LEFT JOIN g n ON TRY_CAST(key AS INT) = n.n LEFT JOIN g e ON e.group_name = key LEFT JOIN c USING (answer)""")
def group_choice(spark, d):
    asked = _rows(spark, d, _ANSWERS, a="nation", b="region").distinct()
    return companies.choose_group(asked, table(spark, d, "nation").select(F.col("n_name").alias("group_name")))
