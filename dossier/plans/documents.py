"""The query from pages to records, and the SQL of all its steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import rules
from dossier.operators import assemble
from dossier.plans.assembly import _MONEY, _problem
from dossier.plans.matching import _CORE, _FILE_TEXT, _KEYWORDS, _known
from dossier.plans.queries import _ANY, _BEST, _SCORES, _norm, _strip, has, query, starts, table

_VENDORS = ["VendorExample"]
_NAME_IN_TEXT = f"CASE p_partkey % 7 WHEN 0 THEN concat({_CORE}, '有限公司') WHEN 1 THEN concat('新', substr({_CORE}, 1, 8), '有限公司') WHEN 2 THEN '范例无名有限公司' WHEN 3 THEN 'VendorExample有限公司' WHEN 4 THEN '关于本项目有限公司' ELSE concat('青岛', {_CORE}, '有限公司') END"
_FILE_OF = f"""CASE p_partkey % 8 WHEN 0 THEN concat('维护合同_', {_CORE}, '（上海）有限公司_2021.pdf') WHEN 1 THEN concat('SRF ', p_brand, ' 2019.pdf') WHEN 2 THEN 'scan.pdf' WHEN 3 THEN concat('报价单-', substr({_CORE}, 1, 9), '-1.pdf') WHEN 4 THEN concat('a 全新', substr({_CORE}, 3, 4), '有限公司 b.pdf') ELSE 'x 2031.pdf' END"""
_BODY = f"""concat(CASE p_partkey % 4 WHEN 0 THEN '维护合同' WHEN 1 THEN '订购单' WHEN 2 THEN 'SRF' ELSE '报价单' END, NL, '甲方：', {_NAME_IN_TEXT}, NL, '买方：', {_NAME_IN_TEXT}, NL, '客户：', {_NAME_IN_TEXT}, NL, '服务期间：', CASE p_partkey % 3 WHEN 0 THEN '2020-01-05至2021-01-04' WHEN 1 THEN '1980.1.5到2021.1.4' ELSE '随时' END)"""
_SECOND = "concat('年度维护费：', CASE p_partkey % 5 WHEN 0 THEN '2019' WHEN 1 THEN '120' ELSE CAST(p_partkey * 10 AS string) END, '元', NL, '合计 ', CAST(p_size * 1000 AS string), NL, '单价、数量与交付地点以双方另行书面确认的清单为准，未尽事宜由双方协商解决，协商不成的提交仲裁。')"
#: Two pages a document; some hold next to nothing, and some of these have scans.
_PAGES = f"SELECT p_partkey AS doc_id, {_FILE_OF} AS file_name, 1 AS page_no, CASE WHEN p_partkey % 11 < 2 THEN 'x' ELSE {_SECOND} END AS text FROM part UNION ALL SELECT p_partkey, {_FILE_OF}, 0, CASE WHEN p_partkey % 11 < 2 THEN NULL ELSE {_BODY} END FROM part"
_SCANS = f"SELECT p_partkey AS doc_id, 0 AS page_no, {_BODY} AS text FROM part WHERE p_partkey % 11 <> 1"


def _fields(t):
    parts = []
    for kind, fields in rules.FIELDS.items():
        for name, patterns in fields.items():
            tries = [f"trim(nullif(regexp_extract(text, '{p}', 1), ''))" for p, _ in patterns]
            level = "CASE " + " ".join(f"WHEN {x} IS NOT NULL THEN {c}::DOUBLE" for x, (_, c) in zip(tries, patterns, strict=True)) + " END"
            parts.append(f"SELECT doc_id, '{assemble.RECORD_FIELDS.get(name, '')}' AS field, coalesce({', '.join(tries)}) AS value, {level} AS confidence FROM {t} WHERE doc_type = '{kind}'")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


def _refused(x):
    vendors = " ".join(f"WHEN contains(lower(trim({x})), '{v.lower()}') THEN 'vendor: {v}'" for v in _VENDORS)
    return f"CASE WHEN length(trim({x})) < 4 THEN 'too short' {vendors} WHEN {starts(f'trim({x})', rules.COMPANY_STARTS)} THEN 'phrase start' WHEN {has(f'trim({x})', rules.CLAUSES)} THEN 'clause' ELSE '' END"


def _better(what):
    return f"arg_min({what}, {{'a': -length(key), 'b': place, 'c': key}})"


def _iso(x):
    return f"CAST(CAST(coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%Y.%m.%d')) AS DATE) AS VARCHAR)"


def _bad_day(f):
    return f"CASE WHEN {f} IS NOT NULL AND CAST(substr({f}, 1, 4) AS INT) NOT BETWEEN 1990 AND 2040 THEN 'date_invalid:{f}:year out of range' END"


def _money_flag(column, field):
    return f"CASE WHEN {column} IS NOT NULL AND {_problem(column, field)} <> '' THEN 'amount_invalid:{field}:' || {_problem(column, field)} END"


_WHOLE = r"([一-龥a-zA-Z0-9（）()]{2,30}(?:有限责任公司|股份有限公司|有限公司))"
_WORD_IN_FILE = f"(regexp_matches(key, '[^\\x00-\\x7F]') OR regexp_matches({_FILE_TEXT}, '(?:^|[^\\p{{L}}\\p{{N}}_])' || replace(key, '#', '[#]') || '(?:$|[^\\p{{L}}\\p{{N}}_])'))"
_WANTED = ("detected_company", "service_period_start", "service_period_end", "annual_maintenance_fee", "contract_total_amount")


@query(f"""WITH {_KEYWORDS}, pg AS ({_PAGES.replace("NL", "chr(10)")}), sc AS ({_SCANS.replace("NL", "chr(10)")}),
ly AS (SELECT doc_id, min(file_name) AS file_name, count(*) AS page_count, sum(length(coalesce(text, ''))) / count(*) >= 50 AS has_text_layer FROM pg GROUP BY 1),
rd AS (SELECT doc_id, page_no, coalesce(text, '') AS text FROM pg JOIN ly USING (doc_id) WHERE has_text_layer UNION ALL SELECT doc_id, page_no, coalesce(text, '') FROM sc JOIN ly USING (doc_id) WHERE NOT has_text_layer),
tx AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS text FROM rd GROUP BY 1), b AS (SELECT ly.*, text, coalesce(text, '') AS body FROM ly LEFT JOIN tx USING (doc_id)),
hd AS (SELECT *, array_to_string(string_split(body, chr(10))[1:15], chr(10)) AS head, {_SCORES} FROM b), dc AS (SELECT doc_id, file_name, page_count, has_text_layer, text, coalesce({_ANY('head')}, {_BEST}, {_ANY('file_name')}, 'UNKNOWN') AS doc_type FROM hd),
fd AS ({_fields('dc')}), one AS (SELECT doc_id, field, min(value) AS value FROM fd WHERE field <> '' GROUP BY 1, 2),
wv AS (SELECT doc_id, {", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in _WANTED)} FROM one GROUP BY 1), cf AS (SELECT doc_id, round(avg(confidence), 4) AS confidence FROM fd GROUP BY 1),
v AS (SELECT dc.*, wv.detected_company AS c, {_iso('service_period_start')} AS service_period_start, {_iso('service_period_end')} AS service_period_end, {_MONEY('annual_maintenance_fee')} AS fee, {_MONEY('contract_total_amount')} AS total, cf.confidence FROM dc LEFT JOIN wv USING (doc_id) LEFT JOIN cf USING (doc_id)),
nm AS (SELECT DISTINCT c AS name, {_norm('c')} AS n, {_strip('c')} AS s FROM v WHERE c IS NOT NULL), hit AS (SELECT name, arg_min(k.group_name, {{'a': -length(key), 'b': k.place}}) AS g FROM nm JOIN k ON contains(lower(n), key) GROUP BY 1),
mp AS (SELECT nm.name AS c, coalesce(e1.group_name, e2.group_name, al1.group_name, al2.group_name, e3.group_name, e4.group_name, hit.g) AS mapped FROM nm LEFT JOIN exact e1 ON e1.key = name LEFT JOIN exact e2 ON e2.key = n
  LEFT JOIN a1 al1 ON al1.alias = name LEFT JOIN a1 al2 ON al2.alias = n LEFT JOIN exact e3 ON e3.key = s LEFT JOIN exact e4 ON e4.key = {_norm('s')} LEFT JOIN hit ON hit.name = nm.name),
fl AS (SELECT DISTINCT file_name, regexp_replace(file_name, '\\.[^.]*$', '') AS stem FROM v), fh AS (SELECT file_name, {_better("{'n': key, 'g': group_name}")} AS h FROM fl JOIN exact ON length(key) >= 5 AND contains({_FILE_TEXT}, lower(key)) GROUP BY 1),
fr AS (SELECT file_name, arg_min(group_name, {{'a': -length(key), 'b': place}}) AS g FROM fl JOIN k ON contains({_FILE_TEXT}, key) AND {_WORD_IN_FILE} GROUP BY 1),
pc AS (SELECT file_name, x[i] AS fragment, i AS nth FROM (SELECT file_name, regexp_extract_all(stem, '[一-龥a-zA-Z][一-龥a-zA-Z0-9（）()]{{3,}}') AS x FROM fl), range(1, 20) AS r(i) WHERE i <= len(x)),
pp AS (SELECT *, list_filter(list_transform(regexp_split_to_array(low, '[()]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM (SELECT DISTINCT fragment, lower(translate(fragment, '（）', '()')) AS low FROM pc)), ln AS (SELECT pos, name, lower(translate(name, '（）', '()')) AS low FROM m WHERE length(name) >= 4),
fg AS (SELECT fragment, arg_min(name, {{'a': length(name), 'b': -pos}}) AS name FROM pp JOIN ln ON contains(ln.low, pp.low) OR (len(parts) >= 2 AND len(list_filter(parts, lambda x: contains(ln.low, x))) = len(parts)) GROUP BY 1), ff AS (SELECT file_name, arg_min(name, nth) AS name FROM pc JOIN fg USING (fragment) WHERE {_refused('name')} = '' GROUP BY 1),
z AS (SELECT v.*, CASE WHEN c IS NOT NULL THEN {_refused('c')} END AS problem, mapped, h.n AS known, coalesce(h.g, fr.g) AS by_file, ff.name AS fragment, nullif(regexp_extract(stem, '{_WHOLE}', 1), '') AS written FROM v LEFT JOIN mp USING (c) JOIN fl USING (file_name) LEFT JOIN fh USING (file_name) LEFT JOIN fr USING (file_name) LEFT JOIN ff USING (file_name)),
y AS (SELECT *, CASE WHEN problem = '' THEN coalesce(mapped, c) END AS said, CASE WHEN problem = '' THEN c END AS kept FROM z)
SELECT doc_id, doc_type, has_text_layer, coalesce(kept, known, fragment, written) AS detected_company, coalesce(by_file, said) AS detected_group, CASE WHEN {_problem('fee', 'annual_maintenance_fee')} = '' THEN fee END AS annual_maintenance_fee, CASE WHEN {_problem('total', 'contract_total_amount')} = '' THEN total END AS contract_total_amount,
CASE WHEN {_bad_day('service_period_start')} IS NULL THEN service_period_start END AS service_period_start, confidence, CASE WHEN text IS NULL THEN 'no text' END AS error,
concat_ws(';', {_money_flag('fee', 'annual_maintenance_fee')}, {_money_flag('total', 'contract_total_amount')}, CASE WHEN text IS NULL THEN 'processing_error' END, 'company_invalid:' || nullif(problem, ''), CASE WHEN by_file <> said THEN 'group_conflict:ocr=' || said || ',filename=' || by_file END,
  CASE WHEN kept IS NULL THEN CASE WHEN known IS NOT NULL THEN 'company_from_filename_known' WHEN fragment IS NOT NULL THEN 'company_from_filename_fragment' WHEN written IS NOT NULL THEN 'company_from_filename_regex' END END, {_bad_day('service_period_start')}, {_bad_day('service_period_end')}) AS flags FROM y""")
def document_records(spark, d):
    part = table(spark, d, "part")
    of_part = lambda sql: spark.sql(sql.replace("FROM part", "FROM {part}").replace("NL", "char(10)"), part=part)
    got = assemble.records(of_part(_PAGES), of_part(_SCANS), _known(spark, d), vendors=_VENDORS)
    return got.select("doc_id", "doc_type", "has_text_layer", "detected_company", "detected_group", "annual_maintenance_fee", "contract_total_amount", "service_period_start", F.col("confidence_overall").alias("confidence"), "error", F.array_join("flags", ";").alias("flags"))
