"""Queries on records: wide and older exports, packets, flags, what file names say against the ledger, audit figures, orders, and models' answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import rules
from dossier.functions import columns as C
from dossier.functions import dates as D
from dossier.operators import candidates, pages, quality, repair, report, resolve, sinks
from dossier.plans.names import _rows
from dossier.plans.queries import _ASKED, _AUDIT, _ENGLISH, _PACKETS, _SIM, LEDGER, ORACLE, TYPED, _mapping, _report_with, _typed_pages, has, ledger, query, table
from dossier.sources import ledger as source

# -- exports ----------------------------------------------------------------------------------------------------------

_FLAGGED = "split(CASE pos % 6 WHEN 0 THEN 'amount_invalid:x|group_conflict' WHEN 1 THEN 'company_invalid' WHEN 2 THEN 'group_conflict:a|other|group_conflict' WHEN 3 THEN '' ELSE 'other|amount_invalid' END, '[|]')"
_DUCK_FLAGS = _FLAGGED.replace("split(", "string_split(").replace("'[|]'", "'|'")
_EXTRA = "pos % 3 = 0 AS is_primary_doc, CAST(pos % 1000 AS double) / 1000.0 + CAST(0.0004 AS double) * (pos % 2) AS confidence_overall, CASE WHEN pos % 5 = 0 THEN CAST(NULL AS string) WHEN pos % 5 = 1 THEN 'USD' ELSE '' END AS currency, CASE WHEN pos % 7 = 0 THEN 'unreadable' END AS error, CASE pos % 4 WHEN 0 THEN 'V8.0' WHEN 1 THEN 'V5.1' ELSE '' END AS software_version"
_FULL = f"{LEDGER}, full_ledger AS (SELECT *, {_DUCK_FLAGS} AS flags, {_EXTRA} FROM ledger)"


def _full(spark, d):
    return ledger(spark, d).selectExpr("*", f"{_FLAGGED} AS flags", *_split(_EXTRA))


def _split(columns: str) -> list[str]:
    """A select list's columns, parted by the commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _wide(name, default):
    there = {"report_year", "detected_group", "detected_company", "doc_type", "service_period_start", "service_period_end", "annual_maintenance_fee", "tax_included_amount", "tax_excluded_amount", "contract_total_amount", "currency", "file_name", "file_md5", "summary", "error"}
    if name == "is_primary_doc":
        return "CASE WHEN is_primary_doc THEN '是' ELSE '否' END"
    if name == "confidence_overall":
        return "round_even(confidence_overall, 3)"
    if name == "flags":
        return "array_to_string(flags, '|')"
    if name not in there:
        return f"'{default}'"
    return name if default is None else f"coalesce({name}, '{default}')"


@query(f"WITH {_FULL} SELECT pos, " + ", ".join(f"{_wide(n, x)} AS {n}" for n, x in sinks.WIDE) + " FROM full_ledger")
def wide_export(spark, d):
    return sinks.wide_rows(_full(spark, d))


@query(f"WITH {LEDGER} SELECT pos, CASE WHEN detected_group IS NULL OR trim(detected_group) IN ('', 'nan') THEN '未分组' ELSE detected_group END AS group_name, file_name, detected_company, report_year, doc_type, '' AS notes FROM ledger ORDER BY group_name, report_year NULLS LAST, pos")
def legacy_export(spark, d):
    return sinks.legacy_rows(ledger(spark, d))


@query(f"""WITH {_PACKETS}, g AS (SELECT doc_id, packet, min(page_no) AS start_page, max(page_no) AS end_page, arg_min(page_type, page_no) AS packet_type, arg_min(coalesce(text, ''), page_no) AS first_text FROM k GROUP BY 1, 2)
SELECT doc_id, concat(CAST(doc_id AS VARCHAR), '.pdf') AS file_name, 'g' || CAST(doc_id % 7 AS VARCHAR) AS group_name, printf('packet_%03d', packet) AS packet_id, start_page, end_page, packet_type,
substr(array_to_string(list_filter(list_transform(string_split(trim(first_text, ' '), chr(10))[1:5], lambda x: trim(x, ' ')), lambda x: x <> ''), ' '), 1, 100) AS title_hint FROM g""")
def packets_export(spark, d):
    rows = pages.packet_rows(_typed_pages(spark, d))
    packed = rows.groupBy("doc_id").agg(F.collect_list(F.struct("packet_id", "start_page", "end_page", "packet_type", "doc_type", "title_hint")).alias("packets"))
    documents = packed.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), F.concat(F.lit("g"), (F.col("doc_id") % 7).cast("string")).alias("group_name"), "packets")
    return sinks.packet_rows(documents).drop("doc_type")


# -- flags and repairs ------------------------------------------------------------------------------------------------


@query(f"WITH {_FULL} SELECT pos, array_to_string(list_filter(flags, lambda f: contains(f, 'amount_invalid') OR contains(f, 'company_invalid')), '; ') AS shown, array_to_string(list_filter(flags, lambda f: NOT contains(f, 'group_conflict')), '|') AS kept FROM full_ledger")
def flag_lists(spark, d):
    flags = F.col("flags")
    return _full(spark, d).select("pos", repair.shown_flags(flags, ["amount_invalid", "company_invalid"]).alias("shown"), F.array_join(repair.without_flags(flags, "group_conflict"), "|").alias("kept"))


_FIXES = "SELECT file_name, min(concat('修正', CAST(pos AS string))) AS company FROM {0} WHERE pos % 50 = 7 GROUP BY file_name"


@query(f"""WITH {_FULL}, f AS ({_FIXES.format('full_ledger')}) SELECT l.pos, coalesce(f.company, l.detected_company) AS company, CASE WHEN f.company IS NOT NULL AND coalesce(detected_company, '') <> '' AND contains(summary, detected_company) THEN replace(summary, detected_company, f.company) ELSE summary END AS summary,
array_to_string(CASE WHEN f.company IS NOT NULL THEN list_filter(flags, lambda x: NOT contains(x, 'group_conflict')) ELSE flags END, '|') AS flags FROM full_ledger l LEFT JOIN f USING (file_name)""")
def exact_fixes(spark, d):
    rows = _full(spark, d)
    fixes = spark.sql(_FIXES.format("{rows}"), rows=rows)
    return repair.exact_fixes(rows, fixes).select("pos", F.col("detected_company").alias("company"), "summary", F.array_join("flags", "|").alias("flags"))


_PREFIX = "|".join(sorted(rules.NAME_PREFIXES, key=lambda p: (-len(p), p)))


@query(f"WITH {LEDGER} SELECT pos, trim(regexp_replace(file_name, '^(?:{_PREFIX})', '')) AS name FROM ledger")
def prefix_strip(spark, d):
    return ledger(spark, d).select("pos", repair.without_prefix(F.col("file_name")).alias("name"))


_TOKEN = "trim(replace(coalesce(detected_group, ''), '集团', ''))"


@query(f"""WITH {LEDGER}, x AS (SELECT *, CASE WHEN pos % 3 = 0 THEN concat(detected_group, '示例有限公司') ELSE nullif(regexp_extract(file_name, '_([^_]+)_', 1), '') END AS named, {_TOKEN} AS token FROM ledger)
SELECT pos, CASE WHEN named IS NOT NULL AND length(token) >= 2 AND contains(named, token) AND NOT contains(coalesce(detected_company, ''), token) THEN named ELSE detected_company END AS company FROM x""")
def company_by_group(spark, d):
    named = F.when(F.col("pos") % 3 == 0, F.concat("detected_group", F.lit("示例有限公司"))).otherwise(C.group(F.col("file_name"), "_([^_]+)_"))
    return repair.company_by_group(ledger(spark, d), named).select("pos", F.col("detected_company").alias("company"))


# -- audits -----------------------------------------------------------------------------------------------------------

_SAYS = "CASE WHEN pos % 9 = 4 THEN NULL ELSE nullif(regexp_extract(file_name, '_([^_]+)_', 1), '') END"
_CROSS = [
    ("COMPANY_MISMATCH", f"says IS NOT NULL AND c <> '' AND {_SIM} < 0.5"), ("COMPANY_MISSING_IN_AUDIT", "says IS NOT NULL AND c = ''"), ("VENDOR_IN_AUDIT", f"says IS NULL AND {has('lower(c)', rules.VENDORS, lower=True)}"),
    ("VERSION_MISMATCH", "sv IS NOT NULL AND v <> '' AND sv <> v"), ("AMOUNT_EMPTY", "coalesce(" + ", ".join(f"nullif({c}, 0)" for c, _ in rules.AMOUNTS) + ") IS NULL"),
]


@query(f"""WITH {_FULL}, x AS (SELECT *, {_SAYS} AS says, 'V' || nullif(regexp_extract(file_name, '([0-9]+\\.[0-9]+)(?:升级|版本)', 1), '') AS sv, trim(coalesce(detected_company, '')) AS c, trim(coalesce(software_version, '')) AS v FROM full_ledger),
y AS (SELECT *, translate(says, '（）', '()') AS a, translate(c, '（）', '()') AS b FROM x) """ + " UNION ALL ".join(f"SELECT pos, detected_group AS group_name, '{code}' AS code FROM y WHERE {condition}" for code, condition in _CROSS))
def cross_issues(spark, d):
    says = F.when(F.col("pos") % 9 != 4, C.group(F.col("file_name"), "_([^_]+)_"))
    rows = _full(spark, d).withColumns({"says": says, "says_version": F.concat(F.lit("V"), C.version_of(F.col("file_name"))), "group_name": F.col("detected_group")})
    return quality.findings(rows, ["pos", "group_name"], quality.cross_checks())


_AUDITED = f"""{TYPED}, r AS (SELECT * FROM (SELECT split_part(path, '/', -1) AS fn, path, company, year, amount, row_number() OVER (PARTITION BY split_part(path, '/', -1) ORDER BY path, company, year, amount) AS k FROM report) WHERE k = 1),
b AS (SELECT l.*, trim(coalesce(l.detected_company, '')) AS c FROM ledger l), e AS (""" + " UNION ALL ".join(f"SELECT b.pos, b.file_name, '{code}' AS kind FROM b LEFT JOIN r ON b.file_name = r.fn WHERE {cond}" for code, cond in _AUDIT) + ")"


@query(f"WITH {_AUDITED}, k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY pos) AS k FROM e) SELECT kind, count(*) AS n, string_agg(file_name, '|' ORDER BY k) FILTER (k <= 5) AS examples FROM k GROUP BY kind")
def audit_examples(spark, d):
    return quality.audit_examples(quality.full_audit(ledger(spark, d), report.report_rows(ledger(spark, d))))


@query(f"WITH {_FULL} SELECT count(*) AS total, count(*) FILTER (coalesce(error, '') = '') AS done, count(*) FILTER (coalesce(error, '') <> '') AS failed, count(*) FILTER (coalesce(trim(detected_group), '') = '') AS no_group FROM full_ledger")
def run_summary(spark, d):
    return report.run_summary(_full(spark, d))


@query(f"WITH {LEDGER} SELECT detected_group AS group_name, min(pos) AS first_pos FROM ledger GROUP BY 1")
def group_order(spark, d):
    return report.first_seen(ledger(spark, d))


@query(f"WITH {TYPED} SELECT pos, group_name, row_number() OVER (PARTITION BY group_name ORDER BY year, category, company, path, pos) AS place FROM report")
def report_places(spark, d):
    return report.places(_report_with(spark, d)).select("pos", "group_name", "place")


@query(f"WITH {TYPED} SELECT group_name, year, category, company, amount, amount_source, service_period, version, path FROM report ORDER BY year, category, company, path")
def ordered_report(spark, d):
    return report.ordered(report.report_rows(ledger(spark, d)))


@query(f"""WITH {LEDGER}, s AS (SELECT *, count(*) OVER (PARTITION BY detected_group) AS group_size, nullif(regexp_extract(file_name, '_([^_]+)_', 1), '') AS says FROM ledger),
x AS (SELECT *, translate(says, '（）', '()') AS a, translate(coalesce(detected_company, ''), '（）', '()') AS b FROM s WHERE says IS NOT NULL), y AS (SELECT *, round({_SIM}, 6) AS similarity FROM x)
SELECT pos, detected_group AS group_name, group_size, file_name, says, similarity FROM y WHERE similarity < 0.5 ORDER BY group_size DESC, group_name, file_name, pos""")
def ordered_conflicts(spark, d):
    return quality.ordered_conflicts(quality.conflicts(ledger(spark, d)))


# -- texts ------------------------------------------------------------------------------------------------------------

_SPLIT = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN concat('签于', substr(CAST(o_orderdate AS string), 1, 4), '年  NL  ', CAST(o_custkey % 12 + 1 AS string), '月3日 完') WHEN 1 THEN concat('a ', substr(CAST(o_orderdate AS string), 1, 5), 'NL', CAST(o_custkey % 12 + 1 AS string), '-2 bNLc') WHEN 2 THEN 'no dateNLhere' ELSE concat(CAST(o_orderdate AS string), 'NLnext') END AS text FROM orders"
_SPLIT_DUCK = _SPLIT.replace("CAST(o_orderdate AS string)", "CAST(CAST(o_orderdate AS DATE) AS string)")


def _lines(sql, duck):
    for half in ("年  NL  ", "-2 bNLc", "no dateNLhere", "NLnext"):
        a, b = half.split("NL")
        sql = sql.replace(f"'{half}'", f"concat('{a}', NL, '{b}')")
    return sql.replace("'NL'", "NL").replace("NL", "chr(10)" if duck else "char(10)")


@query(f"""WITH t AS ({_lines(_SPLIT_DUCK, True)}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line_no FROM t),
p AS (SELECT doc_id, line_no, regexp_replace(line, '\\s+$', '') || regexp_replace(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), '^\\s+', '') AS line FROM l)
SELECT doc_id, line_no, line FROM p WHERE regexp_matches(line, '[0-9]{{4}}年[0-9]{{1,2}}月|[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.]')""")
def date_stitch(spark, d):
    return candidates.stitched(spark.sql(_lines(_SPLIT_DUCK, False).replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")))


@query("WITH c AS (SELECT o_orderkey % 500 AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'OCR' WHEN 1 THEN 'TEXT_LAYER' ELSE 'FILENAME' END AS source, o_orderkey AS pos FROM orders), r AS (SELECT *, CASE source WHEN 'TEXT_LAYER' THEN 0 WHEN 'OCR' THEN 1 ELSE 2 END AS source_rank FROM c) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source_rank, pos) AS place FROM r")
def candidate_union(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("doc_id"), F.element_at(F.array(F.lit("OCR"), F.lit("TEXT_LAYER"), F.lit("FILENAME")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("source"), F.col("o_orderkey").alias("pos"))
    each = [o.where(F.col("source") == s) for s in ("TEXT_LAYER", "OCR", "FILENAME")]
    return candidates.ranked(each[0].unionByName(each[1]).unionByName(each[2]), ["TEXT_LAYER", "OCR"])


_EVIDENCE = "SELECT o_orderkey AS id, concat('共 ', CAST(CAST(floor(o_totalprice) AS bigint) AS string), '.75 元, ', CAST(o_custkey AS string), ',', CAST(o_custkey % 900 + 100 AS string), ' x ', CAST(o_orderkey % 90 AS string)) AS text FROM orders"


@query(f"WITH e AS ({_EVIDENCE}) SELECT id, CAST(list_max(list_transform(list_filter(list_transform(regexp_extract_all(text, '([0-9,]+(?:\\.[0-9]+)?)', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda v: v BETWEEN 100 AND 1e8), lambda v: floor(v))) AS BIGINT) AS amount FROM e")
def evidence_amount(spark, d):
    return _rows(spark, d, _EVIDENCE, a="orders").select("id", candidates.evidence_amount(F.col("text")).alias("amount"))


_ANSWERS = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat('```json {"type": "SRF", "name": "', c_name, '", "inner": {"a": 1}} ``` done') WHEN 1 THEN concat('Sure: {"type": "odd", "name": " None ", "n": ', CAST(c_custkey AS string), '} and {"type": "x"}') WHEN 2 THEN concat('{"type": "CONTRACT", "name": ', c_name, '}') WHEN 3 THEN 'no object' ELSE '{"name": null, "type": "CONTRACT"}' END AS text FROM customer"""


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'SRF' WHEN 1 THEN '其他' WHEN 4 THEN 'CONTRACT' ELSE '其他' END AS type, CASE c_custkey % 5 WHEN 0 THEN c_name ELSE '' END AS name, c_custkey % 5 IN (0, 1, 4) AS parsed FROM customer""")
def model_answers(spark, d):
    rows = _rows(spark, d, _ANSWERS, a="customer").withColumn("answer", source.fenced_json(F.col("text"), "type string, name string"))
    fields = F.create_map(F.lit("type"), F.col("answer.type"), F.lit("name"), F.col("answer.name"))
    clean = source.default_fields(fields, ["type", "name"], "type", ["CONTRACT", "SRF"], "其他")
    return rows.select("id", clean["type"].alias("type"), clean["name"].alias("name"), F.col("answer").isNotNull().alias("parsed"))


_SUMS = """SELECT pos, file_name, concat(CASE pos % 3 WHEN 0 THEN '[示例集团] ' ELSE '' END, summary, CASE pos % 4 WHEN 0 THEN '服务期内' ELSE '' END) AS summary, CASE pos % 5 WHEN 0 THEN '' ELSE concat('2020-01-01 ~ 2021-0', CAST(pos % 9 + 1 AS string), '-01') END AS period, CASE pos % 5 WHEN 1 THEN '一年' WHEN 2 THEN '2年' ELSE '' END AS duration,
CASE pos % 6 WHEN 3 THEN concat('SRF-', CAST(pos AS string)) WHEN 4 THEN '编号读错了' ELSE '' END AS srf, CASE pos % 4 WHEN 0 THEN '维护合同' WHEN 1 THEN 'SRF' WHEN 2 THEN '采购合同' ELSE '升级合同' END AS category FROM {0}"""
_KIND = "CASE " + " ".join(f"WHEN contains(file_name, '{k}') THEN '{v}'" for k, v in rules.SERVICE_KINDS) + " ELSE '服务' END"


@query(f"""WITH {LEDGER}, s AS ({_SUMS.format('ledger')}), x AS (SELECT *, trim(regexp_replace(coalesce(summary, ''), '^\\[[^\\]]+\\]\\s*', '')) AS t, CASE WHEN srf <> '' AND length(srf) <= 30 AND NOT regexp_matches(srf, '[一-龥]{{3,}}') THEN srf END AS no FROM s),
y AS (SELECT *, concat_ws('；', CASE WHEN duration <> '' THEN duration || '合同' END, CASE WHEN period <> '' AND NOT contains(t, '服务期') AND NOT contains(t, '至') THEN '维护期 ' || period END) AS c, concat_ws('；', {_KIND}, '编号 ' || no, CASE WHEN period <> '' THEN '服务期 ' || period END) AS r FROM x)
SELECT pos, CASE WHEN category IN ('维护合同', '升级合同') THEN CASE WHEN c <> '' THEN t || '（' || c || '）' ELSE t END WHEN category = 'SRF' THEN CASE WHEN t <> '' THEN t || '（' || r || '）' ELSE r END ELSE t END AS text FROM y""")
def summary_text(spark, d):
    rows = spark.sql(_SUMS.format("{rows}"), rows=ledger(spark, d))
    c = [F.col(x) for x in ("category", "summary", "file_name", "period", "duration", "srf")]
    return rows.select("pos", report.summary_text(*c).alias("text"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN c_name ELSE '' END AS value FROM customer")
def nested_field(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "top").otherwise("").alias("flat"), F.when(F.col("c_custkey") % 3 == 1, F.struct(F.col("c_name").alias("value"))).alias("nested"))
    return c.select("id", source.field_of(F.col("flat"), F.col("nested")).alias("value"))


# -- dates and years --------------------------------------------------------------------------------------------------

_DATED = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN concat('签署日期：', CAST(CAST(o_orderdate AS date) AS string), ' 合同') WHEN 1 THEN concat('始 20', CAST(o_custkey % 60 + 10 AS string), '年', CAST(o_custkey % 14 AS string), '月', CAST(o_custkey % 33 AS string), '日 日期: 2009.1.', CAST(o_custkey % 40 AS string)) WHEN 2 THEN concat('DATE: 2011/', CAST(o_custkey % 13 AS string), '/5') WHEN 3 THEN concat('year 2040 then 20', CAST(o_custkey % 45 + 10 AS string))
WHEN 4 THEN concat('日期：20', CAST(o_custkey % 60 + 10 AS string), '-3-4 签订: ', CAST(CAST(o_orderdate AS date) AS string)) WHEN 5 THEN CAST(CAST(o_orderdate AS date) AS string) ELSE '' END AS text, CASE o_orderkey % 4 WHEN 0 THEN '1998-5-6.pdf' WHEN 1 THEN concat('a20', CAST(o_custkey % 50 + 10 AS string), '.pdf') ELSE 'x.pdf' END AS file_name, concat('in/', CAST(1990 + o_custkey % 60 AS string), '/20', CAST(o_custkey % 40 + 10 AS string), '/x2001/f.pdf') AS path FROM orders"""
_REST = "[.\\-/年](?:0?[1-9]|1[0-2])[.\\-/月](?:0?[1-9]|[12][0-9]|3[01])"
_PLAIN = _REST.replace("年", "").replace("月", "")
_WHOLE = "(file_name || chr(10) || text)"
_FIRST_DATE = f"coalesce(regexp_extract_all({_WHOLE}, '20[0-9]{{2}}{_REST}日?')[1], regexp_extract_all({_WHOLE}, '19[0-9]{{2}}{_REST}日?')[1], '')"


@query(f"""WITH d AS ({_DATED}), f AS (SELECT *, {_FIRST_DATE} AS first FROM d) SELECT id, first, coalesce(nullif(regexp_extract(text, '签[字署订][日期]*[：:]\\s*(20[0-9]{{2}}{_REST}日?)', 1), ''), nullif(regexp_extract(text, '日期[：:]\\s*(20[0-9]{{2}}{_REST}日?)', 1), ''), nullif(regexp_extract(text, '(?i)Date[：:]\\s*(20[0-9]{{2}}{_PLAIN})', 1), ''), first) AS signed,
coalesce(CASE WHEN TRY_CAST(substr(first, 1, 4) AS INT) BETWEEN 2000 AND 2035 THEN substr(first, 1, 4) END, list_filter(regexp_extract_all({_WHOLE}, '(?:19|20)[0-9]{{2}}'), lambda y: CAST(y AS INT) BETWEEN 2000 AND 2035)[1], '') AS year,
coalesce(list_filter(string_split(path, '/'), lambda p: regexp_matches(p, '^(?:19|20)[0-9]{{2}}$') AND TRY_CAST(p AS INT) BETWEEN 2000 AND 2035)[1], '') AS path_year, CASE WHEN id % 7 = 5 THEN strftime(TRY_CAST(text AS DATE), '%Y-%m-%d') ELSE text END AS iso FROM f""")
def legacy_dates(spark, d):
    text, name = F.col("text"), F.col("file_name")
    return _rows(spark, d, _DATED, a="orders").select("id", D.first_date(text, name).alias("first"), D.signing_date(text, name).alias("signed"), D.legacy_year(text, name).alias("year"), D.path_year(F.col("path")).alias("path_year"), D.iso_or_text(text).alias("iso"))


_SCORED = "SELECT o_orderkey % 3000 AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'company' WHEN 1 THEN 'date' WHEN 2 THEN 'amount' ELSE 'tax_rate' END AS kind, o_orderkey AS pos, concat('v', CAST(o_custkey AS string)) AS value, CAST(o_custkey % 10 AS double) / 10.0 AS score FROM orders"


@query(f"""WITH c AS ({_SCORED}), b AS (SELECT doc_id, kind, arg_min({{'v': value, 's': score}}, {{'a': -score, 'b': pos}}) AS b FROM c GROUP BY 1, 2)
SELECT doc_id, CASE kind WHEN 'company' THEN 'detected_company' WHEN 'date' THEN 'sign_date' ELSE 'contract_total_amount' END AS field, b.v AS value, round(b.s * CASE kind WHEN 'amount' THEN 0.4 ELSE 0.5 END, 6)::DOUBLE AS confidence FROM b WHERE kind <> 'tax_rate' UNION ALL SELECT DISTINCT doc_id, '_flag_unknown_type', 'UNKNOWN_DOC_TYPE', 1.0 FROM c""")
def unknown_fields(spark, d):
    rows = _rows(spark, d, _SCORED, a="orders")
    return candidates.unknown_fields(rows.select("doc_id").distinct(), rows)


_SAID = "CASE WHEN pos % 4 = 0 THEN concat('示例', CAST(pos % 100 AS string), '有限公司') ELSE nullif(regexp_extract(file_name, '_([^_]+)_', 1), '') END"
_VENDOR_SQL = has("replace(lower(c), ' ', '')", [v.lower().replace(" ", "") for v in rules.VENDORS])
_EN = _ENGLISH.replace("0.7", "0.65").replace(">= 3", ">= 1")


@query(f"""WITH {LEDGER}, x AS (SELECT *, trim(coalesce(detected_company, '')) AS c, {_SAID} AS named FROM ledger), y AS (SELECT *, CASE WHEN c <> '' AND ({_VENDOR_SQL} OR regexp_matches(c, '(?i)^(?:上海|Shanghai)[^，,。]{{1,6}}[升维纬禾茵开达][^，,。]{{0,10}}(?:信息|软件|科技|技术|咨询|Information|Software)') OR regexp_matches(c, '{rules.NO_COMPANY}')) THEN CASE WHEN named <> c THEN 'VENDOR_OR_NOISE' END
WHEN {_EN.format('c')} THEN CASE WHEN NOT {_EN.format('trim(named)')} THEN 'EN_TO_CN' END END AS r FROM x), z AS (SELECT *, CASE WHEN named IS NOT NULL THEN r END AS reason FROM y)
SELECT pos, reason, CASE WHEN reason IS NOT NULL THEN named ELSE detected_company END AS company, CASE WHEN reason IS NOT NULL AND contains(summary, c) THEN replace(summary, c, named) ELSE summary END AS summary FROM z""")
def company_from_name(spark, d):
    named = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("示例"), (F.col("pos") % 100).cast("string"), F.lit("有限公司"))).otherwise(C.group(F.col("file_name"), "_([^_]+)_"))
    return repair.company_from_name(ledger(spark, d), named).select("pos", "reason", F.col("detected_company").alias("company"), "summary")


@query(f"SELECT name, CASE WHEN group_name <> name THEN group_name END AS group_name FROM ({ORACLE['map_cascade']})")
def map_changed(spark, d):
    asked = spark.sql(_ASKED.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, d, "supplier"))
    return resolve.map_changed(asked, resolve.checked_mapping(_mapping(spark, d)))
