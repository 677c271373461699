"""Queries on dates by position, missing amounts on pages, and reports in folders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier import rules
from dossier.operators import candidates, evidence, report
from dossier.operators.assemble import _written
from dossier.plans.queries import TYPED, ledger, query, quoted, table
from dossier.sources import reports

#: Dates of orders as they are written: over two lines, with short years, month first, misread, as a deadline.
_WRITTEN = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN concat('签署日期', NL, y, '年', m, NL, '月', d, '日') WHEN 1 THEN concat('Date: ', right(y, 2), '.', m, '.', d) WHEN 2 THEN concat('ref ', right(y, 2), '.', m, '.', d)
WHEN 3 THEN concat('issued ', m, '/', lpad(d, 2, '0'), '/', right(y, 2)) WHEN 4 THEN concat('生效 ', left(y, 3), 'l.', m, '.', d) ELSE concat('如果在', y, '-', m, '-', d, '之前签署') END AS text
FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS string) AS y, CAST(month(o_orderdate) AS string) AS m, CAST(day(o_orderdate) AS string) AS d FROM orders) x"""

_ISO = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"


@query(f"""SELECT o_orderkey AS doc_id, 1 AS line_no, {_ISO} AS value, 'sign_date' AS label, 0.85::DOUBLE AS score FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT o_orderkey, 0, {_ISO}, 'date_generic', 0.7 FROM orders WHERE o_orderkey % 6 IN (1, 3)
UNION ALL SELECT o_orderkey, 0, {_ISO}, 'date_condition', 0.7 FROM orders WHERE o_orderkey % 6 = 5
UNION ALL SELECT k, 0, v, 'effective_date', 0.55 FROM (SELECT o_orderkey AS k, left({_ISO}, 3) || '1' || substr({_ISO}, 5) AS v FROM orders WHERE o_orderkey % 6 = 4) WHERE try_cast(v AS DATE) IS NOT NULL""")
def date_forms(spark, d):
    texts = spark.sql(_WRITTEN.replace("FROM orders", "FROM {orders}").replace("NL", "char(10)"), orders=table(spark, d, "orders"))
    return candidates.dates(texts, 2030)


_PAGES = """SELECT l_orderkey AS doc_id, CAST(l_linenumber - 1 AS int) AS page_no, CASE WHEN l_returnflag <> 'N' THEN CAST(x AS double) END AS amount,
CASE l_returnflag WHEN 'R' THEN concat('合计 ', substr(x, 1, length(x) - 3), ',', right(x, 3), ' 元') ELSE '见附件' END AS evidence
FROM (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(CAST(floor(l_extendedprice) AS bigint) AS string) AS x FROM lineitem) y"""


@query(f"""WITH {TYPED}, t AS (SELECT pos AS doc_id FROM typed WHERE category IN ({quoted(rules.TARGETS)}) AND amount IS NULL), p AS (SELECT *, amount IS NOT NULL AND evidence <> '见附件' AS sure FROM ({_PAGES}) WHERE page_no < 3),
s AS (SELECT t.doc_id, min(page_no) FILTER (sure) AS stop FROM t LEFT JOIN p USING (doc_id) GROUP BY 1),
b AS (SELECT doc_id, arg_min({{'amount': amount, 'evidence': evidence, 'page': page_no + 1, 'sure': sure}}, {{'a': NOT sure, 'b': page_no, 'c': amount, 'd': evidence}}) FILTER (amount IS NOT NULL) AS b, count(*) AS pages_read FROM s JOIN p USING (doc_id) WHERE page_no <= coalesce(stop, 2) GROUP BY 1)
SELECT doc_id, b.b.amount AS amount, coalesce(b.b.evidence, '') AS evidence, CAST(coalesce(b.b.page, 3) AS INT) AS page, CASE WHEN b.b.sure THEN 'high' ELSE 'low' END AS confidence, coalesce(pages_read, 0) AS pages_read FROM s LEFT JOIN b USING (doc_id)""")
def page_evidence(spark, d):
    """Amounts that the ledger lacks, from its documents' pages, which the line items stand for."""
    wanted = _written(evidence.targets(report.typed(ledger(spark, d)).withColumnRenamed("pos", "doc_id")).select("doc_id"))
    return evidence.by_page(wanted, spark.sql(_PAGES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem")), lambda pages: pages)


@query(f"WITH {TYPED} SELECT group_name, year, category, CASE WHEN category <> 'SRF' THEN company END AS company, amount, CASE WHEN category = 'SRF' THEN path END AS note FROM report WHERE group_name NOT IN ({quoted(rules.SKIPPED_GROUPS)})")
def report_folders(spark, d):
    """The report, written to a folder for each group by two writers with different columns, and read back."""
    rows = report.report_rows(ledger(spark, d)).where(~F.col("group_name").isin(rules.SKIPPED_GROUPS))
    shared = _written(rows)
    path = f"{spark.sparkContext.getCheckpointDir()}/reports-{uuid.uuid4().hex}"
    reports.write(shared.where("category <> 'SRF'").select("group_name", "year", "category", "company", "amount"), path)
    reports.write(shared.where("category = 'SRF'").select("group_name", "year", "category", "amount", F.col("path").alias("note")), path)
    read, _ = reports.read(spark, path)
    return read.select("group_name", F.col("year").cast("int").alias("year"), "category", "company", F.col("amount").cast("double").alias("amount"), "note")
