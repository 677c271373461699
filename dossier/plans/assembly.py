"""Queries that put a document's record together."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import rules
from dossier.operators import assemble
from dossier.plans.queries import query, table
from dossier.streaming import budget

_FOUND = """SELECT o_orderkey AS doc_id, 'contract_total_amount' AS field, CASE o_orderkey % 6 WHEN 0 THEN '2019' WHEN 1 THEN '0' WHEN 2 THEN '¥12,345.5' WHEN 3 THEN 'abc' WHEN 4 THEN '3万' ELSE CAST(o_totalprice AS string) END AS value,
  concat(CAST(o_orderkey % 3000 AS string), '|x|88|', CAST(o_totalprice AS string)) AS alternatives FROM orders
UNION ALL SELECT o_orderkey, 'annual_maintenance_fee', CASE o_orderkey % 4 WHEN 0 THEN '700' WHEN 1 THEN '1999' WHEN 2 THEN '' ELSE '99999999' END, CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS string) ELSE '5|6|' || CAST(o_custkey AS string) END FROM orders
UNION ALL SELECT o_orderkey, 'sign_date', CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS date) AS string) WHEN 1 THEN '2021年3月5日' ELSE 'someday' END, '' FROM orders
UNION ALL SELECT o_orderkey, 'tax_rate', CASE o_orderkey % 4 WHEN 0 THEN '13' WHEN 1 THEN '.06' WHEN 2 THEN '9 %' ELSE 'free' END, '' FROM orders
UNION ALL SELECT o_orderkey, 'currency', CASE o_orderkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'GBP' ELSE 'EUR' END, '' FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'is_primary_doc' ELSE 'doc_subtype_hint' END, CASE o_orderkey % 4 WHEN 0 THEN 'False' WHEN 2 THEN 'True' ELSE 'hint' END, '' FROM orders
UNION ALL SELECT o_orderkey, 'po_number', concat('P', CAST(o_custkey AS string)), '' FROM orders WHERE o_orderkey % 5 <> 1"""


def _range(field):
    return rules.AMOUNT_RANGES.get(field, rules.DEFAULT_RANGE)


_MONEY = lambda x: f"CASE WHEN ends_with({x}, '万') THEN try_cast(replace({x}, '万', '') AS DOUBLE) * 10000 ELSE try_cast(replace(replace({x}, '¥', ''), ',', '') AS DOUBLE) END"


def _problem(v, field):
    low, high = _range(field)
    return f"CASE WHEN {v} <= 0 THEN 'not positive' WHEN {v} = floor({v}) AND {v} BETWEEN 1990 AND 2035 THEN 'looks like a year' WHEN {v} NOT BETWEEN {low} AND {high} THEN 'out of range' ELSE '' END"


def _amount_sql(field, name):
    return f"""{name} AS (SELECT doc_id, v, CASE WHEN len(list_filter(v, lambda x: {_problem('x', field)} = '')) = 0 THEN len(v) ELSE list_position(list_transform(v, lambda x: {_problem('x', field)}), '') - 1 END AS k
FROM (SELECT doc_id, list_filter(list_transform(list_concat([value], string_split(coalesce(alternatives, ''), '|')), lambda x: {_MONEY('x')}), lambda x: x IS NOT NULL) AS v FROM f WHERE field = '{field}' AND {_MONEY('value')} IS NOT NULL))"""


_FLAG = lambda name, field: f"list_transform({name}.v[1:{name}.k], lambda x: 'amount_invalid:{field}:' || {_problem('x', field)})"
_ONE = lambda field, x="value": f"max({x}) FILTER (field = '{field}' AND value <> '')"


@query(f"""WITH f AS ({_FOUND}), {_amount_sql('contract_total_amount', 'c')}, {_amount_sql('annual_maintenance_fee', 'a')},
w AS (SELECT doc_id, {_ONE('sign_date')} AS d, {_ONE('tax_rate')} AS t, upper({_ONE('currency')}) AS u, {_ONE('is_primary_doc')} AS p, {_ONE('doc_subtype_hint')} AS doc_subtype, {_ONE('po_number')} AS po_number FROM f GROUP BY 1)
SELECT w.doc_id, po_number, CAST(CAST(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%Y年%m月%d日')) AS DATE) AS VARCHAR) AS sign_date, CASE t WHEN '.06' THEN '6%' WHEN '9 %' THEN '9%' WHEN '13' THEN '13%' ELSE t END AS tax_rate, a.v[a.k + 1] AS annual_maintenance_fee, c.v[c.k + 1] AS contract_total_amount,
CASE WHEN u IN ('CNY', 'USD', 'EUR') THEN u ELSE 'CNY' END AS currency, coalesce(p, '') <> 'False' AS is_primary_doc, doc_subtype, array_to_string(list_concat(coalesce({_FLAG('a', 'annual_maintenance_fee')}[1:1], []), coalesce({_FLAG('c', 'contract_total_amount')}[1:1], [])), ';') AS flags,
array_to_string(list_concat(coalesce({_FLAG('a', 'annual_maintenance_fee')}, []), coalesce({_FLAG('c', 'contract_total_amount')}, [])), ';') AS refused FROM w LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)""")
def document_results(spark, d):
    found = spark.sql(_FOUND.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")).withColumn("alternatives", F.split("alternatives", "[|]"))
    columns = ["doc_id", "po_number", "sign_date", "tax_rate", "annual_maintenance_fee", "contract_total_amount", "currency", "is_primary_doc", "doc_subtype"]
    return assemble.results(found).select(*columns, F.array_join("flags", ";").alias("flags"), F.array_join("refused", ";").alias("refused"))


@query()
def token_grants(spark, d):
    """Events as requests of their types, under a budget that holds some of them up."""
    events = table(spark, d, "events").select(F.col("event_type").alias("provider"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("value") * 100).cast("long").alias("tokens"))
    return budget.grants(events, 20_000, 3600.0)
