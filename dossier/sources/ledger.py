"""Sources: JSON Lines ledgers with a fixed schema, files of an archive by content, cached pages, mappings, and synthetic ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """pos BIGINT, file_path STRING, file_name STRING, file_md5 STRING, page_count INT, has_text_layer BOOLEAN, doc_type STRING, doc_subtype STRING, is_primary_doc BOOLEAN,
packet_count INT, detected_group STRING, detected_company STRING, detected_counterparty STRING, sign_date STRING, effective_date STRING, service_period_start STRING, service_period_end STRING,
report_year INT, currency STRING, annual_maintenance_fee DOUBLE, tax_rate STRING, tax_included_amount DOUBLE, tax_excluded_amount DOUBLE, contract_total_amount DOUBLE, po_number STRING,
quote_number STRING, software_version STRING, summary STRING, confidence_overall DOUBLE, flags ARRAY<STRING>, error STRING"""


def read_jsonl(spark: SparkSession, path: str, drop_malformed: bool = True) -> DataFrame:
    """A ledger of JSON Lines; malformed lines are dropped, or kept as rows of nulls."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE").json(path)


def scan_files(spark: SparkSession, path: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, file_name, size and md5 of the files of a folder and those below it; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "path string, file_name string, size long, file_md5 string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), F.md5("content").alias("file_md5"))


def fenced_json(text, schema: str):
    """The first {...} of a model's answer as a struct, code fences aside; null if it can't be read. Columns in, a Column out. Braces are matched three levels deep."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"```(?:json)?\s*", "")
    inner = r"[^{}]*"
    for _ in range(2):
        inner = rf"(?:[^{{}}]|\{{{inner}\}})*"
    found = F.nullif(F.regexp_extract(bare, rf"(?s)\{{{inner}\}}", 0), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), F.from_json(found, schema, {"mode": "PERMISSIVE"}))


def default_fields(fields, keys: list[str], kind: str, kinds: list[str], otherwise: str):
    """A map of texts with all the keys: words for nothing and missing values become empty, a kind that isn't known becomes the other one."""
    value = lambda k: F.trim(F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit("")))
    clean = lambda k: F.when(F.lower(value(k)).isin("null", "none", "nan"), "").otherwise(value(k))
    known = lambda k: F.when(clean(k).isin(kinds), clean(k)).otherwise(otherwise) if k == kind else clean(k)
    return F.create_map(*[x for k in keys for x in (F.lit(k), known(k))])


def field_of(flat, nested):
    """A field that stands at the top or, if that is blank, in the nested struct's value."""
    return F.coalesce(F.nullif(flat, F.lit("")), nested["value"], F.lit(""))


def read_through(pages: DataFrame, cached: DataFrame, provider) -> DataFrame:
    """Cached pages of the documents of pages (file_md5, ...), and what provider(DataFrame) makes of those that the cache lacks."""
    known = cached.join(pages.select("file_md5").distinct(), "file_md5", "left_semi")
    return known.unionByName(provider(pages.join(cached.select("file_md5").distinct(), "file_md5", "left_anti")))


#: A ledger made of orders, customers and nations: the same text runs in Spark SQL and DuckDB.
SYNTHETIC = """
SELECT o.o_orderkey AS pos,
  concat(CASE o.o_orderkey % 6 WHEN 0 THEN '维护合同_' WHEN 1 THEN '采购合同_' WHEN 2 THEN '项目合同_' WHEN 3 THEN 'SRF_' WHEN 4 THEN '财务8.0升级_' ELSE '报价单_' END,
         c.c_name, '_', CAST(year(o.o_orderdate) + 10 AS string), '.pdf') AS file_name,
  md5(concat(c.c_name, CAST(o.o_orderkey % 6 AS string))) AS file_md5,
  CASE o.o_orderkey % 6 WHEN 1 THEN 'PURCHASE_ORDER' WHEN 3 THEN 'SRF' WHEN 5 THEN 'QUOTE' ELSE CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE 'CONTRACT' END END AS doc_type,
  CASE WHEN o.o_orderkey % 41 = 0 THEN '' WHEN o.o_orderkey % 43 = 0 THEN c.c_name ELSE n.n_name END AS detected_group,
  CASE WHEN o.o_orderkey % 11 = 0 THEN '' WHEN o.o_orderkey % 13 = 0 THEN '服务合同-示例机械有限公司' WHEN o.o_orderkey % 17 = 0 THEN concat('关于', c.c_name) WHEN o.o_orderkey % 19 = 0 THEN 'Vendor Example' WHEN o.o_orderkey % 23 = 0 THEN n.n_name ELSE c.c_name END AS detected_company,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL WHEN o.o_orderkey % 29 = 0 THEN 1985 ELSE CAST(year(o.o_orderdate) + 10 AS int) END AS report_year,
  CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_totalprice END AS annual_maintenance_fee,
  CASE WHEN o.o_orderkey % 31 = 0 THEN CAST(50.0 AS double) WHEN o.o_orderkey % 37 = 0 THEN CAST(2018.0 AS double) END AS tax_excluded_amount,
  CASE WHEN o.o_orderkey % 53 = 0 THEN CAST(-1.0 AS double) * o.o_totalprice WHEN o.o_orderkey % 4 = 0 THEN CAST(0.0 AS double) END AS tax_included_amount,
  CASE WHEN o.o_orderkey % 5 = 0 THEN CAST(0.0 AS double) WHEN o.o_orderkey % 5 = 1 THEN o.o_totalprice WHEN o.o_orderkey % 59 = 0 THEN CAST(5.0 AS double) END AS contract_total_amount,
  CASE WHEN o.o_orderkey % 8 = 0 THEN '' ELSE CAST(CAST(o.o_orderdate AS date) AS string) END AS service_period_start,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(o.o_orderdate AS date) AS string) END AS service_period_end,
  CASE WHEN o.o_orderkey % 15 = 0 THEN '' WHEN o.o_orderkey % 14 = 0 THEN concat('与Vendor Example签订的', CAST(year(o.o_orderdate) AS string), '年合同') WHEN o.o_orderkey % 10 = 0 THEN 'Total Excluding VAT' ELSE concat(c.c_name, '的', CAST(year(o.o_orderdate) + 10 AS string), '年服务合同') END AS summary
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet") for name in ("orders", "customer", "nation")}
    return spark.sql(SYNTHETIC.replace("FROM orders o JOIN customer c", "FROM {orders} o JOIN {customer} c").replace("JOIN nation n", "JOIN {nation} n"), **tables)
