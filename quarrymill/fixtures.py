"""The driver's tables in the roles of the engine's inputs. Each view is one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

STATES = "MACTNYRIVTNHNJPAONQCABBCTXCAFLGAOHMIILWAORMESKMBNS"  # by nation, two letters each

VENDORS = f"""
SELECT c_custkey AS ord, concat('v', c_custkey) AS vendor_key,
  concat(CASE WHEN c_custkey % 7 = 3 THEN 'Acme ' ELSE 'Vendor ' END, c_custkey % 400,
         CASE c_custkey % 6 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Corp' WHEN 3 THEN ' Limited' WHEN 4 THEN '' ELSE ' Québec, Ltd' END) AS company_name,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('https://www.site', c_custkey % 300, '.com/about') WHEN 2 THEN concat('http://site', c_custkey % 300, '.com:8080/x')
       WHEN 3 THEN concat('V', c_custkey % 350, '.example.ca') ELSE concat('https://shop.v', c_custkey % 350, '.example.ca?q=1') END AS website,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('info', c_custkey, '@site', c_custkey % 300, '.com') END AS email,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('+1', 2000000000 + c_custkey) END AS phone,
  CAST(NULL AS STRING) AS location, concat('City ', c_nationkey % 5) AS city, substr('{STATES}', c_nationkey * 2 + 1, 2) AS state,
  CASE WHEN c_nationkey BETWEEN 8 AND 11 THEN 'Canada' ELSE 'United States' END AS country, c_mktsegment AS industry,
  CASE c_custkey % 4 WHEN 0 THEN 'canada_contracts' WHEN 1 THEN 'sam_entity' WHEN 2 THEN 'canada_odbus' ELSE 'serper_discovery' END AS source,
  c_custkey % 3 = 0 AS is_past_winner, CASE WHEN c_custkey % 11 = 0 THEN concat('uei', c_custkey % 90) ELSE NULL END AS uei, CAST(NULL AS STRING) AS duns,
  CASE WHEN c_custkey % 13 = 0 THEN concat('c', c_custkey % 70) ELSE NULL END AS cage_code,
  CASE WHEN c_acctbal > 0 THEN c_acctbal * 100 ELSE NULL END AS total_contract_value, c_custkey % 120 AS contract_count,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '8(a)' WHEN 2 THEN 'small business,WOSB' WHEN 3 THEN 'HUBZone' ELSE 'Large' END AS types,
  concat(CASE WHEN c_acctbal > 8000 THEN 'high_value_supplier,' ELSE '' END, CASE WHEN c_custkey % 120 > 50 THEN 'frequent_supplier,' ELSE '' END) AS flags
FROM {{customer}}
"""

REGISTRY = """
SELECT concat('s', s_suppkey) AS vendor_key, s_name AS legal_name, concat('City ', s_nationkey % 5) AS city, CASE WHEN s_nationkey % 2 = 0 THEN 'ON' ELSE 'Quebec' END AS state,
  CASE s_suppkey % 3 WHEN 0 THEN 'canada_contracts' WHEN 1 THEN 'canada_odbus' ELSE 'other' END AS source,
  CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE v.total END AS total_contract_value, CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE v.n END AS contract_count
FROM {supplier} LEFT JOIN (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS n FROM {lineitem} GROUP BY l_suppkey) v ON s_suppkey = v.l_suppkey
"""

CODES = """
SELECT DISTINCT concat('s', l_suppkey) AS vendor_key, concat(substr(concat('0', p_size), -2, 2), substr(p_brand, 7, 2), p_partkey % 10) AS code
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

CONTRACTS = """
SELECT l_orderkey * 8 + l_linenumber AS ord, concat('Supplier ', l_suppkey) AS legal_name, CAST(NULL AS STRING) AS standardized_name, CAST(NULL AS STRING) AS address,
  concat('City ', l_suppkey % 9) AS city, 'ON' AS state, concat(' k1a', l_suppkey % 10, ' b', l_suppkey % 7, 'c') AS postal_code, CAST(NULL AS STRING) AS employee_count_range,
  CASE WHEN l_partkey % 17 = 0 THEN '' ELSE concat('N', l_partkey % 40) END AS gsin, concat('U', l_partkey % 25) AS unspsc, CAST(NULL AS STRING) AS contact_name,
  CASE WHEN l_linenumber = 1 THEN concat('sales', l_suppkey, '@vendor', l_suppkey, '.com') ELSE '' END AS contact_email, CAST(NULL AS STRING) AS contact_phone,
  concat('C', l_orderkey) AS contract_number, l_returnflag AS description, l_linestatus AS category,
  CASE WHEN l_orderkey % 19 = 0 THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING) END AS value,
  CASE WHEN l_orderkey % 23 = 0 THEN '' ELSE substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) END AS date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

SECTIONS = """
SELECT conv_id AS tender_id, turn AS ord, concat(CASE turn % 9 WHEN 0 THEN '1. Scope of Work' WHEN 3 THEN 'Mandatory Requirements' WHEN 5 THEN 'Delivery location' WHEN 7 THEN 'Legal' ELSE '' END, '') AS title,
  concat(CASE WHEN conv_id % 3 = 0 THEN 'Work to be performed within 30 calendar days. ' ELSE '' END, coalesce(text, '')) AS content, CASE WHEN turn % 6 = 4 THEN 'table' ELSE 'text' END AS section_type
FROM {conversations}
"""


def _tables(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(sql)})


def plain(sql: str) -> str:
    """The view as SQL over the driver's tables."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    out = view(spark, sf_dir, VENDORS)
    return out.withColumn("business_types", listed("types")).withColumn("enrichment_flags", listed("flags")).drop("types", "flags")
