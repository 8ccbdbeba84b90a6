"""Domain tables derived from the given tables.

Every text below is plain SQL that Spark and the checking engine both run, so a query and its check start
from the same rows. All are projections (or distinct sets) of whole tables and grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millaudit.session import table

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DERIVED = {
    # One report per order: food name and production date text in four spellings.
    "d_report": """
SELECT o_orderkey AS report_id,
  CASE o_custkey % 12 WHEN 0 THEN '鲜黄瓜' WHEN 1 THEN '星光幼儿配方奶粉3段' WHEN 2 THEN '纯牛奶(250ml)' WHEN 3 THEN '苹果香蕉汁'
    WHEN 4 THEN '火腿肠' WHEN 5 THEN '胡萝卜' WHEN 6 THEN '大豆油' WHEN 7 THEN '草鱼片' WHEN 8 THEN '食品' || CAST(o_custkey % 97 AS STRING)
    WHEN 9 THEN '' WHEN 10 THEN '番茄炒鸡蛋' ELSE '风味酸乳' END AS food_name,
  CASE o_orderkey % 4
    WHEN 0 THEN CAST(year(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) || '-' || CAST(day(o_orderdate) AS STRING)
    WHEN 1 THEN CAST(year(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING)
    WHEN 2 THEN CAST(year(o_orderdate) AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) || '.' || CAST(day(o_orderdate) AS STRING)
    ELSE CAST(year(o_orderdate) AS STRING) || '年' || CAST(month(o_orderdate) AS STRING) || '月' || CAST(day(o_orderdate) AS STRING) || '日' END AS production_date,
  CASE o_orderkey % 6 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'LARGE' ELSE 'SMALL' END || '/Brand#' || CAST(1 + o_orderkey % 25 AS STRING) AS category,
  CAST(o_orderdate AS DATE) AS made, o_custkey AS custkey
FROM {orders}""",
    # One reported item per line: (line, part, supp, price) is its place in the report.
    "d_item": """
SELECT l_orderkey AS report_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
  CASE l_orderkey % 6 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'LARGE' ELSE 'SMALL' END || '/Brand#' || CAST(1 + l_orderkey % 25 AS STRING) AS category,
  CASE l_partkey % 6 WHEN 0 THEN p_name || '（以' || p_brand || '计）' WHEN 1 THEN replace(p_name, ' ', '') || '总量'
    WHEN 2 THEN '总' || p_name WHEN 3 THEN replace(p_name, ' ', '和') WHEN 4 THEN p_name || '1' ELSE p_name END AS item,
  CASE l_suppkey % 4 WHEN 0 THEN 'mg/kg' WHEN 1 THEN 'g/100g' WHEN 2 THEN '' ELSE 'CFU/g' END AS unit,
  CASE l_suppkey % 8 WHEN 0 THEN '≤' || CAST(10 + l_suppkey % 30 AS STRING) WHEN 1 THEN '≥' || CAST(5 + l_suppkey % 20 AS STRING)
    WHEN 2 THEN '5~' || CAST(10 + l_suppkey % 30 AS STRING) WHEN 3 THEN 'n=5,c=2,m=10,M=40' WHEN 4 THEN '不得检出' WHEN 5 THEN ''
    WHEN 6 THEN CAST(10 + l_suppkey % 30 AS STRING) ELSE 'n=5,c=0,m=0' END AS standard,
  CASE l_partkey % 7 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN 1 THEN '<0.01' WHEN 2 THEN '未检出'
    WHEN 3 THEN '<10,' || CAST(CAST(l_quantity AS INT) AS STRING) || ',20,15,12' WHEN 4 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ':1'
    WHEN 5 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.5' ELSE 'ND' END AS value,
  CASE l_suppkey % 3 WHEN 0 THEN 'GB 5009.' || CAST(l_partkey % 20 AS STRING) || '-2016 第一法'
    WHEN 1 THEN 'GB/T 5009.' || CAST(l_partkey % 20 AS STRING) || '-2016 第二法' ELSE '' END AS method,
  l_shipdate AS shipped, l_extendedprice AS price
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # Rule book: required items per category; place by part number.
    "d_rule": """
SELECT p_type || '/' || p_brand AS category, p_partkey AS pos,
  CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '') || '之和' WHEN 2 THEN replace(p_name, ' ', '、')
    WHEN 3 THEN p_name || '（' || p_brand || '）' ELSE substr(p_name, 1, 7) END AS item_name,
  CASE WHEN p_partkey % 4 = 1 THEN '限' || p_brand || '产品' ELSE '' END AS condition,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '产品明示标准' ELSE 'GB ' || CAST(2000 + p_size AS STRING) END AS standard_basis,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'GB 5009.' || CAST(p_partkey % 20 AS STRING) || ' 第一法'
    ELSE 'GB 5009.' || CAST(p_partkey % 20 AS STRING) || ' 第二法、第三法' END AS test_method,
  p_size AS source_page
FROM {part}""",
    # Registry of standards.
    "d_standard": """
SELECT 'GB ' || CAST(2000 + s_suppkey AS STRING) || '-2016' AS code,
  CAST(1990 + s_suppkey % 9 AS STRING) || '-03-01' AS publish_date,
  CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(1995 + s_suppkey % 5 AS STRING) || '年3月1日'
    ELSE CAST(1992 + s_suppkey % 10 AS STRING) || '-0' || CAST(1 + s_suppkey % 9 AS STRING) || '-15' END AS implement_date,
  CASE WHEN s_suppkey % 7 = 3 THEN '2030-01-01' ELSE NULL END AS abolish_date,
  CASE s_suppkey % 5 WHEN 0 THEN '现行有效' WHEN 1 THEN '已废止' WHEN 2 THEN '即将实施' WHEN 3 THEN NULL ELSE '有效' END AS status,
  'https://standards.example/' || CAST(s_suppkey AS STRING) AS detail_url
FROM {supplier}""",
    # Cited codes of a report; some are not in the registry.
    "d_cited": """
SELECT DISTINCT l_orderkey AS report_id, l_suppkey AS pos,
  CASE l_suppkey % 5 WHEN 0 THEN 'GB ' || CAST(90000 + l_suppkey AS STRING) WHEN 1 THEN 'GB/T ' || CAST(2000 + l_suppkey AS STRING) || '- 2016'
    ELSE 'GB ' || CAST(2000 + l_suppkey AS STRING) || '-2016' END AS code,
  CASE l_orderkey % 6 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'LARGE' ELSE 'SMALL' END || '/Brand#' || CAST(1 + l_orderkey % 25 AS STRING) AS category
FROM {lineitem}""",
    # Verdict store with old and young rows.
    "d_store": """
SELECT DISTINCT 'GB ' || CAST(2000 + l_suppkey AS STRING) || '-2016' AS code,
  CAST(year(l_shipdate) AS STRING) || '-01-01' AS production_date,
  l_suppkey % 2 = 0 AS passed, CASE WHEN l_suppkey % 2 = 0 THEN 'valid' ELSE 'obsolete' END AS status,
  1700000000.0 + 7200.0 * (l_suppkey % 24) AS ts
FROM {lineitem}""",
    # Lookups of verdicts.
    "d_request": """
SELECT CASE WHEN user_id % 9 = 0 THEN 'GB 9' ELSE 'GB ' || CAST(2000 + user_id AS STRING) || '-2016' END AS code,
  CAST(1992 + event_id % 10 AS STRING) || '-01-01' AS production_date, event_type, ts AS asked
FROM {events}""",
    # Human decisions on items of a report.
    "d_override": """
SELECT o_orderkey AS report_id, '__ev_choice__' || CAST(c_nationkey AS STRING) AS key,
  CASE o_custkey % 4 WHEN 0 THEN 'compliant' WHEN 1 THEN 'exceeded' WHEN 2 THEN 'unit_mismatch' ELSE 'standard_mismatch' END AS decision,
  c_nationkey AS nation
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
}


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    text = DERIVED[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, folder, t) for t in used})


def check_sql(text: str) -> str:
    """The checking SQL with the derived tables it names put in front."""
    names = [n for n in DERIVED if re.search(rf"\b{n}\b", text)]
    parts = []
    for name in names:
        body = DERIVED[name]
        for t in BASE:
            body = body.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({body})")
    text = text.strip()
    if not parts:
        return text
    if text.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + text[15:]
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:]
    return "WITH " + ",\n".join(parts) + "\n" + text
