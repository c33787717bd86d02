"""Views derived from the recorded pages: two snapshots of a site, URL variants, and a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlloom.functions.classify import resource_type

PREV = """SELECT page_id AS pos, url, '' AS parent_url,
  CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status_code,
  CASE page_id % 7 WHEN 0 THEN 'text/css' WHEN 1 THEN 'application/javascript' WHEN 2 THEN 'image/png'
    WHEN 3 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type
  FROM pages WHERE page_id % 10 <> 0"""
CURR = """SELECT page_id AS pos, url, '' AS parent_url,
  CASE WHEN page_id % 29 = 0 THEN 0 WHEN page_id % 13 = 0 THEN 500 WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status_code,
  CASE WHEN page_id % 29 = 0 THEN '' WHEN page_id % 19 = 0 THEN 'application/json' WHEN page_id % 7 = 0 THEN 'text/css'
    WHEN page_id % 7 = 1 THEN 'application/javascript' WHEN page_id % 7 = 2 THEN 'image/png' WHEN page_id % 7 = 3 THEN 'application/pdf'
    ELSE 'text/html; charset=utf-8' END AS content_type
  FROM pages WHERE page_id % 10 <> 1"""
DUP = """SELECT page_id AS pos,
  'https://' || CASE WHEN page_id % 11 = 0 THEN 'E.test' ELSE 'e.test' END || '/p/' || CAST(page_id % 37 AS VARCHAR(20))
    || CASE WHEN page_id % 4 = 0 THEN '/' ELSE '' END
    || CASE WHEN page_id % 3 = 0 THEN '?q=' || CAST(page_id % 2 AS VARCHAR(20)) ELSE '' END
    || CASE WHEN page_id % 6 = 1 THEN '#top' ELSE '' END AS url,
  '' AS parent_url, 200 AS status_code, 'text/html' AS content_type
  FROM pages"""
GRAPH = """SELECT page_id AS src, (page_id * 3 + 1) % (SELECT count(*) FROM pages) AS dst FROM pages WHERE page_id % 4 <> 3
  UNION SELECT page_id AS src, (page_id * page_id + 2) % (SELECT count(*) FROM pages) AS dst FROM pages WHERE page_id % 5 <> 4"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("pages", "{pages}"), pages=pages(spark, sf_dir))


def prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PREV).withColumn("resource_type", resource_type(F.col("content_type")))


def curr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CURR).withColumn("resource_type", resource_type(F.col("content_type")))


def dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DUP)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst) of a cyclic graph over the page numbers; some nodes aren't reached from 0."""
    return view(spark, sf_dir, GRAPH)
