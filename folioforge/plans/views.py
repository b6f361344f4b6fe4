"""The driver's tables as the capture model: captures from pages, their texts from documents, collections from sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.cluster import spread
from folioforge.functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for queries that work long on each row."""
    return spread(table(spark, sf_dir, name))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, url, url_canon, title, doi, updated_at."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").cast("string").alias("id"), "url", urls.canonical_url(F.col("url")).alias("url_canon"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit("").alias("doi"), F.col("page_id").alias("updated_at"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, content_text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("capture_id"), F.col("text").alias("content_text"))


def indexed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title: the captures of pages, and documents without a page as captures without a title."""
    pages = captures(spark, sf_dir).select("id", "title")
    return pages.unionByName(texts(spark, sf_dir).select(F.col("capture_id").alias("id"), F.lit("").alias("title")).join(pages, "id", "left_anti"))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name: the sources, numbered by the digits in their names."""
    return table(spark, sf_dir, "documents").select("source").distinct().select(F.regexp_extract("source", r"(\d+)", 1).try_cast("long").alias("id"), F.col("source").alias("name"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collection_id, capture_id."""
    return table(spark, sf_dir, "documents").select(F.regexp_extract("source", r"(\d+)", 1).try_cast("long").alias("collection_id"), F.col("doc_id").cast("string").alias("capture_id"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliographic rows made of documents: every field is blank in some of them. The abstract is the whole text."""
    d = spread_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.cast("string").alias("id"),
        F.when(i % 7 == 0, "").otherwise(F.concat(F.lit('The {"'), F.substring_index("text", " ", 3), F.lit('"} \\ case'))).alias("title"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("10."), (i + 1000).cast("string"), F.lit("/x"))).alias("doi"),
        F.concat(F.lit("https://example.org/"), i.cast("string")).alias("url"),
        F.when(i % 5 != 0, (F.lit(1990) + i % 35).cast("int")).alias("year"),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("Journal of "), F.col("source"))).alias("container_title"),
        F.when(i % 6 == 0, F.array().cast("array<string>")).when(i % 6 == 1, F.array(F.lit("Ann Lee"))).when(i % 6 == 2, F.array(F.lit("Ann Lee"), F.lit("Bo Roe"))).otherwise(F.array(F.lit("Ann Lee"), F.lit("Bo Roe"), F.lit("Cy Poe"))).alias("authors"),
        F.when(i % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("lang"), F.col("source"))).alias("keywords"),
        F.when(i % 9 == 0, "").otherwise(F.col("text")).alias("abstract"),
    )


CAPTURES_SQL = r"""
u AS (SELECT page_id, url, html, regexp_replace(url, '#.*$', '') AS a FROM pages),
v AS (SELECT *, regexp_extract(a, '^([^?]*)', 1) AS base, regexp_extract(a, '\?(.*)$', 1) AS q FROM u),
w AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: regexp_matches(p, '^[^=]+=.') AND lower(split_part(p, '=', 1)) NOT IN
  ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','utm_reader','utm_name','utm_cid','gclid','dclid','fbclid','msclkid','ref','ref_src','ref_url'))), '&') AS kept FROM v),
captures AS (SELECT page_id::VARCHAR AS id, url,
  lower(regexp_extract(base, '^([a-zA-Z]+://[^/]*)', 1)) || coalesce(nullif(regexp_extract(base, '^[a-zA-Z]+://[^/]*(/.*)$', 1), ''), '/') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url_canon,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, '' AS doi, page_id AS updated_at FROM w),
texts AS (SELECT doc_id::VARCHAR AS capture_id, text AS content_text FROM documents),
items AS (SELECT regexp_extract(source, '(\d+)', 1)::BIGINT AS collection_id, doc_id::VARCHAR AS capture_id FROM documents),
collections AS (SELECT DISTINCT regexp_extract(source, '(\d+)', 1)::BIGINT AS id, source AS name FROM documents)
"""

WORKS_SQL = r"""
works AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'The {"' || array_to_string(string_split(text, ' ')[1:3], ' ') || '"} \ case' END AS title,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE '10.' || (doc_id + 1000) || '/x' END AS doi, 'https://example.org/' || doc_id AS url,
  CASE WHEN doc_id % 5 <> 0 THEN 1990 + doc_id % 35 END AS year, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Journal of ' || source END AS container_title,
  CASE WHEN doc_id % 6 = 0 THEN [] WHEN doc_id % 6 = 1 THEN ['Ann Lee'] WHEN doc_id % 6 = 2 THEN ['Ann Lee', 'Bo Roe'] ELSE ['Ann Lee', 'Bo Roe', 'Cy Poe'] END::VARCHAR[] AS authors,
  CASE WHEN doc_id % 8 = 0 THEN [] ELSE [lang, source] END::VARCHAR[] AS keywords, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS abstract FROM documents)
"""
