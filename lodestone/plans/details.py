"""Detail, display and small lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import markup as M
from ..operators import store as S
from ..sources.tables import table
from .structure import _H, tei_pages


def text_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id = 11")
    return docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("content_md5"), F.col("source").alias("parent_id"), F.length("text").cast("long").alias("character_count"))


def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document's page shows, of every page read as TEI."""
    d = M.documents(M.tei(tei_pages(spark, sf_dir)))
    return d.select("id", F.coalesce("title", F.lit("")).alias("title"), F.array_join(F.transform("authors", lambda a: a["last_name"]), "; ").alias("authors"), "year", "abstract", "doi", "page_count")


def display_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    human, key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("h-"), "lang")).otherwise(""), F.when(F.col("doc_id") % 3 == 1, F.col("source"))
    return docs.select("doc_id", S.display_id(human, key, F.col("doc_id").cast("string")).alias("shown"))


def page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column's page, else the metadata's; 0 is none."""
    rows = table(spark, sf_dir, "events")
    meta = F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"page"'))).otherwise(F.replace("props", F.lit('"k"'), F.lit('"page_num"')))
    return rows.select("event_id", S.page_number((F.col("event_id") % 3).cast("int"), meta).alias("page"))


def author_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderpriority", F.lit("x")).alias("a"), F.year("o_orderdate").alias("y"))
    return rows.select("o_orderkey", T.author_year(F.col("a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("y"))).alias("shown"), T.abbreviate(F.md5(F.col("o_orderkey").cast("string"))).alias("short_id"))


def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").endswith(".html")).select("page_id")


def blank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.substring("text", 1, 5)).alias("query"))
    return asked.where(F.trim("query") != "").select("doc_id")


def headings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first headings by index, unknown ones first."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size")).alias("index"))
    return rows.orderBy(F.asc_nulls_first("index"), "p_partkey").limit(40)


def first_and_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten customers without a positive balance, and how many more there are."""
    rows = table(spark, sf_dir, "customer").where("c_acctbal <= 0").select("c_custkey")
    more = F.broadcast(rows.agg(F.greatest(F.count("*") - 10, F.lit(0)).alias("n_more")))  # one row
    return rows.orderBy("c_custkey").limit(10).crossJoin(more)


def model_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's limit by name in either case, with defaults for names that have none."""
    limits = table(spark, sf_dir, "region").select(F.lower("r_name").alias("name"), ((F.col("r_regionkey") + 1) * 100).alias("rpm"))
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.upper(F.concat(F.lit("region_"), (F.col("n_nationkey") % 7).cast("string")))).otherwise(F.col("n_name")).alias("model"))
    return asked.join(limits, F.lower("model") == F.col("name"), "left").select("n_nationkey", F.coalesce("rpm", F.lit(60)).alias("rpm"))


QUERIES = {f.__name__: f for f in (text_detail, document_detail, display_id, page_number, author_year, suffix_filter, blank_queries, headings_in_order, first_and_more, model_limits)}
ORACLE = {
    "text_detail": "SELECT doc_id AS id, md5(text) AS content_md5, source AS parent_id, length(text) AS character_count FROM documents WHERE doc_id = 11",
    "document_detail": f"SELECT page_id::VARCHAR AS id, trim({_H}) AS title, 'Cole ' || page_id || '; Day' AS authors, 2021 AS year, 'All of ' || page_id || '.' AS abstract, '10.1/' || page_id AS doi, 2 AS page_count FROM pages",
    "display_id": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'h-' || lang WHEN 1 THEN source ELSE doc_id::VARCHAR END AS shown FROM documents",
    "page_number": "SELECT event_id, CAST(coalesce(nullif(event_id % 3, 0), nullif(CAST(json_extract(props, '$.k') AS INT), 0)) AS INT) AS page FROM events",
    "author_year": "SELECT o_orderkey, o_orderpriority || ' (' || CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate)::VARCHAR ELSE '' END || ')' AS shown, substr(md5(o_orderkey::VARCHAR), 1, 10) AS short_id FROM orders",
    "suffix_filter": "SELECT page_id FROM pages WHERE ends_with(url, '.html')",
    "blank_queries": "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND trim(substr(text, 1, 5)) <> ''",
    "headings_in_order": "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size END AS \"index\" FROM part ORDER BY 2 NULLS FIRST, 1 LIMIT 40",
    "first_and_more": "SELECT c_custkey, greatest((SELECT count(*) FROM customer WHERE c_acctbal <= 0) - 10, 0) AS n_more FROM customer WHERE c_acctbal <= 0 ORDER BY 1 LIMIT 10",
    "model_limits": "SELECT n_nationkey, CAST(coalesce((r_regionkey + 1) * 100, 60) AS INT) AS rpm FROM nation LEFT JOIN region ON lower(r_name) = lower(CASE WHEN n_nationkey % 2 = 0 THEN 'region_' || (n_nationkey % 7) ELSE n_name END)",
}
