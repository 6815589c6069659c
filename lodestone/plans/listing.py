"""Listing, sorting, paging and counting queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as X
from ..operators import listing as L
from ..operators import vectors as V
from ..sources.paged import PagedOrder
from ..sources.scratch import shared_dir
from ..sources.tables import table
from .search import HITS

SIZE = 20


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the listing's columns: the text's start as title, the source and language as authors, a year for most, two pages for long ones."""
    docs = table(spark, sf_dir, "documents")
    year, stamp = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 30 + 1990).cast("int")), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("doc_id") % 50).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.array("source", "lang").alias("authors"), year.alias("year"), F.when(F.col("n_chars") > 5000, 2).otherwise(1).alias("page_count"), F.concat(F.lit("/data/"), "source").alias("source_path"), stamp.alias("created_at"))


def documents_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("id", "title", F.array_join("authors", ", ").alias("authors"), "year", "page_count", "source_path")


def list_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(50)


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 40))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("sort_key"))


def documents_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by title."""
    return L.sorted_documents(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def documents_sorted_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by each of the other keys, both ways."""
    docs, out = _documents(spark, sf_dir), None
    for key in ("year", "author", "created", "id"):
        for descending in (False, True):
            rows = L.sorted_documents(docs, key, descending).select(F.lit(key).alias("key"), F.lit(descending).alias("descending"), "pos", "id")
            out = rows if out is None else out.unionByName(rows)
    return out


def documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = 2
    docs = _sorted(spark, sf_dir)
    n = docs.agg(F.count("*").alias("n"))
    rows = docs.orderBy("sort_key", "doc_id").offset((page - 1) * SIZE).limit(SIZE)
    out = rows.crossJoin(F.broadcast(n))  # one row
    return out.select(F.lit(page).alias("page"), X.total_pages(F.col("n"), SIZE).alias("total_pages"), F.lit((page - 1) * SIZE + 1).alias("showing_start"), F.least(F.lit(page * SIZE), "n").cast("int").alias("showing_end"), "doc_id")


def documents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written in order of title; the first page, the rows after its last key, and the last page."""
    paged = PagedOrder.write(_sorted(spark, sf_dir), f"{shared_dir(spark)}/lodestone/pages-{uuid.uuid4().hex[:12]}", ["sort_key", "doc_id"])
    rows = lambda df, how: df.select(F.lit(how).alias("how"), "pos", "doc_id")
    first = paged.page(1, SIZE)
    end = first.agg(F.max(F.struct("pos", "sort_key", "doc_id")).alias("x")).first().x
    key = None if end is None else {"sort_key": end.sort_key, "doc_id": end.doc_id}
    out = rows(first, "first").unionByName(rows(paged.page(max(1, -(-paged.total() // SIZE)), SIZE), "last"))
    return out if key is None else out.unionByName(rows(paged.after(key, SIZE), "after"))


def pagination_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    rows = rows.select("key", (F.col("key") % 12 + 1).alias("total"), ((F.col("key") * 7) % (F.col("key") % 12 + 1) + 1).alias("current"))
    return rows.select("key", F.array_join(X.pagination_strip(F.col("current").cast("int"), F.col("total").cast("int")), " ").alias("strip"))


def search_over_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of five results of a search that fetched enough for all of its pages."""
    vectors = table(spark, sf_dir, "embeddings")
    hits = V.knn(vectors, V.fetch(vectors, 0), X.over_fetch(X.check_top_k(5)))
    return V.shown(hits.where("rank between 11 and 15"), "vec_id")


def upload_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a batch: errors failed, the rest completed."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"))
    said = F.when(F.col("failed") == 0, F.format_string("%d completed", "completed")).when(F.col("completed") == 0, F.format_string("%d failed", "failed")).otherwise(F.format_string("%d completed, %d failed", "completed", "failed"))
    return n.withColumn("message", said)


def upload_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9).alias("done"), (F.col("event_id") * 13 % 101).alias("percent"))
    return rows.select("event_id", X.progress(F.col("done"), F.col("percent"), F.lit(9)).alias("progress"))


def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in one-minute windows, and whether they pass a limit of two."""
    n = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n_requests"))
    return n.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_requests", (F.col("n_requests") > 2).alias("limited"))


QUERIES = {f.__name__: f for f in (documents_list, list_limit, documents_sorted, documents_sorted_by, documents_page, documents_pages, pagination_strip, search_over_fetch, upload_stats, upload_progress, rate_window)}
ORACLE = {
    "documents_list": "SELECT doc_id AS id, substr(text, 1, 40) AS title, source || ', ' || lang AS authors, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 30 + 1990 AS INT) END AS year, CASE WHEN n_chars > 5000 THEN 2 ELSE 1 END AS page_count, '/data/' || source AS source_path FROM documents",
    "documents_sorted_by": " UNION ALL ".join(
        f"SELECT '{key}' AS key, {way == 'DESC'} AS descending, CAST(row_number() OVER (ORDER BY {value} {way}, doc_id) AS INT) AS pos, doc_id AS id FROM documents"
        for key, value in (("year", "CASE WHEN doc_id % 7 <> 0 THEN doc_id % 30 + 1990 ELSE 0 END"), ("author", "lower(source)"), ("created", "doc_id % 50"), ("id", "doc_id"))
        for way in ("ASC", "DESC")
    ),
    "search_over_fetch": f"WITH {HITS} SELECT rank, vec_id, round(c, 6) AS score FROM t WHERE rank BETWEEN 11 AND 15",
    "list_limit": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50",
    "documents_sorted": "SELECT CAST(row_number() OVER (ORDER BY k, doc_id) AS INT) AS pos, doc_id, k AS sort_key FROM (SELECT doc_id, lower(substr(coalesce(text, ''), 1, 40)) AS k FROM documents)",
    "documents_page": "SELECT 2 AS page, CAST(greatest(1, ceil(n / 20.0)) AS INT) AS total_pages, 21 AS showing_start, CAST(least(40, n) AS INT) AS showing_end, doc_id FROM (SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY lower(substr(coalesce(text, ''), 1, 40)), doc_id) AS r FROM documents) WHERE r BETWEEN 21 AND 40",
    "pagination_strip": """SELECT key, CASE WHEN t <= 7 THEN array_to_string(range(1, greatest(t, 1) + 1), ' ') WHEN c <= 4 THEN '1 2 3 4 5 ... ' || t WHEN c >= t - 3 THEN '1 ... ' || array_to_string(range(t - 4, t + 1), ' ')
        ELSE '1 ... ' || array_to_string(range(c - 1, c + 2), ' ') || ' ... ' || t END AS strip FROM (SELECT o_orderkey AS key, o_orderkey % 12 + 1 AS t, (o_orderkey * 7) % (o_orderkey % 12 + 1) + 1 AS c FROM orders)""",
    "upload_stats": """SELECT *, CASE WHEN failed = 0 THEN completed || ' completed' WHEN completed = 0 THEN failed || ' failed' ELSE completed || ' completed, ' || failed || ' failed' END AS message
        FROM (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)""",
    "upload_progress": "SELECT event_id, CAST(floor((event_id % 9 + (event_id * 13 % 101) / 100.0) / 9 * 100 + 0.5) AS INT) AS progress FROM events",
    "rate_window": "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_requests, count(*) > 2 AS limited FROM events GROUP BY date_trunc('minute', ts)",
}
