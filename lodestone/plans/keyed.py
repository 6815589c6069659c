"""Queries over keyed tables: look-ups by key, hydration, upserts and deletions that touch only their buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from ..sources.scratch import shared_dir
from ..sources.tables import table


def laid_out(spark: SparkSession, rows: DataFrame, owner: str, key: str) -> KeyedTable:
    made = KeyedTable.make(spark, f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/keyed-{uuid.uuid4().hex[:12]}", rows.schema, owner, key)
    made.append(rows)
    return made


def _orders(spark: SparkSession, sf_dir: str) -> KeyedTable:
    return laid_out(spark, table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


def keyed_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all vectors whose id is divisible by 100, from the documents laid out by id."""
    docs = laid_out(spark, table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", "doc_id")
    found = docs.lookup(table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("doc_id")))
    return found.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def keyed_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of two customers: their buckets alone are read."""
    return _orders(spark, sf_dir).of([7, 32]).select("o_custkey", "o_orderkey", "o_orderstatus")


def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every fiftieth customer closed, and a new one for each of them."""
    orders = _orders(spark, sf_dir)
    some = table(spark, sf_dir, "orders").where("o_custkey % 50 = 0").select("o_custkey", "o_orderkey", F.lit("C").alias("o_orderstatus"))
    new = some.select("o_custkey").distinct().select("o_custkey", (-F.col("o_custkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))
    orders.upsert(some.unionByName(new.select(*(F.col(c).cast(some.schema[c].dataType) for c in some.columns))))
    return orders.rows()


def keyed_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders less all of every fortieth customer and less every ninth order."""
    orders, all_orders = _orders(spark, sf_dir), table(spark, sf_dir, "orders")
    orders.delete(all_orders.where("o_custkey % 40 = 0").select("o_custkey").distinct())
    orders.delete(all_orders.where("o_orderkey % 9 = 0").select("o_custkey", "o_orderkey"))
    return orders.rows()


QUERIES = {f.__name__: f for f in (keyed_hydration, keyed_get, keyed_upsert, keyed_delete)}
ORACLE = {
    "keyed_hydration": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents JOIN embeddings ON vec_id = doc_id WHERE vec_id % 100 = 0",
    "keyed_get": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (7, 32)",
    "keyed_upsert": "SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN 'C' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT DISTINCT o_custkey, -o_custkey, 'N' FROM orders WHERE o_custkey % 50 = 0",
    "keyed_delete": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 40 <> 0 AND o_orderkey % 9 <> 0",
}
