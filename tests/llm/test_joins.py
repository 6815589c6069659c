"""Joins on keys of any length, some of them hot."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, url_filter


@pytest.mark.parametrize("least_bytes", [0, 1 << 30])
def test_join_of_long_keys(spark, monkeypatch, least_bytes):
    """Broadcast whole or met by salted shuffle: every row once, with its key's row."""
    monkeypatch.setattr(common, "SMALL_BYTES", least_bytes)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    many = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"), F.lit(1).alias("hot_salt"))
    one = many.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.repeat("k", 3))
    joined = common.join_texts(many, one, "k", "n")
    assert set(joined.columns) == {"k", "id", "hot_salt", "n", "v"}
    rows = joined.collect()
    assert len(rows) == 3000 and len({r.id for r in rows}) == 3000 and all(r.v == 3 * r.k and r.hot_salt == 1 for r in rows)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == (2 if least_bytes == 0 else 1)  # the marks on both sides, or the table
    assert common.join_texts(many.limit(0), one.limit(0), "k", "n").count() == 0


def test_urls_judged_without_a_broadcast_are_judged_the_same(spark, small, monkeypatch):
    want = sorted(map(tuple, url_filter.op2_url_filter(spark, small).collect()))
    monkeypatch.setattr(common, "SMALL_BYTES", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 30)
    assert want and sorted(map(tuple, url_filter.op2_url_filter(spark, small).collect())) == want
