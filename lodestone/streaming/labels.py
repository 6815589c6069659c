"""Structured Streaming forms of the label fold and the request limiter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import one_of_each
from ..sources.files import exists


def fold(events: DataFrame, owner: str, label: Column, *order: str) -> DataFrame:
    """The last label of each owner so far: for update or complete output."""
    return events.withColumn("label", label).where("label is not null").groupBy(owner).agg(F.max_by("label", F.struct(*order)).alias("label"))


def rate_windows(events: DataFrame, time: str, owner: str, late: str = "10 minutes", size: str = "1 minute") -> DataFrame:
    """Requests of each owner in tumbling windows; events later than late are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), owner).agg(F.count("*").alias("n_requests"))


def ingest_stream(batches: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Appends each new key once, whichever batch brings it first: a batch is written to a folder of its own, so running it again
    writes nothing twice, and less the keys that the batches before it have.  Of rows with the same key the least stays."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = one_of_each(batch, key, None, False).select(*batch.columns)
        if exists(spark, path):
            there = spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, batch int").parquet(path).where(F.col("batch") < number)
            new = new.join(there.select(key), key, "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
