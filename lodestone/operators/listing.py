"""Sorted listings of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: What documents can be sorted by: a key, and its value where it is missing.
SORT_KEYS = {
    "title": lambda c: F.lower(F.coalesce(c["title"], F.lit(""))),
    "year": lambda c: F.coalesce(c["year"], F.lit(0)),
    "author": lambda c: F.lower(F.coalesce(F.get(c["authors"], F.lit(0)), F.lit(""))),
    "created": lambda c: c["created_at"],
    "id": lambda c: c["id"],
}


def positions(rows: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """rows with their place, from 1, in a total order.  No task sees all rows: ranges are sorted and written once with
    their rows' numbers, and a range's rows start after those of the ranges before it."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "sorted")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    out = placed.withColumns({"_part": part, "_row": row}).join(F.broadcast(starts), "_part")  # as many rows as ranges
    return out.withColumn(name, (F.col("_start") + F.col("_row") + 1).cast("int")).select(name, *rows.columns)


def sorted_documents(docs: DataFrame, key: str = "title", descending: bool = False) -> DataFrame:
    """pos, id and the sort key of documents (id, title, year, authors, created_at); ties stay in id order, whichever way the key goes."""
    rows = docs.select(F.col("id"), SORT_KEYS[key](docs).alias("sort_key"))
    by = F.col("sort_key")
    return positions(rows, by.desc_nulls_last() if descending else by.asc_nulls_first(), F.col("id").asc())
