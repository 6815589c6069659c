"""A written order of rows, read a page at a time.

Rows are cut into ranges of the order, a folder each, with their place in the range; a small table holds each
range's number of rows, the rows before it and its last key.  A page by number, or the rows after a key, then read only
the ranges they lie in: the first page costs as much as the last."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

#: Columns of a written order's own.
RANGE, PLACE = "_range", "_place"


class PagedOrder:
    """The order at a path; order names the columns, ascending with nulls first, whose values together are different in all rows."""

    def __init__(self, spark: SparkSession, path: str, order: list[str]):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    @classmethod
    def write(cls, rows: DataFrame, path: str, order: list[str], ranges: int | None = None) -> PagedOrder:
        """Writes rows to a new path.  ranges: how many at most, else as many as the session's shuffles have partitions.

        The table of ranges is written last: an order that a lost job left without it cannot be read."""
        out = cls(rows.sparkSession, path, order)
        by = [F.col(c).asc_nulls_first() for c in order]
        cut = rows.repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by)
        at = F.monotonically_increasing_id()  # the partition in the upper bits, the row's place in it below
        placed = cut.withColumn("_at", at).withColumns({RANGE: F.shiftright("_at", 33).cast("int"), PLACE: F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
        placed.write.partitionBy(RANGE).parquet(f"{out.path}/rows")
        rows.limit(0).write.parquet(f"{out.path}/columns")
        key = F.struct(*order)
        sizes = out._rows().groupBy(RANGE).agg(F.count("*").alias("n"), F.max(key).alias("last"))
        before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{out.path}/ranges")
        return out

    def _columns(self) -> StructType:
        return self.spark.read.parquet(f"{self.path}/columns").schema

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self._columns().add(PLACE, LongType()).add(RANGE, IntegerType())).parquet(f"{self.path}/rows")

    def ranges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranges")

    def total(self) -> int:
        return self.ranges().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _in(self, found: list[Row]) -> DataFrame:
        """The rows of some ranges, with their place in the whole order, from 1, as pos."""
        if not found:
            return self.spark.createDataFrame([], self._columns().add("pos", LongType()))
        start = F.lit(0)
        for r in found:  # a page's: few
            start = F.when(F.col(RANGE) == r[RANGE], F.lit(r.start)).otherwise(start)
        return self._rows().where(F.col(RANGE).isin([r[RANGE] for r in found])).withColumn("pos", start + F.col(PLACE) + 1).drop(RANGE, PLACE)

    def page(self, number: int, size: int) -> DataFrame:
        """The number-th page (from 1) of size rows, in order; past the end, none."""
        if number < 1 or size < 1:
            raise ValueError("pages and their size start at 1")
        low, high = (number - 1) * size, number * size
        found = self.ranges().where((F.col("start") < high) & (F.col("start") + F.col("n") > low)).collect()
        return self._in(found).where((F.col("pos") > low) & (F.col("pos") <= high)).orderBy("pos")

    def after(self, key: dict[str, Any] | None, size: int) -> DataFrame:
        """The next size rows after a key, whether a row has it or not; without one, the first rows."""
        if size < 1:
            raise ValueError("a page's size starts at 1")
        types = {f.name: f.dataType for f in self._columns()}
        asked = None if key is None else F.struct(*(F.lit(key[c]).cast(types[c]).alias(c) for c in self.order))
        left = self.ranges() if asked is None else self.ranges().where(F.col("last") > asked)
        first = left.agg(F.min("start").alias("s"), F.min_by("n", "start").alias("n")).first()
        if first.s is None:
            return self._in([])
        # Of the first of these ranges perhaps one row is after the key; those behind it have all theirs after it.
        found = left.where(F.col("start") < first.s + first.n + size - 1).collect()
        rows = self._in(found)
        return (rows if asked is None else rows.where(F.struct(*self.order) > asked)).orderBy("pos").limit(size)
