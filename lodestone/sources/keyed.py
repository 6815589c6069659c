"""Relations laid out by key: hash buckets of the owner, rows sorted by key, a Bloom filter of the keys in every row group.

A row's bucket is the hash of its owner (a text's document, say) modulo the number of buckets, so what
belongs to one owner lies in one bucket of every relation.  A look-up by owner names its bucket as a
constant, so only that folder is listed in the plan; within it the sorted row groups, their page
statistics and the Bloom filter rule out what does not have the key.  Changes write the touched buckets
anew beside the old ones and then switch (sources/partitions.py); other buckets are not read.

Buckets should hold about a gigabyte: a table of 100 TB takes some 100,000.  Their number is fixed when
the table is made and stands in its ``_layout`` file, with owner, key and schema."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .partitions import Folder, add, recover, stage, switch

LAYOUT, BUCKET = "_layout", "bucket"
BUCKETS = 16
#: Keys named as constants in one look-up; more are joined.
NAMED = 1000
#: Bytes of a bucket that one task writes anew.
SHARE = 8 << 20


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)
        if not self.folder.exists(LAYOUT):
            raise FileNotFoundError(f"{root} has no keyed table")
        recover(spark, self.root, drop=False)  # what another job planned and did not finish
        said = json.loads(self.folder.read_text(LAYOUT))
        self.owner, self.key, self.buckets = said["owner"], said["key"], said["buckets"]
        self.schema = StructType.fromJson(said["schema"])

    @classmethod
    def make(cls, spark: SparkSession, root: str, schema: StructType, owner: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
        """The table at root, made empty if there is none."""
        folder = Folder(spark, root)
        if not folder.exists(LAYOUT):
            if BUCKET in schema.names:
                raise ValueError(f"a column may not be called {BUCKET}")
            folder.write_text(LAYOUT, json.dumps({"owner": owner, "key": key, "buckets": buckets, "schema": schema.jsonValue()}))
        return cls(spark, root)

    def bucket_of(self, owner: Column) -> Column:
        return F.pmod(F.hash(owner.cast(self.schema[self.owner].dataType)), F.lit(self.buckets)).cast("int")

    # -- reading ------------------------------------------------------------------------

    def placed(self) -> DataFrame:
        """All rows with their bucket."""
        schema = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        return self.spark.read.schema(schema).parquet(self.root)

    def rows(self) -> DataFrame:
        return self.placed().select(*self.schema.names)

    def of(self, owners: Sequence[object], keys: Sequence[object] | None = None) -> DataFrame:
        """Rows of some owners, or of some of their keys: only their buckets are read."""
        if len(owners) > NAMED or len(keys or ()) > NAMED:
            raise ValueError(f"more than {NAMED} are looked up by a table: use lookup")
        found = self.placed().where(F.col(BUCKET).isin([self.bucket_of(F.lit(o)) for o in owners]) & F.col(self.owner).isin(list(owners)))
        return (found if keys is None else found.where(F.col(self.key).isin(list(keys)))).select(*self.schema.names)

    def by_key(self, keys: Sequence[object]) -> DataFrame:
        """Rows by key where the owner is not known: statistics and Bloom filters of all buckets are asked."""
        return self.rows().where(F.col(self.key).isin(list(keys)))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of many owners and keys (a table of both): rows meet within their bucket, which prunes at run time where wanted is small."""
        names = [self.owner, self.key]
        asked = wanted.select(*names).distinct().withColumn(BUCKET, self.bucket_of(F.col(self.owner)))
        return self.placed().join(asked, [BUCKET, *names], "left_semi").select(*self.schema.names)

    # -- writing ------------------------------------------------------------------------

    def _dealt(self, rows: DataFrame, touched: Sequence[int] | None = None) -> DataFrame:
        """rows with their bucket, each bucket in partitions of its own (small ones Spark may put together): two a core over all, of which a bucket that is written anew takes one per SHARE bytes; touched: the only buckets that rows are in."""
        placed = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket_of(F.col(self.owner)))
        buckets = range(self.buckets) if touched is None else touched
        tasks, wanted = int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * self.spark.sparkContext.defaultParallelism // max(1, len(buckets)))
        if len(buckets) > tasks:
            return placed.repartitionById(tasks, F.pmod(F.col(BUCKET), F.lit(tasks)))
        if touched is not None:
            held = max((self.folder.size(f"{BUCKET}={b}") for b in touched), default=0)
            wanted = min(wanted, 1 + held // SHARE)
        number = F.col(BUCKET) if touched is None else F.array_position(F.lit(list(touched)), F.col(BUCKET)).cast("int") - 1
        return placed.repartitionById(wanted * len(buckets), number * wanted + F.pmod(F.xxhash64(self.key), F.lit(wanted)).cast("int"))

    def _staged(self, rows: DataFrame, touched: Sequence[int] | None = None) -> str:
        recover(self.spark, self.root)
        return stage(self._dealt(rows, touched).sortWithinPartitions(BUCKET, self.key), self.root, [BUCKET], {
            f"parquet.bloom.filter.enabled#{self.key}": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(1 << 20), "parquet.block.size": str(32 << 20)})

    def append(self, rows: DataFrame) -> int:
        """Adds rows whose key is not there under their owner; of rows with the same key one is taken.  Returns how many were added."""
        names = [self.owner, self.key]
        there = self.placed().select(BUCKET, *names)
        new = rows.dropDuplicates(names).withColumn(BUCKET, self.bucket_of(F.col(self.owner))).join(there, [BUCKET, *names], "left_anti")
        staged = self._staged(new)
        n = self.spark.read.schema(self.schema).parquet(f"{self.root}/{staged}").count()  # from footers
        add(self.spark, self.root, staged)
        return n

    def _buckets(self, owners: DataFrame) -> list[int]:
        found = owners.select(self.bucket_of(F.col(self.owner)).alias(BUCKET)).distinct().collect()  # no more than there are buckets
        return sorted(r[0] for r in found)

    def _rewrite(self, touched: Sequence[int], rows: DataFrame) -> None:
        switch(self.spark, self.root, self._staged(rows, touched), [f"{BUCKET}={b}" for b in touched])

    def upsert(self, rows: DataFrame) -> list[int]:
        """Puts rows (a key once) in place of those with the same owner and key; returns the buckets written."""
        names = [self.owner, self.key]
        touched = self._buckets(rows)
        kept = self.placed().where(F.col(BUCKET).isin(touched)).join(rows.select(*names), names, "left_anti")
        if touched:
            self._rewrite(touched, kept.select(*self.schema.names).unionByName(rows.select(*self.schema.names)))
        return touched

    def delete(self, gone: DataFrame) -> int:
        """Removes the rows of gone: owners, or owners and keys.  Only buckets that lose rows are written; returns how many went."""
        names = [c for c in (self.owner, self.key) if c in gone.columns]
        near = self.placed().where(F.col(BUCKET).isin(self._buckets(gone)))
        lost = {r[BUCKET]: r["n"] for r in near.join(gone, names, "left_semi").groupBy(BUCKET).agg(F.count("*").alias("n")).collect()}
        if lost:
            self._rewrite(sorted(lost), near.where(F.col(BUCKET).isin(list(lost))).join(gone, names, "left_anti"))
        return sum(lost.values())
