"""Late rows overwrite the days they touch in a table of sorted files of fixed size.

The table keeps the latest-arrived row of each key under ``<root>/<day>=N/<file>=I/``: a day's
rows by time and key, cut into files of the same number of rows.  Late rows are applied like this:

* The latest late row of each key is found by partial maxima.
* Their keys make a Bloom filter: 2^WORDS words of 64 bits, a key sets BITS bits in one word.
  The filter is a table of words, made by a partial bit_or and broadcast; its size is fixed, so
  it never grows with the input.  The scan of the standing files reads only key, arrival and day
  and keeps the rows that the filter lets through.  Beyond some ten million late keys it lets
  more rows through (``words`` raises it), which costs time and changes nothing.
* An exact join of those rows with the late ones removes false positives, and tells which late
  rows win (the later arrival; a standing row wins a tie) and on which days their keys stood.
* Those days and the winners' days are rewritten: their standing rows, read by partition, less
  the winners' keys, plus the winners, into new files beside the old; then the days are switched
  (sources/partitions.py), so a job that is lost midway loses no rows.  All other files stay as
  they are, byte by byte.

Places within a day come from a range partition by day, time and key, whose pieces are counted,
so no day goes through one task; a file is written by the one task that sorts it.  To the driver
come names of days only.

A null time is the day -1.  A null key is a key of its own and comes first in its place.  A null
arrival is earlier than any; it is no early row.  Of rows that arrive at once, the later time
wins, then the larger row as JSON, so repeated rows count once.  Columns stand as they came,
extra ones too; the folders' names avoid them.  Without rows there are no files, without late
rows nothing is rewritten.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.partitions import recover, stage, switch
from ..sources.scratch import shared_dir
from .common import fresh, materialise, read

#: Words of the Bloom filter as a power of two, and bits that a key sets.
WORDS, BITS = 18, 4
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Layout:
    """A table under root.  schema: its columns; key, time, arrived: their names."""

    root: str
    schema: T.StructType
    rows_per_file: int
    key: str = "sale_id"
    time: str = "sold_at"
    arrived: str = "arrived_at"

    def free(self, name: str) -> str:
        taken = {c.lower() for c in self.schema.names}
        while name in taken:
            name = f"_{name}"
        return name

    @property
    def day(self) -> str:
        return self.free("day")

    @property
    def file(self) -> str:
        return self.free("file_no")

    def read(self, spark: SparkSession) -> DataFrame:
        parts = [T.StructField(self.day, T.LongType()), T.StructField(self.file, T.LongType())]
        return spark.read.schema(T.StructType([*self.schema.fields, *parts])).option("basePath", self.root).parquet(self.root)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def epoch_us(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 in UTC; a time without a zone is taken as UTC, whatever the session's zone."""
    c = col(name)
    if isinstance(rows.schema[name].dataType, T.TimestampType):
        return F.unix_micros(c)
    second = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * DAY_US + (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + second


def day_of(rows: DataFrame, name: str) -> Column:
    return F.coalesce(F.floor(epoch_us(rows, name) / DAY_US) if isinstance(rows.schema[name].dataType, T.TimestampType) else F.unix_date(col(name).cast("date")), F.lit(-1)).cast("long")


def latest(rows: DataFrame, layout: Layout) -> DataFrame:
    """The latest-arrived row of each key."""
    every = F.struct(*(col(c) for c in layout.schema.names))
    order = F.struct(col(layout.arrived), col(layout.time), F.to_json(every))
    best = rows.groupBy(col(layout.key).alias("key")).agg(F.max_by(every, order).alias("row"))
    return best.select("row.*")


def placed(rows: DataFrame, layout: Layout) -> DataFrame:
    """rows with their day and file, dealt by file and sorted within it."""
    day, file, seq, part, first, base = layout.day, layout.file, *(layout.free(x) for x in ("seq", "part", "first", "base"))
    order = [col(day), col(layout.time), col(layout.key)]
    ranged = rows.withColumn(day, day_of(rows, layout.time)).repartitionByRange(*order).sortWithinPartitions(*order)
    table = materialise(ranged.withColumn(seq, F.monotonically_increasing_id()), "ranged").withColumn(part, F.shiftright(seq, 33))
    pieces = table.groupBy(part, day).agg(F.min(seq).alias(first), F.count("*").alias("n"))  # as many as there are partitions and days
    before = F.coalesce(F.sum("n").over(Window.partitionBy(day).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialise(pieces.select(part, day, (before - F.col(first)).alias(base)), "pieces")
    numbered = table.join(bases, [part, day]).withColumn(file, F.floor((F.col(seq) + F.col(base)) / layout.rows_per_file).cast("long"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said outright: by bytes alone a task would be dealt all of many small files
    dealt = numbered.select(*(col(c) for c in layout.schema.names), day, file).repartition(tasks, day, file)
    return dealt.sortWithinPartitions(day, file, col(layout.time), col(layout.key))


def write(rows: DataFrame, layout: Layout) -> None:
    """The layout of rows, in a new folder."""
    placed(latest(rows, layout), layout).write.option("maxRecordsPerFile", 0).partitionBy(layout.day, layout.file).parquet(layout.root)


def word_and_mask(key: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, words + 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return h.bitwiseAND(F.lit((1 << words) - 1)), mask


def bloom(keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """word, bits: at most 2^words rows."""
    word, mask = word_and_mask(col(key), words)
    return keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def may_be_in(rows: DataFrame, key: str, filter_: DataFrame, words: int = WORDS) -> DataFrame:
    """rows whose key the filter lets through: all that are in it, and few others."""
    word, mask = word_and_mask(col(key), words)
    bits = filter_.toDF(fresh(rows, "bloom_word"), fresh(rows, "bloom_bits"))
    w, b = (F.col(c) for c in bits.columns)
    return rows.join(F.broadcast(bits), word == w).where(b.bitwiseAND(mask) == mask).drop(*bits.columns)


def overwrite(late: DataFrame, layout: Layout, words: int = WORDS) -> DataFrame:
    """Makes the table the layout of its rows and the late ones; returns the days rewritten."""
    spark = late.sparkSession
    recover(spark, layout.root)
    day, stood, stood_day, stood_at = layout.day, *(layout.free(x) for x in ("stood", "stood_day", "stood_at"))
    newest = materialise(latest(late, layout), "late")
    standing = layout.read(spark).select(col(layout.key).alias(stood), col(layout.arrived).alias(stood_at), F.col(day).alias(stood_day))
    hits = may_be_in(standing, stood, materialise(bloom(newest, layout.key, words), "bloom"), words)
    met = newest.join(hits, col(layout.key).eqNullSafe(col(stood)), "left")
    arrived = col(layout.arrived)
    kept = materialise(met.where(F.col(stood_day).isNull() | (arrived > F.col(stood_at)) | (arrived.isNotNull() & F.col(stood_at).isNull())), "winners")
    own = kept.select(day_of(kept, layout.time).alias(day))
    days = materialise(own.distinct().union(kept.select(stood_day).where(F.col(stood_day).isNotNull()).distinct()).distinct(), "days")
    names = [f"{day}={r[0]}" for r in days.collect()]  # partitions by name: as many as there are days, whatever the rows
    if not names:
        return days
    new = kept.select(*(col(c) for c in layout.schema.names))
    old_key = kept.where(F.col(stood_day).isNotNull()).select(col(layout.key).alias(stood))
    old = layout.read(spark).join(days, day, "left_semi").join(old_key, col(layout.key).eqNullSafe(col(stood)), "left_anti")
    switch(spark, layout.root, stage(placed(old.select(*new.columns).unionByName(new), layout), layout.root, [day, layout.file]), names)
    return days


def files(spark: SparkSession, layout: Layout) -> DataFrame:
    """day, file_no, path, columns, n_rows and ids_sha256 of every file, as read back; ids in file order are digested in one stream."""
    spark.catalog.refreshByPath(layout.root)
    day, file = layout.day, layout.file
    rows = layout.read(spark).select(col(day).alias("day"), col(file).alias("file_no"), col(layout.key).cast("string").alias("key"), "_metadata.row_index", F.col("_metadata.file_path").alias("path"))
    paths = rows.groupBy("day", "file_no", "path").agg(F.count("*").alias("n_rows"))
    names = [c for c in spark.read.option("mergeSchema", True).parquet(layout.root).columns if c not in (day, file)] if paths.limit(1).count() else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, hashlib.sha256()
        for b in batches:
            done = []
            for d, i, key in zip(*(b.column(c).to_pylist() for c in ("day", "file_no", "key"))):
                if at != (d, i):
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (d, i), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update((key or "").encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("day", "file_no", "ids_sha256"), x)) for x in done])
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"day": at[0], "file_no": at[1], "ids_sha256": sha.hexdigest()}])

    in_order = rows.select("day", "file_no", "row_index", "key").repartition("day", "file_no").sortWithinPartitions("day", "file_no", "row_index").select("day", "file_no", "key")
    digests = in_order.mapInArrow(run, "day long, file_no long, ids_sha256 string")
    return paths.join(digests, ["day", "file_no"]).withColumn("columns", F.lit(",".join(names)))


# -- the shop's sales ----------------------------------------------------------------

CUTOFF = "2024-03-20 00:00:00"


def with_corrections(sales: DataFrame) -> DataFrame:
    """sales and the copies that arrive later, of every third sale (by CRC-32) of every fourth day."""
    h = F.crc32(F.col("sale_id").cast("string"))
    moved = lambda c, days: F.col(c) + F.make_dt_interval(days=days.cast("int"))
    copies = sales.where((h % 3 == 0) & (day_of(sales, "sold_at") % 4 == 0))
    return sales.unionByName(copies.withColumns({"total": F.col("total") + 1, "sold_at": moved("sold_at", h % 2), "arrived_at": moved("arrived_at", 1 + h % 97)}))


def op13_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = read(spark, sf_dir, "sales")
    layout = Layout(f"{shared_dir(spark)}/op13-{uuid.uuid4().hex}", sales.schema, 1 + sales.count() // 1100)
    rows = with_corrections(sales)
    early = F.coalesce(epoch_us(rows, "arrived_at") < F.expr(f"unix_date(date'{CUTOFF[:10]}') * {DAY_US}"), F.lit(False))
    write(rows.where(early), layout)
    days = overwrite(rows.where(~early), layout).select(F.col(layout.day).alias("day"), F.lit(True).alias("rewritten"))
    sold = layout.read(spark)
    text = F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit("")) for x in (F.col("sale_id"), epoch_us(sold, "sold_at"), epoch_us(sold, "arrived_at"))))
    cents = F.coalesce(F.floor(100 * F.col("total") + 0.5), F.lit(0)).cast("long")
    sums = sold.groupBy(col(layout.day).alias("day"), col(layout.file).alias("file_no")).agg(F.sum(cents).alias("cents"), F.sum(F.crc32(text)).alias("rows_crc"))
    out = files(spark, layout).join(sums, ["day", "file_no"]).join(days, "day", "left")
    return out.select("day", "file_no", "n_rows", "cents", "rows_crc", "path", "columns", "ids_sha256", F.coalesce("rewritten", F.lit(False)).alias("rewritten"))


QUERIES = {"op13_late_overwrite": op13_late_overwrite}
#: The query writes files; it is tested against a plain version.
ORACLE: dict[str, str] = {}
