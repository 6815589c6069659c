"""What the operators share: scratch tables in the cluster's shared folder, Arrow mapping, row handling."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop_scratch(spark, path)
        except Exception:  # the session may be gone at interpreter exit; the folder is the cluster's scratch
            pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and returns the reread table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch, cut so that only a few MB are worked on at once."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield fn(part)

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in Arrow batches: Spark's default size is lowered to 4 MB, a smaller setting of the user's is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if byte_size(spark.conf.get(key)) > 4 << 20:
        spark.conf.set(key, str(4 << 20))


def byte_size(setting: str) -> int:
    """Bytes of a setting as Spark writes them: ``4194304``, ``4194304b``, ``8m``, ``1 gb``."""
    number, unit = re.fullmatch(r"\s*([0-9]+)\s*([a-z]?)b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit if unit not in ("", "b") else " ")


def slices(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names: extra columns never clash with its own."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: At most so many rows of the smaller side are broadcast for hot keys, whatever the tables' sizes.
HOT_KEYS = 1000
#: A list of ids is broadcast up to so many rows (16 bytes each); a longer one is joined by shuffle.
SHORT_LIST = 1_000_000


#: A table of at most so many rows (up to 100 bytes each) is broadcast whole.
SMALL_TABLE = 50_000
#: Where rows may be of any length, a table is broadcast up to so many bytes of strings, measured.
SMALL_BYTES = 8 << 20
#: A hot key that is not broadcast meets in so many tasks.
SALTS = 32


def join_texts(many: DataFrame, one: DataFrame, key: str, size: str) -> DataFrame:
    """many with the columns of one, as ``join_split`` joins them, for a key and columns of one that are strings of any length.

    one is broadcast whole only if its rows and its strings' bytes are few; else a hot key's rows of one are
    copied SALTS times and meet many's rows by shuffle, and what is broadcast is 64 bits each of fewer than HOT_KEYS keys.
    Both should be scans or written tables, so that a task that runs again deals its rows out as before."""
    strings = [c for c, kind in one.dtypes if kind == "string"]
    n, size_of = one.agg(F.count("*"), F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(0)))).first()
    if n <= SMALL_TABLE and (size_of or 0) <= SMALL_BYTES:
        return many.join(F.broadcast(one), key)
    least, mark, salt = many.count() // HOT_KEYS, fresh(many, "hot_key"), fresh(many, "hot_salt")
    hot = one.where(F.col(size) > least).select(F.xxhash64(key).alias(mark)).distinct()  # two keys of one mark are both salted
    known = hot.withColumn(salt, F.lit(SALTS))
    marked = lambda df: df.withColumn(mark, F.xxhash64(key)).join(F.broadcast(known), mark, "left").drop(mark)
    left = marked(many).withColumn(salt, F.when(F.col(salt).isNull(), 0).otherwise(F.floor(F.rand(7) * SALTS).cast("int")))
    right = marked(one).withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salt, F.lit(1)) - 1)))
    return left.join(right.hint("shuffle_hash"), [key, salt]).drop(salt)


def join_split(many: DataFrame, one: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """many with the columns of one, a row for each key, joined on key without meeting a hot key in one task.

    size is one's column that tells how many rows of many have the key.  Fewer than HOT_KEYS keys can
    hold over 1/HOT_KEYS of many's rows: their rows of one are broadcast, all others meet by shuffle.
    If one has at most SMALL_TABLE rows, it is broadcast whole.  Both sides are read twice, so they
    should be written tables.  how: inner, or left."""
    if one.count() <= SMALL_TABLE:
        return many.join(F.broadcast(one), key, how)
    least = many.count() // HOT_KEYS
    hot = one.where(F.col(size) > least)
    rest = one.where(F.col(size) <= least)
    by_key = many.join(F.broadcast(hot), key)
    others = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how)
    return by_key.unionByName(others)


def listed(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """docs whose id is (left_semi) or is not (left_anti) in ids, one column of distinct longs or null; columns unchanged.

    A list of at most SHORT_LIST rows is broadcast, so docs stay where they are; a longer one is joined by shuffle."""
    name = fresh(docs, "listed_id")
    ids = materialise(ids.toDF(name), "ids")
    if ids.count() <= SHORT_LIST:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(name)), how)
