"""Table scans, catalogue introspection and the parquet-backed relations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import TABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def create_empty(spark: SparkSession, root: str, schemas: dict[str, StructType] = TABLES) -> None:
    """Destroys and creates every relation, empty."""
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def tables_present(spark: SparkSession, root: str, names: Iterable[str] = tuple(TABLES)) -> DataFrame:
    """name, present: which of the expected relations are there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
        there.append((name, bool(path.getFileSystem(conf).exists(path))))
    return spark.createDataFrame(there, "name string, present boolean")


def missing_tables(spark: SparkSession, root: str) -> list[str]:
    return sorted(r.name for r in tables_present(spark, root).where("not present").collect())


def describe_vectors(vectors: DataFrame) -> DataFrame:
    """n_rows and columns of a vector relation."""
    return vectors.agg(F.count("*").alias("n_rows")).withColumn("columns", F.lit(",".join(vectors.columns)))
