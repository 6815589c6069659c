"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
to the shared folder and reread as the next stage's docs.  All but the last return the
columns of documents, extra ones included whatever their names.

Each stage names the rows that go; where that list is short (common.SHORT_LIST) it is
broadcast and the texts stay where they are, else rows and list meet by shuffle.

Null texts are empty texts: they are scored, of all empty texts one stays, and that one is
packed as its end id.  Of equal texts the longest original stays, then the smallest id; of
near copies the smallest id.  Rows that repeat an id are told apart where texts are
compared, and share one decision in the stages after.  A null id is an id of its own, and
the largest.  Very long texts are read whole.  An empty table goes through as an empty
table; without labels nothing is rejected, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, exact_dedup, packing, quality, simhash
from lodestone.llm.common import materialise, read


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_selected(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one stays."""
    return simhash.drop_near(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays is cut and packed into training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier, the fingerprints and the packing plan are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
