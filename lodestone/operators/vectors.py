"""Exact cosine search over unit vectors, centroids and Rocchio feedback."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .chunking import bound
from .embedding import outcome

ALPHA, BETA, GAMMA = 1.0, 0.75, 0.15


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


#: A vector whose length is 1 up to this is a unit vector as it stands: dividing it again would only move its last bits, and with them the order of equals.
ROUNDING = 1e-14


def unit(v: Column) -> Column:
    """v over its length; a zero vector has no direction and gives null: it is not searchable."""
    return bound(norm(v), lambda n: F.when(F.abs(n - 1) <= ROUNDING, doubles(v)).when(n > 0, F.transform(doubles(v), lambda x: x / n)))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def fetch(vectors: DataFrame, key: object, id_col: str = "vec_id") -> list[float] | None:
    """The vector of one id, or None."""
    rows = vectors.where(F.col(id_col) == key).select(doubles(F.col("embedding")).alias("v")).limit(1).collect()
    return rows[0].v if rows else None


def scored(vectors: DataFrame, query: Sequence[float], id_col: str = "vec_id") -> DataFrame:
    """id and cosine of every searchable vector."""
    length = float(np.sqrt(np.dot(query, query)))
    if not length:
        raise ValueError("a zero vector has no direction to search in")
    q = literal(query if abs(length - 1) <= ROUNDING else [x / length for x in query])
    if "embedding_unit" in vectors.columns:  # the index has it
        cosine = dot(doubles(F.col("embedding_unit")), q)
    else:
        cosine = bound(norm(F.col("embedding")), lambda n: F.when(n > 0, dot(doubles(F.col("embedding")), q) / n))
    return vectors.select(id_col, cosine.alias("cosine")).where("cosine is not null")


def ranked(hits: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A few hits with their rank, by falling cosine, then id."""
    w = Window.orderBy(F.col("cosine").desc(), id_col)
    return hits.withColumn("rank", F.row_number().over(w).cast("int"))


def knn(vectors: DataFrame, query: Sequence[float], k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """rank, id, cosine, distance of the k nearest; each task keeps k, one merges them."""
    return with_distance(scored(vectors, query, id_col).orderBy(F.col("cosine").desc(), id_col).limit(k), id_col)


def with_distance(top: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return ranked(top, id_col).select("rank", id_col, "cosine", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine"))).alias("distance"))


def first_hits(hits: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Each id once, with its best hit, k at most, ranked anew; repeated ids inside the hits leave fewer than k."""
    best = hits.groupBy(id_col).agg(F.max("cosine").alias("cosine")).orderBy(F.col("cosine").desc(), id_col).limit(k)
    return ranked(best, id_col).select("rank", id_col, "cosine")


def search_text(vectors: DataFrame, text: str, embed: Callable[[Column], Column], k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """The k nearest to a text: the text is embedded as the vectors were, then searched for.  A text without a vector finds nothing.

    Texts of different words may be equally near but for the last bits: all that are as near as the k-th up to CLOSE
    are compared by products that are not rounded before they are added."""
    row = vectors.sparkSession.range(1).select(doubles(embed(F.lit(text))).alias("v")).first()
    if row.v is None or not any(row.v):
        return vectors.select(F.lit(0).alias("rank"), id_col, F.lit(0.0).alias("cosine"), F.lit(0.0).alias("distance")).where("false")
    least = knn(vectors, row.v, k, id_col).agg(F.min("cosine")).first()[0]
    if least is None:
        return knn(vectors, row.v, k, id_col)
    length = float(np.sqrt(np.dot(row.v, row.v)))
    q = row.v if abs(length - 1) <= ROUNDING else [x / length for x in row.v]

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fused_dot(u, q) for u in b.column(1).to_pylist()], pa.float64())], names=[id_col, "cosine"])

    of = F.col("embedding_unit") if "embedding_unit" in vectors.columns else unit(F.col("embedding"))
    near = vectors.select(id_col, doubles(of).alias("u")).where(dot(F.col("u"), literal(q)) >= least - CLOSE)
    top = near.mapInArrow(fused, StructType([near.schema[id_col], StructField("cosine", DoubleType())]))  # not a Column function, which Spark does not take out of a plan where u is an embedding model's
    return with_distance(top.orderBy(F.col("cosine").desc(), id_col).limit(k), id_col)


#: Cosines closer than this may be equal.
CLOSE = 1e-12


def fused_dot(a: Sequence[float], b: Sequence[float]) -> float:
    s = 0.0
    for x, y in zip(a, b):
        s = math.fma(x, y, s)
    return s


def index_texts(texts: DataFrame, embed: Callable[[Column], Column], id_col: str = "id", text_col: str = "content", *more: str) -> DataFrame:
    """text id, vector id (the same), more, embedding, unit vector, metadata (the raw embedding as JSON) and reason of texts: where a text has no vector these are null and reason says why."""
    rows = texts.select(F.col(id_col).alias("text_id"), F.col(id_col).alias("vector_id"), *more, outcome(embed, F.col(text_col)).alias("made"))
    rows = rows.select("text_id", "vector_id", *more, "made.embedding", "made.reason")
    return rows.withColumns({"embedding_unit": unit(F.col("embedding")), "metadata": F.to_json(F.struct("embedding"))})


def shown(hits: DataFrame, id_col: str = "vec_id", *more: str) -> DataFrame:
    return hits.select("rank", id_col, F.round("cosine", 6).alias("score"), *more)


def centroids(labelled: DataFrame, label_col: str = "label") -> DataFrame:
    """label, mean: element-wise means of the raw vectors (all of one length); a group is one buffer in the JVM, and buffers are what is shuffled."""
    vectors = labelled.where("embedding is not null").select(label_col, array_to_vector(doubles(F.col("embedding"))).alias("vector"))
    return vectors.groupBy(label_col).agg(Summarizer.mean(F.col("vector")).alias("mean")).select(label_col, vector_to_array("mean").alias("mean"))


def centroid(vectors: DataFrame) -> list[float] | None:
    """The mean of all vectors, or None of none."""
    row = centroids(vectors.select(F.lit(0).alias("label"), "embedding")).first()
    return row and row["mean"]


def rocchio_query(query: Sequence[float], positive: Sequence[float] | None, negative: Sequence[float] | None, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> list[float]:
    q = alpha * np.asarray(query, float)
    if positive is not None:
        q = q + beta * np.asarray(positive)
    if negative is not None:
        q = q - gamma * np.asarray(negative)
    return q.tolist()


def rocchio(vectors: DataFrame, query: Sequence[float], positive: DataFrame, negative: DataFrame, k: int = 20, id_col: str = "vec_id") -> DataFrame:
    """rank, id, cosine, is_positive, is_negative: the search moved towards the mean of the positive ids and off that of the negative.

    positive and negative have one column of ids; ids without a vector count for nothing."""
    p, n = (ids.select(F.col(ids.columns[0]).alias(id_col)).distinct() for ids in (positive, negative))
    moved = rocchio_query(query, centroid(vectors.join(p, id_col, "left_semi")), centroid(vectors.join(n, id_col, "left_semi")))
    hits = knn(vectors, moved, k, id_col)
    flags = hits.join(p.withColumn("is_positive", F.lit(True)), id_col, "left").join(n.withColumn("is_negative", F.lit(True)), id_col, "left")
    return flags.select("rank", id_col, "cosine", F.coalesce("is_positive", F.lit(False)).alias("is_positive"), F.coalesce("is_negative", F.lit(False)).alias("is_negative"))


def hydrate(hits: DataFrame, texts: DataFrame, id_col: str = "vec_id", text_id: str = "doc_id") -> DataFrame:
    """Hits with their texts; a hit whose text is gone is dropped, the others keep their rank."""
    return F.broadcast(hits).join(texts, hits[id_col] == texts[text_id])


def collapse(hits: DataFrame, owner: str, k: int) -> DataFrame:
    """The first hit of each owner, ranked anew, k at most."""
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy(owner).orderBy("rank"))).where("n = 1").orderBy("rank").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("rank")).cast("int")).drop("n")


def orphans(vectors: DataFrame, texts: DataFrame, id_col: str = "vec_id", text_id: str = "doc_id") -> DataFrame:
    """Vectors whose id is no text's."""
    return vectors.join(texts.select(F.col(text_id).alias(id_col)), id_col, "left_anti")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: partial maxima are shuffled, not all versions of a key."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("last"))
    return last.select(key, "last.*")


def roll_up(children: DataFrame, parent: str) -> DataFrame:
    """parent, embedding: the mean of the children's raw vectors."""
    return centroids(children.where(F.col(parent).isNotNull()), parent).withColumnRenamed("mean", "embedding")


def to_tall(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return vectors.select(id_col, F.posexplode("embedding").alias("idx", "value"))


def from_tall(tall: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return tall.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("embedding"))
