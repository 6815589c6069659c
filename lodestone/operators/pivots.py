"""Exact nearest neighbours with metric pruning: unit vectors in cells around pivots, cells and blocks ruled out by the triangle inequality.

Pivots are fitted on at most SAMPLE vectors (those of the smallest hashed ids, so the choice does not
vary); every vector goes to its nearest pivot's cell.  A cell's vectors are sorted by their distance
to the pivot and packed into blocks of BLOCK vectors with their least and greatest distance.  A
vector x of a cell with pivot p cannot be nearer to a query q than |d(q, p) - d(x, p)|, so once k
hits within t are known, only blocks that reach into d(q, p) - t .. d(q, p) + t can have a better one.
What is read first gives t, the rest is read only where it may matter; hits are those of a full scan.

Distances are those of unit vectors, sqrt(2 - 2 cosine); bounds are widened by SLACK for rounding.  How
much is skipped depends on the vectors: much where they form clusters, little where all are equally far
from each other.  Zero vectors and nulls are not searchable.  Pivots, and one row of figures a cell,
are all that comes to the driver; their number is a parameter."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.partitions import Folder
from ..sources.scratch import scratch, written
from .vectors import ranked, unit

PIVOTS, SAMPLE, ROUNDS = 64, 8192, 6
BLOCK = 512
#: Blocks of a cell that one task meets at once, and queries that go together.
SALT, QUERIES = 64, 256
SLACK = 1e-6


def fitted(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots by a few rounds of spherical k-means."""
    centres = sample[np.random.default_rng(7).permutation(len(sample))[:pivots]]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def apart(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row, equal scores by id."""
    if len(score) > 4 * k:  # all that may tie with the k-th stay
        kth = np.partition(score, -k)[-k]
        near = np.flatnonzero(score >= kth)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


@dataclass(frozen=True)
class Cell:
    cell: int
    n: int
    blocks: int
    low: float
    high: float


class PivotIndex:
    """An index under a folder: ``blocks`` by cell, and ``_index`` with pivots and cells."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        said = json.loads(Folder(spark, self.root).read_text("_index"))
        self.pivots = np.array(said["pivots"])
        self.cells = [Cell(*c) for c in said["cells"]]
        self.id_type = said["id_type"]
        self.schema = f"ids array<{self.id_type}>, vectors array<double>, away array<double>, low double, high double, n int, block long, cell int"

    @classmethod
    def build(cls, vectors: DataFrame, root: str, id_col: str = "vec_id", pivots: int = PIVOTS, block: int = BLOCK) -> PivotIndex:
        """The index of vectors (id, embedding), in a new folder."""
        spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
        rows = vectors.select(F.col(id_col).alias("id"), unit(F.col("embedding")).alias("v")).where("v is not null and id is not null")
        sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
        centres = fitted(sample, pivots) if len(sample) else np.zeros((0, 0))
        width = centres.shape[1]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cosine = matrix(b.column("v"), width) @ centres.T
                    cell = cosine.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(apart(cosine[np.arange(len(cell)), cell]))], names=["id", "v", "cell", "away"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            serial = 0

            def packed() -> pa.RecordBatch:
                nonlocal serial
                t = pa.Table.from_batches(held).combine_chunks()
                away = t.column("away").to_numpy()
                serial += 1
                row = [t.column("id").to_pylist(), t.column("v").combine_chunks().flatten().to_numpy(), away, float(away.min()), float(away.max()), len(away), serial, t.column("cell")[0].as_py()]
                kinds = [pa.list_(t.schema.field("id").type), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.int32()]
                return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["ids", "vectors", "away", "low", "high", "n", "block", "cell"])

            for b in batches:
                cells = b.column("cell").to_numpy()
                at = 0
                while at < b.num_rows:
                    if held and held[0].column("cell")[0].as_py() != cells[at]:
                        yield packed()
                        held = []
                    full = block - sum(h.num_rows for h in held)
                    end = at + int(np.searchsorted(cells[at : at + full], cells[at], "right"))
                    held.append(b.slice(at, end - at))
                    at = end
                    if sum(h.num_rows for h in held) == block:
                        yield packed()
                        held = []
            if held:
                yield packed()

        placed = rows.mapInArrow(assign, f"id {kind}, v array<double>, cell int, away double")
        ordered = placed.repartitionByRange("cell", "away").sortWithinPartitions("cell", "away")
        schema = f"ids array<{kind}>, vectors array<double>, away array<double>, low double, high double, n int, block long, cell int"
        blocks = ordered.mapInArrow(pack, schema).withColumn("block", F.spark_partition_id().cast("long") * (1 << 32) + F.col("block"))
        blocks.write.partitionBy("cell").parquet(f"{root}/blocks")
        made = spark.read.schema(schema).parquet(f"{root}/blocks")
        cells = made.groupBy("cell").agg(F.sum("n"), F.count("*"), F.min("low"), F.max("high")).collect()  # no more than there are pivots
        Folder(spark, root).write_text("_index", json.dumps({"id_type": kind, "pivots": centres.tolist(), "cells": sorted(list(c) for c in cells)}))
        return cls(spark, root)

    @property
    def size(self) -> int:
        return sum(c.n for c in self.cells)

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/blocks")

    # -- one query ----------------------------------------------------------------------

    def _scan(self, blocks: DataFrame, query: np.ndarray, k: int) -> list[tuple[float, object]]:
        """The k best of some blocks: each task sends k at most."""
        width = len(query)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids, score = b.column("ids").flatten(), matrix(b.column("vectors"), width) @ query
                    top = pa.array(best(score, np.array(ids.to_pylist()), k))
                    yield pa.RecordBatch.from_arrays([ids.take(top), pa.array(score).take(top)], names=["id", "cosine"])

        hits = blocks.select("ids", "vectors").mapInArrow(run, f"id {self.id_type}, cosine double")
        return [(r.cosine, r.id) for r in hits.orderBy(F.col("cosine").desc(), "id").limit(k).collect()]

    def search(self, query: Sequence[float], k: int = 10, id_col: str = "vec_id") -> tuple[DataFrame, int]:
        """rank, id, cosine of the k nearest, and how many vectors were looked at."""
        q = np.asarray(query, float)
        if not np.linalg.norm(q):
            raise ValueError("a zero vector has no direction to search in")
        q = q / np.linalg.norm(q)
        hits: list[tuple[float, object]] = []
        looked = 0
        if self.cells:
            to_pivot = apart(self.pivots @ q)
            nearest, seen, first = sorted(self.cells, key=lambda c: to_pivot[c.cell]), 0, []
            while nearest and seen < k:
                first.append(nearest.pop(0))
                seen += first[-1].n
            hits, looked = self._scan(self.blocks().where(F.col("cell").isin([c.cell for c in first])), q, k), seen
            reach = float(apart(np.array(hits[-1][0]))) + SLACK if len(hits) == k else 2.0 + SLACK
            rest = [c for c in nearest if max(to_pivot[c.cell] - c.high, c.low - to_pivot[c.cell]) <= reach]
            if rest:
                near = F.lit(False)
                for c in rest:
                    near = near | ((F.col("cell") == c.cell) & (F.col("high") >= float(to_pivot[c.cell] - reach)) & (F.col("low") <= float(to_pivot[c.cell] + reach)))
                chosen = self.blocks().where(F.col("cell").isin([c.cell for c in rest]) & near)
                looked += chosen.agg(F.sum("n")).first()[0] or 0
                hits = sorted([*hits, *self._scan(chosen, q, k)], key=lambda h: (-h[0], h[1]))[:k]
        return ranked(self.spark.createDataFrame([(i, float(c)) for c, i in hits], f"{id_col} {self.id_type}, cosine double"), id_col).select("rank", id_col, "cosine"), looked

    # -- many queries -------------------------------------------------------------------

    def _figures(self) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(c.cell, c.n, c.blocks, c.low, c.high) for c in self.cells], "cell int, n long, blocks long, cell_low double, cell_high double"))

    def _met(self, asked: DataFrame, k: int, kind: str) -> DataFrame:
        """query_id, id, cosine: the k best of each query in each cell it asks (query_id, v, cell, low, high: the distances to the pivot that may matter).

        Queries of a cell go together, QUERIES at a time, and meet its blocks by cell and salt, so a large cell is met by many tasks."""
        width = self.pivots.shape[1]
        salts = F.ceil(F.col("blocks") / SALT).cast("int")
        many = asked.groupBy("cell").agg(F.count("*").alias("asked"))  # a row a cell
        grouped = asked.join(F.broadcast(many), "cell").withColumn("slot", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("asked") / QUERIES)))
        together = grouped.groupBy("cell", "slot").agg(F.collect_list(F.struct("query_id", "v", "low", "high")).alias("q"))
        spread = together.join(self._figures().select("cell", salts.alias("salts")), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "q")
        blocks = self.blocks().join(self._figures().select("cell", salts.alias("salts")), "cell")
        blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")).cast("int")).select("cell", "salt", "ids", "vectors", "away")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1)
                    q, ids = row.column("q").flatten(), row.column("ids").flatten()
                    away, names = row.column("away").flatten().to_numpy(), np.array(ids.to_pylist())
                    score = matrix(q.field("v"), width) @ matrix(row.column("vectors"), width).T
                    low, high = (q.field(c).to_numpy() for c in ("low", "high"))
                    near = (away >= low[:, None]) & (away <= high[:, None])
                    asks, takes = [], []
                    for j in range(len(score)):
                        at = np.flatnonzero(near[j])
                        top = at[best(score[j][at], names[at], k)] if len(at) else at
                        asks.append(np.full(len(top), j))
                        takes.append(top)
                    a, t = np.concatenate(asks), np.concatenate(takes)
                    yield pa.RecordBatch.from_arrays([q.field("query_id").take(pa.array(a)), ids.take(pa.array(t)), pa.array(score[a, t])], names=["query_id", "id", "cosine"])

        pairs = spread.join(blocks, ["cell", "salt"]).select("q", "ids", "vectors", "away")
        return pairs.mapInArrow(run, f"query_id {kind}, id {self.id_type}, cosine double")

    def search_batch(self, queries: DataFrame, k: int = 10, id_col: str = "vec_id", query_col: str = "query_id") -> DataFrame:
        """query id, rank, id, cosine: the k nearest of each query (query id, embedding), exact; queries never pass through the driver."""
        kind, pivots = dict(queries.dtypes)[query_col], self.pivots
        if not self.cells:
            return self.spark.createDataFrame([], f"{query_col} {kind}, rank int, {id_col} {self.id_type}, cosine double")
        asked = queries.select(F.col(query_col).alias("query_id"), unit(F.col("embedding")).alias("v")).where("v is not null")
        sizes = np.zeros(len(pivots), np.int64)
        for c in self.cells:
            sizes[c.cell] = c.n

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                to_pivot = apart(matrix(b.column("v"), pivots.shape[1]) @ pivots.T)
                order = np.argsort(to_pivot, axis=1, kind="stable")
                enough = np.cumsum(sizes[order], axis=1)
                first = np.minimum((enough < k).sum(axis=1) + 1, order.shape[1])  # nearest cells that have k vectors together
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("v"), pa.array(list(to_pivot)), pa.array([o[:n].astype(np.int32) for o, n in zip(order, first)])], names=["query_id", "v", "to_pivot", "home"])

        placed = asked.mapInArrow(place, f"query_id {kind}, v array<double>, to_pivot array<double>, home array<int>")
        home = placed.select("query_id", "v", F.explode("home").alias("cell"), F.lit(0.0).alias("low"), F.lit(3.0).alias("high"))
        top = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
        best_k = lambda hits: hits.withColumn("rank", F.row_number().over(top).cast("int")).where(F.col("rank") <= k)
        first = written(best_k(self._met(home, k, kind).select("query_id", "id", "cosine")), "first")
        reach = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("cosine").alias("worst"))
        far = F.when(F.col("found") < k, F.lit(2.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")))) + SLACK
        low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for c in self.cells:
            low[c.cell], high[c.cell] = c.low, c.high

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d, reach = matrix(b.column("to_pivot"), len(pivots)), b.column("reach").to_numpy()[:, None]
                near = (d - high <= reach) & (low - d <= reach)
                for i, home in enumerate(b.column("home").to_pylist()):
                    near[i, home] = False
                i, cell = np.nonzero(near)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("v").take(at), pa.array(cell.astype(np.int32)), pa.array((d - reach)[i, cell]), pa.array((d + reach)[i, cell])], names=["query_id", "v", "cell", "low", "high"])

        others = placed.join(reach.select("query_id", far.alias("reach")), "query_id")
        rest = self._met(others.mapInArrow(within, f"query_id {kind}, v array<double>, cell int, low double, high double"), k, kind)
        hits = best_k(first.select("query_id", "id", "cosine").unionByName(rest.select("query_id", "id", "cosine")))
        return hits.select(F.col("query_id").alias(query_col), "rank", F.col("id").alias(id_col), "cosine")


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", query_col: str = "query_id", pivots: int = PIVOTS) -> DataFrame:
    """The k nearest vectors of each query, through an index made for the occasion."""
    index = PivotIndex.build(vectors, scratch(vectors.sparkSession, "pivots"), id_col, pivots)
    return index.search_batch(queries, k, id_col, query_col)
