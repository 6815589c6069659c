"""Exact deduplication by content-defined chunk recipes.

Each text, less its ASCII white space (``[\\x20\\x09-\\x0D]``), is cut where a rolling hash
of its last 16 bytes hits a pattern, so equal runs of text give equal chunks wherever
they stand.  A chunk is named by its length and 128 bits of BLAKE2b, keyed by a seed.

Chunk store: the chunks of all texts are deduplicated, first within a batch and a task,
then across tasks.  Of each name the least and the greatest content are kept; where these
are the same bytes the name is a verified identifier.  Should a name stand for two
contents, all names are made anew with the next seed, until every one is verified.

A document becomes its recipe, the ordered list of identifiers.  Recipes meet by a digest
and are compared as whole lists (least and greatest of each digest, again verified), so a
text's bytes move once, as distinct chunks, and a group of copies moves as recipes only.

Of equal texts the row with the most code points in its original text stays, then the
smallest doc_id (nulls last), then the first in the table.  Null text counts as empty;
empty texts are equal to one another (the empty recipe).  Very long texts are chunked and
moved chunk by chunk, MOST bytes at most.  Repeated rows are copies: one stays.  An empty
table gives an empty result.  Columns besides id and text are not read, whatever their
names; drop_copies returns them as they are.

Groups are counted by partial aggregates; rows get their group by a join that broadcasts
the few hot groups and shuffles the rest, so a group of any size is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, fresh, id_text, join_split, listed, materialise, read, texts

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LEAST, MEAN_BITS, MOST = 256, 10, 8192
RECIPE = "row_id long, doc_id long, n_chars long, n_norm_bytes long, text_sha256 string, recipe binary, digest binary"
ID_BYTES = 20

_GEAR = np.random.default_rng(20_011).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_candidates(data: bytes) -> np.ndarray:
    """Positions after which a chunk may end: the hash of the last 16 bytes has MEAN_BITS zero high bits."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return np.flatnonzero(h < np.uint32(1 << (32 - MEAN_BITS))) + 1


def cuts(start: int, end: int, candidates: np.ndarray) -> Iterator[tuple[int, int]]:
    """Chunks of data[start:end]; candidates are of the whole buffer.  As no chunk is shorter than LEAST, they do not depend on what stands before start."""
    while end - start > LEAST:
        i = np.searchsorted(candidates, start + LEAST)
        at = min(candidates[i] if i < len(candidates) else end, start + MOST, end)
        yield start, int(at)
        start = int(at)
    if start < end:
        yield start, end


def identifier(chunk: bytes, seed: int = 0) -> bytes:
    """ID_BYTES bytes: the chunk's length and its keyed digest."""
    return len(chunk).to_bytes(4, "big") + hashlib.blake2b(chunk, digest_size=ID_BYTES - 4, key=b"%d" % seed).digest()


def chunks_of(raw: list[bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Normalised text and chunks of each text."""
    norm = [x.translate(None, SPACES) for x in raw]
    buffer = b"".join(norm)
    candidates, at = cut_candidates(buffer), 0
    for x in norm:
        yield x, [buffer[a:b] for a, b in cuts(at, at + len(x), candidates)]
        at += len(x)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """A row for each row of docs, written to the shared folder; row_id tells repeated rows apart."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = texts(b)
        made = [(len(x), hashlib.sha256(x).hexdigest(), b"".join(identifier(c, seed) for c in chunks)) for x, chunks in chunks_of(raw)]
        size, sha, recipe = zip(*made)
        cols = [b.column("row_id"), b.column("doc_id"), pa.array(map(code_points, raw), pa.int64()), pa.array(size, pa.int64()), pa.array(sha), pa.array(recipe, pa.binary()), pa.array([identifier(r, seed) for r in recipe], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RECIPE.split(", ")])

    rows = id_text(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id())
    return materialise(arrow_map(rows, run, RECIPE), "recipes")


def chunk_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The distinct chunks: chunk_id, content, verified (false where the identifier stands for several contents)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        distinct = {(identifier(c, seed), c) for _, chunks in chunks_of(texts(b)) for c in chunks}
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (zip(*distinct) if distinct else ([], []))], names=["chunk_id", "content"])

    chunks = arrow_map(id_text(docs, id_col, text_col), run, "chunk_id binary, content binary")
    return chunks.groupBy("chunk_id").agg(F.min("content").alias("content"), F.max("content").alias("other")).select("chunk_id", "content", (F.col("content") == F.col("other")).alias("verified"))


def verified_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Recipes of verified identifiers, and their groups: digest, keep_id, keep_row, group_size (both written)."""
    rank = F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row_id").alias("r"))
    seed = 0
    while True:
        unsure = chunk_store(docs, id_col, text_col, seed).where(~F.col("verified")).limit(1).count()
        rows = recipes(docs, id_col, text_col, seed)
        best = rows.groupBy("digest").agg(F.min(rank).alias("best"), F.count("*").alias("group_size"), (F.min("recipe") == F.max("recipe")).alias("same"))
        best = materialise(best.select("digest", F.col("best.d").alias("keep_id"), F.col("best.r").alias("keep_row"), "group_size", "same"), "groups")
        if not unsure and not best.where(~F.col("same")).limit(1).count():
            return rows, best.drop("same")
        seed += 1


_CONTINUATION = bytes(range(0x80, 0xC0))


def code_points(x: bytes) -> int:
    return len(x) if x.isascii() else len(x.translate(None, _CONTINUATION))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_id, text_sha256, keep_id, keep_row, group_size for each row."""
    rows, best = verified_recipes(docs, id_col, text_col)
    narrow = rows.select("doc_id", "row_id", "text_sha256", "digest")
    return join_split(narrow, best, "digest", "group_size").select("doc_id", "row_id", "text_sha256", "keep_id", "keep_row", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return groups(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less its copies, columns unchanged.

    Where ids are unique, the ids of the copies tell which rows go.  Rows that repeat an id are
    told apart by their text; of those with the same id and text length the one whose other
    columns, as JSON, come first stays."""
    g = groups(docs, id_col, text_col)
    if not g.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return listed(docs, id_col, g.where(F.col("row_id") != F.col("keep_row")).select("doc_id"), "left_anti")
    sha, n, pick, kept_sha = (fresh(docs, x) for x in ("norm_sha256", "norm_chars", "pick", "kept_sha"))
    kept_id = fresh(docs, "kept_id")
    kept = g.where(F.col("row_id") == F.col("keep_row")).select(F.col("keep_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marked = docs.withColumns({sha: F.sha2(F.translate(text, " \t\n\x0b\f\r", ""), 256), n: F.length(text)})
    found = marked.join(kept, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi")
    w = Window.partitionBy(sha).orderBy(F.col(n).desc(), F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
    return found.withColumn(pick, F.row_number().over(w)).where(F.col(pick) == 1).drop(pick, sha, n)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE_SQL = """
    WITH a AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
    b AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM a)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM b"""
QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLE = {"op6_exact_dedup": ORACLE_SQL}
