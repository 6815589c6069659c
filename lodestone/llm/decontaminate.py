"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.  Every 10
consecutive words of a benchmark item are a window; an item of fewer words (but not
none) is one window of all its words.  The training texts are turned into ids of the
benchmark's own vocabulary (any other word: none), a rolling hash runs over every run of
known words, hashes found in the set are verified word by word, and the words inside any
verified occurrence are hit.

Only a benchmark index of at most BLOCK_WORDS words is broadcast at a time, and one block
at a time is at the driver; a longer item is taken in parts that overlap by a window less
a word.  A benchmark of several blocks is taken block by block against the documents,
written once with their row numbers; from the second block on only hits are written.

Null or wordless texts have no words and no hits; a null item text, or an empty
benchmark, has no windows.  Texts of any length are scanned whole.  Repeated documents
each get their row; items with the same id count as one; all items without an id count as
one item too, which has no name in the list.  Empty tables give empty results.  Columns
besides id and text are not read, whatever their names; drop_contaminated returns them.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, id_text, listed, materialise, read, texts
from .words import WORD_BYTES, words_of

WINDOW = 10
BLOCK_WORDS = 300_000
_K = np.uint64(0x9E3779B97F4A7C15)


class Index:
    """The n-gram set of a bounded block of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            n = min(len(ids), window)
            for i in range(len(ids) - n + 1) if n else ():
                found.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.vocabulary = vocabulary
        self.by_length = {}
        for n in sorted({len(w) for w in found}):
            rows = np.array([w for w in found if len(w) == n], np.int64).reshape(-1, n)
            key = rolling(rows.ravel(), n)[::n] if len(rows) else np.empty(0, np.uint64)
            order = np.argsort(key, kind="stable")
            self.by_length[n] = key[order], rows[order], [sorted(found[tuple(r)]) for r in rows[order].tolist()]
        self.least = min(self.by_length, default=0)

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(start, length, items) of each window of ids; -1 is a word that no item has."""
        known = np.flatnonzero(ids >= 0)
        if len(known) < max(self.least, 1):
            return
        for n, (keys, rows, items) in self.by_length.items():
            if len(ids) < n:
                continue
            # starts from which n known words follow: the n-th known position from there is n - 1 further
            starts = known[: len(known) - n + 1]
            starts = starts[known[n - 1 :] - starts == n - 1]
            if not len(starts):
                continue
            h = np.zeros(len(starts), np.uint64)
            for j in range(n):
                h = mix(h, ids[starts + j])
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            for k in np.flatnonzero(keys[at] == h).tolist():
                s, i = int(starts[k]), int(at[k])
                while i < len(keys) and keys[i] == h[k]:  # several windows may share a hash
                    if np.array_equal(rows[i], ids[s : s + n]):
                        yield s, n, items[i]
                    i += 1


def mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ (x.astype(np.uint64) + np.uint64(1))) * _K
    return h ^ (h >> np.uint64(29))


def rolling(flat: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of flat."""
    h = np.zeros(len(flat) - n + 1, np.uint64)
    for j in range(n):
        h = mix(h, flat[j : len(flat) - n + 1 + j])
    return h


def hits(index: Index, docs: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
    """For each document the hit word positions and the items found; all documents of a batch are scanned at once."""
    get, lengths = index.vocabulary.get, [len(d) for d in docs]
    flat = np.full(sum(lengths) + len(docs), -1, np.int64)  # a gap after each document: no window crosses it
    starts = np.cumsum([0] + [n + 1 for n in lengths])
    for s, d in zip(starts, docs):
        flat[s : s + len(d)] = [get(w, -1) for w in d]
    covered, items = np.zeros(len(flat) + 1, np.int32), [set() for _ in docs]
    for s, n, names in index.find(flat):
        covered[s] += 1
        covered[s + n] -= 1
        items[int(np.searchsorted(starts, s, "right")) - 1].update(names)
    on = np.cumsum(covered[:-1]) > 0
    return [(np.flatnonzero(on[s : s + n]), x) for s, n, x in zip(starts, lengths, items)]


#: Stands for the missing id among item names, none of which is empty for it: names start with "=".
NAMELESS = ""


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's items in blocks of at most BLOCK_WORDS words (or one window)."""
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit(NAMELESS))
    block: list[tuple[str, list[bytes]]] = []
    size, part = 0, max(BLOCK_WORDS, window)
    for r in benchmark.select(name.alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null").toLocalIterator():
        words = words_of(r.t.encode())
        for at in range(0, max(len(words) - window + 1, 1), part - window + 1):
            piece = words[at : at + part]
            if block and size + len(piece) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((r.i, piece))
            size += len(piece)
    yield block


HITS = "row_id long, doc_id long, n_words long, positions array<int>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: row_id, doc_id, n_words, hit word positions (ascending), the names of items found (sorted) and whether one without an id was."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id())

    def scanned(block: list[tuple[str, list[bytes]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(pickle.dumps(Index(block, window)))

        loaded: list[Index] = []

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            if not loaded:
                loaded.append(pickle.loads(sent.value))
            docs = [words_of(x) for x in texts(b)]
            found = hits(loaded[0], docs)
            cols = [b.column("row_id"), b.column("doc_id"), pa.array(map(len, docs), pa.int64()), pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())), pa.array([sorted(x) for _, x in found], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, names=["row_id", "doc_id", "n_words", "positions", "items"])

        return arrow_map(rows, run, HITS)

    blocks = benchmark_blocks(benchmark, window=window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return named(scanned(first))
    rows = materialise(rows, "rows")  # the blocks' hits meet by row number
    both = materialise(scanned(first), "hits")
    for block in (b for more in ([second], blocks) for b in more):
        both = both.unionByName(materialise(scanned(block).where(F.size("positions") > 0), "hits"))
    # a row for each document and for each block with a hit in it, with positions in one document
    positions, items = (F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("positions", "items"))
    return named(both.groupBy("row_id", "doc_id", "n_words").agg(positions, items))


def named(found: DataFrame) -> DataFrame:
    """Items by their names, and nameless: whether an item without an id was found."""
    names = F.transform(F.filter("items", lambda i: i != NAMELESS), lambda i: F.substr(i, F.lit(2)))
    return found.withColumns({"items": F.array_sort(names), "nameless": F.array_contains("items", NAMELESS)})


def judged(found: DataFrame) -> DataFrame:
    n: Column = F.size("positions").cast("long")
    items = F.size("items").cast("long") + F.col("nameless").cast("long")
    return found.select("doc_id", "n_words", n.alias("n_hit"), items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the contaminated ones, columns unchanged; rows that share an id are judged together."""
    bad = judged(scan(docs, benchmark, id_col, text_col)).where("contaminated").select("doc_id").distinct()
    return listed(docs, id_col, bad, "left_anti")


def remove_spans(text: bytes, positions: set[int]) -> bytes:
    """text less its hit words; what separates the words that stay is left as it was."""
    import re

    kept, at, lowered = [], 0, text.translate(WORD_BYTES)
    for i, m in enumerate(re.finditer(rb"[^ ]+", lowered)):
        if i in positions:
            kept.append(text[at : m.start()])
            at = m.end()
    return b"".join([*kept, text[at:]])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


ORACLE_SQL = """
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    l AS (SELECT DISTINCT n FROM g),
    h AS (SELECT p.doc_id, p.i, g.n, g.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM p, l WHERE i + n - 1 <= len(w)) p JOIN g ON g.n = p.n AND g.s = p.s),
    k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)"""
QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE = {"op7_decontaminate": ORACLE_SQL}
