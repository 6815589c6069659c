"""Token-id files under Re-Pair grammar compression.

Documents are dealt by doc_id ranges and sorted, tokenised, and gathered into shards of
about SHARD_TOKENS ids.  Per shard, frequent neighbouring pairs of ids are replaced by
nonterminals, round after round (in a round all pairs above a count are replaced at once,
left to right, and none across two documents), until no pair is frequent or the symbols run
out: a symbol has two bytes where the shard's ids fit into them, else four.  A file row holds
the rules, the length each rule expands to, the compressed symbols, and for each document its
id, its number of ids and its number of symbols; so a document, or a range in it, is decoded
without decoding what stands before it.

The files are Parquet, written to the shared folder by Spark, so any store works and a
lost executor's rows are written anew; results come from the files as read back.

Order is ascending doc_id, null ids first; rows that repeat an id stand next to each
other in no promised order.  Null text is empty: its document is the end id alone.  An
empty table gives empty files and an empty result.  Very long texts are encoded whole, each
within one shard.  Columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, read, scratch_path, slices, small_batches
from .token_cache import library_ids, tokenizer_path

SHARD_TOKENS = 1 << 20
END_ID = 2
#: A pair is frequent from this count; and symbols in all, of two bytes and of four.
FREQUENT, SYMBOLS, WIDE_SYMBOLS = 24, 1 << 16, 1 << 31
TABLE_BITS = 20


def rules_at(key: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each pair its place in keys, or -1.  Looked up in a hashed table; pairs whose slot several of keys share are searched for."""
    folded = (lambda x: x) if key.dtype == np.uint32 else lambda x: (x ^ (x >> np.uint64(29))).astype(np.uint32)
    slots = lambda x: (folded(x) * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)
    table, taken = np.full(1 << TABLE_BITS, -1, np.int32), slots(keys)
    table[taken] = np.arange(len(keys), dtype=np.int32)
    rule = table[slots(key)]
    rule[keys[rule] != key] = -1
    lost = np.flatnonzero(table[taken] != np.arange(len(keys)))
    if len(lost):
        order = lost[np.argsort(keys[lost])]
        rest = np.flatnonzero(rule < 0)
        at = np.minimum(np.searchsorted(keys[order], key[rest]), len(order) - 1)
        same = keys[order[at]] == key[rest]
        rule[rest[same]] = order[at[same]]
    return rule


def symbol_type(first: int) -> tuple[type, int]:
    """The symbols' type, and how many there may be, where ids are below first."""
    if first > WIDE_SYMBOLS:
        raise ValueError(f"id {first - 1} does not fit into four bytes with rules beside it")
    return (np.uint16, SYMBOLS) if first <= SYMBOLS else (np.uint32, WIDE_SYMBOLS)


def compress(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n x 2), symbols, and each document's number of symbols; ids of documents one after another.

    Counts are exact.  A round leaves no occurrence of a pair it has a rule for, and no other
    pair of older symbols can become frequent, so the next round counts only pairs with a new symbol."""
    first = int(ids.max(initial=0)) + 1
    kind, limit = symbol_type(first)
    pair = np.uint32 if kind is np.uint16 else np.uint64
    shift = pair(8 * np.dtype(kind).itemsize)
    seq, sizes = ids.astype(kind), lengths.astype(np.int64)
    rules: list[np.ndarray] = [np.empty((0, 2), kind)]
    made, near = 0, None  # near: where pairs with a new symbol stand; None is everywhere
    while (room := limit - first - made) > 0 and len(seq) > 1:
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(seq), bool)
        inner[ends[sizes > 0]] = False  # no pair across documents
        near = np.flatnonzero(inner) if near is None else near[inner[near]]
        key = (seq[near].astype(pair) << shift) | seq[near + 1]
        ordered = np.sort(key)
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
        counts = np.diff(np.r_[starts, len(ordered)])
        often = counts >= FREQUENT
        keys, counts = ordered[starts[often]], counts[often]
        if not len(keys):
            break
        cut = len(keys) > room
        keys = keys[np.argsort(-counts, kind="stable")[:room]]
        rule = rules_at(key, keys)
        # of overlapping matches every second one, from the left
        match = rule >= 0
        at, rule = near[match], rule[match]
        new_run = np.r_[True, at[1:] != at[:-1] + 1]
        run_start = at[new_run][np.cumsum(new_run) - 1]
        left = (at - run_start) % 2 == 0
        at, rule = at[left], rule[left]
        used = np.bincount(rule, minlength=len(keys)) > 0
        number = np.cumsum(used) - 1
        keys = keys[used]
        rules.append(np.stack([keys >> shift, keys & ((pair(1) << shift) - pair(1))], axis=1).astype(kind))
        seq[at] = (first + made + number[rule]).astype(kind)
        made += len(keys)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        sizes = sizes - np.diff(np.searchsorted(at, np.r_[0, ends + 1]))
        seq = seq[keep]
        if cut:
            near = None
        else:
            new = at - np.arange(len(at))
            mark = np.zeros(len(seq) + 1, bool)
            mark[new], mark[new - 1] = True, True  # the first one's -1 is the spare place at the end
            near = np.flatnonzero(mark[:-1])
    return np.concatenate(rules), seq, sizes


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for; a rule uses only earlier ones."""
    out = [0] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (1 if a < first else out[a - first]) + (1 if b < first else out[b - first])
    return np.array(out, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for.  Every symbol's place in the output follows from the expansion lengths, so each
    rule's two sides are put where they go, and what is an id by then is done."""
    lengths = np.r_[np.ones(first, np.int64), expansion_lengths(rules, first) if lengths is None else lengths]
    size = lengths[symbols]
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, symbols.dtype)
    at, left = ends - size, symbols
    while len(left):
        done = left < first
        out[at[done]] = left[done]
        at, pairs = at[~done], rules[left[~done].astype(np.int64) - first]
        left, at = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([at, at + lengths[pairs[:, 0]]])
    return out


def expand_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a document's symbols, expanding only the symbols they fall in."""
    size = np.ones(len(symbols), np.int64)
    big = symbols >= first
    size[big] = lengths[symbols[big].astype(np.int64) - first]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules, first, lengths)[start - skipped : stop - skipped]


FILE = "part int, shard int, first_symbol int, n_ids long, doc_ids array<long>, doc_n_ids array<long>, doc_n_symbols array<long>, symbol_bytes int, rules binary, rule_lengths binary, symbols binary"


def shards(docs: DataFrame, path: str, spaces: bool, end_id: int) -> DataFrame:
    """File rows of docs, which come in order."""
    end = end_id.to_bytes(4, "little")

    def row(part: int, shard: int, held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
        n = np.array([len(x) // 4 for _, x in held], np.int64)
        rules, symbols, sizes = compress(ids, n)
        first = int(ids.max()) + 1
        values = [part, shard, first, len(ids), [d for d, _ in held], n, sizes, (width := symbols.dtype.itemsize), rules.astype(f"<u{width}").tobytes(), expansion_lengths(rules, first).astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int32(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in FILE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = library_ids(path, spaces), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0
        for whole in batches:
            for b in slices(whole, 4 << 20):
                for doc, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text"))):
                    held.append((doc, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= SHARD_TOKENS:
                        yield row(part, shard, held)
                        held, size, shard = [], 0, shard + 1
        if held:
            yield row(part, shard, held)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, FILE)


def write_ids(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, spaces: bool = False, end_id: int = END_ID) -> None:
    ordered = id_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards(ordered, path or tokenizer_path("word_bpe_49k.json"), spaces, end_id).write.parquet(out)


def decoded(files: DataFrame) -> DataFrame:
    """part, shard, doc_id, at (ids before it in its shard), n_tokens, ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pydict()
                get = {k: v[0] for k, v in one.items()}
                kind = f"<u{get['symbol_bytes']}"
                rules = np.frombuffer(get["rules"], kind).reshape(-1, 2)
                ids = expand(np.frombuffer(get["symbols"], kind), rules, get["first_symbol"], np.frombuffer(get["rule_lengths"], "<u4")).astype("<u4").tobytes()
                n = np.array(get["doc_n_ids"], np.int64)
                at = np.cumsum(n) - n
                crc = [zlib.crc32(ids[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist())]
                cols = [pa.array(np.full(len(n), get["part"], np.int32)), pa.array(np.full(len(n), get["shard"], np.int32)), pa.array(get["doc_ids"], pa.int64()), pa.array(at), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    files = spark.read.schema(FILE).parquet(path)
    sizes = files.select("part", "shard", "n_ids")
    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the writing stage
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("part_start"))
    starts = sizes.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    return decoded(files).join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_ids(read(spark, sf_dir, "documents"), path)
    return read_back(spark, path)


QUERIES = {"op9_token_files": op9_token_files}
ORACLE: dict[str, str] = {}
