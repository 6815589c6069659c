"""SimHash near-duplicates with bit-sliced comparison.

Texts are A-Z lower-cased; words are runs of ``[^\\x20\\x09-\\x0D]``; features are 3-word
shingles, repeats included, joined by a space (fewer words: the whole sequence; none:
fingerprint zero, linked like any other).  A fingerprint bit is 1 if it is set in over
half of the shingles' XXH64 (seed 42).

Fingerprints link at RADIUS = 3 or fewer differing bits.  The 64 bits are cut into five
blocks; two fingerprints within 3 bits agree in at least two blocks, so each distinct
fingerprint is filed under its ten pairs of blocks (about 26 bits each) and only those
filed together are compared.  Comparison is bit-sliced: a bucket's fingerprints are kept
as 64 bit planes, a word holds one bit of 64 fingerprints, carry-save counters add up
the differing bits of 64 fingerprints at once, and words in which all counters have
passed the radius are left out of the remaining planes.

Equal fingerprints are one node (their smallest doc_id) before anything is compared.
A bucket of more than BLOCK fingerprints is filed again: what is left of the bits is cut
into five blocks once more, and so a third time; then at most 15 bits are left, so no
bucket can hold over 2^15 fingerprints, and nowhere are all pairs of blocks dealt out.
Within a bucket only enough links are kept to join what is linked (a spanning forest).
Each task joins what it has linked before its pairs go out.  Components come from
alternating large-star and small-star steps over node pairs, until all are stars.  Rows meet their fingerprint's component, and pairs their node's smallest
neighbour, by joins that broadcast the few hot keys and shuffle the rest.

Null text is empty.  Texts of any length are read whole, their hashes counted in slices.
Repeated rows each get a row.  A null doc_id gets a fingerprint and links like others, and
counts as larger than any id.  An empty table gives an empty result.  Columns besides id
and text are not read, whatever their names; drop_near returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, id_text, join_split, listed, materialise, read, texts

RADIUS = 3
BLOCK = 8192
#: Widths of the five blocks, lowest first: of a fingerprint, and of what is left of it (at most 39, then 24 bits) where a bucket is crowded.
WIDTHS = ((13, 13, 13, 13, 12), (8, 8, 8, 8, 7), (5, 5, 5, 5, 4))
SEED = 42
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
NULL_ID = (1 << 63) - 1
#: So many nodes are joined at once within a task.
HELD = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.translate(_LOWER).split()  # bytes.split() splits at exactly \x20 and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < 3:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-3].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[2:] - 1).tolist())], np.uint64)


def fingerprints(raw: list[bytes]) -> np.ndarray:
    out = np.zeros(len(raw), np.uint64)
    for i, x in enumerate(raw):
        h = shingle_hashes(x)
        if n := len(h):
            ones = np.zeros(64, np.int64)
            for at in range(0, n, 8192):  # bounded memory for very long texts
                ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(texts(b)).view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, fp long")


# -- bit-sliced comparison ------------------------------------------------------------


def planes_of(fp: np.ndarray) -> np.ndarray:
    """64 planes; bit i of plane b is bit b of fingerprint i."""
    width = -(-len(fp) // 64)
    padded = np.zeros(width * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def within(differ, width: int, radius: int = RADIUS, planes: int = 64) -> np.ndarray:
    """A mask, a bit each, of the lanes in which at most radius planes differ.

    differ(b, words): the words, given by index, of plane b's differences."""
    depth = (radius + 1).bit_length()
    alive, out = np.arange(width), np.zeros(width, np.uint64)
    counts, over = np.zeros((depth, width), np.uint64), np.zeros(width, np.uint64)
    for first in range(0, planes, 8):
        for b in range(first, min(first + 8, planes)):
            carry = differ(b, alive)
            for k in range(depth):
                counts[k], carry = counts[k] ^ carry, counts[k] & carry
            over |= carry
            if 1 << (depth - 1) > radius:  # the counter's top bit alone tells
                over |= counts[depth - 1]
        stay = over != FULL
        if not stay.all():
            alive, counts, over = alive[stay], counts[:, stay], over[stay]
            if not len(alive):
                return out
    bad = over.copy()
    equal = np.full(len(alive), FULL)
    for k in reversed(range(depth)):  # counters greater than radius
        if radius >> k & 1:
            equal &= counts[k]
        else:
            bad |= equal & counts[k]
            equal &= ~counts[k]
    out[alive] = ~bad
    return out


def lanes(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


def near_one(planes: np.ndarray, n: int, query: int, radius: int = RADIUS) -> np.ndarray:
    """Which of n fingerprints lie within radius of query."""
    return lanes(within(lambda b, w: planes[b, w] ^ (FULL if query >> b & 1 else np.uint64(0)), planes.shape[1], radius), n)


def near_shifted(planes: np.ndarray, n: int, d: int, radius: int = RADIUS) -> np.ndarray:
    """Which i < n - d lie within radius of fingerprint i + d (0 < d < 64)."""
    low, high = np.uint64(d), np.uint64(64 - d)

    def differ(b: int, w: np.ndarray) -> np.ndarray:
        p = planes[b]
        ahead = p[w] >> low
        inside = w + 1 < len(p)
        ahead[inside] |= p[w[inside] + 1] << high
        return p[w] ^ ahead

    return lanes(within(differ, planes.shape[1], radius), n - d)


def links_small(fp: np.ndarray, bucket: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the same bucket within the radius; buckets are runs of at most most rows."""
    planes, a, b = planes_of(fp), [], []
    for d in range(1, most):
        if not (same := bucket[d:] == bucket[:-d]).any():
            break
        i = near_shifted(planes, len(fp), d)
        i = i[same[i]]
        a.append(i)
        b.append(i + d)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


def links_large(fp: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links in one bucket: what a search has reached leaves the planes."""
    rest, a, b = np.arange(len(fp)), [], []
    planes, queue = planes_of(fp), []
    gone = np.zeros(len(fp), bool)
    while True:
        if not queue:
            left = np.flatnonzero(~gone)
            if len(left) < 2:
                return a, b
            gone[left[0]] = True
            queue = [int(rest[left[0]])]
        at = queue.pop()
        near = near_one(planes, len(rest), int(fp[at]))
        near = near[~gone[near]]
        gone[near] = True
        found = rest[near].tolist()
        a += [at] * len(found)
        b += found
        queue += found
        if gone.sum() * 2 > len(gone):
            rest = rest[~gone]
            planes, gone = planes_of(fp[rest]), np.zeros(len(rest), bool)
            if not len(rest):
                return a, b


SMALL = 48


def bucket_links(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked node pairs of rows sorted by bucket; whole buckets."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    size_of = np.repeat(sizes, sizes)
    small = (size_of > 1) & (size_of <= SMALL)
    if small.any():
        rows = np.flatnonzero(small)
        i, j = links_small(fp[rows], bucket[rows], int(size_of[rows].max()))
        yield node[rows[i]], node[rows[j]]
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        i, j = links_large(fp[s : s + n])
        if i:
            yield node[s + np.array(i)], node[s + np.array(j)]


# -- candidate search -----------------------------------------------------------------


def filed(rest: Column, widths: tuple[int, ...]) -> Column:
    """By each pair of blocks: struct<pair, key: the bits of the two, rest: the bits of the other three>."""
    block, at = [], 0
    for w in widths:
        block.append((F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << w) - 1)), w))
        at += w

    def joined(blocks: list[tuple[Column, int]]) -> Column:
        bits, at = F.lit(0).cast("long"), 0
        for value, w in blocks:
            bits = bits.bitwiseOR(F.shiftleft(value, at))
            at += w
        return bits

    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    return F.array(*(F.struct(F.lit(n).alias("pair"), joined([block[i], block[j]]).alias("key"), joined([b for k, b in enumerate(block) if k not in (i, j)]).alias("rest")) for n, (i, j) in enumerate(pairs)))


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes(fp, node), distinct fingerprints, that join what is linked and nothing else.

    Bucket numbers are hashes: two buckets that share one are compared together, which adds work and no link."""
    found, left = [], nodes.select(F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("rest"), "fp", "node")
    for level, widths in enumerate(WIDTHS):
        dealt = left.select("bucket", F.explode(filed(F.col("rest"), widths)).alias("f"), "fp", "node")
        dealt = dealt.select(F.xxhash64("bucket", "f.pair", "f.key").alias("bucket"), "f.rest", "fp", "node")
        counts = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        crowded = materialise(counts, "crowded") if level + 1 < len(WIDTHS) else None
        if crowded is None or not crowded.limit(1).count():
            found.append(compared(dealt))
            break
        dealt = materialise(dealt, "buckets")
        split = join_split(dealt, crowded, "bucket", "n", "left")
        found.append(compared(split.where("n is null").drop("n")))
        left = materialise(split.where("n is not null").drop("n"), "crowded-rows")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def compared(dealt: DataFrame) -> DataFrame:
    """Pairs that join what is linked within a bucket: each task's rows with the smallest node that its buckets join them to."""
    spread = dealt.select("bucket", "fp", "node").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def work(parts) -> Iterator[pa.RecordBatch]:
            bucket, fp, node = (np.concatenate(x) for x in zip(*parts))
            for a, b in bucket_links(bucket, fp, node):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def found() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for batch in batches:
                if not batch.num_rows:
                    continue
                bucket, node = (batch.column(k).to_numpy() for k in ("bucket", "node"))
                fp = batch.column("fp").to_numpy().view(np.uint64)
                last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
                if last:
                    yield from work([*held, (bucket[:last], fp[:last], node[:last])])
                    held = []
                held.append((bucket[last:], fp[last:], node[last:]))
            if held:
                yield from work(held)

        return stars(found())

    return spread.mapInArrow(run, "a long, b long")


def stars(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) as pairs of each node with the smallest that these join it to; after every most nodes what is held goes out and is forgotten."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        at = x
        while (up := above.setdefault(at, at)) != at:
            at = up
        while (up := above[x]) != at:
            above[x], x = at, up
        return at

    def out() -> Iterator[pa.RecordBatch]:
        joined = [(root(x), x) for x, up in list(above.items()) if up != x]
        if joined:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*joined)], names=["a", "b"])
        above.clear()

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
            if len(above) >= most:
                yield from out()
    yield from out()


def settled(edges: DataFrame) -> bool:
    """Whether each b has one a, and no a is a b: every component is a star, so its centre is its smallest node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(0).alias("below")), F.struct(F.col("b").alias("u"), F.lit(1).alias("below")))).alias("e")).select("e.*")
    nodes = ends.groupBy("u").agg(F.sum("below").alias("above"), F.min("below").alias("centre"))
    return nodes.where("above > 1 or above = 1 and centre = 0").agg(F.count("*")).first()[0] == 0


def components(pairs: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in pairs(a, b), by star contraction.

    Each round's pairs are written to the shared folder; rounds end when all that is left are stars.  What a task
    reads of them it joins first, which saves most rounds: a round is five shuffles, this is none."""
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialise(pairs.where("a <> b").select(low, high).distinct(), "links")
    while not settled(edges):
        edges = materialise(edges.mapInArrow(stars, "a long, b long"), "joined")
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = join_split(both, least, "u", "n").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        # small star: towards the smallest of the smaller neighbours
        small_least = materialise(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")), "least")
        small = join_split(large, small_least, "b", "n")
        small = small.select(F.col("m").alias("a"), F.col("b")).unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        edges = materialise(small, "links")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    marked = materialise(with_fingerprint(docs, id_col, text_col), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("node"), F.count("*").alias("n")), "nodes")
    joined = components(links(nodes))
    found = materialise(nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n"), "found")
    return join_split(marked, found, "fp", "n").select("doc_id", "fp", F.when(F.col("component_id") < NULL_ID, F.col("component_id")).alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest doc_id of each component only, columns unchanged; rows that share that id all stay."""
    found = near_groups(docs, id_col, text_col)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    # an id of several rows stays where one of its rows is its component's first
    return listed(docs, id_col, gone.join(kept, gone["doc_id"].eqNullSafe(kept["doc_id"]), "left_anti"), "left_anti")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLE: dict[str, str] = {}
