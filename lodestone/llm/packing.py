"""Packing by cutting-stock column generation.

A document is its token ids and an end id.  It is cut into pieces of CAPACITY tokens and
a remainder; the remainders' length histogram (at most CAPACITY - 1 bins, whatever the
corpus) is a cutting-stock problem: a linear program over patterns (multisets of lengths
that fit a sequence), solved by column generation, in which a knapsack dynamic program
prices the next patterns, from a basis of patterns filled longest first to within GAP of a
proven bound.  Patterns are rounded down to what the histogram can fill; what is left is
filled longest first or, if that is better, as full as its pieces allow.  So the plan is a list of
(pattern, how often) of a size bound by CAPACITY, and every slot of it is taken.

Documents are then ranked within their length (by task and place in it), and the r-th
remainder of a length takes the r-th slot of that length: sequence and offset follow
from the plan by look-up, without a shuffle of the pieces by sequence.

Token ids, ranks and pieces are written once to the shared folder, so a lost executor
cannot change a rank.  A piece finds how many of its length stand in the tasks before its
own by a join on task and length: a task's pieces are bounded by its input, so no key of
that join grows with the corpus.

Null text is empty: its document is the end id alone.  Very long texts are encoded whole and
cut.  Repeated rows and ties are documents of their own.  An empty table gives an empty
result.  Columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, materialise, read, slices, small_batches
from .token_cache import library_ids, tokenizer_path

CAPACITY = 1024
END_ID = 0
#: Column generation ends at this share over the least number of sequences that is proven.
GAP = 0.006
#: Shares of the best bound's prices in those that are tried, one after the other until a pattern gains; patterns that one pricing offers.
MIXED, COLUMNS = (0.7, 0.3, 0.0), 60
#: The least pivot, and after how many the inverse is made anew.
STRICT = (1e-9, 256), (1e-7, 64), (1e-5, 16)

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


class Knapsack:
    """The most valuable multisets of lengths within a capacity, by dynamic programming; a price for each length."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, capacity: int):
        worth = np.full(capacity + 1, -np.inf)  # by length
        worth[lengths] = values
        best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        behind = best[::-1]  # behind[capacity + 1 - c:] is best before c, nearest first
        for c in range(1, capacity + 1):
            got = behind[capacity + 1 - c :] + worth[1 : c + 1]
            k = int(got.argmax())
            before = best[c - 1]
            if got[k] > before + 1e-12:
                best[c], take[c] = got[k], k + 1
            else:
                best[c] = before
        self.best, self.take, self.capacity = best, take, capacity
        self.last = np.maximum.accumulate(np.where(take > 0, np.arange(capacity + 1), 0))  # where the next piece is taken
        self.values, self.lengths = values, lengths
        self.place = np.full(capacity + 1, -1)
        self.place[lengths] = np.arange(len(lengths))

    def with_each(self, most: int) -> Iterator[np.ndarray]:
        """The best pattern of all that hold one given length, for up to most lengths, most valuable first."""
        value = self.values + self.best[self.capacity - self.lengths]
        for i in np.argsort(-value, kind="stable")[:most]:
            pattern, c = np.zeros(len(self.lengths)), self.last[self.capacity - self.lengths[i]]
            pattern[i] = 1
            while c:
                pattern[self.place[self.take[c]]] += 1
                c = self.last[c - self.take[c]]
            yield pattern


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis from patterns filled longest first, and how often each is used: until one length, its row, is used up, so the matrix is triangular but for the order of rows."""
    m, left = len(lengths), demand.copy()
    times = np.zeros(m)
    basis = np.diag((capacity // lengths).astype(float))
    alive = list(np.argsort(-lengths, kind="stable"))
    while alive:
        pattern, room = np.zeros(m), capacity
        for i in alive:
            if n := min(room // lengths[i], int(np.ceil(left[i]))):
                pattern[i] = n
                room -= n * lengths[i]
        used = np.flatnonzero(pattern)
        ratio = left[used] / pattern[used]
        gone = used[np.argmin(ratio)]
        times[gone] = ratio.min()
        left[used] -= ratio.min() * pattern[used]
        left[gone] = 0
        left[left < 1e-9] = 0
        basis[:, gone] = pattern
        alive = [i for i in alive if left[i] > 0]
    return basis, times


def inverted(basis: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The inverse and how often each pattern is used; None where the basis is singular, or so nearly that these do not meet the demand."""
    try:
        inverse = np.linalg.inv(basis)
    except np.linalg.LinAlgError:
        return None
    x = inverse @ demand
    if not np.isfinite(inverse).all() or np.abs(basis @ x - demand).max() > 1e-6 * demand.max() or x.min() < -1e-6 * demand.max():
        return None
    return inverse, np.maximum(x, 0)


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, enough: float = np.inf) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (columns), how often each is used, and a lower bound: the linear program by the revised simplex method.

    Prices are mixed with those of the best bound so far (at first: a length costs its share of a
    sequence), as prices of a basis alone swing.  Ends within GAP of the bound and at no more than enough,
    or at the optimum; a bound comes with every pricing.  The inverse is made anew every few pivots, against drift.
    Where that shows a basis that is all but singular, or no fewer sequences, the last sound one is gone on from
    with stricter pivots (STRICT); after the strictest it is the answer.  A first basis that is all but singular (many
    lengths chain) is the answer if it is within GAP, else the start is each length alone."""
    exact, demand = demand, demand * (1 + 1e-8 * np.random.default_rng(5).random(len(demand)))  # ties of the ratio test are rare so
    basis, x = first_basis(lengths, demand, capacity)
    centre = lengths / capacity
    bound, mixing, pivots, strict = float(centre @ demand), 0, 0, 0
    if x.sum() <= max(bound, min(bound * (1 + GAP), enough)) + 1e-9:
        return basis, x, bound
    if (made := inverted(basis, demand)) is None:
        if x.sum() <= bound * (1 + GAP):
            return basis, x, bound
        basis = np.diag((capacity // lengths).astype(float))
        made = inverted(basis, demand)
    (inverse, x), sound = made, basis.copy()
    y, fewest = inverse.sum(axis=0), x.sum()
    while x.sum() > max(bound, min(bound * (1 + GAP), enough)) + 1e-9:
        share = MIXED[mixing]
        prices = np.maximum(share * centre + (1 - share) * y, 0)
        priced = Knapsack(prices, lengths, capacity)
        scale = max(1.0, priced.best[capacity])
        if prices @ demand / scale > bound:
            bound, centre = float(prices @ demand / scale), prices / scale
        before, (least, often) = pivots, STRICT[strict]
        for column in priced.with_each(COLUMNS):
            gain = y @ column - 1
            if gain <= 1e-9:
                continue
            used = np.flatnonzero(column)
            w = (inverse[:, used] * column[used]).sum(axis=1)  # a few columns: not worth a threaded product
            rows = np.flatnonzero(w > least)
            if not len(rows):
                continue
            ratios = x[rows] / w[rows]
            near = rows[ratios <= ratios.min() + 1e-12]
            r = int(near[np.argmax(w[near])])
            x = np.maximum(x - ratios.min() * w, 0)
            x[r] = ratios.min()
            row = inverse[r] / w[r]
            inverse -= np.outer(w, row)
            inverse[r], basis[:, r] = row, column
            y = y - gain * row
            pivots += 1
            if pivots % often == 0:
                break
        if pivots > before:
            mixing = 0
        elif mixing + 1 < len(MIXED):
            mixing += 1
        else:
            break  # no pattern is worth more than it costs
        if pivots > before and pivots % often == 0:
            made = inverted(basis, demand)
            if made is None or made[1].sum() > fewest - 1e-9:
                if strict + 1 == len(STRICT):
                    break
                strict, pivots, basis = strict + 1, 0, sound.copy()
                made = inverted(basis, demand)
            (inverse, x), sound = made, basis.copy()
            y, fewest = inverse.sum(axis=0), x.sum()
    for b in (basis, sound):
        if (made := inverted(b, demand)) is not None and made[1].sum() <= fewest + 1e-6:
            break
    return b, np.maximum(made[0] @ exact, 0), bound


def fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that use up what is left, longest first, each repeated as often as it can be."""
    out, left = [], left.copy()
    order = np.argsort(-lengths)
    while left.any():
        pattern, room = np.zeros(len(lengths), np.int64), capacity
        for i in order[left[order] > 0]:
            n = min(room // lengths[i], left[i])
            if n:
                pattern[i] = n
                room -= int(n * lengths[i])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= pattern * times
        out.append((pattern, times))
    return out


def fill_fullest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """As fill, but the longest piece's sequence is filled as far as any choice of pieces can: sums within reach are bits of a number."""
    out, left = [], left.copy()
    order = [int(i) for i in np.argsort(-lengths)]
    while left.any():
        order = [i for i in order if left[i]]
        room = capacity - int(lengths[order[0]])
        bits, reach, items = 1, [1], []
        for i in order:
            size, n, k = int(lengths[i]), min(int(left[i]) - (i == order[0]), room // int(lengths[i])), 1
            if n <= 0:
                continue
            while n:  # n pieces as 1, 2, 4, ... of them
                bits |= bits << size * min(k, n) & (1 << room + 1) - 1
                n -= min(k, n)
                k *= 2
            items.append(i)
            reach.append(bits)
            if bits >> room & 1:
                break
        pattern, sum_ = np.zeros(len(lengths), np.int64), bits.bit_length() - 1
        pattern[order[0]] = 1
        for i, before in zip(reversed(items), reversed(reach[:-1])):
            while not before >> sum_ & 1:
                sum_ -= int(lengths[i])
                pattern[i] += 1
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= pattern * times
        out.append((pattern, times))
    return out


def rounded(lengths: np.ndarray, demand: np.ndarray, patterns: np.ndarray, x: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of the linear program as often as the histogram can fill them, and what is left by the better of two fillings."""
    left, chosen = demand.copy(), []
    for i in np.argsort(-x, kind="stable"):
        p = patterns[:, i].astype(np.int64)
        used = p > 0
        times = min(int(x[i] + 1e-6), int((left[used] // p[used]).min()))
        if times:
            left -= p * times
            chosen.append((p, times))
    return chosen + min((f(lengths, left, capacity) for f in (fill, fill_fullest)), key=sequences)


def sequences(planned: list[tuple[object, int]]) -> int:
    return sum(times for _, times in planned)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(pattern, how often): together exactly the histogram's pieces."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], np.int64)
    largest_first = fill(lengths, demand, capacity)
    patterns, x, _ = solve(lengths, demand.astype(float), capacity, sequences(largest_first))
    chosen = rounded(lengths, demand, patterns, x, capacity)
    if sequences(chosen) > sequences(largest_first):  # rounding may lose a sequence or two
        chosen = largest_first
    return [(tuple((int(lengths[i]), int(p[i])) for i in np.flatnonzero(p)[::-1]), t) for p, t in chosen]


def slots(planned: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, slots in a sequence, offset of the first; one entry for each pattern with it."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for pattern, times in planned:
        offset = 0
        for length, n in pattern:
            found.setdefault(length, []).append((ranks[length], sequence, n, offset))
            ranks[length] += n * times
            offset += n * length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in found.items()}


def place(table: dict[int, tuple[np.ndarray, ...]], length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, sequence, n, offset = table[length]
    i = np.searchsorted(first, rank, "right") - 1
    within = rank - first[i]
    return sequence[i] + within // n[i], offset[i] + within % n[i] * length


PIECES = "part int, rank long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, spaces: bool = True) -> DataFrame:
    """The pieces of all documents; rank counts a task's pieces of the same length."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = library_ids(path, spaces), TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for b in slices(whole, 4 << 20):
                rows = []
                for doc, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text"))):
                    ids += end
                    total = len(ids) // 4
                    for at in range(0, total, capacity):
                        n = min(capacity, total - at)
                        rows.append((part, seen[n], doc, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows))], names=[x.split()[0] for x in PIECES.split(", ")])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(cut(id_text(docs, id_col, text_col), path or tokenizer_path("byte_bpe_50k.json"), capacity, end_id), "pieces")
    # a row for each task and length: how many of that length the tasks before it have
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "base")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    full = histogram.pop(capacity, 0)
    planned = plan(histogram, capacity)
    table = slots([(((capacity, 1),), full), *planned] if full else planned)
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                sequence[at], offset[at] = place(sent.value, n, rank[at])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEPT), pa.array(sequence), pa.array(offset)], names=[*KEPT, "sequence_id", "offset"])

    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("rank", *KEPT).mapInArrow(run, ", ".join(f"{k} long" for k in [*KEPT, "sequence_id", "offset"]))


KEPT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLE: dict[str, str] = {}
