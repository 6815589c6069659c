"""Removal of repeated byte strings by prefix-free parsing.

Every byte that is covered by a WIDTH-byte string which also starts earlier (smaller
doc_id, or earlier in the same document) is removed; strings never cross documents,
overlaps count, and all strings are those of the input.

Parse: a rolling hash of GRAM bytes triggers phrase boundaries where it is 0 modulo EVERY;
where WIDTH bytes in a row have no such place, their smallest hash is the trigger.  A
string's trigger is the first one inside it, so equal strings have equal triggers at equal
places.  Strings in a row with the same trigger are a phrase's suffixes: left of the
trigger stands the phrase, right of it the parse goes on, to a depth of WIDTH bytes.

Dictionary: phrases (with what follows) are reduced to their first place in corpus order,
first within a batch, then within their group; all strings of a later place are repeats.
Equality is by 128 bits of BLAKE2b.  Most triggers have one phrase; those are done.

Order: where a trigger has several phrases, two suffix arrays are built: of the dictionary
(what stands left of the trigger, read from the trigger outwards) and of the parse (what
follows it).  Neighbours' common lengths give classes at each depth; a suffix that reaches
d bytes left of its trigger is known, to WIDTH bytes, by its class at depth d in the one
and at depth WIDTH - d in the other.  Of equal suffixes, in corpus order, all but the first
are repeats.  That is the corpus suffix array as far as repeats need it: suffixes with
different triggers differ within WIDTH bytes, so their order need not be known.  Only
phrases that meet others travel with their bytes, and all comparison there is by bytes.

Hot triggers: those that hold over 1/HOT_SHARE of the phrases in a sample of documents (at
most HOT_SHARE; the sample steers only where rows meet, not what is found) are dealt out
by phrase, each phrase once a task, and their phrases, like those of triggers with more
than CROWDED, by the strings themselves, each string once a task; so no group grows with
the corpus faster than the number of tasks.  Sort and walk are streamed.

Texts are UTF-8 bytes; null is empty; a text of under WIDTH bytes loses nothing.  Very long
texts are parsed in parts of PART bytes.  Rows that share a doc_id, or have none, stand in
table order (nulls last).  An empty table gives an empty result.  Columns besides id and
text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, id_text, join_split, materialise, read, slices, small_batches

WIDTH = 100
GRAM = 24
EVERY = 48
CROWDED = 4000
PART = 1 << 19
#: Documents looked at for hot triggers, and how many there can be.
SAMPLE, HOT_SHARE = 1024, 2000
#: Entries that a task keeps to see repeats of its own.
SEEN = 200_000
#: Rows of phrases or strings that are sent on at once, or a phrase's strings more.
OUT = 20_000

_RNG = np.random.default_rng(77_003)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_M = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(32))


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest, leftmost of every width neighbours of h is."""
    at, span = np.arange(len(h), dtype=np.int32), 1
    best = lambda a, b: np.where(h[b] < h[a], b, a)
    while span * 2 <= width:
        at = best(at[:-span], at[span:])
        span *= 2
    n = len(h) - width + 1
    return best(at[:n], at[width - span : width - span + n])


Phrases = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def parse(texts: list[bytes], width: int = WIDTH) -> Phrases:
    """Phrases of texts: text index, first start, how many strings, the trigger's place from the start, trigger hash, digest (n x 2).

    Texts are taken in parts that overlap by a string less a byte, a few parts at a time."""
    found: list[Phrases] = []
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for i, x in enumerate(texts):
        for at in range(0, max(len(x) - width + 1, 0), PART):
            parts.append((i, at, x[at : at + PART + width - 1]))
            size += len(parts[-1][2])
            if size >= PART:
                found.append(parse_parts(parts, width))
                parts, size = [], 0
    if parts:
        found.append(parse_parts(parts, width))
    if not found:
        return tuple(np.empty(s, t) for s, t in ((0, np.int64),) * 4 + ((0, np.uint64), ((0, 2), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found)) if len(found) > 1 else found[0]


def parse_parts(parts: list[tuple[int, int, bytes]], width: int) -> Phrases:
    buffer = b"".join(p for _, _, p in parts)
    size = np.array([len(p) for _, _, p in parts])
    begin = np.cumsum(size) - size
    power, inverse = powers(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(buffer, np.uint8)] * power[:-1], out=total[1:])
    gram = min(GRAM, width)
    grams = mixed((total[gram:] - total[:-gram]) * inverse[: len(total) - gram])
    trigger = least_in(np.where(grams % np.uint64(EVERY) == 0, np.uint64(0), grams), width - gram + 1)
    # starts of strings inside one part; a phrase ends where the trigger or the part does
    part_of = np.repeat(np.arange(len(parts)), size - width + 1)
    start = np.arange(len(part_of)) + np.repeat(begin - np.r_[0, np.cumsum(size - width + 1)[:-1]], size - width + 1)
    trigger = trigger[start]
    first = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (part_of[1:] != part_of[:-1])])
    many = np.diff(np.r_[first, len(start)])
    at = start[first]
    owner = np.array([(i, a) for i, a, _ in parts])[part_of[first]]
    digest = hashlib.blake2b
    keys = b"".join([digest(buffer[a:b], digest_size=16).digest() for a, b in zip(at.tolist(), (at + many + width - 1).tolist())])
    return owner[:, 0], owner[:, 1] + at - begin[part_of[first]], many, trigger[first] - at, grams[trigger[first]], np.frombuffer(keys, np.int64).reshape(-1, 2)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def pack(start: np.ndarray, n: np.ndarray, trigger: np.ndarray, hot: np.ndarray | int = 0) -> np.ndarray:
    """A phrase's place in one number that sorts by start: how many strings, where its trigger is, whether that is hot."""
    return (start << 25) | (n << 13) | (trigger << 1) | hot


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 25, (at >> 13) & 4095, (at >> 1) & 4095


# Rows of the first exchange: a phrase's group, digest, document and place; or, with at = -1, bytes k0..k1 to be removed.
PHRASES = "unit long, k0 long, k1 long, doc long, at long"
# Its result: phrases that may meet others (end = -1), or bytes at..end to be removed.
MARKS = "unit long, doc long, at long, end long"


def _batch(schema: str, cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cols], names=[x.split()[0] for x in schema.split(", ")])


def spans_of_phrases(doc: np.ndarray, start: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases' bytes, joined per document where they touch.  Within a document ends ascend as starts do."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + n + width - 1)[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])])
    return doc[new], start[new], end[np.r_[new[1:], len(doc)] - 1]


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]


def hot_triggers(docs: DataFrame, width: int) -> np.ndarray:
    """Triggers with over 1/HOT_SHARE of the phrases of about SAMPLE documents, ascending."""
    share = min(1 << 20, (SAMPLE << 20) // max(docs.count(), 1))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        trigger, n = np.unique(parse(_texts(b), width)[4], return_counts=True)
        return _batch("trigger, n", [trigger, n])

    seen = arrow_map(docs.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < share), run, "trigger long, n long")
    counts = materialise(seen.groupBy("trigger").agg(F.sum("n").alias("n")), "triggers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("n") > total // HOT_SHARE) & (F.col("n") > 1)).select("trigger").collect()  # fewer than HOT_SHARE
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def first_places(docs: DataFrame, width: int) -> DataFrame:
    """Per batch: each phrase's first place, and what is a repeat within the batch (for hot triggers, the task) already."""
    sent = docs.sparkSession.sparkContext.broadcast(hot_triggers(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_list, seen = sent.value, {}
        for whole in batches:
            for b in slices(whole, PART):
                which, start, n, place, trigger, key = parse(_texts(b), width)
                if not len(which):
                    continue
                doc = b.column("doc").to_numpy()[which]
                order = np.lexsort((start, doc, key[:, 1], key[:, 0]))
                doc, start, n, place, trigger, key = (c[order] for c in (doc, start, n, place, trigger, key))
                again = np.r_[False, (key[1:] == key[:-1]).all(axis=1)]
                hot = np.isin(trigger, hot_list, kind="sort") if len(hot_list) else np.zeros(len(trigger), bool)
                for i in np.flatnonzero(hot & ~again).tolist():
                    k, here = key[i].tobytes(), (int(doc[i]), int(start[i]))
                    if seen.get(k, here) < here:
                        again[i] = True
                    else:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[k] = here
                unit = np.where(hot, mixed(trigger ^ key[:, 0].view(np.uint64)), trigger)
                stay = ~again
                yield _batch(PHRASES, [c[stay] for c in (unit, key[:, 0], key[:, 1], doc, pack(start, n, place, hot.astype(np.int64)))])
                if again.any():
                    d, s, e = spans_of_phrases(doc[again], start[again], n[again], width)
                    spread = mixed(d.view(np.uint64) * np.uint64(31) + s.view(np.uint64))
                    yield _batch(PHRASES, [spread, s, e, d, np.full(len(d), -1)])

    return docs.mapInArrow(run, PHRASES)


def marks(places: DataFrame, width: int) -> DataFrame:
    """Bytes to be removed, and the first places of phrases whose trigger has others or is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # unit and digest of the row before
        pending: list[np.ndarray] | None = None  # the only phrase so far of the last unit
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(k).to_numpy() for k in ("unit", "k0", "k1", "doc", "at")]
            done = rows[4] < 0
            out = [[np.zeros(int(done.sum()), np.int64), rows[3][done], rows[1][done], rows[2][done]]]
            u, k0, k1, doc, at = (c[~done] for c in rows)
            if len(u):
                same_u = np.r_[last is not None and last[0] == u[0], u[1:] == u[:-1]]
                same = same_u & np.r_[last is not None and last[1:] == (k0[0], k1[0]), (k0[1:] == k0[:-1]) & (k1[1:] == k1[:-1])]
                start, n, _ = unpack(at[same])
                d, s, e = spans_of_phrases(doc[same], start, n, width)
                out.append([np.zeros(len(d), np.int64), d, s, e])
                new = [u[~same], doc[~same], at[~same], np.full(int((~same).sum()), -1)]
                follows = same_u[~same]  # another phrase of the same unit stands before
                if len(follows):
                    if pending is not None and follows[0]:
                        out.append(pending)
                    hot = (new[2] & 1) == 1
                    several = follows | np.r_[follows[1:], False] | hot
                    out.append([c[several] for c in new])
                    pending = None if several[-1] else [c[-1:] for c in new]
                last = int(u[-1]), int(k0[-1]), int(k1[-1])
            yield _batch(MARKS, [np.concatenate(c) for c in zip(*out)])

    return places.repartition("unit").sortWithinPartitions("unit", "k0", "k1", "doc", "at").mapInArrow(run, MARKS)


SUFFIXES = "bucket long, doc long, at long, bytes binary"


def with_bytes(docs: DataFrame, several: DataFrame, width: int) -> DataFrame:
    """Phrases that may meet others, with their bytes; those of crowded or hot triggers string by string (no bytes: to be removed)."""
    counts = materialise(several.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED), "crowded")
    dealt = join_split(several, counts, "unit", "n", "left")
    by_string = F.col("n").isNotNull() | (F.col("at").bitwiseAND(F.lit(1)) == 1)
    wanted = dealt.groupBy("doc").agg(F.collect_list(F.struct("at", "unit", by_string.alias("by_string"))).alias("wanted"))

    def rows(out: list[tuple[int, int, int, bytes | None]]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["bucket", "doc", "at", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        out: list[tuple[int, int, int, bytes | None]] = []
        for whole in batches:
            for b in slices(whole, PART):
                phrases = b.column("wanted").flatten()
                ends = np.cumsum(pc.list_value_length(b.column("wanted")).to_numpy(zero_copy_only=False))
                at = phrases.field("at").to_numpy(zero_copy_only=False)
                wants = list(zip(*(x.tolist() for x in (*unpack(at), at)), phrases.field("unit").to_pylist(), phrases.field("by_string").to_pylist()))
                first = 0
                for doc, text, end in zip(b.column("doc").to_pylist(), _texts(b), ends.tolist()):
                    for start, n, place, packed, unit, by_string in wants[first:end]:
                        if len(out) >= OUT:
                            yield rows(out)
                            out = []
                        if not by_string:
                            out.append((unit, doc, packed, text[start : start + n + width - 1]))
                            continue
                        for i in range(start, start + n):
                            x, here = text[i : i + width], (doc, i)
                            bucket = int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
                            if seen.get(x, here) < here:
                                out.append((bucket ^ hash(here), doc, pack(i, 0, 0), None))
                                continue
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen[x] = here
                            out.append((bucket, doc, pack(i, 1, start + place - i), x))
                    first = end
        yield rows(out)

    return docs.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(run, SUFFIXES)


def suffix_classes(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of rows of bytes (padded to one width) within groups, as classes: at depth d the rows whose first d bytes are equal share classes[d, rank]; and each row's rank."""
    m, width = side.shape
    padded = np.zeros((m, -(-max(width, 1) // 8) * 8), np.uint8)
    padded[:, :width] = side
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    ranked, groups = side[order], group[order]
    same = ranked[1:] == ranked[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1)) if width else np.zeros(m - 1, np.int64)
    common = np.where(groups[1:] == groups[:-1], common, -1)
    classes = np.zeros((width + 1, m), np.int64)
    np.cumsum(common[None, :] < np.arange(width + 1)[:, None], axis=1, out=classes[:, 1:])
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    return classes, rank


def repeats_in_order(group: np.ndarray, n: np.ndarray, place: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which strings (row, place in it) of the groups' phrases, in corpus order within a group, equal an earlier one."""
    buffer = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size

    def side(length: np.ndarray, step: int) -> np.ndarray:
        j = np.arange(int(length.max()))[None, :]
        inside = j < length[:, None]
        return np.where(inside, buffer[np.where(inside, (begin + place)[:, None] + (j if step > 0 else -1 - j), 0)], 0)

    left, left_rank = suffix_classes(group, side(place, -1))
    right, right_rank = suffix_classes(group, side(size - place, 1))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    depth = place[row] - at  # bytes left of the trigger
    key = ((left[depth, left_rank[row]] * (width + 1) + depth) << 32) | right[width - depth, right_rank[row]]
    order = np.argsort(key, kind="stable")
    hit = np.zeros(len(key), bool)
    hit[order[1:]] = key[order[1:]] == key[order[:-1]]
    return row[hit], at[hit]


def repeats(suffixes: DataFrame, width: int) -> DataFrame:
    """doc, start, end of the strings that equal an earlier one in their bucket."""

    def found(doc: np.ndarray, at: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (doc, at, ends)], names=["doc", "start", "end"])

    def settle(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]) -> tuple[pa.RecordBatch, np.ndarray, tuple]:
        """Spans of the repeats; rows that have a string of their own; the rows."""
        bucket, doc, at = (np.concatenate(c) for c in list(zip(*held))[:3])
        texts = [x for h in held for x in h[3]]
        start, n, place = unpack(at)
        row, i = repeats_in_order(bucket, n, place, texts, width)
        lone = np.bincount(row, minlength=len(n)) < n
        new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
        last = np.r_[new[1:], len(row)] - 1
        hit = row[new]  # a row's strings overlap, so its repeats are one span
        return found(doc[hit], start[hit] + i[new], start[hit] + i[last] + width if len(hit) else hit), lone, (bucket, doc, at, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
        for whole in batches:
            for b in slices(whole):
                bucket, doc, at = (b.column(k).to_numpy() for k in ("bucket", "doc", "at"))
                start, n, _ = unpack(at)
                gone = n == 0
                if gone.any():
                    yield found(doc[gone], start[gone], start[gone] + width)
                keep = np.flatnonzero(~gone)
                if not len(keep):
                    continue
                texts = b.column("bytes").take(pa.array(keep)).to_pylist()
                bucket, doc, at = bucket[keep], doc[keep], at[keep]
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
                if cut or (held and held[0][0][0] != bucket[0]):
                    yield settle([*held, (bucket[:cut], doc[:cut], at[:cut], texts[:cut])])[0]
                    held = []
                held.append((bucket[cut:], doc[cut:], at[cut:], texts[cut:]))
                if sum(len(h[0]) for h in held) > 2 * CROWDED:  # one bucket: what has no string of its own need not stay
                    spans, lone, (u, d, a, x) = settle(held)
                    yield spans
                    held = [(u[lone], d[lone], a[lone], [y for y, s in zip(x, lone.tolist()) if s])]
        if held:
            yield settle(held)[0]

    ordered = suffixes.repartition("bucket").sortWithinPartitions("bucket", "doc", "at")
    return ordered.mapInArrow(run, "doc long, start long, end long")


CUT = "doc long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """docs as (doc, doc_id, text), doc unique and in corpus order; whether doc is doc_id itself."""
    rows = id_text(docs, id_col, text_col)
    clash = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() > 0
    if not clash:
        return rows.select(F.col("doc_id").alias("doc"), "text"), True
    order = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(F.col("doc_id").asc_nulls_last(), F.col("at")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "at")
    return materialise(order.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "ordered"), False


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept_sha256."""
    small_batches(docs.sparkSession)
    rows, plain = keyed(docs, id_col, text_col)
    texts = rows.select("doc", "text").where("doc is not null")  # the same plan in both joins below, so the texts are shuffled once
    marked = materialise(marks(first_places(texts, width), width), "marks")
    later = repeats(with_bytes(texts, marked.where("end < 0").drop("end"), width), width)
    spans = marked.where("end >= 0").select("doc", F.col("at").alias("start"), "end").unionByName(later)
    gone = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, spans in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("gone").to_pylist()):
            text, runs, at, kept = text or b"", merged([(s["start"], s["end"]) for s in spans or []]), 0, hashlib.sha256()
            for s, e in runs:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            out.append((doc, len(text), sum(e - s for s, e in runs), [{"start": s, "end": e} for s, e in runs], kept.hexdigest()))
        kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc", "n_bytes", "n_removed", "spans", "kept_sha256"])

    done = arrow_map(texts.join(gone, "doc", "left").select("doc", "text", "gone"), run, CUT)
    if plain:
        return done.withColumnRenamed("doc", "doc_id")
    return done.join(rows.select("doc", "doc_id"), "doc").select("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op5_repeats": op5_repeats}
ORACLE: dict[str, str] = {}
