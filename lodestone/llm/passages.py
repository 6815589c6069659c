"""Removal of passages that a document shares with an earlier one, by difference-cover anchors.

A window is WIDTH words (runs of ``[^\\x20\\x09-\\x0D]``, unchanged) in a row.  Every word is removed
that is covered by a window whose words also start in a document with a smaller id; windows never
cross documents and are those of the input.

Anchors: words are hashed only at places whose number modulo PERIOD lies in a difference cover, GRAM
words from each.  For any two places some shift below PERIOD brings both onto the cover, so equal
windows share an aligned anchor: GRAM is WIDTH - PERIOD + 1.  Anchors are reduced to the first
document of each task's buffer, then meet by hash; one that has an earlier document is linked to the
first such place, and all that have company are marked.

Extension, in three steps.  Links of a document to the same text at the same distance, no further
apart than GRAM words, make a run: its words are equal throughout, as GRAM is at least PERIOD, so
windows inside it are repeats.  The windows around marked anchors that no run explains (at a
passage's ends, between edits, or whose first place continues otherwise) are digested whole (128 bits
of BLAKE2b) and meet by digest; those with an earlier document are repeats too.  A window that a run
explains need not be sent: the smallest document that has it always sends it.

A link rests on 64 bits of a rolling hash, but a run that matters has at least two that agree in
text and distance; single false links only cost digests.  What repeats inside a task's buffer is
settled there, and of a hash only the first document goes out, so a hot key sends a row for each
buffer (ANCHORS anchors), not for each copy.  Sort and walk of each group are streamed.

Null text has no words; a text of fewer than WIDTH words loses nothing.  Texts of any length are read
in parts of PART bytes.  A null id is larger than all others; rows that repeat an id are documents of
that id, and none of them is smaller.  An empty table gives an empty result.  Columns besides id and
text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, id_text, join_split, materialise, read, slices, small_batches
from .repeats import _BYTE, merged, mixed, powers

WIDTH = 50
#: Perfect difference sets, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 6, 15, 22, 26, 45, 55)}
PART = 1 << 19
#: Anchors, or windows, that a task holds before it sends what is left of them.
ANCHORS = 1 << 20
NULL_ID = (1 << 63) - 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

# Rows of the first exchange.  end: ANCHOR (at has company in its task if end2), or link to word end2 of document end.
LINKS = "unit long, doc long, up long, at long, of long, of_at long"
ANCHOR, COMPANY = -1, -2
# Rows of the second: by its digest a window at start, again every so many words (end: see times), or words start..end to be removed.
WINDOWS = "unit long, k1 long, doc long, up long, start long, end long"


def period_of(width: int) -> int:
    """The largest period whose anchors are at least as long as it."""
    return max(p for p in COVERS if width - p + 1 >= p)


def parts(text: bytes, width: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words): parts share width-1 words, so each window lies in just one."""
    at, first, tail = 0, 0, []
    while at < len(text):
        cut = _SPACE.search(text, at + PART)
        end = cut.start() if cut else len(text)
        words = tail + text[at:end].split()
        yield first, words
        tail = words[max(len(words) - width + 1, 0) :]
        first, at = first + len(words) - len(tail), end


def hashes(buffer: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = powers(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(buffer, np.uint8)] * power[:-1], out=total[1:])
    return mixed((total[end] - total[start]) * inverse[start])


def word_places(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words that one space follows each."""
    end = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    return np.r_[0, end[:-1] + 1] if len(end) else end, end


def anchors(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, word number and hash of every anchor of texts with a window."""
    period = period_of(width)
    gram, on_cover = width - period + 1, np.isin(np.arange(period), COVERS[period])
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, int]] = []
    raw: list[bytes] = []
    size = 0

    def settle() -> None:
        buffer = b" ".join([*raw, b""])
        start, end = word_places(buffer)
        owner, first, n = (np.array(c) for c in zip(*held))
        part = np.repeat(np.arange(len(n)), n)
        local = np.arange(len(part)) - (np.cumsum(n) - n)[part]
        number = first[part] + local
        at = np.flatnonzero(on_cover[number % period] & (local + gram <= n[part]))
        found.append((owner[part[at]], number[at], hashes(buffer, start[at], end[at + gram - 1])))

    for i, text in enumerate(texts):
        for first, words in parts(text, width):
            if len(words) < width:
                continue
            raw.append(b" ".join(words))
            held.append((i, first, len(words)))
            size += len(raw[-1])
            if size >= PART:
                settle()
                held, raw, size = [], [], 0
    if held:
        settle()
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def rows_of(schema: str, cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cols], names=[x.split()[0] for x in schema.split(", ")])


def spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(doc.view(np.uint64) * np.uint64(31) + at.view(np.uint64))


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]


def reduced(hash_: np.ndarray, doc: np.ndarray, up: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Anchors of one buffer: links to an earlier document of it, and one anchor of each hash that goes out."""
    order = np.lexsort((at, doc, hash_))
    hash_, doc, up, at = (c[order] for c in (hash_, doc, up, at))
    new = np.r_[True, hash_[1:] != hash_[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = doc[first] < doc - up
    size = np.diff(np.r_[np.flatnonzero(new), len(new)])
    alone = new & (np.repeat(size, size) == 1)
    of = np.where(later, doc[first], np.where(new, ANCHOR, COMPANY))
    of_at = np.where(later, at[first], np.where(new & ~alone, 1, 0))
    return rows_of(LINKS, [np.where(new, hash_, spread(doc, at)), doc, up, at, of, of_at])


def local_links(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for whole in batches:
            for b in slices(whole, PART):
                which, at, hash_ = anchors(_texts(b), width)
                doc, up = (b.column(c).to_numpy()[which] for c in ("doc", "up"))
                held.append([hash_, doc, up, at])
                size += len(at)
                if size >= ANCHORS:
                    yield reduced(*(np.concatenate(c) for c in zip(*held)))
                    held, size = [], 0
        if size:
            yield reduced(*(np.concatenate(c) for c in zip(*held)))

    return docs.mapInArrow(run, LINKS)


MARKS = "doc long, at long, of long, of_at long"


def links(local: DataFrame) -> DataFrame:
    """Anchors with company: linked to the first place of an earlier document, or only marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, first_doc, first_at, waits = None, 0, 0, None  # of the last hash; waits: its only row so far
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in ("unit", "doc", "up", "at", "of", "of_at")]
            settled = cols[4] != ANCHOR
            out = [[c[settled] for c in (cols[1], cols[3], cols[4], cols[5])]]
            u, doc, up, at, _, company = (c[~settled] for c in cols)
            if len(u):
                same = np.r_[unit is not None and unit == u[0], u[1:] == u[:-1]]
                if waits is not None and same[0]:
                    out.append(waits)
                place = np.maximum.accumulate(np.where(same, -1, np.arange(len(u))))
                of = np.where(place < 0, first_doc, doc[place])
                of_at = np.where(place < 0, first_at, at[place])
                linked = same & (of < doc - up)
                several = same | np.r_[same[1:], False] | (company == 1)
                kind = np.where(linked, of, COMPANY)
                out.append([doc[several], at[several], kind[several], np.where(linked, of_at, 0)[several]])
                waits = None if several[-1] else [c[-1:] for c in (doc, at, np.array([COMPANY]), np.array([0]))]
                unit, first_doc, first_at = int(u[-1]), int(of[-1]), int(of_at[-1])
            yield rows_of(MARKS, [np.concatenate(c) for c in zip(*out)])

    return local.repartition("unit").sortWithinPartitions("unit", "doc", "at").mapInArrow(run, MARKS)


def runs(at: np.ndarray, of: np.ndarray, of_at: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that runs of links explain, those of a window or more."""
    keep = of >= 0
    at, of, away = at[keep], of[keep], at[keep] - of_at[keep]
    if not len(at):
        return at, at
    order = np.lexsort((at, away, of))
    at, of, away = at[order], of[order], away[order]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (away[1:] != away[:-1]) | (at[1:] - at[:-1] > gram)])
    end = at[np.r_[new[1:], len(at)] - 1] + gram
    long = end - at[new] >= width
    return at[new][long], end[long]


def times(n: np.ndarray, step: np.ndarray) -> np.ndarray:
    """How often and how far apart, in one negative number."""
    return -((step << 32) | n)


def progressions(new: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of groups (new: their first rows) as arithmetic progressions of at: first row, count, step of each."""
    gap = np.diff(at, prepend=at[:1])
    second = np.r_[False, new[:-1]]  # a group's second row sets the step
    cut = new | (np.r_[True, gap[1:] != gap[:-1]] & ~second)
    first = np.flatnonzero(cut)
    n = np.diff(np.r_[first, len(at)])
    return first, n, np.where(n > 1, gap[np.minimum(first + 1, len(at) - 1)], 0)


def joined(doc: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as spans: those of a document that touch are one."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + width)]) if len(doc) else order
    return doc[new], start[new], start[np.r_[new[1:], len(doc)] - 1] + width if len(doc) else start


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in start..end of any."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(start, 0, n), 1)
    np.add.at(edge, np.clip(end, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def extended(docs: DataFrame, marked: DataFrame, width: int) -> DataFrame:
    """Words that runs explain, and the windows that need to meet by digest."""
    period = period_of(width)
    gram = width - period + 1
    wanted = marked.groupBy("doc").agg(F.collect_list(F.struct("at", "of", "of_at")).alias("wanted"))

    def settle(held: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
        """Of the windows held, those with an earlier document are repeats; of the others go out those of the first document, a row for as many as are evenly spaced."""
        key = np.frombuffer(b"".join([h[0] for h in held]), np.int64).reshape(-1, 2)
        doc, up, at = (np.array(c, np.int64) for c in list(zip(*held))[1:])
        order = np.lexsort((at, doc, key[:, 1], key[:, 0]))
        key, doc, up, at = key[order], doc[order], up[order], at[order]
        new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = doc[first] < doc - up
        d, s, e = joined(doc[later], at[later], width)
        found = [spread(d, s).view(np.int64), s, d, np.zeros_like(d), s, e]
        key, doc, up, at, new = (c[~later] for c in (key, doc, up, at, new))
        new |= np.r_[True, doc[1:] != doc[:-1]] if len(doc) else new
        i, n, step = progressions(new, at)
        sent = [key[i, 0], key[i, 1], doc[i], up[i], at[i], times(n, step)]
        return rows_of(WINDOWS, [np.concatenate(c) for c in zip(found, sent)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, held = hashlib.blake2b, []
        for whole in batches:
            for b in slices(whole, PART):
                marks, ends = b.column("wanted").flatten(), np.cumsum(pc.list_value_length(b.column("wanted")).to_numpy(zero_copy_only=False))
                at, of, of_at = (marks.field(c).to_numpy(zero_copy_only=False) for c in ("at", "of", "of_at"))
                i = 0
                for doc, up, text, j in zip(b.column("doc").to_pylist(), b.column("up").to_pylist(), _texts(b), ends.tolist()):
                    own = slice(i, j)
                    i = j
                    start, end = runs(at[own], of[own], of_at[own], gram, width)
                    if len(start):
                        yield rows_of(WINDOWS, [spread(np.full(len(start), doc), start), start, np.full(len(start), doc), np.full(len(start), up), start, end])
                    for first, words in parts(text, width):
                        n = len(words) - width + 1
                        if n <= 0:
                            continue
                        need = covered(n, at[own] - (width - gram) - first, at[own] - first + 1) & ~covered(n, start - first, end - width + 1 - first)
                        where = np.flatnonzero(need)
                        if not len(where):
                            continue
                        buffer = b" ".join([*words, b""])
                        w_start, w_end = word_places(buffer)
                        held += [(digest(buffer[a:z], digest_size=16).digest(), doc, up, s) for a, z, s in zip(w_start[where].tolist(), w_end[where + width - 1].tolist(), (where + first).tolist())]
                        if len(held) >= ANCHORS // 8:
                            yield settle(held)
                            held = []
        if held:
            yield settle(held)

    return docs.join(wanted, "doc").select("doc", "up", "text", "wanted").mapInArrow(run, WINDOWS)


SPANS = "doc long, start long, end long"


def repeated(windows: DataFrame, width: int) -> DataFrame:
    """Words to be removed: those that runs explain, and windows whose digest an earlier document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_doc = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            u, k1, doc, up, start, end = (b.column(k).to_numpy() for k in ("unit", "k1", "doc", "up", "start", "end"))
            done = end >= 0
            out = [[doc[done], start[done], end[done]]]
            u, k1, doc, up, start = (c[~done] for c in (u, k1, doc, up, start))
            if len(u):
                same = np.r_[last == (u[0], k1[0]), (u[1:] == u[:-1]) & (k1[1:] == k1[:-1])]
                place = np.maximum.accumulate(np.where(same, -1, np.arange(len(u))))
                of = np.where(place < 0, first_doc, doc[place])
                hit = same & (of < doc - up)
                n, step = -end[~done][hit] & 0xFFFFFFFF, -end[~done][hit] >> 32
                i = np.repeat(np.flatnonzero(hit), n)
                at = start[i] + (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(step, n)
                out.append(list(joined(doc[i], at, width)))
                last, first_doc = (u[-1], k1[-1]), int(of[-1])
            yield rows_of(SPANS, [np.concatenate(c) for c in zip(*out)])

    return windows.repartition("unit").sortWithinPartitions("unit", "k1", "doc", "start").mapInArrow(run, SPANS)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """docs as (doc, up, doc_id, text): doc unique and ordered as ids, up how far the id's first row is; whether doc is doc_id itself."""
    rows = id_text(docs, id_col, text_col)
    if not rows.groupBy("doc_id").count().where("count > 1 or doc_id is null or doc_id < 0").limit(1).count():
        return rows.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("up"), "text"), True
    placed = rows.withColumns({"id": F.coalesce("doc_id", F.lit(NULL_ID)), "at": F.monotonically_increasing_id()})
    order = placed.repartitionByRange("id", "at").sortWithinPartitions("id", "at").drop("at")
    table = materialise(order.withColumn("doc", F.monotonically_increasing_id()), "ordered")
    firsts = materialise(table.groupBy("id").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "firsts")
    return materialise(join_split(table, firsts, "id", "n").select("doc", (F.col("doc") - F.col("least")).alias("up"), "doc_id", "text"), "keyed"), False


CUT = "doc long, n_words long, n_removed long, kept string, kept_sha256 string"


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, texts: bool = True) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept (what is left, words joined by one space; null unless texts), kept_sha256."""
    small_batches(docs.sparkSession)
    rows, plain = keyed(docs, id_col, text_col)
    whole = rows.select("doc", "up", "text")  # the same plan in both joins, so the texts are shuffled once
    marked = materialise(links(local_links(whole, width)), "links")
    spans = repeated(extended(whole, marked, width), width)
    gone = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, spans in zip(b.column("doc").to_pylist(), _texts(b), b.column("gone").to_pylist()):
            gaps = merged([(s["start"], s["end"]) for s in spans or []])
            sha, kept, n = hashlib.sha256(), [], 0
            for first, words in parts(text, 1):
                n = first + len(words)
                at = 0
                left: list[bytes] = []
                for s, e in gaps:
                    if e > first and s < n:
                        left += words[at : max(s - first, 0)]
                        at = min(e - first, len(words))
                left += words[at:]
                if left:
                    kept.append(b" ".join(left))
                    sha.update((b" " if len(kept) > 1 else b"") + kept[-1])
                    if not texts:
                        kept[-1] = b""
            out.append((doc, n, sum(e - s for s, e in gaps), b" ".join(kept).decode(errors="replace") if texts else None, sha.hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 3 + [pa.string()] * 2)], names=["doc", "n_words", "n_removed", "kept", "kept_sha256"])

    done = arrow_map(whole.join(gone, "doc", "left").select("doc", "text", "gone"), run, CUT)
    if plain:
        return done.withColumnRenamed("doc", "doc_id")
    return done.join(rows.select("doc", "doc_id"), "doc").select("doc_id", "n_words", "n_removed", "kept", "kept_sha256")


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(read(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = f"""
    WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    b AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM a),
    c AS (SELECT doc_id, i, x, md5(string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)) AS h,
        count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS n FROM b),
    d AS (SELECT *, n = {WIDTH} AND min(CASE WHEN n = {WIDTH} THEN doc_id END) OVER (PARTITION BY h) < doc_id AS again FROM c),
    e AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM d),
    f AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN f USING (doc_id)"""
QUERIES = {"op11_passages": op11_passages}
ORACLE = {"op11_passages": ORACLE_SQL}
