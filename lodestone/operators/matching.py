"""Which terms stand in which texts, as they are or nearly, without comparing all with all."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.scratch import written
from .piece_index import PieceIndex, stretch_score

#: So many short beginnings are sought one by one.
FEW = 64
#: Strings are broadcast where their pieces take up to so many bytes, measured.
SMALL_INDEX = 32 << 20
#: So many characters of texts are looked through at once.
AT_ONCE = 1 << 20
#: Where both sides are larger, texts' grams that are alike meet in so many tasks.
SALT = 16
#: Runs of characters are cut out of stretches of so many.
STRETCH = 256
#: White space that is taken off both ends.
SPACE = " \t\n\r\x0b\x0c"


def runs(chars: Column, n: int) -> Column:
    """The distinct runs of n characters of an array of characters."""
    out = chars
    for k in range(1, n):
        out = F.zip_with(out, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(out, lambda x: x.isNotNull()))


def match_terms(texts: DataFrame, terms: DataFrame, text_id: str, term_id: str, text_col: str = "text", term_col: str = "term") -> DataFrame:
    """term id and text id where the trimmed, lower-cased, non-empty term is in the lower-cased text.

    A word that has a space on both sides in a term has them in any text that holds it: the longest such
    word of a term is looked up among the texts' words by an equi-join.  A term without such a word, a short
    one, is looked up by its first three characters (or all it has) among the texts' runs of as many; up to FEW
    such beginnings are looked for in each text instead.  Only what a look-up finds is searched for the whole
    term, so no texts and terms are paired otherwise."""
    t = terms.select(term_id, F.lower(F.trim(F.coalesce(term_col, F.lit("")))).alias("wanted")).where("wanted <> ''")
    pieces = F.split("wanted", " ")
    inner = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: w != "")
    t = t.select(term_id, "wanted", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    n = F.when(F.col("word").isNull(), F.least(F.length("wanted"), F.lit(3))).otherwise(0)
    t = t.select(term_id, "wanted", n.alias("n"), F.coalesce("word", F.substring("wanted", 1, 3)).alias("key"))
    lowered = texts.select(text_id, F.lower(text_col).alias("lowered"))
    keys = F.array_distinct(F.split("lowered", " "))
    words = lowered.select(text_id, F.lit(0).alias("n"), F.explode(keys).alias("key"))
    short = t.where("n > 0").select("n", "key").distinct()
    few = short.limit(FEW + 1).collect()
    if 0 < len(few) <= FEW:  # each is looked for in each text
        there = F.filter(F.array(*(F.struct(F.lit(r.n).alias("n"), F.lit(r.key).alias("key")) for r in few)), lambda k: F.contains("lowered", k["key"]))
        words = words.unionByName(lowered.select(text_id, F.explode(there).alias("k")).select(text_id, "k.n", "k.key"))
    elif few:
        for size in (1, 2, 3):
            words = words.unionByName(lowered.select(text_id, F.lit(size).alias("n"), F.explode(runs(F.split("lowered", ""), size)).alias("key")))
    candidates = words.join(t.select(term_id, "n", "key"), ["n", "key"]).select(text_id, term_id)
    found = lowered.join(candidates, text_id).join(t.select(term_id, "wanted"), term_id).where(F.contains("lowered", F.col("wanted")))
    return found.select(term_id, text_id)


def _cleaned(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key and the lower-cased text without white space at its ends, named name; empty ones go."""
    return rows.select(F.col(key), F.btrim(F.lower(F.col(text)), F.lit(SPACE)).alias(name)).where(F.col(name) != "")


def pieces(short: DataFrame, key: str, tolerance: int) -> DataFrame:
    """key, q, gram, place, edits and least: each string cut into pieces of q characters.

    A window that reaches the tolerance is at most ``edits`` insertions and deletions from the string, each of which
    harms one piece: at least ``least`` pieces stand in it unharmed.  q is the greatest, up to 8, that leaves an eighth of the pieces."""
    m = F.length("short")
    edits = F.floor(m * F.lit(201 - 2 * tolerance) / 100)  # twice the length, less the tolerance, which half a point under rounds to
    n = lambda q: F.floor(m / q)
    q = F.coalesce(*(F.when(n(q) - edits >= F.greatest(F.lit(1), F.floor(n(q) / 8)), q) for q in range(8, 1, -1)), F.lit(1))
    sized = short.select(key, "short", q.alias("q"), edits.cast("int").alias("edits"))
    sized = sized.withColumn("n", F.floor(m / F.col("q")).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("short"), i * F.col("q") + 1, F.col("q")))
    return sized.select(key, "q", "edits", (F.col("n") - F.col("edits")).alias("least"), F.posexplode(cut).alias("place", "gram"))


def grams(long: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """key, q, at and gram: every run of q characters, for each size, by way of overlapping stretches of bounded length."""
    out = None
    for q in sizes:
        stretches = F.regexp_extract_all("long", F.lit(f"(?s)(?=(.{{1,{STRETCH + q - 1}}})).{{1,{STRETCH}}}"), F.lit(1))
        rows = long.select(key, F.posexplode(stretches).alias("stretch", "part")).where(F.length("part") >= q)
        rows = rows.select(key, "stretch", "part", F.explode(F.sequence(F.lit(0), F.length("part") - q)).alias("i"))
        rows = rows.select(key, F.lit(q).alias("q"), (F.col("stretch") * STRETCH + F.col("i")).alias("at"), F.substring("part", F.col("i") + 1, F.lit(q)).alias("gram"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _windows(short: DataFrame, long: DataFrame, short_id: str, long_id: str, tolerance: int) -> DataFrame:
    """short_id, long_id and score of each stretch of a text where a string no longer than it may stand; what is under the tolerance may be lower than it is."""
    index = pieces(short, short_id, tolerance)
    sizes = [r.q for r in index.select("q").distinct().orderBy("q").collect()]  # at most eight
    if not sizes:
        return short.join(long, F.lit(False)).select(short_id, long_id, F.lit(0).alias("score"))
    salted = grams(long, long_id, sizes).withColumn("salt", F.pmod(F.hash(long_id, F.floor(F.col("at") / 1024)), F.lit(SALT)))
    hits = salted.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["q", "gram", "salt"])
    # The unharmed pieces' shifts against the text differ by at most edits: two bands of twice that, half overlapping, hold them.
    step = F.col("edits") + 1
    band = F.floor((F.col("at") - F.col("place") * F.col("q")) / step).cast("int")
    hits = hits.select(short_id, long_id, "place", "edits", "least", F.explode(F.array(band - 1, band)).alias("band"))
    bands = hits.groupBy(short_id, long_id, "band", "edits", "least").agg(F.count_distinct("place").alias("n")).where("n >= least")
    bands = written(bands, "bands")  # few against the texts; the joins below know their size
    pairs = bands.join(short, short_id).join(long, long_id).where("length(short) <= length(long)")
    # A window starts at most edits before or after its band; where one may start with the text, so may those cut off by its start.
    low, high = F.col("band") * step - F.col("edits"), (F.col("band") + 2) * step + F.col("edits")
    base = F.greatest(low, F.lit(0))
    part = F.substring(F.col("long"), base + 1, high - base + F.length("short"))
    whole = pairs.select(short_id, long_id, "short", part.alias("part"), F.when((low <= 0) & (high > 0), 1 - F.length("short")).otherwise(low - base).alias("low"), (high - base).alias("high")).where("high > 0")

    @F.pandas_udf("int")
    def score(short: pd.Series, part: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([stretch_score(s, t, a, b, tolerance - 0.5) for s, t, a, b in zip(short, part, low, high)], dtype="int32")

    return whole.select(short_id, long_id, score("short", "part", "low", "high").alias("score"))


def _small(rows: DataFrame, key: str, text: str) -> bool:
    """Whether the strings' pieces, at eight characters each with their key, take no more than SMALL_INDEX bytes."""
    each = F.octet_length(text) + F.ceil(F.length(text) / 8) * (F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 64)
    return (rows.agg(F.sum(each)).first()[0] or 0) <= SMALL_INDEX


def _near(few: pa.Table, tolerance: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id of few, id and score of what is alike in batches of id and string: few's strings stand in those that are as long, and those that are as short in few's.

    Equal strings are compared once; strings are gathered up to AT_ONCE characters, the short ones apart, so that each way round is done for many of them."""
    ids, own = few.column(0).combine_chunks(), {}
    for i, s in enumerate(few.column(1).to_pylist()):
        own.setdefault(s, []).append(i)
    strings = list(own)
    if not strings:
        return
    index, longest = PieceIndex(strings, tolerance), max(map(len, strings))

    def said(texts: dict[str, list], found: Iterator[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        names, best = list(texts), {}
        for s, t, score in found:
            best[s, t] = max(score, best.get((s, t), 0))
        rows = [(i, j, score) for (s, t), score in best.items() for i in own[strings[s]] for j in texts[names[t]]]
        if rows:
            mine, theirs, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine)), pa.array(theirs, kind), pa.array(scores, pa.int32())], names=["few", "many", "score"])

    def inside(texts: dict[str, list]) -> Iterator[pa.RecordBatch]:
        yield from said(texts, ((s, t, score) for t, s, score in index.scores(list(texts))))

    def around(texts: dict[str, list]) -> Iterator[pa.RecordBatch]:
        yield from said(texts, PieceIndex(list(texts), tolerance).scores(strings))

    gathered, brief, sizes, kind = {}, {}, [0, 0], None
    for batch in batches:
        kind = batch.column(0).type
        for i, s in zip(batch.column(0), batch.column(1)):
            i, s = i.as_py(), s.as_py()
            for n, (group, wanted) in enumerate(((gathered, True), (brief, len(s) <= longest))):
                if wanted:
                    if s not in group:
                        sizes[n] += len(s)
                    group.setdefault(s, []).append(i)
            if sizes[0] >= AT_ONCE:
                yield from inside(gathered)
                gathered, sizes[0] = {}, 0
            if sizes[1] >= AT_ONCE:
                yield from around(brief)
                brief, sizes[1] = {}, 0
    if gathered:
        yield from inside(gathered)
    if brief:
        yield from around(brief)


def _met(many: DataFrame, few: DataFrame, tolerance: int) -> DataFrame:
    """many's id, few's id and score, by a pass over many with few (id and string each) in every task."""
    sent = few.sparkSession.sparkContext.broadcast(few.toArrow())
    fields = [StructField("few", few.schema[0].dataType), StructField("many", many.schema[0].dataType), StructField("score", IntegerType())]
    return many.mapInArrow(lambda batches: _near(sent.value, tolerance, batches), StructType(fields)).select(F.col("many").alias(many.columns[0]), F.col("few").alias(few.columns[0]), "score")


def match_fuzzy(texts: DataFrame, terms: DataFrame, text_id: str, term_id: str, text_col: str = "text", term_col: str = "term", tolerance: int = 80) -> DataFrame:
    """term id, text id and score (0 to 100) where the shorter of term and text is like a window of the longer by at least tolerance.

    Exactly the pairs, and scores, that comparing all with all gives: likeness is twice the longest common subsequence over both
    lengths, letters lower-cased.  The shorter string's pieces meet the longer one's runs of characters; where too few different
    pieces stand within a band of shifts, no window there can reach the tolerance.  What is left is compared by bits, a stretch of
    text at a time.  If one side's strings are small they are sent to every task, and one pass over the other side does it all
    without a shuffle of texts; else pieces and runs meet in an equi-join.  The lower the tolerance, the shorter the pieces and
    the more there is to compare; it must be over 50.  Null and empty strings match nothing; of several rows with one id the best counts."""
    if not 50 < tolerance <= 100:
        raise ValueError("tolerance must be over 50 and at most 100")
    t, x = _cleaned(terms, term_id, term_col, "term"), _cleaned(texts, text_id, text_col, "text")
    for few, many, key, text in ((t, x, term_id, "term"), (x, t, text_id, "text")):
        if _small(few, key, text):
            out = _met(many, few, tolerance).select(term_id, text_id, "score")
            return out.groupBy(term_id, text_id).agg(F.max("score").alias("score"))
    longest = t.agg(F.max(F.length("term"))).first()[0] or 0
    out = _windows(t.withColumnRenamed("term", "short"), x.withColumnRenamed("text", "long"), term_id, text_id, tolerance)
    brief = x.where(F.length("text") <= longest).withColumnRenamed("text", "short")
    out = out.unionByName(_windows(brief, t.withColumnRenamed("term", "long"), text_id, term_id, tolerance))
    return out.groupBy(term_id, text_id).agg(F.max("score").alias("score")).where(F.col("score") >= tolerance)  # after the fold, so that no stretch is compared twice
