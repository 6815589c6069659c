"""Table-driven cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import values as X
from lodestone.operators.chunking import LEAST, MOST, hard_split, pack, with_overlap


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def array_of(spark, column, rows):
    """A column over one array column s."""
    return [r.x for r in spark.createDataFrame([(r,) for r in rows], "s array<string>").select(column.alias("x")).collect()]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Über\r\nzwei\rZeilen", "über zwei zeilen"), ("\tone   two ", "one two"), ("well - known", "well-known"), ("multi- part", "multi-part"), ("over -night", "over-night"),
        ("((both))", "both"), ("[a; b]", "a; b"), ("x{y}", "x{y"), ("\n{Semi- Final};\n", "semi-final"), ("", ""), ("...", ""),
    ],
)
def test_normalize_text(spark, raw, expected):
    assert one(spark, T.normalize_text(F.col("t")), t=raw) == expected


@pytest.mark.parametrize(
    ("raw", "value", "reason"),
    [
        ('{"n": [1, {"m": null}]}', {"n": [1, {"m": None}]}, "json_ok"), ("[true]", [True], "json_array"), ("{'a': None, 'b': (1, 2)}", {"a": None, "b": (1, 2)}, "python_literal_dict"),
        ("['x',]", ["x"], "python_literal_array"), ('```\n{"q": 2}\n```', {"q": 2}, "json_ok"), ('It is {"z": "}"} I think', {"z": "}"}, "json_salvaged_obj"),
        ("list: [4, 5] done", [4, 5], "json_salvaged_array"), ("", None, "empty_output"), ("\t\n", None, "empty_output"), ("no braces here", None, "unparseable"), (None, None, "empty_output"), ("42", None, "unparseable"),
    ],
)
def test_parse_structured(raw, value, reason):
    assert X.parse_structured(raw) == (value, reason)


@pytest.mark.parametrize("raw", ["{a: 1}", "[7,]", "{'q': 1}", "words", '{"open": 1'])
def test_parse_structured_strict(raw):
    assert X.parse_structured(raw, True) == (None, "json_invalid")


@pytest.mark.parametrize(("term", "expected"), [("brown", True), ("BROWN fox", True), ("browm", True), ("  jumps ", True), ("jumpss", True), ("zebra", False), ("", False), (None, False)])
def test_fuzzy_match(spark, term, expected):
    df = spark.createDataFrame([(term, "The quick Brown fox jumps")], "a string, b string")
    assert df.select(T.fuzzy_match(F.col("a"), F.col("b")).alias("x")).first().x is expected


def test_partial_ratio_reaches_both_ends():
    assert T.partial_ratio("foo", "bar baz") < 80 and T.partial_ratio("abcd", "zzabcdzz") == 100 and T.partial_ratio("xab", "ab yyyyy") >= 80


def test_partial_ratio_prunes_nothing_that_counts():
    import random

    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(1, n))) for n in (8, 30))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        sides = [(short, long), (long, short)] if len(a) == len(b) else [(short, long)]
        windows = [(s, t[max(i, 0) : i + len(s)]) for s, t in sides for i in range(1 - len(s), len(t))]
        best = 100 if short in long else round(max(200.0 * T.indel_length(s, w) / (len(s) + len(w)) for s, w in windows))
        assert T.partial_ratio(a, b) == best
        for least in (50, 70, 80):
            assert (T.partial_ratio(a, b, least) >= least) == (best >= least)


def test_sentences_cut_after_every_mark(spark):
    rows = spark.createDataFrame([("Hello world! How are you? I'm fine.",), ("pi is 3.14... so",), (None,)], "t string").select(T.split_sentences(F.col("t")).alias("s")).collect()
    assert rows[0].s == ["Hello world!", "How are you?", "I'm fine."]
    assert rows[1].s == ["pi is 3.", "14.", ".", ".", "so"]
    assert rows[2].s is None


def test_many_short_sentences_fill_towards_the_middle(spark):
    """Twelve characters and a space each: 39 of them (506 characters) are nearer to 500 than 38 (493), the rest is long enough to stand alone."""
    (chunks,) = array_of(spark, pack(F.col("s")), [["Twelve chars"] * 75])
    assert [len(c) for c in chunks] == [39 * 13 - 1, 36 * 13 - 1]


def test_a_short_last_chunk_joins_the_one_before(spark):
    both, alone, none = array_of(spark, pack(F.col("s")), [["a" * 450, "b" * 140], ["a" * 560, "b" * 60], []])
    assert [len(c) for c in both] == [591] and [len(c) for c in alone] == [560, 60] and none == []


@pytest.mark.parametrize("seed", range(4))
def test_chunks_keep_words_and_bounds(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [["w" * rng.randint(1, 30) + " " + "x" * rng.randint(1, rng.choice([20, 300, 1500])) + "." for _ in range(40)] for _ in range(3)]
    for sentences, chunks in zip(rows, array_of(spark, pack(F.col("s")), rows)):
        assert all(len(c) <= MOST for c in chunks)
        assert "".join("".join(chunks).split()) == "".join("".join(sentences).split())
        assert all(len(c) >= LEAST for c in chunks[:-2]) or any(len(s) > MOST - LEAST for s in sentences)


@pytest.mark.parametrize(("sentence", "most", "parts"), [("one two three", 8, ["one two", "three"]), ("one two three", 7, ["one", "two", "three"]), ("abcdefghij", 4, ["abcd", "efgh", "ij"]), ("ab cdefghij k", 5, ["ab", "cdefg", "hij k"]), ("short", 9, ["short"]), ("", 3, [])])
def test_hard_split_cuts_at_spaces(spark, sentence, most, parts):
    """A part ends before a space that stands among its first characters, so seven characters and a space do not fit into seven."""
    assert spark.createDataFrame([(sentence,)], "t string").select(hard_split(F.col("t"), most).alias("x")).first().x == parts


def test_overlap_leads_with_the_tail_of_the_chunk_before(spark):
    chunks = ["One. " + "Two is longer than the rest of all of these here sentences, so that it reaches a hundred characters by itself.", "Three."]
    got = spark.createDataFrame([(chunks,)], "c array<string>").select(with_overlap(F.col("c")).alias("x")).first().x
    assert got[0] == chunks[0] and got[1].endswith(" Three.") and got[1].startswith("Two is longer")


def test_paging(spark):
    df = spark.createDataFrame([(1, 3), (1, 12), (6, 12), (11, 12)], "c int, t int")
    got = [r.x for r in df.select(F.array_join(X.pagination_strip(F.col("c"), F.col("t")), " ").alias("x")).collect()]
    assert got == ["1 2 3", "1 2 3 4 5 ... 12", "1 ... 5 6 7 ... 12", "1 ... 8 9 10 11 12"]
    assert X.over_fetch(3) == 50 and X.over_fetch(20) == 100
    with pytest.raises(ValueError):
        X.check_top_k(0)


def test_names_and_numbers(spark):
    assert one(spark, T.slugify(F.col("t")), t="My Paper (v2).final.pdf") == "my-paper-v2-final"
    assert one(spark, T.slugify(F.col("t")), t=".hidden") == "hidden"
    assert spark.range(1).select(T.base36(F.lit(16777215)).alias("x")).first().x == "9zldr"
    assert one(spark, T.extract_year(F.col("t")), t="May 2019, vol 12019") == 2019
    assert one(spark, T.key_phrase(F.col("t")), t="The quick brown fox. Jumps") == "The quick brown"
    assert one(spark, T.highlight(F.col("t"), ["t"]), t="été at t") == "é<strong>t</strong>é at <strong>t</strong>"  # ASCII edges
    assert T.keywords("What is a B-tree, really?") == ["what", "btree", "really"]


def test_content_normalisation(spark):
    assert one(spark, T.normalise_content(F.col("t")), t="eﬀec-\ntively [1, 2] see Figure 3") == "effectively  see"


@pytest.mark.parametrize(("score", "short", "two"), [(0.123456, "0.123", "0.12"), (1.0, "1", "1.00"), (12.5, "12.5", "12.50"), (123.4, "123", "123.40"), (1234.5, "1.23e+03", "1234.50"), (0.00001234, "1.23e-05", "0.00"), (0.0, "0", "0.00"), (-0.5, "-0.5", "-0.50"), (0.9999, "1", "1.00")])
def test_score_formats(spark, score, short, two):
    row = spark.range(1).select(T.score_short(F.lit(score)).alias("s"), T.score_fixed(F.lit(score), 2).alias("t")).first()
    assert (row.s, row.t) == (short, two) and row.s == f"{score:.3g}"
