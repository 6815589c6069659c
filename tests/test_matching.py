"""Fuzzy matches of all terms with all texts, against comparing all with all."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import best_window, indel_length, partial_ratio
from lodestone.operators import matching as M
from lodestone.operators.piece_index import PieceIndex, stretch_score
from lodestone.plans import catalogue


def plain(texts, terms, tolerance):
    """Every pair, one after the other."""
    out = {}
    for i, a in terms:
        for j, b in texts:
            a_, b_ = ((x or "").lower().strip(M.SPACE) for x in (a, b))
            if (s := partial_ratio(a_, b_, tolerance)) >= tolerance:
                out[i, j] = max(s, out.get((i, j), 0))
    return out


def matched(spark, texts, terms, tolerance):
    a, b = spark.createDataFrame(texts, "d int, text string"), spark.createDataFrame(terms, "t int, term string")
    rows = M.match_fuzzy(a, b, "d", "t", tolerance=tolerance).collect()
    assert len({(r.t, r.d) for r in rows}) == len(rows)
    return {(r.t, r.d): r.score for r in rows}


def damaged(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        if rng.random() < 0.5:
            s[i : i + 1] = []
        else:
            s.insert(i, rng.choice("abcdefgh é"))
    return "".join(s)


@pytest.fixture(scope="module")
def strings():
    """Texts and terms of all lengths, terms damaged inside texts and at both of their ends, ties, repeated ids, nulls."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefgh \U0001f600é", k=n))
    texts = [word(n) + "x" for n in (1, 2, 3, 7, 20, 60, 150, 300)]
    terms = [word(n) + "y" for n in (1, 2, 4, 9, 15, 40, 80)]
    for s in list(terms)[2:]:
        texts += [word(50) + damaged(rng, s, len(s) // 8) + word(30), damaged(rng, s, 2)[len(s) // 12 :] + word(40), word(40) + s[: len(s) - len(s) // 10], damaged(rng, s, 1), s.upper(), f" \n{s}\t"]
    texts = [(i % 40, x) for i, x in enumerate(texts)] + [(90, None), (91, ""), (92, " \t"), (93, "aaaaaaaaaaaaaaaaaaaaaaaa"), (93, "aaaaaaaaaaaaaaaaaaaaaaaa")]
    terms = list(enumerate(terms)) + [(90, None), (91, " "), (92, "aaaaaa"), (93, "aaaaab"), (0, "aabbaabbaabb")]
    return texts, terms


@pytest.mark.parametrize("tolerance", [51, 70, 80, 90, 100])
def test_is_all_with_all(spark, strings, tolerance):
    texts, terms = strings
    expected = plain(texts, terms, tolerance)
    assert expected and matched(spark, texts, terms, tolerance) == expected


def test_a_shuffled_index_finds_the_same(spark, strings, monkeypatch):
    monkeypatch.setattr(M, "SMALL_INDEX", 0)
    monkeypatch.setattr(M, "STRETCH", 7)
    texts, terms = strings
    assert matched(spark, texts, terms, 80) == plain(texts, terms, 80)


@pytest.mark.parametrize("tolerance", [51, 95])
def test_small_texts_are_sent_to_the_terms(spark, strings, monkeypatch, tolerance):
    """The smaller side goes to every task, whichever it is; both small and both large find the same."""
    texts, terms = strings
    many = terms + [(200 + i, "zyxw" * 40 + str(i)) for i in range(60)]
    monkeypatch.setattr(M, "_small", lambda rows, key, text: key == "d")
    monkeypatch.setattr(M, "AT_ONCE", 100)
    assert matched(spark, texts, many, tolerance) == plain(texts, many, tolerance)


def test_texts_do_not_become_rows(spark, strings):
    """With few terms no text is shuffled, copied or cut into rows: one pass over the texts does it."""
    texts, terms = strings
    a, b = spark.createDataFrame(texts, "d int, text string"), spark.createDataFrame(terms, "t int, term string")
    plan = M.match_fuzzy(a, b, "d", "t", tolerance=95)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("tolerance", [51, 80, 95, 100])
def test_pieces_are_alike_in_both_ways(spark, tolerance):
    lengths = list(range(1, 420, 3))
    index = PieceIndex(["".join(chr(97 + (i * i + n) % 26) for i in range(n)) for n in lengths], tolerance)
    rows = M.pieces(spark.createDataFrame([(i, s) for i, s in enumerate(index.strings)], "t int, short string"), "t", tolerance).select("t", "q", "edits", "least").distinct().collect()
    assert {r.t: (r.q, r.edits, r.least) for r in rows} == dict(enumerate(zip(index.q.tolist(), index.edits.tolist(), index.least.tolist())))


def test_windows_that_are_passed_over_are_no_better():
    rng = random.Random(3)
    for _ in range(400):
        short, text = ("".join(rng.choices("abc", k=rng.randrange(1, n))) for n in (12, 40))
        starts, least = range(rng.randrange(-14, 10), rng.randrange(0, 45)), rng.choice([0, 50, 80])
        windows = [(i, text[max(i, 0) : i + len(short)]) for i in starts if 1 - len(short) <= i < len(text)]
        best = max((200 * indel_length(short, w) / (len(short) + len(w)) for i, w in windows), default=0.0)
        got = best_window(short, text, starts, least)
        assert got == best or got <= best < least
        assert stretch_score(short, text, starts.start, starts.stop, least) in ({round(best)} if best >= least else {0, round(got)})


@pytest.mark.parametrize("seed", range(12))
def test_a_task_finds_what_every_window_says(seed, monkeypatch):
    """Strings of few letters, damaged up to a little more than the tolerance allows, whole and cut off, against each window of each pair."""
    rng = random.Random(seed)
    letters, tolerance = "abcdefgh é😀"[: (2, 4, 11)[seed % 3]], (60, 80, 90, 95)[seed % 4]
    monkeypatch.setattr("lodestone.operators.piece_index.STEP", (5, 1 << 18)[seed % 2])
    monkeypatch.setattr(M, "AT_ONCE", (10, 400)[seed // 2 % 2])
    word = lambda most: "".join(rng.choices(letters, k=rng.randrange(1, most))).strip() or "a"
    terms, texts = [word(n) for n in (8, 40, 90)], [word(60)]
    for s in terms:
        d = damaged(rng, s, rng.randrange(2 + len(s) * (201 - 2 * tolerance) // 100)) or "b"
        texts += [word(30) + d + word(30), d[len(d) // 8 :] + word(30), word(30) + d[: len(d) - len(d) // 8]]
    terms, texts = ([(i, x.strip()) for i, x in enumerate(xs) if x.strip()] for xs in (terms, texts))

    def like(a, b):
        windows = lambda s, t: (t[max(i, 0) : i + len(s)] for i in range(1 - len(s), len(t)))
        ways = [(s, t) for s, t in ((a, b), (b, a)) if len(s) <= len(t)]
        return round(max(200 * indel_length(s, w) / (len(s) + len(w)) for s, t in ways for w in windows(s, t)))

    few, many = (pa.record_batch([pa.array([i for i, _ in xs], pa.int32()), pa.array([x for _, x in xs])], ["id", "text"]) for xs in (terms, texts))
    got = {}
    for b in M._near(pa.Table.from_batches([few]), tolerance, [many.slice(0, 4), many.slice(4)]):
        got |= {(r["few"], r["many"]): max(r["score"], got.get((r["few"], r["many"]), 0)) for r in b.to_pylist()}
    assert got == {(i, j): n for i, a in terms for j, b in texts if (n := like(a, b)) >= tolerance}


def test_many_meetings_in_one_text(spark, monkeypatch):
    """A text of one letter meets every piece everywhere; runs are looked at a few at a time."""
    monkeypatch.setattr("lodestone.operators.piece_index.STEP", 7)
    texts, terms = [(1, "a" * 300), (2, "b" + "ab" * 150), (3, "a" * 40)], [(1, "a" * 60), (2, "ab" * 30 + "c"), (3, "b" * 20)]
    few = pa.table({"t": pa.array([i for i, _ in terms], pa.int32()), "term": [x for _, x in terms]})
    for tolerance in (80, 95):
        got = {}
        for b in M._near(few, tolerance, [pa.record_batch([pa.array([i for i, _ in texts], pa.int32()), pa.array([x for _, x in texts])], ["d", "text"])]):
            got.update({(r["few"], r["many"]): max(r["score"], got.get((r["few"], r["many"]), 0)) for r in b.to_pylist()})
        assert got == plain(texts, terms, tolerance)


def test_nothing_to_match(spark, strings):
    texts, terms = strings
    assert matched(spark, [], terms, 80) == {} and matched(spark, texts, [], 80) == {} and matched(spark, [(1, None)], [(1, "")], 80) == {}
    with pytest.raises(ValueError):
        matched(spark, texts, terms, 50)


def test_hidden_windows_are_not_compared(spark):
    """Of a long text only the stretch that holds enough pieces of the term is compared."""
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnop", k=20000))
    a = spark.createDataFrame([(1, text)], "d int, long string")
    b = spark.createDataFrame([(1, text[9000:9050] + "zz" + text[9050:9100])], "t int, short string")
    plan = M._windows(b, a, "t", "d", 90)
    assert max(r.score for r in plan.collect()) == 98 and plan.count() < 5
    index = M.pieces(b, "t", 90).first()
    assert (index.q, index.edits, index.least) == (4, 21, 4)


def test_registered_query(spark, small, tmp_path):
    """The registered query over a small table of short documents and items, one item damaged, against all with all."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 600").select("doc_id", "text")
    items = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").orderBy("item_id").limit(8)
    first, last = (r.text for r in (items.first(), items.tail(1)[0]))
    more = [(-1, f"Before. {first[:40]}{first[42:]} After."), (-2, last[5:].upper()), (-3, last), (-4, None)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    texts, terms = ([tuple(r) for r in spark.read.parquet(f"{tmp_path}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    got = {(r.item_id, r.doc_id): r.score for r in catalogue.QUERIES["fuzzy_terms"](spark, str(tmp_path)).collect()}
    assert len(got) >= 3 and got == plain(texts, terms, 95)
