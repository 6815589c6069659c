"""What the methods promise beyond their results: verification, refinement, suffix arrays, splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, decontaminate, exact_dedup, repeats, simhash


@pytest.mark.parametrize(("setting", "size"), [("8m", 8 << 20), ("4194304", 4 << 20), ("4194304b", 4 << 20), ("1 gb", 1 << 30), ("64KB", 1 << 16)])
def test_byte_sizes(setting, size):
    assert common.byte_size(setting) == size


def test_arrow_setting_in_megabytes(spark, awkward):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "8m")
    try:
        assert exact_dedup.exact_dedup(awkward).count() == awkward.count()
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("hot_keys", "small"), [(1, 0), (3, 0), (1000, 0), (1000, 50_000)])
def test_join_split_is_a_join(spark, monkeypatch, how, hot_keys, small):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    monkeypatch.setattr(common, "SMALL_TABLE", small)
    many = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 20 + [3, 4, 5] * 2)], "k long, i long")
    one = spark.createDataFrame([(1, "a", 50), (2, "b", 20), (3, "c", 2), (9, "z", 1)], "k long, v string, size long")
    want = many.join(one, "k", how)
    assert sorted(map(str, common.join_split(many, one, "k", "size", how).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("short", [0, 1_000_000])
def test_listed_by_broadcast_or_shuffle(spark, monkeypatch, short):
    monkeypatch.setattr(common, "SHORT_LIST", short)
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d")], "doc_id long, listed_id string")
    ids = spark.createDataFrame([(2,), (None,)], "x long")
    assert [r.listed_id for r in common.listed(docs, "doc_id", ids, "left_anti").collect()] == ["a"]
    assert sorted(r.listed_id for r in common.listed(docs, "doc_id", ids, "left_semi").collect()) == ["b", "c", "d"]


def test_identifiers_are_verified(spark, awkward, monkeypatch):
    """Names that collide with the first seeds are seen by their contents, and made anew."""
    real, tried = exact_dedup.identifier, []
    want = sorted(map(str, exact_dedup.exact_dedup(awkward).collect()))

    def weak(chunk, seed=0):
        return bytes([real(chunk, seed)[-1] & 1]) * exact_dedup.ID_BYTES if seed < 2 else real(chunk, seed)

    recipes = exact_dedup.recipes
    monkeypatch.setattr(exact_dedup, "identifier", weak)
    monkeypatch.setattr(exact_dedup, "recipes", lambda *a: tried.append(a[-1]) or recipes(*a))
    assert exact_dedup.chunk_store(awkward).where("not verified").count() > 0
    assert sorted(map(str, exact_dedup.exact_dedup(awkward).collect())) == want
    assert tried == [0, 1, 2]


def test_weak_identifiers_in_the_chunk_store(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "identifier", lambda chunk, seed=0: b"same")
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    assert [r.verified for r in exact_dedup.chunk_store(docs).collect()] == [False]
    assert [r.verified for r in exact_dedup.chunk_store(docs.where("doc_id = 1")).collect()] == [True]


def test_chunk_store_holds_each_chunk_once(spark):
    import random

    rng = random.Random(1)
    base = ["".join(rng.choices("abcdefgh ", k=20_000)) for _ in range(3)]
    docs = spark.createDataFrame([(i, base[i % 3] + f" tail {i}" + base[(i + 1) % 3]) for i in range(30)], "doc_id long, text string").repartition(4)
    store = exact_dedup.chunk_store(docs)
    assert store.where("not verified").count() == 0
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    assert store.agg(F.sum(F.length("content"))).first()[0] < total / 5


def test_what_is_left_of_the_bits_is_filed_again(spark):
    """Pairs within the radius share a bucket at every level, and the pieces of the bits are whole."""
    rng = np.random.default_rng(5)
    x = [int(v) for v in rng.integers(0, 1 << 62, 40)]
    near = [v ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for v, (a, b, c) in zip(x, rng.integers(0, 63, (40, 3)))]
    df = spark.createDataFrame(list(enumerate(zip(x, near))), "id long, p struct<x: long, y: long>")
    for bits, widths in ((64, simhash.WIDTHS[0]), (39, simhash.WIDTHS[1]), (24, simhash.WIDTHS[2])):
        assert sum(widths) == bits
        cut = lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        rows = df.select(F.arrays_zip(simhash.filed(cut("p.x"), widths).alias("a"), simhash.filed(cut("p.y"), widths).alias("b")).alias("z"), cut("p.x").alias("x"), cut("p.y").alias("y")).collect()
        for r in rows:
            pairs = [tuple(v) for v in r.z]
            assert any(a["key"] == b["key"] for a, b in pairs)
            for a, b in pairs:
                assert bin(a["key"]).count("1") + bin(a["rest"]).count("1") == bin(r.x).count("1")
                if a["key"] == b["key"]:
                    assert bin(a["rest"] ^ b["rest"]).count("1") == bin(r.x ^ r.y).count("1")
    assert max(sum(sorted(w)[-3:]) for w in simhash.WIDTHS[-1:]) == 15


def test_suffix_classes():
    rng = np.random.default_rng(2)
    group, side = np.sort(rng.integers(0, 4, 60)), rng.integers(97, 99, (60, 11)).astype(np.uint8)
    classes, rank = repeats.suffix_classes(group, side)
    for d in range(12):
        for i in range(60):
            for j in range(60):
                assert (classes[d, rank[i]] == classes[d, rank[j]]) == (group[i] == group[j] and side[i, :d].tolist() == side[j, :d].tolist())


def test_every_string_has_its_trigger_at_the_same_place():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 100, 900, np.uint8).tobytes(), b"a" * 500, b"ab" * 300]
    texts.append(b"xyz" + texts[0][100:400])
    which, start, n, place, trigger, _ = repeats.parse(texts)
    found = {}
    for w, s, k, p, t in zip(which.tolist(), start.tolist(), n.tolist(), place.tolist(), trigger.tolist()):
        for i in range(k):
            x = texts[w][s + i : s + i + 100]
            assert len(x) == 100 and 0 <= p - i <= 100 - repeats.GRAM and found.setdefault(x, (p - i, t)) == (p - i, t)
    assert len(found) == len({t[i : i + 100] for t in texts for i in range(len(t) - 99)})


def test_long_items_are_taken_in_parts(spark, monkeypatch):
    words = [f"w{i}" for i in range(95)]
    bench = spark.createDataFrame([(1, " ".join(words)), (None, "a b c"), (None, "d e f")], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 12])) for i in range(80)] + [(90, "x a b c y"), (91, "d e f"), (92, "a b c d e f w0 " + " ".join(words))], "doc_id long, text string")
    want = sorted(map(str, decontaminate.judged(decontaminate.scan(docs, bench)).collect()))
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.judged(decontaminate.scan(docs, bench)).collect()}
    assert got[0] == (12, 1) and got[79] == (12, 1) and got[90] == (3, 1) and got[92] == (6 + 95, 2)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 25)
    assert sorted(map(str, decontaminate.judged(decontaminate.scan(docs, bench)).collect())) == want


@pytest.mark.parametrize("small", [0, 50_000])
def test_results_do_not_depend_on_how_tables_meet(spark, awkward, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_TABLE", small)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = awkward.unionByName(awkward.selectExpr("doc_id + 100 as doc_id", *[c for c in awkward.columns if c != "doc_id"]))
    found = [r.text_sha256 for r in exact_dedup.exact_dedup(rows).collect()]
    assert all(r.group_size == found.count(r.text_sha256) for r in exact_dedup.exact_dedup(rows).collect())
    assert {r.component_id for r in simhash.near_groups(rows).where("fp = 0").collect()} == {2}
    assert simhash.near_groups(rows).count() == rows.count()
