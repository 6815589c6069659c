"""Embedders: batches, reasons, the offline model against a plain one; means of vectors."""

import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import embedding as E
from lodestone.operators import vectors as V


class Odd:
    """Fails on a batch that holds 'bad', has no vector for 'none', a wrong one for 'short', infinity for 'inf'."""

    def __call__(self, texts):
        if "bad" in texts:
            raise RuntimeError("bad text")
        return [None if t == "none" else np.ones(2) if t == "short" else np.full(3, np.inf) if t == "inf" else np.array([len(t), 1.0, 0.0]) for t in texts]


def test_reasons(spark):
    texts = ["ab", None, " \n", "bad", "none", "short", "inf", "abc", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    odd = E.BatchEmbedder(Odd, 3, batch_size=4)
    got = {r.id: r.x for r in rows.select("id", odd.outcome(F.col("text")).alias("x")).collect()}
    assert {i: x.reason for i, x in got.items()} == {0: None, 1: "no text", 2: "no text", 3: "RuntimeError: bad text", 4: "no vector", 5: "(2,) instead of 3 numbers", 6: "not finite", 7: None, 8: "no text"}
    assert {i: x.embedding for i, x in got.items() if x.embedding} == {0: [2.0, 1.0, 0.0], 7: [3.0, 1.0, 0.0]}
    indexed = {r.text_id: r for r in V.index_texts(rows, odd, "id", "text").collect()}
    assert indexed[3].embedding is None and indexed[3].reason.startswith("RuntimeError") and abs(indexed[0].embedding_unit[0] - 2 / math.sqrt(5)) < 1e-12
    assert rows.where("id > 99").select(odd(F.col("text")).alias("x")).collect() == []


def test_hashed_words_is_the_plain_count(spark, small):
    def plain(text, n):
        sums = [0] * n
        for w in re.findall("[0-9a-z]+", text.lower()):
            p = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (2 * n)
            sums[p // 2] += 1 - 2 * (p % 2)
        length = math.sqrt(sum(x * x for x in sums))
        return [x / length for x in sums] if length else None

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.v for r in docs.select("doc_id", E.hash_embed(F.col("text"), 16).alias("v")).collect()}
    for r in docs.collect():
        want = plain(r.text or "", 16)
        assert (want is None and got[r.doc_id] is None) or np.allclose(got[r.doc_id], want, atol=1e-12)


def test_means_are_one_buffer_a_group(spark):
    rows = spark.createDataFrame([(i % 3, [float(i), 1.0]) for i in range(30)] + [(0, None), (7, None)], "label int, embedding array<float>")
    means = V.centroids(rows)
    assert "Generate" not in means._jdf.queryExecution().toString()
    assert {r.label: r["mean"] for r in means.collect()} == {k: [k + 13.5, 1.0] for k in range(3)}
    assert V.centroid(rows.where("label > 9")) is None and V.centroid(rows.where("label = 1")) == [14.5, 1.0]


def test_a_text_whose_words_cancel_has_a_vector_if_asked_for():
    word = {}
    for i in range(200):  # two words of one place and opposite signs
        p = int(hashlib.md5(f"w{i}".encode()).hexdigest()[:8], 16) % 16
        if (other := word.get(p ^ 1)) is not None:
            break
        word[p] = f"w{i}"
    texts = [f"w{i} {other}", "...", f"w{i}"]
    plain, always = E.HashedWords(8)(texts), E.HashedWords(8, always=True)(texts)
    assert plain[0] is None and always[0] is not None and abs(np.linalg.norm(always[0]) - 1) < 1e-12 and always[0][p // 2] == 1
    assert plain[1] is None and always[1] is None and (plain[2] == always[2]).all()


def test_a_text_without_ascii_words_has_a_vector_if_asked_for():
    bare = E.HashedWords(8, always=True, bare=True)(["óí. éè óí.", "...", "óí a", " \n"])
    assert all(abs(np.linalg.norm(v) - 1) < 1e-12 for v in bare[:3]) and bare[3] is None
    assert (bare[2] == E.HashedWords(8)(["a"])[0]).all() and E.HashedWords(8, always=True)(["óí. éè óí."]) == [None]


def test_ingest_persist_of_odd_pages_is_its_sql(spark, tmp_path):
    """Chunks whose words have no ASCII letter or digit, or cancel, have a vector too."""
    import duckdb

    from lodestone.plans import structure

    cancelled = next(f"w{i} w{j}" for i in range(60) for j in range(i) if E.HashedWords(16)([f"w{i} w{j}"])[0] is None)
    odd = ["óí. " * 400, "éè " * 500, "!?" * 700, "漢字。" * 300, f"{cancelled}. " * 120, "plain words. " * 90, ""]
    rows = [(i, "http://a.org/b", f"<h1>{'Head' if i % 2 else ''}</h1><p>{x}</p><p>more {i}</p>") for i, x in enumerate(odd)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.sql(structure.ORACLE["ingest_persist"]).fetchall())
    assert want["vector"] > 20 and {r.relation: r.n for r in structure.ingest_persist(spark, str(tmp_path)).collect()} == want


def test_index_text_of_odd_texts_is_its_sql(spark, tmp_path):
    import duckdb

    from lodestone.plans import files, search

    cancelled = next(f"w{i} w{j}" for i in range(60) for j in range(i) if E.HashedWords(32)([f"w{i} w{j}"])[0] is None)
    eight = next(f"w{i} w{j}" for i in range(60) for j in range(i) if E.HashedWords(8)([f"w{i} w{j}"])[0] is None)
    rows = [(1, cancelled), (2, "..."), (3, "İstanbul"), (4, "a b"), (5, "a"), (6, eight), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    for module, name in ((search, "index_text"), (files, "failed_embeddings")):
        got = module.QUERIES[name](spark, str(tmp_path)).collect()
        assert key(got) == key(con.sql(module.ORACLE[name]).fetchall()), name
    assert sum(r.n == -1 for r in search.index_text(spark, str(tmp_path)).collect()) == 3


def test_search_by_text_breaks_ties_as_its_sql(spark, tmp_path):
    """Texts of the query's words in changing numbers are equally near up to the last bits."""
    import duckdb

    from lodestone.plans import search

    words, rng = search.QUERY_TEXT.split(), np.random.default_rng(2)
    base = sorted(set(rng.integers(1, 30, 40).tolist()))[:5]
    rows = [(i, " ".join(w for w, n in zip(words, rng.permutation(base)) for _ in range(int(n)))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r["rank"], r.vec_id, r.score, r.snippet) for r in search.search_by_text(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(search.ORACLE["search_by_text"]).fetchall())
