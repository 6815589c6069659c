"""Pruned neighbours against a full scan."""

import numpy as np
import pytest

from lodestone.operators import pivots as P
from lodestone.operators import vectors as V


def plain(ids, vectors, query, k):
    cosine = vectors @ query / np.linalg.norm(vectors, axis=1) / np.linalg.norm(query)
    return [ids[i] for i in np.lexsort((ids, -np.round(cosine, 9)))[:k]]


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty clusters, one of them a third of all, with repeated vectors, a zero vector and a null."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 4
    which = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, 40, 3000))
    x = centres[which] + rng.normal(size=(3000, 16)) * 0.3
    x[2000:2010] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, [0.0] * 16), (9002, None)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)


def test_search_is_the_full_scan_and_skips(spark, clustered, tmp_path):
    x, rows = clustered
    index = P.PivotIndex.build(rows, str(tmp_path / "index"), pivots=32, block=64)
    assert index.size == 3000
    looked = []
    for q in (5, 10, 700, 2999):
        hits, n = index.search(x[q].tolist(), 12)
        assert [(r["rank"], r.vec_id) for r in hits.orderBy("rank").collect()] == list(enumerate(plain(np.arange(3000), x, x[q], 12), 1))
        looked.append(n)
    assert max(looked) < 2000 and min(looked) < 600  # of 3000; the large cluster holds a third
    hits, n = index.search([1.0] * 16, 5000)  # more than there are
    assert hits.count() == 3000 and n == 3000
    again = P.PivotIndex(spark, index.root)
    assert [r.vec_id for r in again.search(x[3].tolist(), 3)[0].orderBy("rank").collect()] == plain(np.arange(3000), x, x[3], 3)
    with pytest.raises(ValueError):
        index.search([0.0] * 16, 1)


@pytest.mark.parametrize(("k", "salt", "queries"), [(4, 64, 256), (60, 2, 7)])
def test_batch_is_the_full_scan(spark, clustered, tmp_path, monkeypatch, k, salt, queries):
    monkeypatch.setattr(P, "SALT", salt)
    monkeypatch.setattr(P, "QUERIES", queries)
    x, rows = clustered
    index = P.PivotIndex.build(rows, str(tmp_path / "index"), pivots=24, block=50)
    asked = rows.where("vec_id % 20 = 0 or vec_id > 9000").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in index.search_batch(asked, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: plain(np.arange(3000), x, x[q], k) for q in range(0, 3000, 20)}


def test_text_ids_few_vectors_and_none(spark, tmp_path):
    rows = spark.createDataFrame([(c, [float(i), 1.0]) for i, c in enumerate("abcde")], "vec_id string, embedding array<float>")
    found = P.knn_batch(rows, rows.selectExpr("vec_id as query_id", "embedding"), 9)
    assert found.count() == 25 and {r.vec_id for r in found.where("rank = 1 and query_id = vec_id").collect()} == set("abcde")
    nothing = P.knn_batch(rows.where("vec_id > 'z'"), rows.selectExpr("vec_id as query_id", "embedding"), 2)
    assert nothing.count() == 0 and nothing.columns == found.columns
    index = P.PivotIndex.build(rows, str(tmp_path / "i"), pivots=3)
    want = [r.vec_id for r in V.knn(rows, [1.0, 1.0], 5).collect()]
    assert [r.vec_id for r in index.search([1.0, 1.0], 5)[0].orderBy("rank").collect()] == want
