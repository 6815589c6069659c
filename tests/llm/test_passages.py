"""Shared passages against a set of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import passages as P


def plain(rows, width):
    docs = [(P.NULL_ID if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for k, _, w in docs:
        for s in range(len(w) - width + 1):
            g = tuple(w[s : s + width])
            least[g] = min(least.get(g, k), k)
    out = []
    for k, i, w in docs:
        gone = {j for s in range(len(w) - width + 1) if least[tuple(w[s : s + width])] < k for j in range(s, s + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


def made(rng, width, n=120):
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 6 * width))] for _ in range(20)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            x = rng.randint(0, len(b))
            words += b[x : rng.randint(x, len(b))] + ["x"] * rng.randint(0, 1) + ["r", "s"] * (rng.randint(0, 2 * width) if rng.random() < 0.1 else 0)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words) if rng.random() < 0.97 else None))
    return rows


def test_covers():
    for period, cover in P.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    for width in range(1, 120):
        p = P.period_of(width)
        assert width - p + 1 >= p


@pytest.mark.parametrize(("width", "anchors", "part"), [(50, 1 << 20, 1 << 19), (50, 30, 300), (27, 300, 1000), (14, 50, 200), (5, 1 << 20, 1 << 19), (1, 9, 50)])
def test_is_the_set_of_all_windows(spark, monkeypatch, width, anchors, part):
    monkeypatch.setattr(P, "ANCHORS", anchors)
    monkeypatch.setattr(P, "PART", part)
    rng = random.Random(width + anchors)
    rows = made(rng, width)
    odd = [(rng.choice([None, 7, -3, i]) if rng.random() < 0.2 else i, t) for i, t in rows]
    for given in (rows, odd):
        got = P.removal(spark.createDataFrame(given, "doc_id long, text string").repartition(5), width=width).collect()
        assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept, r.kept_sha256)) for r in got) == plain(given, width)


def test_a_hot_passage_goes_out_once_a_buffer():
    n = 4000
    batch = P.reduced(np.full(n, 9, np.uint64), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64))
    assert (batch.column("of").to_numpy() == P.ANCHOR).sum() == 1
    first, count, step = P.progressions(np.r_[True, np.zeros(999, bool), True, np.zeros(3, bool)], np.r_[np.arange(1000) * 7, 5, 6, 9, 12])
    assert [list(map(int, c)) for c in (first, count, step)] == [[0, 1000, 1002], [1000, 2, 2], [7, 1, 3]]


def test_awkward_and_empty(awkward, nothing):
    got = P.removal(awkward)
    assert got.count() == awkward.count() and P.removal(nothing).count() == 0
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept, r.kept_sha256)) for r in got.collect()) == plain([(r.doc_id, r.text) for r in awkward.collect()], P.WIDTH)
