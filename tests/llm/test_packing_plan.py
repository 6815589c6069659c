"""The packing plan comes from column generation: never worse than largest-first, within GAP of a proven bound, in a few seconds."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import packing as P
from lodestone.llm.common import id_text, read
from lodestone.llm.token_cache import tokenizer_path

RNG = np.random.default_rng(1)
DRAWN = {
    "uniform": RNG.integers(1, 1024, 1_000_000),
    "log-normal": np.clip(RNG.lognormal(5.5, 1, 200_000).astype(int), 1, 1023),
    "long": RNG.integers(300, 1024, 50_000),
    "few lengths": RNG.choice([341, 342, 400, 623, 700, 1000], 10_000),
    "about a third": RNG.integers(260, 520, 3000),
    "one": np.array([5]),
    "full but one": np.full(7, 1023),
}


def histogram(name, spark, small):
    if name in DRAWN:
        return dict(zip(*(x.tolist() for x in np.unique(DRAWN[name], return_counts=True))))
    rows = P.cut(id_text(read(spark, small, "documents")), tokenizer_path("byte_bpe_50k.json")).where(F.col("length") < P.CAPACITY).groupBy("length").count().collect()
    return {r[0]: r[1] for r in rows}


@pytest.mark.parametrize("name", [*DRAWN, "documents"])
def test_plan(spark, small, name):
    h = histogram(name, spark, small)
    lengths = np.array(sorted(h), np.int64)
    demand = np.array([h[int(n)] for n in lengths], np.int64)
    greedy = P.sequences(P.fill(lengths, demand, P.CAPACITY))
    began = time.thread_time()
    patterns, x, bound = P.solve(lengths, demand.astype(float), P.CAPACITY, greedy)
    assert time.thread_time() - began < 20  # a few seconds on an idle machine
    assert ((lengths @ patterns)[x > 0] <= P.CAPACITY).all() and np.allclose(patterns @ x, demand)
    optimal = x.sum() > bound * (1 + P.GAP) + 1e-6  # then no pattern may gain anything
    if optimal:
        y = np.linalg.solve(patterns.T, np.ones(len(lengths)))
        assert P.Knapsack(np.maximum(y, 0), lengths, P.CAPACITY).best[P.CAPACITY] <= 1 + 1e-6
    rounded = P.sequences(P.rounded(lengths, demand, patterns, x, P.CAPACITY))
    planned = P.plan(h)
    assert x.sum() <= greedy + 1e-6 and rounded <= greedy and P.sequences(planned) == rounded  # largest-first is not what is returned
    used = {}
    for pattern, times in planned:
        for length, n in pattern:
            used[length] = used.get(length, 0) + n * times
    assert used == h


def test_column_generation_finds_what_largest_first_does_not():
    for name, fewer in (("few lengths", 100), ("about a third", 50), ("long", 5)):
        h = histogram(name, None, None)
        lengths = np.array(sorted(h), np.int64)
        demand = np.array([h[int(n)] for n in lengths], np.int64)
        assert P.sequences(P.plan(h)) <= P.sequences(P.fill(lengths, demand, P.CAPACITY)) - fewer


def test_knapsack_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(3, 40), 5, replace=False))
        values, capacity = rng.random(5), 60
        best = np.zeros(capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max([best[c - 1], *(best[c - n] + v for n, v in zip(lengths, values) if n <= c)])
        k = P.Knapsack(values, lengths, capacity)
        assert np.allclose(k.best, best)
        for p in k.with_each(5):
            assert p @ lengths <= capacity
        assert np.isclose(next(k.with_each(1)) @ values, best[capacity])


@pytest.mark.parametrize("broken", ["singular", "drifted"])
@pytest.mark.parametrize("after", [0, 1])
def test_a_basis_that_cannot_be_inverted_does_not_end_the_plan(monkeypatch, broken, after):
    drawn = np.clip(np.random.default_rng(2).normal(450, 90, 6000).astype(int), 200, 1023)
    h = dict(zip(*(x.tolist() for x in np.unique(drawn, return_counts=True))))
    real, calls = np.linalg.inv, []

    def inv(basis):
        calls.append(1)
        if len(calls) == after + 1:
            if broken == "singular":
                raise np.linalg.LinAlgError("Singular matrix")
            return real(basis) * 1.5
        return real(basis)

    monkeypatch.setattr(P.np.linalg, "inv", inv)
    planned, used = P.plan(h), {}
    for pattern, times in planned:
        for length, n in pattern:
            used[length] = used.get(length, 0) + n * times
    lengths, demand = np.array(sorted(h)), np.array([h[n] for n in sorted(h)])
    assert used == h and len(calls) > after and P.sequences(planned) <= P.sequences(P.fill(lengths, demand, P.CAPACITY))
