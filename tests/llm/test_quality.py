"""Held-out accuracy of the classifier."""

import random

import numpy as np

from lodestone.llm import quality


def corpus(n, seed):
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(400)]
    bad = [f"insult{i}" for i in range(8)]
    for _ in range(n):
        words = rng.choices(common, k=rng.randint(30, 200))
        grade = rng.choices((0, 1, 2), (1, 2, 6))[0]
        if grade == 0:
            for w in rng.sample(bad, 3):
                words[rng.randrange(len(words))] = w
        if grade == 1:
            words = rng.choice(([words[0]] * len(words), [f"{w.upper()}!!" for w in words], [f"{w}***" for w in words]))
        yield " ".join(words).encode(), grade


def test_held_out():
    train, test = list(corpus(1500, 1)), list(corpus(800, 2))
    model = quality.fit([quality.features(t) for t, _ in train], np.array([g for _, g in train]))
    tails = model.score([quality.features(t) for t, _ in test])
    grades = np.array([g for _, g in test])
    keep = tails[:, 1] >= quality.CUT
    assert keep[grades == 2].mean() > 0.97 and keep[grades < 2].mean() < 0.05
    assert (tails[:, 0] >= tails[:, 1]).all() and model.thresholds[0] <= model.thresholds[1]


def test_one_grade_is_nothing_to_fit():
    assert quality.fit([quality.features(b"a"), quality.features(b"b")], np.array([2, 2])) is None


def test_fit_is_deterministic():
    rows = list(corpus(300, 3))
    x, y = [quality.features(t) for t, _ in rows], np.array([g for _, g in rows])
    assert (quality.fit(x, y).weights == quality.fit(x, y).weights).all()


def plain_loss(s, y, t, weight):
    """The likelihood by the book, one document at a time."""
    import math

    total = 0.0
    for score, grade in zip(s, y):
        tail = lambda k: 1.0 if k == 0 else 0.0 if k == len(t) + 1 else 1 / (1 + math.exp(t[k - 1] - score))
        total -= weight[grade] * math.log(tail(grade) - tail(grade + 1))
    return total / len(y)


def test_likelihood_and_slopes():
    rng = np.random.default_rng(6)
    s, y, t, weight = rng.normal(0, 2, 30), rng.integers(0, 3, 30), np.array([-0.7, 0.9]), np.array([2.0, 1.5, 0.5])
    loss, by_s, by_t = quality.likelihood(s, y, t, weight)
    assert abs(loss - plain_loss(s, y, t, weight)) < 1e-12
    for i in range(30):
        step = np.eye(30)[i] * 1e-6
        assert abs((plain_loss(s + step, y, t, weight) - plain_loss(s - step, y, t, weight)) / 2e-6 - by_s[i]) < 1e-6
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert abs((plain_loss(s, y, t + step, weight) - plain_loss(s, y, t - step, weight)) / 2e-6 - by_t[k]) < 1e-6


def test_scores_are_the_plain_sums():
    train = list(corpus(300, 4))
    found = [quality.features(t) for t, _ in train]
    model = quality.fit(found, np.array([g for _, g in train]))
    tails = model.score(found[:20])
    for f, row in zip(found, tails):
        score = sum(float(model.weights[i]) for i in f)
        for p, threshold in zip(row, model.thresholds):
            assert abs(p - 1 / (1 + np.exp(threshold - score))) < 1e-9
        assert len(set(f.tolist())) == len(f)


def test_held_out_on_the_tables(spark, small):
    """Fitted on two thirds of the labelled documents of the driver's tables, judged on the rest."""
    from pyspark.sql import functions as F

    data = small.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(3)) == 0
    model = quality.train(docs, labels.where(~held))
    judged = quality.classify(docs.join(labels.where(held).select("doc_id").distinct(), "doc_id", "left_semi"), model).join(quality.graded(labels), "doc_id").select("grade", "selected").collect()
    kept = lambda g: np.mean([r.selected for r in judged if r.grade == g])
    assert len(judged) > 1000
    assert kept(2) > 0.98 and kept(0) < 0.25 and kept(1) < 0.2, (kept(0), kept(1), kept(2))


def test_repeated_ids_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(i % 5, f"word{i} word{i % 7} text") for i in range(400)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    seen, fit = [], quality.fit
    quality.fit = lambda found, grades: seen.append(len(found)) or fit(found, grades)
    try:
        quality.train(docs, labels, sample=50)
    finally:
        quality.fit = fit
    assert seen == [50]
