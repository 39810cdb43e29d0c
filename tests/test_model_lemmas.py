"""Focal-loss classifier (M13) against numpy, lemmas (X7) against Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import losses, model, similarity


def data(n=400, d=5, seed=2, noise=1.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    y = (x @ rng.standard_normal(d) + noise * rng.standard_normal(n) > 0.8).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y)], "embedding array<double>, topic_shift int").repartition(3)


def loss(w, x, y, ridge, alpha=(0.25, 0.75), gamma=2.0):
    m = np.where(y == 1, 1, -1) * (x @ w[:-1] + w[-1])
    log_p = -np.logaddexp(0, -m)
    return (-np.where(y == 1, alpha[1], alpha[0]) * (1 - np.exp(log_p)) ** gamma * log_p).mean() + ridge / 2 * (w[:-1] ** 2).sum()


def test_focal_fit_is_a_minimum(spark):
    x, y = data()
    w = np.array(model.fit_focal(frame(spark, x, y), ridge=1e-3))
    at = loss(w, x, y, 1e-3)
    assert at < loss(np.zeros(6), x, y, 1e-3)
    h = 1e-5
    slope = [(loss(w + h * e, x, y, 1e-3) - loss(w - h * e, x, y, 1e-3)) / (2 * h) for e in np.eye(6)]
    assert np.abs(slope).max() < 1e-8
    rng = np.random.default_rng(0)
    assert all(loss(w + 0.05 * rng.standard_normal(6), x, y, 1e-3) > at for _ in range(50))
    # the same from another layout, and the mean loss is that of M4
    assert np.allclose(model.fit_focal(frame(spark, x, y).repartition(7), ridge=1e-3), w, atol=1e-7)
    z = model.with_score(frame(spark, x, y).withColumnRenamed("topic_shift", "label"), w.tolist(), out="logit1").withColumn("logit0", F.lit(0.0))
    assert abs(losses.focal_loss(z).first()[0] - loss(w, x, y, 0)) < 1e-12


def test_focal_scores_rows_it_has_not_seen(spark):
    x, y = data(900, noise=0.1)
    w = model.fit_focal(frame(spark, x[:600], y[:600]))
    p = model.predict_focal(frame(spark, x[600:], y[600:]), w, keep=["topic_shift"])
    assert p.where("prediction = topic_shift").count() > 0.75 * 300


def test_focal_odd_rows(spark):
    x, y = data(100)
    odd = spark.createDataFrame([(None, 1), ([1.0, 2.0], 0), (x[0].tolist(), None)], "embedding array<double>, topic_shift int")
    clean = frame(spark, x, y)
    assert np.allclose(model.fit_focal(clean.unionByName(odd)), model.fit_focal(clean), atol=1e-8)
    assert model.fit_focal(clean.limit(0)) == [0.0]
    assert len(model.fit_focal(clean.where("topic_shift = 1"))) == 6  # one class: the constant grows until the rounds end


@pytest.mark.parametrize("limit", [0, 1000])
def test_lemmas(spark, limit):
    """Inside the row and by a join: the same; a word without a lemma stays, as do null and empty lists."""
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    lemmas = {f"w{k}": f"l{k % 4}" for k in range(0, 30, 3)}
    rows = [(0, t, [rnd.choice(words[:3]) if rnd.random() < 0.7 else rnd.choice(words) for _ in range(rnd.randint(0, 6))]) for t in range(60)]
    rows += [(1, 0, None), (1, 1, [])]
    df = spark.createDataFrame(rows, "conversation_id long, turn_id long, ws array<string>")
    table = spark.createDataFrame(list(lemmas.items()), "token string, lemma string")
    got = similarity.with_lemmas(df, "ws", table, "out", map_limit=limit).collect()
    assert {(r[0], r[1]): r["out"] for r in got} == {(c, t): None if w is None else [lemmas.get(x, x) for x in w] for c, t, w in rows}
    empty = similarity.with_lemmas(df, "ws", table.limit(0), "out", map_limit=limit).collect()
    assert {(r[0], r[1]): r["out"] for r in empty} == {(c, t): w for c, t, w in rows}
