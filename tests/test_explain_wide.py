"""Shapley values against background tables and for models of many features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from costwise.operators.explain import Background, ShapleyBatch, background_table, feature_orders, permutation_error, shapley_values
from costwise.plans.analyze import Models, analyze, score
from costwise.plans.pinned import PINNED_CLASSIFIER
from costwise.operators import forest as fst
from costwise.schema import FEATURES
from costwise.sources.events import transactions_from_events
from tests.conftest import SF001


def model(m, seed=1):
    w = np.random.default_rng(seed).normal(size=m)
    pair = np.random.default_rng(seed + 1).normal(size=(m, m)) / m

    def predict(X):
        eta = X @ w + np.einsum("ij,jk,ik->i", X, pair, X)
        return 1 / (1 + np.exp(-eta))

    return predict


def by_definition(predict, x, rows, shares):
    """phi_i = sum over S of |S|!(m-|S|-1)!/m! (v(S + i) - v(S)), v the mean prediction over the background."""
    m = len(x)

    def v(S):
        z = rows.copy()
        z[:, list(S)] = x[list(S)]
        return float(predict(z) @ shares)

    out = []
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (v((*S, i)) - v(S)) for k in range(m) for S in itertools.combinations(rest, k)))
    return np.array(out)


def test_background_by_definition():
    r = np.random.default_rng(4)
    rows, X, predict = r.normal(size=(7, 4)), r.normal(size=(5, 4)), model(4)
    shares = r.random(7)
    shares /= shares.sum()
    phi = ShapleyBatch(predict, 4, Background(rows, shares))(X)
    assert np.allclose(phi, [by_definition(predict, x, rows, shares) for x in X], atol=1e-12)
    assert np.allclose(phi.sum(axis=1), predict(X) - predict(rows) @ shares)


def test_background_blocks_change_nothing(monkeypatch):
    from costwise.operators import explain

    r = np.random.default_rng(5)
    run = ShapleyBatch(model(5), 5, Background(r.normal(size=(40, 5)), np.full(40, 1 / 40)))
    X = r.normal(size=(30, 5))
    whole = run(X)
    monkeypatch.setattr(explain, "_BLOCK_VALUES", 700)
    assert np.allclose(run(X), whole, atol=1e-14)


def test_background_table(spark):
    df = spark.createDataFrame([(1.0, 2, 3.0), (1.0, 2, 1.0), (0.5, 1, 4.0)], "a double, b int, w double")
    got = background_table(df, ("a", "b"), "w")
    assert got.rows.tolist() == [[0.5, 1.0], [1.0, 2.0]] and got.shares.tolist() == [0.5, 0.5]
    assert background_table(df, ("a", "b")).shares.tolist() == pytest.approx([1 / 3, 2 / 3])
    with pytest.raises(ValueError, match="more than 1 different"):
        background_table(df, ("a", "b"), limit=1)
    with pytest.raises(ValueError, match="empty"):
        background_table(df.limit(0), ("a", "b"))
    with pytest.raises(ValueError, match="finite"):
        background_table(df.withColumn("a", F.lit(float("nan"))), ("a", "b"))
    with pytest.raises(ValueError, match="finite"):
        background_table(df.withColumn("a", F.lit(None).cast("double")), ("a", "b"))
    with pytest.raises(ValueError, match="positive"):
        background_table(df.withColumn("w", F.lit(0.0)), ("a", "b"), "w")


def test_permutations_lie_within_the_bound_at_ten_features():
    m, pairs = 10, 200
    predict = model(m)
    X = np.random.default_rng(6).normal(size=(8, m))
    exact = ShapleyBatch(predict, m)(X)
    got = ShapleyBatch(predict, m, permutations=pairs, seed=3)(X, with_error=True)
    phi, se = got[:, :m], got[:, m:]
    worst = np.abs(phi - exact).max()
    assert worst < permutation_error(pairs, m)
    assert worst < 6 * se.max() and (np.abs(phi - exact) < 6 * se + 1e-12).mean() > 0.98
    assert np.allclose(phi.sum(axis=1), predict(X) - predict(np.zeros((1, m))), atol=1e-12)
    more = ShapleyBatch(predict, m, permutations=1600, seed=3)(X)
    assert np.abs(more - exact).max() < 0.7 * worst


def test_thirty_features_add_up(spark):
    m = 30
    names = [f"x{i}" for i in range(m)]
    predict = model(m)
    X = np.random.default_rng(7).normal(size=(50, m)) / 3
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id int, " + ", ".join(f"{n} double" for n in names))
    rows = np.random.default_rng(8).normal(size=(6, m)) / 3
    for background, base in ((None, predict(np.zeros((1, m)))[0]), (Background(rows, np.full(6, 1 / 6)), predict(rows).mean())):
        out = shapley_values(df, predict, names, background, permutations=16, with_error=True).toPandas().sort_values("id")
        assert np.allclose(out[[f"phi_{n}" for n in names]].to_numpy().sum(axis=1), predict(X) - base, atol=1e-9)
        assert (out[[f"se_{n}" for n in names]].to_numpy() > 0).all()


def test_settings_are_checked():
    with pytest.raises(ValueError, match="permutations"):
        ShapleyBatch(model(13), 13)
    with pytest.raises(ValueError, match="at least 1"):
        ShapleyBatch(model(13), 13, permutations=0)
    assert feature_orders(6, 3, 1) == feature_orders(6, 3, 1) != feature_orders(6, 3, 2)
    assert all(sorted(o) == list(range(6)) for o in feature_orders(6, 5, 1))


def test_analysis_against_a_background(spark):
    """``analyze`` explains against a table of rows: values add up to the distance from its mean prediction."""
    tx = transactions_from_events(spark.read.parquet(f"{SF001}/events.parquet")).cache()
    models = Models(PINNED_CLASSIFIER, fst.fit_forest(tx, n_trees=5, max_samples=32))
    background = background_table(tx.limit(25))
    df = score(tx, models, background=background)
    m = PINNED_CLASSIFIER
    mean = float((1 / (1 + np.exp(-(background.rows @ np.array(m.raw_coef) + m.raw_intercept)))) @ background.shares)
    gap = df.select(F.max(F.abs(sum(F.col(f"phi_{f}") for f in FEATURES) - (F.col("fraud_probability") - mean)))).first()[0]
    assert gap < 1e-12
    assert analyze(tx, models, background=background).count() == tx.count()
    with pytest.raises(ValueError, match="background"):
        score(tx, models, shapley="jvm", background=background)
