"""Properties over the test tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from costwise.operators import classifier as clf
from costwise.operators import decision as dec
from costwise.operators import explain as expl
from costwise.operators import forest as fst
from costwise.operators.quantile import exact_quantile
from costwise.plans.pinned import PINNED_CLASSIFIER
from costwise.schema import ACTIONS, FEATURES
from costwise.sources.events import transactions_from_events
from tests.conftest import SF001


@pytest.fixture(scope="module")
def tx(spark):
    return transactions_from_events(spark.read.parquet(f"{SF001}/events.parquet")).cache()


def test_view_shares(tx):
    r = tx.agg(F.count(F.lit(1)).alias("n"), F.avg("is_fraud").alias("f"), F.avg("location_change").alias("l"), F.avg("device_change").alias("d")).first()
    assert (r["n"], round(r["f"], 3), round(r["l"], 3), round(r["d"], 3)) == (1000, 0.263, 0.736, 0.493)


@pytest.mark.parametrize("ranges", [1, 3, 100])
def test_lag_independent_of_ranges(spark, tx, ranges):
    other = transactions_from_events(spark.read.parquet(f"{SF001}/events.parquet"), ranges=ranges)
    assert other.exceptAll(tx).count() == 0 and tx.exceptAll(other).count() == 0


def test_shapley_sums_to_difference(tx):
    m = PINNED_CLASSIFIER
    df = expl.shapley_linear(clf.predict_proba(tx, m), m)
    f0 = 1 / (1 + math.exp(-m.raw_intercept))
    total = sum(F.col(f"phi_{f}") for f in FEATURES)
    worst = df.select(F.max(F.abs(total - (F.col("fraud_probability") - f0))).alias("e")).first()["e"]
    assert worst < 1e-12
    zero_ok = df.filter((F.col("location_change") == 0) & (F.col("phi_location_change") != 0)).count()
    assert zero_ok == 0


def test_shapley_forms_agree(tx):
    m = PINNED_CLASSIFIER
    a = expl.shapley_linear(tx, m)
    b = expl.shapley_values(tx, expl.linear_predictor(m))
    j = a.alias("a").join(b.alias("b"), "transaction_id")
    diff = j.select(F.greatest(*[F.abs(F.col(f"a.phi_{f}") - F.col(f"b.phi_{f}")) for f in FEATURES]).alias("d")).agg(F.max("d")).first()[0]
    assert diff < 1e-12


def test_chosen_action_is_cheapest(tx):
    df = dec.choose_action(dec.action_costs(clf.predict_proba(tx, PINNED_CLASSIFIER)))
    least = F.least(*[F.col(f"cost_{a}") for a in ACTIONS])
    chosen = F.coalesce(*[F.when(F.col("decision") == a, F.col(f"cost_{a}")) for a in ACTIONS])
    assert df.filter(chosen != least).count() == 0


def test_action_options_long_form(tx):
    long = dec.action_options(clf.predict_proba(tx, PINNED_CLASSIFIER))
    assert long.count() == 3 * tx.count()
    best = long.groupBy("transaction_id").agg(F.min_by("action", F.struct("cost", "rank")).alias("a"))
    wide = dec.choose_action(clf.predict_proba(tx, PINNED_CLASSIFIER)).select("transaction_id", F.col("decision").alias("a"))
    assert best.exceptAll(wide).count() == 0


def test_duplicate_ids_stay_separate(tx):
    doubled = tx.unionByName(tx)
    out = expl.contributions_long(expl.shapley_linear(doubled, PINNED_CLASSIFIER))
    assert out.count() == 2 * 5 * tx.count()


def test_gradient_at_fit_sf001(tx):
    m = clf.fit_logistic(tx)
    g = clf.objective_gradient(tx, m).first()
    assert max(abs(v) for v in g) < 1e-4


def test_forest_independent_of_partitioning(spark, tx):
    a, psi = fst.forest_sample(tx, 10, 64)
    b, _ = fst.forest_sample(tx.repartition(7), 10, 64)
    assert a.exceptAll(b).count() == 0 and psi == 64
    na = fst.grow_forest(a, psi).toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    nb = fst.grow_forest(b, psi).toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    assert na.equals(nb)


def test_forest_flags_contamination_share(tx):
    forest = fst.fit_forest(tx, n_trees=50, max_samples=128)
    scored = fst.anomaly_score(tx, forest)
    share = scored.select(F.avg((F.col("anomaly_score") < 0).cast("double"))).first()[0]
    assert abs(share - 0.2) < 0.01
    assert forest.feature.shape == (50, 2 ** (fst.depth_limit(128) + 1))


def test_forest_small_table_branch(spark, tx):
    small = tx.limit(40)
    sample, psi = fst.forest_sample(small, 5, 256)
    assert psi == 40
    counts = {r["tree"]: r["count"] for r in sample.groupBy("tree").count().collect()}
    assert counts == {t: 40 for t in range(5)}


def test_path_lengths_match_scalar_walk(spark, tx):
    forest = fst.fit_forest(tx, n_trees=8, max_samples=32)
    X = np.array(tx.select(*FEATURES).limit(50).toPandas(), dtype="float64")
    got = fst.path_lengths(X, forest.feature, forest.threshold, forest.path, forest.max_depth)
    for r in range(len(X)):
        for t in range(8):
            k = 1
            while forest.feature[t, k] >= 0:
                k = 2 * k + int(X[r, forest.feature[t, k]] > forest.threshold[t, k])
            assert got[r, t] == forest.path[t, k]


@pytest.mark.parametrize("q", [0.0, 0.2, 0.5, 0.77, 1.0])
def test_exact_quantile_multi_pass(spark, q):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.integers(0, 5, 500).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = exact_quantile(df, "v", q, buckets=8, collect_limit=50)
    assert got == pytest.approx(float(np.percentile(vals, 100 * q)), abs=1e-12)


def test_exact_quantile_empty(spark):
    assert exact_quantile(spark.createDataFrame([], "v double"), "v", 0.2) is None


def test_forest_size_guard():
    assert fst.forest_bytes(100, 256) < 1_000_000
    with pytest.raises(ValueError, match="bytes per executor"):
        fst.check_forest_size(100_000, 1 << 16)


def test_exact_quantile_adjacent_doubles(spark):
    a, b = 1.0, float(np.nextafter(1.0, 2.0))
    vals = [a] * 1700 + [b] * 1300
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for q in (0.2, 0.5666, 0.9):
        assert exact_quantile(df, "v", q, buckets=8, collect_limit=10) == pytest.approx(float(np.percentile(vals, 100 * q)), abs=0)


def test_path_norm_column_matches_scalar(spark):
    from costwise.functions import c_of, path_norm

    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 10, 256, 1000)], "n int")
    got = [r[0] for r in df.select(path_norm(F.col("n").cast("double"))).collect()]
    assert got == pytest.approx([c_of(n) for n in (0, 1, 2, 3, 10, 256, 1000)], rel=1e-15)


@pytest.mark.parametrize("solver", ["newton", "lbfgs"])
def test_constant_feature(tx, solver):
    const = tx.withColumn("device_change", F.lit(0))
    m = clf.fit_logistic(const, solver=solver)
    assert m.scale[3] == 1.0 and m.mean[3] == 0.0
    assert abs(m.coef[3]) < 1e-12
    g = clf.objective_gradient(const, m).first()
    assert max(abs(v) for v in g) < (1e-6 if solver == "newton" else 1e-2)


def test_forest_never_splits_on_constant(tx):
    const = tx.withColumn("device_change", F.lit(0))
    forest = fst.fit_forest(const, n_trees=20, max_samples=64)
    assert not (forest.feature == 3).any()
    assert (forest.feature >= 0).any()


def test_round_keeps_sign_of_zero(spark):
    import math

    from costwise.functions import round_to

    vals = [-0.00004, 0.00004, -0.0, 0.0, -1.23456, 1.23455]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_to(F.col("x"), 4)).collect()]
    want = [round(v, 4) for v in vals]
    assert [math.copysign(1, g) for g in got] == [math.copysign(1, w) for w in want]
    assert got[:4] == want[:4] and got[4] == -1.2346


def test_mean_path_independent_of_tree_order():
    rng = np.random.default_rng(3)
    paths = rng.random((200, 100)) * 9
    shuffled = np.array([rng.permutation(r) for r in paths])
    assert np.array_equal(fst.mean_of_paths(paths), fst.mean_of_paths(shuffled))


def test_fits_refuse_missing_values(tx):
    broken = tx.withColumn("merchant_risk", F.when(F.col("transaction_id") == 7, F.lit(float("nan"))).otherwise(F.col("merchant_risk")))
    with pytest.raises(ValueError, match="finite values"):
        clf.fit_logistic(broken)
    with pytest.raises(ValueError, match="finite values"):
        fst.fit_forest(broken, n_trees=5, max_samples=32)


@pytest.mark.parametrize("n_trees, psi", [(10, 64), (30, 64)])
def test_hot_copies_sampled_in_proportion(spark, tx, n_trees, psi):
    """One row copied until it holds a third of the table gets about a third of the sample,
    with a row key that tells the copies apart."""
    hot = tx.filter(F.col("transaction_id") == 11)
    copies = hot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(499))))
    table = tx.withColumn("copy", F.lit(0)).unionByName(copies)  # 1,499 rows, 500 of them identical
    sample, got_psi = fst.forest_sample(table, n_trees, psi, row_key=("transaction_id", "copy"))
    share = sample.filter(F.col("transaction_id") == 11).count() / (n_trees * got_psi)
    assert 0.25 < share < 0.42, share


@pytest.mark.parametrize("equal", [True, False])
def test_hot_id_sampled_in_proportion_by_default(spark, tx, equal):
    """A third of the rows carry one id, as copies or with amounts of their own; no row key is named."""
    hot = tx.filter(F.col("transaction_id") == 11).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(499))))
    table = tx.unionByName((hot if equal else hot.withColumn("amount", F.col("amount") + F.col("copy"))).drop("copy"))
    sample, psi = fst.forest_sample(table, 10, 64)
    per_tree = {r["tree"]: r["n"] for r in sample.groupBy("tree").agg(F.sum((F.col("transaction_id") == 11).cast("int")).alias("n")).collect()}
    assert len(per_tree) == 10 and all(0 < n < 45 for n in per_tree.values()), per_tree
    assert 0.25 < sum(per_tree.values()) / (10 * psi) < 0.42
    again, _ = fst.forest_sample(table.repartition(7), 10, 64)
    if equal:  # copies are told apart by where they lie: as many of them, and the first in each tree are the same other rows
        assert 0.25 < again.filter("transaction_id = 11").count() / (10 * psi) < 0.42
    else:
        assert sample.exceptAll(again).count() == 0 and again.exceptAll(sample).count() == 0


def test_train_and_queries_sample_a_hot_id(spark, tmp_path):
    """The query's own path: a third of the events repeat one event id. ``train`` takes a row key too."""
    from costwise.plans.analyze import train
    from costwise.plans.queries import q_forest_sample, transactions

    events = spark.read.parquet(f"{SF001}/events.parquet")
    users = F.explode(F.sequence(F.lit(10_000), F.lit(10_498)).cast(f"array<{events.schema['user_id'].dataType.simpleString()}>"))
    hot = events.filter("event_id = 11").withColumn("user_id", users)
    events.unionByName(hot).write.parquet(f"{tmp_path}/events.parquet")
    share = q_forest_sample(spark, str(tmp_path)).select(F.avg((F.col("transaction_id") == 11).cast("double"))).first()[0]
    assert 0.25 < share < 0.42
    table = transactions(spark, str(tmp_path)).withColumn("row", F.monotonically_increasing_id()).cache()
    a, b = train(table, n_trees=5, max_samples=32), train(table, n_trees=5, max_samples=32, row_key=("row",))
    assert all((m.forest.feature[:, 1] >= 0).all() for m in (a, b))  # no tree holds copies of one row only


def test_shapley_blocks_bound_memory_at_twelve_features():
    from costwise.operators.explain import ShapleyBatch

    rng = np.random.default_rng(8)
    w = rng.normal(size=12)
    run = ShapleyBatch(lambda Z: np.tanh(Z @ w), 12)
    X = rng.normal(size=(300, 12))
    whole = run(X)
    assert np.allclose(whole.sum(axis=1), np.tanh(X @ w)) and np.array_equal(whole[:5], run(X[:5]))


def test_walk_blocks_change_nothing(tx):
    forest = fst.fit_forest(tx, n_trees=6, max_samples=64)
    X = np.array(tx.select(*FEATURES).limit(700).toPandas(), dtype="float64")
    whole = fst.path_lengths(X, forest.feature, forest.threshold, forest.path, forest.max_depth)
    parts = [fst.path_lengths(X[i : i + 1], forest.feature, forest.threshold, forest.path, forest.max_depth) for i in range(len(X))]
    assert np.array_equal(whole, np.concatenate(parts))


def test_quantile_skips_what_is_not_finite(spark):
    from costwise.operators.quantile import exact_quantile

    rows = [(float(i),) for i in range(1001)] + [(float("inf"),), (float("-inf"),), (float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "v double").cache()
    assert exact_quantile(df, "v", 0.25, collect_limit=10) == 250.0
    wide = spark.createDataFrame([(-1.7e308,), (1.7e308,), *[(float(i),) for i in range(100)]], "v double").cache()
    assert exact_quantile(wide, "v", 0.5, collect_limit=5) == 49.5


def test_class_weights_refuse_null_labels(spark, tx):
    with pytest.raises(Exception, match="label on every row"):
        clf.class_weights(tx.withColumn("is_fraud", F.when(F.col("transaction_id") != 3, F.col("is_fraud")))).collect()


def test_train_without_staging_equals_persist(tx):
    from costwise.plans.analyze import train

    a, b = train(tx, n_trees=5, max_samples=32), train(tx, n_trees=5, max_samples=32, stage="none")
    assert a.forest.offset == b.forest.offset and np.allclose(a.classifier.coef, b.classifier.coef)
