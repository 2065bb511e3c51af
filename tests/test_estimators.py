"""The models as pyspark.ml stages: fit, save, load, transform."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from costwise.operators import classifier as clf
from costwise.operators import forest as fst
from costwise.operators.estimators import AnomalyForest, AnomalyForestModel, FraudClassifier, FraudClassifierModel
from costwise.operators.quantile import exact_quantile, sketch_quantile, sketch_rank_error
from costwise.session import scratch_path
from costwise.sources.events import transactions_from_events
from tests.conftest import SF001


@pytest.fixture(scope="module")
def tx(spark):
    return transactions_from_events(spark.read.parquet(f"{SF001}/events.parquet")).cache()


def test_pipeline_with_other_stages(spark, tx):
    """A Spark stage, both models and a Spark stage after them; saved, loaded, applied."""
    stages = [
        SQLTransformer(statement="SELECT *, amount AS value FROM __THIS__"),
        FraudClassifier(inputCols=["value", "merchant_risk"], probabilityCol="p", predictionCol="flag"),
        AnomalyForest(nTrees=5, maxSamples=32, contamination=0.1, scoreCol="strange"),
        SQLTransformer(statement="SELECT transaction_id, p, flag, strange, anomaly_label FROM __THIS__"),
    ]
    path = scratch_path(spark, "test-pipeline")
    model = Pipeline(stages=stages).fit(tx)
    model.save(path)
    loaded = PipelineModel.load(path)
    a, b = model.transform(tx), loaded.transform(tx)
    assert a.columns == ["transaction_id", "p", "flag", "strange", "anomaly_label"]
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    linear = clf.fit_logistic(tx.withColumnRenamed("amount", "value"), features=("value", "merchant_risk"))
    assert np.allclose(loaded.stages[1].linear.coef, linear.coef) and loaded.stages[1].uid == model.stages[1].uid
    forest = fst.fit_forest(tx, 5, 32, 0.1)
    assert loaded.stages[2].forest.offset == forest.offset and (loaded.stages[2].forest.feature == forest.feature).all()
    assert b.filter((F.col("flag") == 1) != (F.col("p") > 0.5)).count() == 0
    assert b.filter((F.col("anomaly_label") == -1) != (F.col("strange") < 0)).count() == 0


def test_unfitted_pipeline_and_stages_persist(spark, tx):
    path = scratch_path(spark, "test-stages")
    Pipeline(stages=[FraudClassifier(C=0.5, solver="lbfgs"), AnomalyForest(seed=7, quantile="sketch")]).save(f"{path}/p")
    one, two = Pipeline.load(f"{path}/p").getStages()
    assert (one.value("C"), one.value("solver"), two.value("seed"), two.value("quantile")) == (0.5, "lbfgs", 7, "sketch")
    fitted = FraudClassifier().fit(tx)
    fitted.write().overwrite().save(f"{path}/c")
    assert FraudClassifierModel.load(f"{path}/c").linear == fitted.linear
    trees = AnomalyForest(nTrees=3, maxSamples=16).fit(tx)
    trees.save(f"{path}/f")
    again = AnomalyForestModel.load(f"{path}/f")
    assert again.forest.settings() == trees.forest.settings() and again.value("nTrees") == 3
    with pytest.raises(Exception):
        trees.save(f"{path}/f")  # no overwriting by accident
    trees.write().overwrite().save(f"{path}/f")


def test_params_map_and_copy(tx):
    est = FraudClassifier()
    model = est.fit(tx, {est.probabilityCol: "chance"})
    assert "chance" in model.transform(tx).columns and est.value("probabilityCol") == "fraud_probability"
    assert "other" in model.transform(tx, {model.probabilityCol: "other"}).columns


def test_fit_and_statistics_share_one_implementation(tx):
    """The fit's scaler and weights are those of ``scaler_stats`` and ``class_weights``, bit for bit."""
    one = tx.coalesce(1)
    n, mean, scale, weights, _ = clf._training_stats(one, clf.FEATURES, clf.LABEL, ())
    st = clf.scaler_stats(one).first()
    assert mean == tuple(st[f"mean_{f}"] for f in clf.FEATURES) and scale == tuple(st[f"scale_{f}"] for f in clf.FEATURES)
    assert {r.is_fraud: r.weight for r in clf.class_weights(one).collect()} == weights


@pytest.mark.parametrize("q", [0.0, 0.01, 0.2, 0.5, 0.99, 1.0])
def test_sketch_rank_error(spark, q):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=60_000), np.full(5_000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(20)
    for k in (64, 1024):
        got = sketch_quantile(df, "v", q, k)
        below, upto = (vals < got).mean(), (vals <= got).mean()
        assert got in vals and max(0.0, below - q, q - upto) <= sketch_rank_error(k)


def test_sketch_skips_what_is_not_finite(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(float("nan"),), (float("inf"),), (None,)], "v double")
    assert sketch_quantile(df, "v", 0.5) == exact_quantile(df, "v", 0.5) == 50.0
    assert sketch_quantile(df.filter("v IS NULL"), "v", 0.5) is None
    with pytest.raises(ValueError):
        sketch_quantile(df, "v", 1.5)
