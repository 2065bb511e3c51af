"""Both models as ``pyspark.ml`` estimators (P2, P3, A1-A5, M1-M4), to compose
with other stages in a ``Pipeline`` and to be saved and loaded with it.

``fit`` and ``transform`` are the library's own jobs: the classifier's fit is
Newton's method over distributed sums and its model a column expression; the
forest's fit samples in one pass and its model is a broadcast of node arrays.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES, FOREST_CONTAMINATION, FOREST_MAX_SAMPLES, FOREST_SEED, FOREST_TREES, ID, LABEL
from . import classifier as clf
from . import forest as fst


class _Columns(Params):
    """Parameters that an estimator shares with its model; plain attributes of the Spark side's own naming."""

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def _with(self, given: dict):
        return self._set(**{k: v for k, v in given.items() if v is not None})


class _ClassifierColumns(_Columns):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns, in order", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label column", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "output: probability of class 1", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output: 1 where the probability exceeds one half, else 0", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "weight of the loss against the penalty", TypeConverters.toFloat)
    solver = Param(Params._dummy(), "solver", "newton or lbfgs", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCols=list(FEATURES), labelCol=LABEL, probabilityCol="fraud_probability", predictionCol="fraud_class", C=1.0, solver="newton")


class FraudClassifier(_ClassifierColumns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Standard scaling, balanced class weights and the penalised logistic regression as one estimator."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol=None, probabilityCol=None, predictionCol=None, C=None, solver=None):
        super().__init__()
        self._with(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "FraudClassifierModel":
        model = clf.fit_logistic(dataset, features=tuple(self.value("inputCols")), label=self.value("labelCol"), C=self.value("C"), solver=self.value("solver"))
        out = FraudClassifierModel()
        out._set(fitted=model.to_json())
        return self._copyValues(out)


class FraudClassifierModel(_ClassifierColumns, Model, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted classifier; its numbers (three per feature) are a parameter, so they are saved with it."""

    fitted = Param(Params._dummy(), "fitted", "the fitted model as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    @property
    def linear(self) -> clf.LinearModel:
        return clf.LinearModel.from_json(self.value("fitted"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = self.value("probabilityCol")
        return clf.predict_class(clf.predict_proba(dataset, self.linear, p), self.linear, self.value("predictionCol"), p)


class _ForestColumns(_Columns):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns, in order", TypeConverters.toListString)
    idCol = Param(Params._dummy(), "idCol", "row id, part of the sampling key", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "output: anomaly score, below 0 for anomalies", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output: -1 for anomalies, else 1", TypeConverters.toString)
    nTrees = Param(Params._dummy(), "nTrees", "trees", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "rows a tree", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of anomalies in the training table", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of all draws", TypeConverters.toInt)
    quantile = Param(Params._dummy(), "quantile", "exact or sketch", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCols=list(FEATURES), idCol=ID, scoreCol="anomaly_score", predictionCol="anomaly_label", nTrees=FOREST_TREES, maxSamples=FOREST_MAX_SAMPLES, contamination=FOREST_CONTAMINATION, seed=FOREST_SEED, quantile="exact")


class AnomalyForest(_ForestColumns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """The isolation forest as an estimator."""

    @keyword_only
    def __init__(self, *, inputCols=None, idCol=None, scoreCol=None, predictionCol=None, nTrees=None, maxSamples=None, contamination=None, seed=None, quantile=None):
        super().__init__()
        self._with(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "AnomalyForestModel":
        forest = fst.fit_forest(
            dataset,
            n_trees=self.value("nTrees"),
            max_samples=self.value("maxSamples"),
            contamination=self.value("contamination"),
            seed=self.value("seed"),
            features=tuple(self.value("inputCols")),
            id_col=self.value("idCol"),
            quantile=self.value("quantile"),
        )
        return self._copyValues(AnomalyForestModel(forest))


class AnomalyForestModel(_ForestColumns, Model, MLWritable, MLReadable):
    """The fitted forest; saved as metadata and a table of nodes."""

    def __init__(self, forest: fst.Forest | None = None):
        super().__init__()
        self.forest = forest

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = self.value("scoreCol")
        return fst.anomaly_score(dataset, self.forest, score).withColumn(self.value("predictionCol"), fst.anomaly_label(F.col(score)))

    def write(self) -> "_ForestWriter":
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> "_ForestReader":
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: AnomalyForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"forest": json.dumps(self.model.forest.settings())})
        self.model.forest.save(self.sparkSession, f"{path}/nodes")


class _ForestReader(MLReader):
    def load(self, path: str) -> AnomalyForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = AnomalyForestModel(fst.Forest.load(self.sparkSession, f"{path}/nodes", json.loads(metadata["forest"])))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
