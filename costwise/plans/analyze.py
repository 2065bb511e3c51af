"""Train, score, decide, explain (K3, K5, X3, F9–F11) over whole tables.

``analyze`` is one narrow stage: scan -> projections -> one Arrow batch
hop for the forest -> projections. No shuffle, no collect; duplicate ids
stay separate rows because nothing groups by the id.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import c_of, decision_label, percent_text, round_to, three_decimals
from ..operators import classifier as clf
from ..operators import forest as fst
from ..operators.decision import CostFn, CostParams, cheapest
from ..operators.explain import Background, ShapleyBatch, contributions, explanation, linear_predictor, phi_columns
from ..session import ship_package
from ..schema import FEATURES, LABEL, FOREST_CONTAMINATION, FOREST_MAX_SAMPLES, FOREST_SEED, FOREST_TREES, ID, RESPONSE_DECIMALS


@dataclass
class Models:
    classifier: clf.LinearModel
    forest: fst.Forest

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        """Both models as small Parquet tables below ``path``."""
        meta = {"classifier": json.loads(self.classifier.to_json()), **self.forest.settings()}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(mode).parquet(f"{path}/meta")
        self.forest.save(spark, f"{path}/forest", mode)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Models":
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        return Models(clf.LinearModel.from_json(json.dumps(meta["classifier"])), fst.Forest.load(spark, f"{path}/forest", meta))


def train(
    df: DataFrame,
    n_trees: int = FOREST_TREES,
    max_samples: int = FOREST_MAX_SAMPLES,
    contamination: float = FOREST_CONTAMINATION,
    seed: int = FOREST_SEED,
    C: float = 1.0,
    stage: str = "persist",
    row_key: tuple[str, ...] = (),
) -> Models:
    """Fit both models on the whole table (the service's start-up training).

    The training columns are read by both fits several times, so they are
    staged once: ``persist`` keeps them in executor memory (spilling to
    disk; lost blocks are recomputed from the source), ``checkpoint`` writes
    them below ``spark.checkpoint.dir`` and cuts the lineage, for long
    derivations on clusters where executors come and go. ``row_key``: see
    ``forest_sample``; repeated ids need none.
    """
    from pyspark.storagelevel import StorageLevel

    from ..session import ensure_checkpoint_dir

    cols = df.select(*dict.fromkeys((ID, *row_key, *FEATURES, LABEL)))
    if stage == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        data = cols.checkpoint(eager=True)
    elif stage == "persist":
        data = cols.persist(StorageLevel.MEMORY_AND_DISK)
    elif stage == "none":  # a pruned Parquet scan is cheaper to read again than to keep
        data = cols
    else:
        raise ValueError("stage must be 'persist', 'checkpoint' or 'none'")
    try:
        forest = fst.fit_forest(data, n_trees=n_trees, max_samples=max_samples, contamination=contamination, seed=seed, persist=False, row_key=row_key)
        classifier = clf.fit_logistic(data, C=C, persist=False)
    finally:
        if stage == "persist":
            data.unpersist()
    return Models(classifier, forest)


def batch_scores(models: Models, spark: SparkSession, with_shapley: bool = True, background: Background | None = None) -> Column:
    """One Arrow-batched hop per batch: mean forest path (and the Shapley values).

    Only the five feature columns travel to Python; both models are applied
    to the same numpy batch (forest nodes from a broadcast, the linear model
    as six numbers).
    """
    forest = models.forest
    bc = forest.broadcast(spark)
    ship_package(spark)
    explain_batch = ShapleyBatch(linear_predictor(models.classifier), len(models.classifier.features), background) if with_shapley else None
    names = list(models.classifier.features)
    fields = [T.StructField("mean_path", T.DoubleType())]
    if with_shapley:
        fields += [T.StructField(f"phi_{f}", T.DoubleType()) for f in names]
    schema = T.StructType(fields)

    @F.pandas_udf(schema)
    def run(*cols: pd.Series) -> pd.DataFrame:
        X = np.column_stack([c.to_numpy(dtype="float64") for c in cols])
        out = {"mean_path": bc.value.mean(X)}
        if explain_batch is not None:
            phi = explain_batch(X)
            out.update({f"phi_{f}": phi[:, i] for i, f in enumerate(names)})
        return pd.DataFrame(out)

    return run(*[F.col(f).cast("double") for f in names])


def score(df: DataFrame, models: Models, cost: CostFn = CostParams(), shapley: str = "arrow", background: Background | None = None) -> DataFrame:
    """Add fraud_probability, anomaly_score, decision and phi_<feature> (all unrounded).

    ``shapley="arrow"`` computes the Shapley values in the forest's Arrow batch;
    ``shapley="jvm"`` as column expressions (fast only when the session keeps
    huge generated methods out of whole-stage codegen, see ``session``).
    ``background``: explain against a table of rows instead of zeros (``arrow`` only).
    """
    if models.forest.offset is None:
        raise ValueError("forest has no offset; fit it with fit_forest")
    if tuple(models.forest.features) != tuple(models.classifier.features):
        raise ValueError("both models must use the same features")
    if shapley not in ("arrow", "jvm"):
        raise ValueError("shapley must be 'arrow' or 'jvm'")
    if background is not None and shapley != "arrow":
        raise ValueError("a background table needs shapley='arrow'")
    spark = df.sparkSession
    names = models.classifier.features
    df = df.withColumn("_b", batch_scores(models, spark, with_shapley=shapley == "arrow", background=background))
    c_psi = F.lit(c_of(models.forest.psi))
    phis = {f"phi_{f}": F.col(f"_b.phi_{f}") for f in names} if shapley == "arrow" else phi_columns(models.classifier)
    return (
        df.withColumns(
            {
                "fraud_probability": clf.logistic(models.classifier.logit()),
                "anomaly_score": -F.pow(F.lit(2.0), -F.col("_b.mean_path") / c_psi) - F.lit(models.forest.offset),
                **phis,
            }
        )
        .withColumn("decision", cheapest(F.col("fraud_probability"), cost))
        .drop("_b")
    )


def analyze(df: DataFrame, models: Models, cost: CostFn = CostParams(), keep: tuple[str, ...] = (), shapley: str = "arrow", background: Background | None = None) -> DataFrame:
    """The service's response record for every row of ``df``."""
    s = score(df, models, cost, shapley, background)
    return s.select(
        *keep,
        F.col(ID).cast("long").alias(ID),
        round_to(F.col("fraud_probability"), RESPONSE_DECIMALS).alias("fraud_probability"),
        round_to(F.col("anomaly_score"), RESPONSE_DECIMALS).alias("anomaly_score"),
        F.col("decision"),
        explanation().alias("explanation"),
        contributions().alias("feature_contributions"),
    )


def display(response: DataFrame) -> DataFrame:
    """The dashboard's three metrics for each response."""
    return response.select(
        ID,
        percent_text(F.col("fraud_probability")).alias("probability_text"),
        three_decimals(F.col("anomaly_score")).alias("anomaly_text"),
        decision_label(F.col("decision")).alias("decision_label"),
    )


def flatten_response(response: DataFrame, decimals: int = 6) -> DataFrame:
    """Response with the contribution map spread into phi_<feature> columns."""
    return response.select(
        ID,
        "fraud_probability",
        "anomaly_score",
        "decision",
        "explanation",
        *[round_to(F.element_at("feature_contributions", F.lit(f)), decimals).alias(f"phi_{f}") for f in FEATURES],
    )


def analyze_records(spark: SparkSession, records, models: Models, strict_domain: bool = False, cost: CostFn = CostParams()) -> tuple[DataFrame, DataFrame]:
    """K3 for request bodies given as Python mappings (the service's request/response
    shape): (responses for valid requests, rejected requests with reasons)."""
    from ..sources.readers import from_records
    from ..sources.validate import split_valid, validate

    ok, bad = split_valid(validate(from_records(spark, records), strict_domain=strict_domain))
    return analyze(ok, models, cost), bad


def analyze_table(df: DataFrame, models: Models, strict_domain: bool = False, cost: CostFn = CostParams()) -> tuple[DataFrame, DataFrame]:
    """K3 + K7 for a table of requests (text or typed fields): (responses, rejected
    rows with their reason). One bad row is one rejected row, never a failed job."""
    from ..sources.validate import split_valid, validate

    ok, bad = split_valid(validate(df, strict_domain=strict_domain))
    return analyze(ok, models, cost), bad
