"""Schemas, the ordered feature list and the fixed values of the decision model.

Everything that names a column or a constant lives here once, so the
scoring, explanation and SQL twins cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the service we reproduce for results to match.
# ---------------------------------------------------------------------------
# Feature order used by every model, the attribution map and the sentence.
FEATURES = ("amount", "transaction_time", "location_change", "device_change", "merchant_risk")
LABEL = "is_fraud"
ID = "transaction_id"
# Actions in the order the decision considers them (also the tie-break order).
ACTIONS = ("approve", "block", "review")
# Default expected-cost parameters.
DEFAULT_FRAUD_LOSS = 1000.0
DEFAULT_FALSE_POSITIVE_COST = 50.0
DEFAULT_REVIEW_COST = 20.0
# Explanation sentence: prefix, separator, suffix per reason, final stop, top-k.
EXPLANATION_PREFIX = "Transaction flagged primarily due to: "
EXPLANATION_SEPARATOR = ", "
REASON_SUFFIX = " impact"
EXPLANATION_END = "."
EXPLANATION_TOP_K = 3
# Isolation forest defaults: trees, contamination, seed, rows per tree.
FOREST_TREES = 100
FOREST_CONTAMINATION = 0.2
FOREST_SEED = 42
FOREST_MAX_SAMPLES = 256
# Display labels of the dashboard, keyed by decision.
DECISION_LABELS = {"approve": "🟢 APPROVE", "review": "🟡 REVIEW", "block": "🔴 BLOCK"}
# Rounding of the response's two scores.
RESPONSE_DECIMALS = 4
# Euler–Mascheroni constant for the isolation-forest path normaliser.
EULER_GAMMA = 0.5772156649015329

# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------
REQUEST = T.StructType(
    [
        T.StructField(ID, T.LongType(), True),
        T.StructField("amount", T.DoubleType(), True),
        T.StructField("transaction_time", T.IntegerType(), True),
        T.StructField("location_change", T.IntegerType(), True),
        T.StructField("device_change", T.IntegerType(), True),
        T.StructField("merchant_risk", T.DoubleType(), True),
    ]
)

TRANSACTION = T.StructType(REQUEST.fields + [T.StructField(LABEL, T.IntegerType(), True)])

# Raw request as it arrives on the wire: every field text, so that a bad value
# becomes a reject reason instead of a failed job.
RAW_REQUEST = T.StructType([T.StructField(f.name, T.StringType(), True) for f in REQUEST.fields])

RESPONSE = T.StructType(
    [
        T.StructField(ID, T.LongType(), True),
        T.StructField("fraud_probability", T.DoubleType(), True),
        T.StructField("anomaly_score", T.DoubleType(), True),
        T.StructField("decision", T.StringType(), True),
        T.StructField("explanation", T.StringType(), True),
        T.StructField("feature_contributions", T.MapType(T.StringType(), T.DoubleType()), True),
    ]
)

INTEGRAL_FEATURES = ("transaction_time", "location_change", "device_change")
