"""The registered queries (one per operator family of the blueprint)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import twins
from ..functions import round_to, zscore
from ..operators import classifier as clf
from ..operators import decision as dec
from ..operators import explain as expl
from ..operators import forest
from ..operators.quantile import sketch_rank_error
from ..schema import ACTIONS, FEATURES, FOREST_CONTAMINATION, FOREST_MAX_SAMPLES, FOREST_SEED, FOREST_TREES, ID
from ..sources.events import transactions_from_events
from ..session import scratch_path
from ..sources.readers import baseline_row, parse_json_requests, read_transactions, response_from_json, response_to_json
from ..sources.validate import split_valid, validate
from ..streaming.stream import analyze_stream, read_sink
from .analyze import Models, analyze, analyze_table, display, flatten_response, train
from .pinned import PINNED_CLASSIFIER
from .registry import query, table

P6 = 6  # decimals of doubles in checked outputs (both sides)
P4 = 4  # decimals for values that depend on a fit


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(table(spark, sf_dir, "events"))


def _tx_sql() -> str:
    return twins.transactions_sql("events")


def _prob_sql(model=PINNED_CLASSIFIER) -> str:
    return twins.sigmoid_sql(twins.logit_sql(model))


# ---------------------------------------------------------------- scoring and decision
@query("tx_features", lambda: f"SELECT * FROM ({_tx_sql()}) t")
def q_tx_features(spark, sf_dir):
    """The transactions view over the whole events table."""
    return transactions(spark, sf_dir)


#: A third of all events are moved to one user and one timestamp.
HOT_TS = "2024-01-01 00:00:00"


@query(
    "tx_features_hot",
    lambda: "SELECT * FROM ("
    + twins.transactions_sql(
        f"(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '{HOT_TS}' ELSE ts END AS ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, value, props FROM events)"
    )
    + ") t",
)
def q_tx_features_hot(spark, sf_dir):
    """F3 / K1 under skew: the view where a third of all events share one user and one timestamp."""
    hot = F.col("event_id") % 3 == 0
    events = table(spark, sf_dir, "events")
    kinds = {f.name: f.dataType for f in events.schema.fields}
    moved = events.withColumns({"ts": F.when(hot, F.lit(HOT_TS).cast(kinds["ts"])).otherwise(F.col("ts")), "user_id": F.when(hot, F.lit(0).cast(kinds["user_id"])).otherwise(F.col("user_id"))})
    return transactions_from_events(moved)


@query(
    "score_probability",
    lambda: f"SELECT transaction_id, round({_prob_sql()}, {P6}) AS fraud_probability FROM ({_tx_sql()}) t",
)
def q_score_probability(spark, sf_dir):
    """M1: fraud probability of every transaction."""
    df = clf.predict_proba(transactions(spark, sf_dir), PINNED_CLASSIFIER)
    return df.select(ID, round_to("fraud_probability", P6).alias("fraud_probability"))


@query(
    "predict_class",
    lambda: f"SELECT transaction_id, CASE WHEN {_prob_sql()} > 0.5 THEN 1 ELSE 0 END AS fraud_class FROM ({_tx_sql()}) t",
)
def q_predict_class(spark, sf_dir):
    """M2: fraud class (probability above one half)."""
    return clf.predict_class(transactions(spark, sf_dir), PINNED_CLASSIFIER).select(ID, "fraud_class")


def _costs_sql(p: str = "p") -> tuple[str, str, str]:
    return (f"({p} * {twins.num(1000.0)})", f"((1.0 - {p}) * {twins.num(50.0)})", twins.num(20.0))


@query(
    "action_costs",
    lambda: (
        "SELECT transaction_id, "
        + ", ".join(f"round({c}, {P6}) AS cost_{a}" for c, a in zip(_costs_sql(), ACTIONS))
        + f" FROM (SELECT transaction_id, {_prob_sql()} AS p FROM ({_tx_sql()}) t) s"
    ),
)
def q_action_costs(spark, sf_dir):
    """Expected cost of each action."""
    df = dec.action_costs(clf.predict_proba(transactions(spark, sf_dir), PINNED_CLASSIFIER))
    return df.select(ID, *[round_to(f"cost_{a}", P6).alias(f"cost_{a}") for a in ACTIONS])


def _decision_sql(p: str = "p") -> str:
    ca, cb, cr = _costs_sql(p)
    return f"CASE WHEN {ca} <= {cb} AND {ca} <= {cr} THEN 'approve' WHEN {cb} <= {cr} THEN 'block' ELSE 'review' END"


@query(
    "choose_action",
    lambda: (
        f"SELECT transaction_id, round(p, {P6}) AS fraud_probability, {_decision_sql()} AS decision "
        f"FROM (SELECT transaction_id, {_prob_sql()} AS p FROM ({_tx_sql()}) t) s"
    ),
)
def q_choose_action(spark, sf_dir):
    """D3: the cheapest action (ties: approve, block, review)."""
    df = dec.choose_action(clf.predict_proba(transactions(spark, sf_dir), PINNED_CLASSIFIER))
    return df.select(ID, round_to("fraud_probability", P6).alias("fraud_probability"), "decision")


# ---------------------------------------------------------------- explain
def _phi_sql() -> str:
    return twins.phi_sql(PINNED_CLASSIFIER, _tx_sql())


def _phi(spark, sf_dir) -> DataFrame:
    return expl.shapley_linear(transactions(spark, sf_dir), PINNED_CLASSIFIER)


@query(
    "shapley_values",
    lambda: f"SELECT transaction_id, {', '.join(f'round(phi_{f}, {P6}) AS phi_{f}' for f in FEATURES)} FROM ({_phi_sql()}) p",
)
def q_shapley_values(spark, sf_dir):
    """Exact Shapley values as Spark expressions."""
    return _phi(spark, sf_dir).select(ID, *[round_to(f"phi_{f}", P6).alias(f"phi_{f}") for f in FEATURES])


@query(
    "shapley_udf",
    lambda: f"SELECT transaction_id, {', '.join(f'round(phi_{f}, {P6}) AS phi_{f}' for f in FEATURES)} FROM ({_phi_sql()}) p",
)
def q_shapley_udf(spark, sf_dir):
    """The same values through the general model-callable path."""
    tx = transactions(spark, sf_dir).select(ID, *FEATURES)
    df = expl.shapley_values(tx, expl.linear_predictor(PINNED_CLASSIFIER))
    return df.select(ID, *[round_to(f"phi_{f}", P6).alias(f"phi_{f}") for f in FEATURES])


@query(
    "shapley_long_sorted",
    lambda: f"SELECT transaction_id, rank, feature, round(contribution, {P6}) AS contribution FROM ({twins.phi_long_sql(_phi_sql())}) l",
)
def q_shapley_long_sorted(spark, sf_dir):
    """One row per feature, ranked by absolute contribution."""
    long = expl.contributions_long(_phi(spark, sf_dir))
    return long.select(ID, F.col("rank").cast("long").alias("rank"), "feature", round_to("contribution", P6).alias("contribution"))


@query(
    "shapley_top3",
    lambda: f"SELECT transaction_id, rank, feature, round(contribution, {P6}) AS contribution FROM ({twins.phi_long_sql(_phi_sql())}) l WHERE rank <= 3",
)
def q_shapley_top3(spark, sf_dir):
    """The three largest contributions of every transaction."""
    long = expl.contributions_long(_phi(spark, sf_dir)).filter(F.col("rank") <= 3)
    return long.select(ID, F.col("rank").cast("long").alias("rank"), "feature", round_to("contribution", P6).alias("contribution"))


@query("explanation_text", lambda: twins.explanation_sql(twins.phi_long_sql(_phi_sql())))
def q_explanation_text(spark, sf_dir):
    """The explanation sentence."""
    return _phi(spark, sf_dir).select(ID, expl.explanation().alias("explanation"))


# ---------------------------------------------------------------- classifier fit
@query(
    "scaler_stats",
    lambda: "SELECT " + ", ".join(f"round(mean_{f}, {P6}) AS mean_{f}, round(scale_{f}, {P6}) AS scale_{f}" for f in FEATURES)
    + f" FROM ({twins.scaler_stats_sql(_tx_sql())}) s",
)
def q_scaler_stats(spark, sf_dir):
    """A1: mean and population deviation of each feature."""
    s = clf.scaler_stats(transactions(spark, sf_dir))
    return s.select(*[round_to(c, P6).alias(c) for c in s.columns])


@query("class_weights", lambda: f"SELECT is_fraud, n, round(weight, {P6}) AS weight FROM ({twins.class_weights_sql(_tx_sql())}) w")
def q_class_weights(spark, sf_dir):
    """A2: balanced class weights."""
    w = clf.class_weights(transactions(spark, sf_dir))
    return w.select("is_fraud", "n", round_to("weight", P6).alias("weight"))


def _model_row(spark, model) -> DataFrame:
    vals = {f"coef_{f}": round(b, P4) for f, b in zip(model.features, model.coef)}
    vals["intercept"] = round(model.intercept, P4)
    return spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} double" for k in vals))


@query(
    "fit_logistic",
    lambda: "SELECT " + ", ".join(f"round(t{j}, {P4}) AS coef_{f}" for j, f in enumerate(FEATURES))
    + f", round(b, {P4}) AS intercept FROM ({twins.logistic_gd_sql(_tx_sql())}) g",
)
def q_fit_logistic(spark, sf_dir):
    """A1-A3 on the whole transactions view; one row of fitted coefficients."""
    return _model_row(spark, clf.fit_logistic(transactions(spark, sf_dir)))


# ---------------------------------------------------------------- isolation forest
def _forest_sql(select: str, extra: list[str] | None = None) -> str:
    """The forest's twin at the service's settings."""
    return twins.forest_sql(_tx_sql(), select, FOREST_TREES, FOREST_MAX_SAMPLES, FOREST_SEED, FOREST_CONTAMINATION, extra=extra)


@query("forest_sample", lambda: _forest_sql("SELECT tree, transaction_id FROM smp"))
def q_forest_sample(spark, sf_dir):
    """A4 sample at the service's settings (100 trees x 256 rows)."""
    sample, _ = forest.forest_sample(transactions(spark, sf_dir))
    return sample.select("tree", ID)


def _repeated_ids_sql() -> str:
    return f"SELECT t.* REPLACE (t.transaction_id // 4 AS transaction_id) FROM ({_tx_sql()}) t"


@query(
    "forest_sample_repeated",
    lambda: twins.forest_sql(_repeated_ids_sql(), "SELECT tree, transaction_id, x0 AS amount FROM smp", FOREST_TREES, FOREST_MAX_SAMPLES, FOREST_SEED, FOREST_CONTAMINATION),
)
def q_forest_sample_repeated(spark, sf_dir):
    """A4 sample of a view in which four rows share each id: the same rule, every row with a key of its own."""
    tx = transactions(spark, sf_dir).withColumn(ID, F.expr(f"{ID} div 4"))
    sample, _ = forest.forest_sample(tx)
    return sample.select("tree", ID, "amount")


@query(
    "forest_nodes",
    lambda: _forest_sql(f"SELECT tree, node, depth, feature, round(threshold, {P6}) AS threshold, size, is_leaf, round(path, {P6}) AS path FROM nodes"),
)
def q_forest_nodes(spark, sf_dir):
    """The grown trees (100 trees x 256 rows)."""
    sample, psi = forest.forest_sample(transactions(spark, sf_dir))
    nodes = forest.grow_forest(sample, psi)
    return nodes.select(
        "tree", "node", "depth", "feature", round_to("threshold", P6).alias("threshold"), "size", "is_leaf", round_to("path", P6).alias("path")
    )


@query(
    "forest_score",
    lambda: _forest_sql(
        f"SELECT s.transaction_id, round(score, {P6}) AS score, round(score - o.offset, {P6}) AS anomaly_score FROM scored s CROSS JOIN offs o"
    ),
)
def q_forest_score(spark, sf_dir):
    """Score and anomaly score of every transaction."""
    tx = transactions(spark, sf_dir)
    fo = forest.fit_forest(tx)
    df = tx.select(ID, forest.score_samples(fo, spark).alias("score"))
    return df.select(ID, round_to("score", P6).alias("score"), round_to(F.col("score") - F.lit(fo.offset), P6).alias("anomaly_score"))


@query(
    "forest_score_jvm",
    lambda: _forest_sql(
        f"SELECT s.transaction_id, round(score, {P6}) AS score, round(score - o.offset, {P6}) AS anomaly_score FROM scored s CROSS JOIN offs o"
    ),
)
def q_forest_score_jvm(spark, sf_dir):
    """A6, M3, J2 without Python workers: the trees walked in column expressions."""
    tx = transactions(spark, sf_dir)
    fo = forest.fit_forest(tx)
    walked = forest.with_mean_path_jvm(tx.select(ID, *FEATURES), fo)
    df = walked.select(ID, forest.score_samples(fo, spark, engine="jvm", walked="mean_path").alias("score"))
    return df.select(ID, round_to("score", P6).alias("score"), round_to(F.col("score") - F.lit(fo.offset), P6).alias("anomaly_score"))


@query(
    "anomaly_offset",
    lambda: _forest_sql(
        f"SELECT round(o.offset, {P6}) AS offset, (SELECT count(*) FROM scored s, offs o2 WHERE round(s.score - o2.offset, 9) < 0) AS n_anomalies FROM offs o"
    ),
)
def q_anomaly_offset(spark, sf_dir):
    """A5: the contamination percentile of the training scores, and how many rows fall below it."""
    tx = transactions(spark, sf_dir)
    fo = forest.fit_forest(tx)
    flagged = forest.anomaly_score(tx, fo).agg(F.sum((round_to("anomaly_score", 9) < 0).cast("long")).alias("n_anomalies"))
    return flagged.select(round_to(F.lit(fo.offset), P6).alias("offset"), F.coalesce("n_anomalies", F.lit(0)).alias("n_anomalies"))


@query(
    "anomaly_offset_sketch",
    lambda: f"SELECT count(*) AS n, CAST({FOREST_CONTAMINATION} AS DOUBLE) AS contamination, TRUE AS within_bound FROM ({_tx_sql()}) t",
)
def q_anomaly_offset_sketch(spark, sf_dir):
    """A5 by mergeable sketch: the rank of the offset among all training scores, held against the stated bound."""
    tx = transactions(spark, sf_dir)
    fo = forest.fit_forest(tx, quantile="sketch")
    score = forest.score_samples(fo, spark)
    ranks = tx.select(score.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("s") < fo.offset).cast("double")).alias("below"), F.avg((F.col("s") <= fo.offset).cast("double")).alias("upto"))
    error = F.greatest(F.lit(0.0), F.col("below") - FOREST_CONTAMINATION, FOREST_CONTAMINATION - F.col("upto"))
    return ranks.select("n", F.lit(FOREST_CONTAMINATION).alias("contamination"), (error <= sketch_rank_error()).alias("within_bound"))


@query(
    "anomaly_label",
    lambda: _forest_sql(
        "SELECT s.transaction_id, CASE WHEN round(score - o.offset, 9) < 0 THEN -1 ELSE 1 END AS anomaly_label FROM scored s CROSS JOIN offs o"
    ),
)
def q_anomaly_label(spark, sf_dir):
    """M4: -1 for anomalies, 1 otherwise."""
    tx = transactions(spark, sf_dir)
    fo = forest.fit_forest(tx)
    return forest.anomaly_score(tx, fo).select(ID, forest.anomaly_label(F.col("anomaly_score"), 9).alias("anomaly_label"))


@query(
    "forest_score_full",
    lambda: _forest_sql(
        f"SELECT s.transaction_id, round(s.score - o.offset, {P6}) AS anomaly_score, "
        "CASE WHEN round(s.score - o.offset, 9) < 0 THEN -1 ELSE 1 END AS anomaly_label FROM scored s CROSS JOIN offs o"
    ),
)
def q_forest_score_full(spark, sf_dir):
    """A4-A6, M3, M4 at the service's settings (100 trees x 256 rows)."""
    tx = transactions(spark, sf_dir)
    fo = forest.fit_forest(tx)
    df = forest.anomaly_score(tx, fo)
    return df.select(ID, round_to("anomaly_score", P6).alias("anomaly_score"), forest.anomaly_label(F.col("anomaly_score"), 9).alias("anomaly_label"))


# ---------------------------------------------------------------- compose
def _trained_rows_sql() -> str:
    return f"SELECT t.*, mdl.rb, {', '.join(f'mdl.r{j}' for j in range(len(FEATURES)))} FROM ({_tx_sql()}) t CROSS JOIN mdl"


def _trained_phi_sql() -> str:
    return twins.phi_sql_from("rb", [f"r{j}" for j in range(len(FEATURES))], _trained_rows_sql())


def _analyze_trained_select(decimals: int = P4) -> str:
    """Twin of the trained analysis: the fit by gradient descent (``mdl``), the
    100-tree forest replayed exactly. Fit-dependent values at 4 decimals."""
    txm = _trained_rows_sql()
    logit = "rb"
    for j, f in enumerate(FEATURES):
        logit = f"({logit} + r{j} * CAST({f} AS DOUBLE))"
    phi = _trained_phi_sql()
    expl_sql = twins.explanation_sql(twins.phi_long_sql(phi))
    phis = ", ".join(f"round(ph.phi_{f}, {decimals}) AS phi_{f}" for f in FEATURES)
    return f"""
    SELECT a.transaction_id, round(a.p, 4) AS fraud_probability, round(s.score - o.offset, 4) AS anomaly_score,
           a.decision, e.explanation, {phis}
    FROM (SELECT transaction_id, p, {_decision_sql()} AS decision
          FROM (SELECT transaction_id, {twins.sigmoid_sql(logit)} AS p FROM ({txm}) t) x) a
    JOIN scored s ON s.transaction_id = a.transaction_id
    CROSS JOIN offs o
    JOIN ({phi}) ph ON ph.transaction_id = a.transaction_id
    JOIN ({expl_sql}) e ON e.transaction_id = a.transaction_id
    """


def _analysis_sql(select: str | None = None) -> str:
    """The trained analysis, or ``select`` over it."""
    return _forest_sql(select or _analyze_trained_select(), extra=twins.logistic_gd_ctes(_tx_sql()))


@query("analyze", lambda: _analysis_sql())
def q_analyze(spark, sf_dir):
    """The full response for every transaction (models trained on the whole view at the service's settings)."""
    tx = transactions(spark, sf_dir)
    return flatten_response(analyze(tx, train(tx)), decimals=P4)


@query("response_json", lambda: _analysis_sql())
def q_response_json(spark, sf_dir):
    """K5 + K6: responses written as JSON text and read back into typed columns."""
    tx = transactions(spark, sf_dir)
    text = response_to_json(analyze(tx, train(tx)), "response")
    back = text.select(response_from_json("response").alias("r")).select("r.*")
    return flatten_response(back, decimals=P4)


@query(
    "display_format",
    lambda: _analysis_sql(
        "SELECT transaction_id, printf('%.2f%%', fraud_probability * 100) AS probability_text, "
        "printf('%.3f', anomaly_score) AS anomaly_text, "
        "CASE WHEN transaction_id % 13 = 0 THEN 'escalate' WHEN decision = 'approve' THEN '🟢 APPROVE' WHEN decision = 'review' THEN '🟡 REVIEW' WHEN decision = 'block' THEN '🔴 BLOCK' END AS decision_label "
        f"FROM ({_analyze_trained_select()}) r"
    ),
)
def q_display_format(spark, sf_dir):
    """The dashboard's formatted metrics for every response; a decision without a label (every 13th row) shows as it is."""
    tx = transactions(spark, sf_dir)
    responses = analyze(tx, train(tx))
    return display(responses.withColumn("decision", F.when(F.col(ID) % 13 == 0, "escalate").otherwise(F.col("decision"))))


def _requests_json(tx: DataFrame) -> DataFrame:
    """Request bodies as JSON text, derived from the transactions view."""
    return tx.select(F.to_json(F.struct(ID, *FEATURES)).alias("value"))


@query(
    "tx_validate",
    lambda: f"""
    SELECT transaction_id, amount, transaction_time, location_change, device_change, merchant_risk,
           CASE WHEN transaction_time NOT BETWEEN 0 AND 23 THEN 'transaction_time out of range [0, 23]'
                WHEN location_change NOT BETWEEN 0 AND 1 THEN 'location_change out of range [0, 1]'
                WHEN device_change NOT BETWEEN 0 AND 1 THEN 'device_change out of range [0, 1]'
                WHEN merchant_risk < 0.0 OR merchant_risk > 1.0 THEN 'merchant_risk out of range [0.0, 1.0]'
           END AS reject_reason
    FROM ({_tx_sql()}) t""",
)
def q_tx_validate(spark, sf_dir):
    """Request bodies as JSON text, parsed and validated with the form's ranges."""
    raw = parse_json_requests(_requests_json(transactions(spark, sf_dir)), "value")
    return validate(raw, strict_domain=True)


@query("analyze_stream", lambda: _analysis_sql())
def q_analyze_stream(spark, sf_dir):
    """K4: the same responses through Structured Streaming (files in, three micro-batches, Parquet and manifests out), read back."""
    tx = transactions(spark, sf_dir)
    models = train(tx)
    base = scratch_path(spark, "analyze-stream")
    _requests_json(tx).repartition(6).write.text(f"{base}/in")
    q = analyze_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", models, max_files_per_trigger=2)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return flatten_response(read_sink(spark, f"{base}/out").drop("batch"), decimals=P4)


@query("analyze_trained", lambda: _analysis_sql())
def q_analyze_trained(spark, sf_dir):
    """Start-up training at the service's settings (fitted classifier, 100-tree
    forest), the models saved as tables and loaded again, then the analysis of every transaction."""
    tx = transactions(spark, sf_dir)
    path = scratch_path(spark, "models")
    train(tx).save(spark, path)
    return flatten_response(analyze(tx, Models.load(spark, path)), decimals=P4)


@query(
    "action_options",
    lambda: (
        "SELECT transaction_id, rank, action, round(cost, 6) AS cost FROM ("
        + " UNION ALL ".join(
            f"SELECT transaction_id, {i} AS rank, '{a}' AS action, {c} AS cost FROM (SELECT transaction_id, {_prob_sql()} AS p FROM ({_tx_sql()}) t) s"
            for i, (a, c) in enumerate(zip(ACTIONS, _costs_sql()))
        )
        + ") u"
    ),
)
def q_action_options(spark, sf_dir):
    """Every transaction expanded by the three actions, with their expected costs."""
    long = dec.action_options(clf.predict_proba(transactions(spark, sf_dir), PINNED_CLASSIFIER))
    return long.select(ID, "rank", "action", round_to("cost", P6).alias("cost"))


@query(
    "scaled_features",
    lambda: "SELECT transaction_id, "
    + ", ".join(
        f"round((CAST({f} AS DOUBLE) - {twins.num(m)}) / {twins.num(s)}, {P6}) AS z_{f}"
        for f, m, s in zip(FEATURES, PINNED_CLASSIFIER.mean, PINNED_CLASSIFIER.scale)
    )
    + f" FROM ({_tx_sql()}) t",
)
def q_scaled_features(spark, sf_dir):
    """The five features in fixed order, standardised with the pinned scaler."""
    tx = transactions(spark, sf_dir)
    m = PINNED_CLASSIFIER
    return tx.select(ID, *[round_to(zscore(F.col(f).cast("double"), mu, sd), P6).alias(f"z_{f}") for f, mu, sd in zip(FEATURES, m.mean, m.scale)])


@query(
    "contributions_table",
    lambda: _analysis_sql(
        f"SELECT transaction_id, rank, feature, round(contribution, {P4}) AS contribution FROM ({twins.phi_long_sql(_trained_phi_sql())}) l"
    ),
)
def q_contributions_table(spark, sf_dir):
    """P8 + T3: the dashboard's contribution table, built from each response's map."""
    tx = transactions(spark, sf_dir)
    table_ = expl.contributions_table(analyze(tx, train(tx)))
    return table_.select(ID, F.col("rank").cast("long").alias("rank"), "feature", round_to("contribution", P4).alias("contribution"))


# ---------------------------------------------------------------- input handling
BROKEN = 24  # kinds of request by transaction_id; the first eleven are broken


def _broken_bodies(tx: DataFrame) -> DataFrame:
    """Request bodies as JSON text, every kind of defect at every BROKEN-th id."""
    kind = F.col(ID) % BROKEN
    value = {f: F.to_json(F.struct(F.col(f).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(f).alias("v")))) - 6) for f in FEATURES}
    wrong = {
        "amount": {1: "null", 4: '"text"', 6: '"1d"'},
        "transaction_time": {3: "12.5", 5: "99999999999", 8: "24"},
        "merchant_risk": {2: '"NaN"'},
    }
    fields = []
    for f in FEATURES:
        v = value[f]
        for k, text in wrong.get(f, {}).items():
            v = F.when(kind == k, F.lit(text)).otherwise(v)
        field = F.concat(F.lit(f'"{f}":'), v)
        fields.append(F.when(kind != 0, field) if f == "amount" else field)  # concat_ws leaves nulls out
    body = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit(f'"{ID}":'), F.col(ID).cast("string")), *fields), F.lit("}"))
    body = F.when(kind == 7, F.lit('{"transaction_id": ')).when(kind == 9, F.lit("")).when(kind == 10, F.lit("[1]")).otherwise(body)
    path = scratch_path(tx.sparkSession, "broken-requests")  # as requests arrive: lines of text
    tx.select(body.alias("value")).write.text(path)
    return tx.sparkSession.read.text(path)


def _reason_sql() -> str:
    reasons = {
        0: "missing field amount",
        1: "null amount",
        2: "merchant_risk is not finite",
        3: "transaction_time is not an integer: 12.5",
        4: "amount is not a number: text",
        5: "transaction_time is not an integer: 99999999999",
        6: "amount is not a number: 1d",
        7: 'malformed body: {"transaction_id": ',
        8: "transaction_time out of range [0, 23]",
        9: "malformed body: ",
        10: "malformed body: [1]",
    }
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in reasons.items())
    return f"CASE transaction_id % {BROKEN} {whens} END"


@query(
    "tx_rejects",
    lambda: f"""SELECT CASE WHEN transaction_id % {BROKEN} IN (7, 9, 10) THEN NULL ELSE transaction_id END AS transaction_id, reject_reason
    FROM (SELECT transaction_id, {_reason_sql()} AS reject_reason FROM ({_tx_sql()}) t) r""",
)
def q_tx_rejects(spark, sf_dir):
    """Broken request bodies of every kind, each with its reason (null for good ones)."""
    raw = parse_json_requests(_broken_bodies(transactions(spark, sf_dir)), "value")
    return validate(raw, strict_domain=True).select(ID, "reject_reason")


@query(
    "analyze_accepted",
    lambda: _analysis_sql(f"SELECT * FROM ({_analyze_trained_select()}) r WHERE transaction_id % {BROKEN} >= 11"),
)
def q_analyze_accepted(spark, sf_dir):
    """K3 + K7: the responses to the good ones among broken requests; no bad row fails the job."""
    tx = transactions(spark, sf_dir)
    ok, _ = analyze_table(parse_json_requests(_broken_bodies(tx), "value"), train(tx), strict_domain=True)
    return flatten_response(ok, decimals=P4)


@query(
    "analyze_rejected",
    lambda: f"SELECT reject_reason, count(*) AS n FROM (SELECT {_reason_sql()} AS reject_reason FROM ({_tx_sql()}) t) r WHERE reject_reason IS NOT NULL GROUP BY 1",
)
def q_analyze_rejected(spark, sf_dir):
    """K7: the rejected side of the same table, counted by reason."""
    tx = transactions(spark, sf_dir)
    _, bad = split_valid(validate(parse_json_requests(_broken_bodies(tx), "value"), strict_domain=True))
    return bad.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("read_csv_reordered", lambda: f"SELECT * FROM ({_tx_sql()}) t")
def q_read_csv_reordered(spark, sf_dir):
    """K1: the view written as CSV in another column order with an extra column, read back by name."""
    tx = transactions(spark, sf_dir)
    path = scratch_path(spark, "csv-reordered")
    tx.select(F.lit("x").alias("note"), *reversed(tx.columns)).write.option("header", True).csv(path)
    return read_transactions(spark, path, schema=tx.schema)


# ---------------------------------------------------------------- settings and pluggable parts
@query(
    "fit_logistic_lbfgs",
    lambda: "SELECT " + ", ".join(f"round(t{j}, {P4}) AS coef_{f}" for j, f in enumerate(FEATURES))
    + f", round(b, {P4}) AS intercept FROM ({twins.logistic_gd_sql(_tx_sql())}) g",
)
def q_fit_logistic_lbfgs(spark, sf_dir):
    """P3 + A3: the same fit from an assembled feature vector by ``pyspark.ml``."""
    return _model_row(spark, clf.fit_logistic(transactions(spark, sf_dir), solver="lbfgs"))


@query(
    "decision_costs",
    lambda: (
        f"SELECT transaction_id, {_decision_sql()} AS decision, "
        + ", ".join(f"round({c}, {P6}) AS best_{a}" for c, a in zip(_costs_sql(), ACTIONS))
        + f", TRUE AS terminal FROM (SELECT transaction_id, {_prob_sql()} AS p FROM ({_tx_sql()}) t) s"
    ),
)
def q_decision_costs(spark, sf_dir):
    """P5 + A7: the decision with its best-cost map, and that it is terminal."""
    df = dec.choose_action(clf.predict_proba(transactions(spark, sf_dir), PINNED_CLASSIFIER), with_costs=True)
    return df.select(ID, "decision", *[round_to(F.element_at("costs", F.lit(a)), P6).alias(f"best_{a}") for a in ACTIONS], dec.is_terminal(F.col("decision")).alias("terminal"))


@query(
    "cost_by_action",
    lambda: (
        f"SELECT transaction_id, action, round(CASE action WHEN 'approve' THEN {_costs_sql()[0]} WHEN 'block' THEN {_costs_sql()[1]} ELSE {_costs_sql()[2]} END, {P6}) AS cost "
        f"FROM (SELECT transaction_id, {_prob_sql()} AS p, CASE transaction_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'block' ELSE 'review' END AS action FROM ({_tx_sql()}) t) s"
    ),
)
def q_cost_by_action(spark, sf_dir):
    """The cost of an action that is data."""
    df = clf.predict_proba(transactions(spark, sf_dir), PINNED_CLASSIFIER)
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.col(ID) % 3 + 1).cast("int"))
    return df.select(ID, action.alias("action"), round_to(dec.cost_of(F.col("fraud_probability"), action), P6).alias("cost"))


def _quadratic_cost(p, action: str):
    """Another cost object: approving grows with the square of the probability."""
    return {"approve": p * p * 800.0, "block": (1.0 - p) * 90.0, "review": p * 10.0 + 15.0}[action]


@query(
    "custom_cost",
    lambda: (
        "SELECT transaction_id, CASE WHEN a <= b AND a <= r THEN 'approve' WHEN b <= r THEN 'block' ELSE 'review' END AS decision FROM ("
        f"SELECT transaction_id, p * p * 800.0::DOUBLE AS a, (1.0::DOUBLE - p) * 90.0::DOUBLE AS b, p * 10.0::DOUBLE + 15.0::DOUBLE AS r FROM (SELECT transaction_id, {_prob_sql()} AS p FROM ({_tx_sql()}) t) s) c"
    ),
)
def q_custom_cost(spark, sf_dir):
    """Decisions under a cost of the caller's own."""
    df = dec.choose_action(clf.predict_proba(transactions(spark, sf_dir), PINNED_CLASSIFIER), cost=_quadratic_cost)
    return df.select(ID, "decision")


@query(
    "forest_settings",
    lambda: twins.forest_sql(
        _tx_sql(),
        f"SELECT s.transaction_id, round(s.score - o.offset, {P6}) AS anomaly_score, CASE WHEN round(s.score - o.offset, 9) < 0 THEN -1 ELSE 1 END AS anomaly_label FROM scored s CROSS JOIN offs o",
        FOREST_TREES,
        FOREST_MAX_SAMPLES,
        7,
        0.1,
    ),
)
def q_forest_settings(spark, sf_dir):
    """The forest with another contamination and seed."""
    tx = transactions(spark, sf_dir)
    df = forest.anomaly_score(tx, forest.fit_forest(tx, contamination=0.1, seed=7))
    return df.select(ID, round_to("anomaly_score", P6).alias("anomaly_score"), forest.anomaly_label(F.col("anomaly_score"), 9).alias("anomaly_label"))


BACKGROUND = (50.0, 12.0, 1.0, 0.0, 0.5)


@query(
    "shapley_background",
    lambda: f"SELECT transaction_id, {', '.join(f'round(phi_{f}, {P6}) AS phi_{f}' for f in FEATURES)} FROM ({twins.phi_sql(PINNED_CLASSIFIER, _tx_sql(), baseline=BACKGROUND)}) p",
)
def q_shapley_background(spark, sf_dir):
    """K8 + X1: Shapley values against a background row of the caller's own."""
    background = spark.createDataFrame([BACKGROUND], ", ".join(f"{f} double" for f in FEATURES))
    df = expl.shapley_linear(transactions(spark, sf_dir), PINNED_CLASSIFIER, baseline=baseline_row(background, FEATURES))
    return df.select(ID, *[round_to(f"phi_{f}", P6).alias(f"phi_{f}") for f in FEATURES])


# ---------------------------------------------------------------- background tables, many features
def _hourly_background(tx: DataFrame) -> DataFrame:
    """A background summary of the whole view: the mean row of every hour, with its number of rows."""
    rest = [F.avg(F.col(f).cast("double")).alias(f) for f in FEATURES if f != "transaction_time"]
    return tx.groupBy("transaction_time").agg(*rest, F.count(F.lit(1)).alias("n"))


def _hourly_background_sql() -> str:
    rest = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS {f}" for f in FEATURES if f != "transaction_time")
    return f"SELECT transaction_time, {rest}, count(*) AS n FROM ({_tx_sql()}) h GROUP BY transaction_time"


@query(
    "shapley_background_table",
    lambda: f"SELECT transaction_id, {', '.join(f'round(phi_{f}, {P6}) AS phi_{f}' for f in FEATURES)} FROM ({twins.phi_background_sql(PINNED_CLASSIFIER, _tx_sql(), _hourly_background_sql(), 'n')}) p",
)
def q_shapley_background_table(spark, sf_dir):
    """K8 + X1: Shapley values against a background table of many (weighted) rows."""
    tx = transactions(spark, sf_dir)
    background = expl.background_table(_hourly_background(tx), weight_col="n")
    df = expl.shapley_values(tx.select(ID, *FEATURES), expl.linear_predictor(PINNED_CLASSIFIER), baseline=background)
    return df.select(ID, *[round_to(f"phi_{f}", P6).alias(f"phi_{f}") for f in FEATURES])


#: Pairs of features whose products make a wider model: 5 + 10 features.
PRODUCTS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
ORDERS = 8  # antithetic pairs of feature orders


def _wide_model() -> clf.LinearModel:
    """The pinned classifier with small interaction terms (fixed weights, alternating in sign)."""
    scale = dict(zip(FEATURES, PINNED_CLASSIFIER.scale))
    names = (*FEATURES, *[f"{a}_by_{b}" for a, b in PRODUCTS])
    coef = (*PINNED_CLASSIFIER.raw_coef, *[(-1) ** k * 0.05 / (scale[a] * scale[b]) for k, (a, b) in enumerate(PRODUCTS)])
    return clf.LinearModel((0.0,) * len(names), (1.0,) * len(names), coef, PINNED_CLASSIFIER.raw_intercept, names)


def _wide_terms_sql() -> dict[str, str]:
    values = [f"CAST({f} AS DOUBLE)" for f in FEATURES] + [f"(CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE))" for a, b in PRODUCTS]
    model = _wide_model()
    return {f: f"{twins.num(b)} * {v}" for f, b, v in zip(model.features, model.coef, values)}


@query(
    "shapley_many_features",
    lambda: f"SELECT transaction_id, {', '.join(f'round(phi_{f}, {P6}) AS phi_{f}' for f in _wide_model().features)} "
    f"FROM ({twins.phi_orders_sql(_wide_model().intercept, _wide_terms_sql(), _tx_sql(), ORDERS, 42)}) p",
)
def q_shapley_many_features(spark, sf_dir):
    """U1 above 12 features: a 15-feature model explained from antithetic pairs of feature orders."""
    model = _wide_model()
    wide = transactions(spark, sf_dir).select(ID, *FEATURES, *[(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{a}_by_{b}") for a, b in PRODUCTS])
    df = expl.shapley_values(wide, expl.linear_predictor(model), model.features, permutations=ORDERS, seed=42)
    return df.select(ID, *[round_to(f"phi_{f}", P6).alias(f"phi_{f}") for f in model.features])


# ---------------------------------------------------------------- decisions from data
@query(
    "undecided_rows",
    lambda: f"""SELECT transaction_id, CASE WHEN transaction_id % 11 > 2 THEN {_decision_sql()} END AS decision,
      CASE transaction_id % 11 WHEN 0 THEN 'fraud probability is null' WHEN 1 THEN 'fraud probability is not a number' WHEN 2 THEN 'fraud probability is outside [0, 1]: 1.5' END AS reject_reason
    FROM (SELECT transaction_id, {_prob_sql()} AS p FROM ({_tx_sql()}) t) s""",
)
def q_undecided_rows(spark, sf_dir):
    """Rows whose probability is missing, no number or out of range are rejects with a reason; the others get their decision."""
    df = clf.predict_proba(transactions(spark, sf_dir), PINNED_CLASSIFIER)
    kind = F.col(ID) % 11
    p = F.when(kind == 0, F.lit(None).cast("double")).when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(1.5)).otherwise(F.col("fraud_probability"))
    return dec.decide_or_reject(df.withColumn("fraud_probability", p)).select(ID, "decision", "reject_reason")


def _segment_costs(tx: DataFrame) -> DataFrame:
    """A cost table from the view itself: segments are quarters of the day (the last has no offer),
    tariffs follow the segment's mean amount, reviews are offered twice, and there is a fourth action."""
    seg = tx.groupBy(F.expr("transaction_time div 6").cast("int").alias("segment")).agg(F.avg("amount").alias("a")).filter("segment < 3")
    offer = lambda action, rank, fraud, clean, fixed: F.struct(F.lit(action).alias("action"), F.lit(rank).alias("rank"), fraud.cast("double").alias("if_fraud"), clean.cast("double").alias("if_clean"), fixed.cast("double").alias("fixed"))
    a, none = F.col("a"), F.lit(0.0)
    offers = F.array(
        offer("approve", 0, a * 4.0, none, none),
        offer("block", 1, none, a / 5.0, none),
        offer("review", 2, none, none, F.lit(20.0)),
        offer("review", 2, none, none, F.lit(12.0) + F.col("segment") * 2.0),
        offer("call", 3, F.lit(30.0), F.lit(5.0), F.lit(3.0)),
    )
    return seg.select("segment", F.inline(offers))


def _segment_costs_sql() -> str:
    seg = f"SELECT transaction_time // 6 AS segment, avg(amount) AS a FROM ({_tx_sql()}) t WHERE transaction_time < 18 GROUP BY 1"
    offers = [
        ("approve", 0, "a * 4.0", "0.0", "0.0"),
        ("block", 1, "0.0", "a / 5.0", "0.0"),
        ("review", 2, "0.0", "0.0", "20.0"),
        ("review", 2, "0.0", "0.0", "12.0 + segment * 2.0"),
        ("call", 3, "30.0", "5.0", "3.0"),
    ]
    rows = [f"SELECT segment, '{n}' AS action, {r} AS rank, CAST({x} AS DOUBLE) AS f, CAST({y} AS DOUBLE) AS c, CAST({z} AS DOUBLE) AS x FROM seg" for n, r, x, y, z in offers]
    return f"seg AS ({seg}), offers AS ({' UNION ALL '.join(rows)})"


@query(
    "choose_by_segment",
    lambda: f"""WITH {_segment_costs_sql()},
    priced AS (SELECT s.transaction_id, o.action, o.rank, s.p * o.f + (1.0 - s.p) * o.c + o.x AS cost
      FROM (SELECT transaction_id, transaction_time // 6 AS segment, {_prob_sql()} AS p FROM ({_tx_sql()}) t) s LEFT JOIN offers o ON o.segment = s.segment),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY cost, rank, action) AS place FROM priced)
    SELECT transaction_id, max(action) FILTER (WHERE place = 1) AS decision, round(min(cost), {P6}) AS best_cost, round(min(cost) FILTER (WHERE action = 'review'), {P6}) AS best_review
    FROM ranked GROUP BY transaction_id""",
)
def q_choose_by_segment(spark, sf_dir):
    """D1-D3, A7, A8, J1 with actions and costs as data: one cost table per segment, two offers for one action."""
    tx = transactions(spark, sf_dir)
    rows = clf.predict_proba(tx, PINNED_CLASSIFIER).withColumn("segment", F.expr("transaction_time div 6").cast("int"))
    chosen = dec.choose_by_table(rows, _segment_costs(tx))
    return chosen.select(ID, "decision", round_to("best_cost", P6).alias("best_cost"), round_to(F.element_at("costs", F.lit("review")), P6).alias("best_review"))


@query(
    "cheapest_proposals",
    lambda: f"""WITH s AS (SELECT transaction_id, transaction_time, {_prob_sql()} AS p FROM ({_tx_sql()}) t),
    offers AS ({" UNION ALL ".join(f"SELECT transaction_time, '{a}' AS action, {i} AS rank, {c} * (1.0 + ((transaction_id + {k}) % 5) / 10.0) AS cost FROM s" for k in range(2) for i, (a, c) in enumerate(zip(ACTIONS, _costs_sql())))}),
    best AS (SELECT *, row_number() OVER (PARTITION BY transaction_time ORDER BY cost, rank, action) AS place FROM offers)
    SELECT transaction_time, max(action) FILTER (WHERE place = 1) AS decision, round(min(cost), {P6}) AS best_cost, {", ".join(f"round(min(cost) FILTER (WHERE action = '{a}'), {P6}) AS best_{a}" for a in ACTIONS)}
    FROM best GROUP BY transaction_time""",
)
def q_cheapest_proposals(spark, sf_dir):
    """A7 + A8: two advisers propose every action for every transaction; per hour, each action's best cost and the cheapest action."""
    options = dec.action_options(clf.predict_proba(transactions(spark, sf_dir), PINNED_CLASSIFIER), keep=(ID, "transaction_time"))
    advised = options.withColumn("adviser", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("cost", F.col("cost") * (F.lit(1.0) + ((F.col(ID) + F.col("adviser")) % 5) / 10.0))
    best = dec.cheapest_proposals(advised, ("transaction_time",))
    return best.select("transaction_time", "decision", round_to("best_cost", P6).alias("best_cost"), *[round_to(F.element_at("costs", F.lit(a)), P6).alias(f"best_{a}") for a in ACTIONS])


@query(
    "estimator_pipeline",
    lambda: _analysis_sql(
        f"SELECT a.transaction_id, round(a.p, {P4}) AS fraud_probability, CASE WHEN a.p > 0.5 THEN 1 ELSE 0 END AS fraud_class, round(s.score - o.offset, {P6}) AS anomaly_score "
        f"FROM (SELECT transaction_id, {twins.sigmoid_sql(' + '.join(['rb', *(f'r{j} * CAST({f} AS DOUBLE)' for j, f in enumerate(FEATURES))]))} AS p FROM ({_trained_rows_sql()}) t) a "
        "JOIN scored s ON s.transaction_id = a.transaction_id CROSS JOIN offs o"
    ),
)
def q_estimator_pipeline(spark, sf_dir):
    """P2, P3, A1-A5, M1-M3 as ``pyspark.ml`` stages: a Pipeline fitted, saved, loaded and applied."""
    from pyspark.ml import Pipeline, PipelineModel

    from ..operators.estimators import AnomalyForest, FraudClassifier

    tx = transactions(spark, sf_dir)
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=[FraudClassifier(), AnomalyForest()]).fit(tx).save(path)
    out = PipelineModel.load(path).transform(tx)
    return out.select(ID, round_to("fraud_probability", P4).alias("fraud_probability"), "fraud_class", round_to("anomaly_score", P6).alias("anomaly_score"))
