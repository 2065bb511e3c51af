"""Validation (P4, K2, K7), the response round trip (K5, K6) and the stream (K4)."""

import json

import pytest
from pyspark.sql import functions as F

from costwise.plans.analyze import Models, analyze, display, flatten_response
from costwise.plans.pinned import PINNED_CLASSIFIER
from costwise.operators import forest as fst
from costwise.session import scratch_path
from costwise.sources.events import transactions_from_events
from costwise.sources.readers import from_records, parse_json_requests, response_from_json, response_to_json
from costwise.sources.validate import split_valid, validate
from costwise.streaming.stream import analyze_stream, read_sink
from tests.conftest import SF001

GOOD = {"transaction_id": 1, "amount": 5000.0, "transaction_time": 12, "location_change": 0, "device_change": 0, "merchant_risk": 0.2}


def _bodies():
    bad = [
        ({k: v for k, v in GOOD.items() if k != "amount"}, "missing field amount"),
        ({**GOOD, "merchant_risk": None}, "null merchant_risk"),
        ({**GOOD, "amount": "NaN"}, "amount is not finite"),
        ({**GOOD, "merchant_risk": "Infinity"}, "merchant_risk is not finite"),
        ({**GOOD, "transaction_time": "12.5"}, "transaction_time is not an integer: 12.5"),
        ({**GOOD, "amount": "lots"}, "amount is not a number: lots"),
    ]
    return bad


def test_json_requests_reasons(spark):
    rows = [json.dumps(GOOD), json.dumps({**GOOD, "extra": "ignored"}), json.dumps({**GOOD, "transaction_time": 12.0})]
    rows += [json.dumps(b) for b, _ in _bodies()]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    out = validate(parse_json_requests(df)).collect()
    reasons = [r["reject_reason"] for r in out]
    assert reasons[:3] == [None, None, None]
    assert reasons[3:] == [why for _, why in _bodies()]
    assert out[2]["transaction_time"] == 12


def test_strict_domain(spark):
    recs = [{**GOOD, "transaction_time": 24}, {**GOOD, "location_change": 2}, {**GOOD, "merchant_risk": 1.1}, {**GOOD, "amount": -5}]
    lax = validate(from_records(spark, recs)).collect()
    assert [r["reject_reason"] for r in lax] == [None] * 4
    strict = validate(from_records(spark, recs), strict_domain=True).collect()
    assert [r["reject_reason"] for r in strict] == [
        "transaction_time out of range [0, 23]",
        "location_change out of range [0, 1]",
        "merchant_risk out of range [0.0, 1.0]",
        None,
    ]


def test_split_keeps_duplicates(spark):
    df = validate(from_records(spark, [GOOD, GOOD, {**GOOD, "amount": None}]))
    ok, bad = split_valid(df)
    assert ok.count() == 2 and bad.count() == 1
    assert "reject_reason" not in ok.columns


@pytest.fixture(scope="module")
def setup(spark):
    tx = transactions_from_events(spark.read.parquet(f"{SF001}/events.parquet")).cache()
    models = Models(PINNED_CLASSIFIER, fst.fit_forest(tx, n_trees=10, max_samples=64))
    return tx, models


def test_response_round_trip(setup):
    tx, models = setup
    resp = analyze(tx, models)
    assert [f.name for f in resp.schema.fields] == ["transaction_id", "fraud_probability", "anomaly_score", "decision", "explanation", "feature_contributions"]
    back = response_to_json(resp).select(response_from_json("response").alias("r")).select("r.*")
    assert flatten_response(back).exceptAll(flatten_response(resp)).count() == 0
    first = json.loads(response_to_json(resp).first()["response"])
    assert set(first["feature_contributions"]) == set(["amount", "transaction_time", "location_change", "device_change", "merchant_risk"])


def test_analyze_empty(spark, setup):
    _, models = setup
    empty = spark.createDataFrame([], "transaction_id long, amount double, transaction_time int, location_change int, device_change int, merchant_risk double")
    assert analyze(empty, models).count() == 0


def test_display(setup):
    tx, models = setup
    d = display(analyze(tx, models)).first()
    assert d["probability_text"].endswith("%") and d["decision_label"].split()[1] in ("APPROVE", "REVIEW", "BLOCK")


def test_models_save_load(spark, setup):
    tx, models = setup
    path = scratch_path(spark, "models")
    models.save(spark, path)
    loaded = Models.load(spark, path)
    a = flatten_response(analyze(tx, models))
    b = flatten_response(analyze(tx, loaded))
    assert a.exceptAll(b).count() == 0


def test_stream_equals_batch(spark, setup):
    tx, models = setup
    base = scratch_path(spark, "stream-test")
    bodies = tx.select(F.to_json(F.struct("transaction_id", "amount", "transaction_time", "location_change", "device_change", "merchant_risk")).alias("value"))
    bad = spark.createDataFrame([(json.dumps({**GOOD, "amount": "lots"}),)], "value string")
    bodies.unionByName(bad).repartition(4).write.text(f"{base}/in")
    q = analyze_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", models, max_files_per_trigger=2)
    q.awaitTermination()
    assert q.exception() is None
    streamed = flatten_response(read_sink(spark, f"{base}/out").drop("batch"))
    batch = flatten_response(analyze(tx, models))
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0
    rejected = read_sink(spark, f"{base}/out", "rejected").collect()
    assert [r["reject_reason"] for r in rejected] == ["amount is not a number: lots"]
    assert read_sink(spark, f"{base}/out").select("batch").distinct().count() >= 2


def test_contributions_table_matches_columns(setup):
    from costwise.operators import explain as expl
    from costwise.plans.analyze import score

    tx, models = setup
    from_map = expl.contributions_table(analyze(tx, models))
    from_cols = expl.contributions_long(score(tx, models))
    assert from_map.exceptAll(from_cols).count() == 0 and from_map.count() == 5 * tx.count()


def test_write_responses_json(spark, setup):
    from costwise.sources.readers import write_responses
    from costwise.schema import RESPONSE

    tx, models = setup
    path = scratch_path(spark, "responses")
    resp = analyze(tx, models)
    write_responses(resp, path)
    back = spark.read.schema(RESPONSE).json(path)
    assert flatten_response(back).exceptAll(flatten_response(resp)).count() == 0


def test_baseline_row(spark, setup):
    from costwise.operators import explain as expl
    from costwise.sources.readers import baseline_row
    from costwise.schema import FEATURES

    tx, _ = setup
    base_df = spark.createDataFrame([(10.0, 12, 0, 0, 0.5)], "amount double, transaction_time int, location_change int, device_change int, merchant_risk double")
    base = baseline_row(base_df, FEATURES)
    a = expl.shapley_linear(tx, PINNED_CLASSIFIER, base)
    b = expl.shapley_values(tx, expl.linear_predictor(PINNED_CLASSIFIER), FEATURES, base)
    j = a.alias("a").join(b.alias("b"), "transaction_id")
    worst = j.select(F.greatest(*[F.abs(F.col(f"a.phi_{f}") - F.col(f"b.phi_{f}")) for f in FEATURES]).alias("d")).agg(F.max("d")).first()[0]
    assert worst < 1e-12
    # features at the baseline value get exactly 0
    assert a.filter((F.col("transaction_time") == 12) & (F.col("phi_transaction_time") != 0)).count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_stream_typed_sources(spark, setup, fmt):
    tx, models = setup
    base = scratch_path(spark, f"stream-{fmt}")
    cols = ["transaction_id", "amount", "transaction_time", "location_change", "device_change", "merchant_risk"]
    writer = tx.select(*cols).repartition(3).write
    if fmt == "csv":
        writer.option("header", True).csv(f"{base}/in")
    else:
        writer.format(fmt).save(f"{base}/in")
    q = analyze_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", models, source_format=fmt)
    q.awaitTermination()
    assert q.exception() is None
    streamed = flatten_response(read_sink(spark, f"{base}/out").drop("batch"))
    assert streamed.exceptAll(flatten_response(analyze(tx, models))).count() == 0
    assert streamed.count() == tx.count()


def test_train_checkpoint_equals_persist(spark):
    from costwise.plans.analyze import train

    tx = transactions_from_events(spark.read.parquet(f"{SF001}/events.parquet"))
    a = train(tx, n_trees=10, max_samples=64)
    b = train(tx, n_trees=10, max_samples=64, stage="checkpoint")
    # sums follow the partitioning, so the fits agree to rounding only
    for x, y in ((a.classifier.mean, b.classifier.mean), (a.classifier.coef, b.classifier.coef)):
        assert x == pytest.approx(y, rel=1e-9)
    assert (a.forest.feature == b.forest.feature).all() and a.forest.offset == b.forest.offset


def test_select_features(spark):
    from costwise.schema import FEATURES
    from costwise.sources.readers import select_features

    df = validate(from_records(spark, [GOOD]))
    out = select_features(df, FEATURES)
    assert out.columns == list(FEATURES)
    assert all(t == "double" for _, t in out.dtypes)


def test_stream_restart_processes_new_files_once(spark, setup):
    """A second run from the same checkpoint picks up only files added since."""
    tx, models = setup
    base = scratch_path(spark, "stream-restart")
    cols = ["transaction_id", "amount", "transaction_time", "location_change", "device_change", "merchant_risk"]
    first = tx.filter(F.col("transaction_id") < 500).select(*cols)
    second = tx.filter(F.col("transaction_id") >= 500).select(*cols)
    first.write.parquet(f"{base}/in/part=1")
    q = analyze_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", models, source_format="parquet")
    q.awaitTermination()
    assert read_sink(spark, f"{base}/out").count() == first.count()
    second.write.parquet(f"{base}/in/part=2")
    q = analyze_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", models, source_format="parquet")
    q.awaitTermination()
    out = flatten_response(read_sink(spark, f"{base}/out").drop("batch"))
    assert out.count() == tx.count()
    assert out.exceptAll(flatten_response(analyze(tx, models))).count() == 0


def test_numbers_are_decimal_literals(spark):
    rows = [json.dumps({**GOOD, "amount": a}) for a in ("1d", "5f", "0x1p3", "1e3", ".5", "-2.")]
    out = [(r.amount, r.reject_reason) for r in validate(parse_json_requests(spark.createDataFrame([(x,) for x in rows], "value string"), "value")).collect()]
    assert [a for a, _ in out] == [None, None, None, 1000.0, 0.5, -2.0]
    assert [bool(r) for _, r in out] == [True, True, True, False, False, False]


def test_overflow_is_a_reason_not_a_failure(spark):
    bodies = [json.dumps({**GOOD, "transaction_time": 99999999999}), json.dumps({**GOOD, "transaction_id": 10**30})]
    out = validate(parse_json_requests(spark.createDataFrame([(x,) for x in bodies], "value string"), "value")).collect()
    assert [r.reject_reason for r in out] == ["transaction_time is not an integer: 99999999999", f"transaction_id is not an integer: {10**30}"]


def test_malformed_bodies_keep_their_text(spark):
    out = validate(parse_json_requests(spark.createDataFrame([('{"a": ',), ("",), ("[1]",)], "value string"), "value")).collect()
    assert [r.reject_reason for r in out] == ['malformed body: {"a": ', "malformed body: ", "malformed body: [1]"]


def test_csv_columns_go_by_name(spark):
    from costwise.sources.readers import read_transactions

    path = scratch_path(spark, "test-csv")
    spark.createDataFrame([(0.1, "note", 1200.0, 1, 13, 0, 1, 0), (0.2, "note", None, 2, 14, 0, 1, 1)], "merchant_risk double, note string, amount double, transaction_id long, transaction_time int, location_change int, device_change int, is_fraud int").coalesce(1).write.option("header", True).csv(path)
    got = {r.transaction_id: r for r in read_transactions(spark, path).collect()}
    assert (got[1].amount, got[1].merchant_risk, got[1].transaction_time) == (1200.0, 0.1, 13) and got[2].amount is None
    with pytest.raises(ValueError, match="no column"):
        spark.createDataFrame([(1,)], "transaction_id long").write.option("header", True).csv(f"{path}-less")
        read_transactions(spark, f"{path}-less")


def test_empty_stream_gives_no_rows(spark, setup):
    _, models = setup
    base = scratch_path(spark, "empty-stream")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/in")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    analyze_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", models).awaitTermination()
    for part in ("accepted", "rejected"):
        assert read_sink(spark, f"{base}/out", part).count() == 0


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from costwise.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=context))


def test_a_body_is_parsed_and_checked_once(spark):
    """One JSON parse a body and one number test a field, though filter, reasons and outputs read them."""
    from costwise.sources.readers import parse_json_requests
    from costwise.sources.validate import split_valid, validate

    bodies = spark.range(3).selectExpr("""concat('{"transaction_id": ', id, ', "amount": 1.5}') AS value""")
    ok, bad = split_valid(validate(parse_json_requests(bodies), strict_domain=True))
    for side in (ok, bad):
        optimized = side._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.count("from_json(") == 1 and optimized.count("json_object_keys(") <= 1
    assert bad.count() == 3 and ok.count() == 0
