"""Golden values (FIXTURES F1, F2, F4): the service's stated model on its ten training rows."""

import math

import pytest
from pyspark.sql import functions as F

from costwise.operators import classifier as clf
from costwise.operators import decision as dec
from costwise.operators import explain as expl
from costwise.schema import FEATURES
from costwise.sources.readers import read_transactions

# The ten training rows of the service.
CSV = """transaction_id,amount,transaction_time,location_change,device_change,merchant_risk,is_fraud
1,1200,14,0,0,0.1,0
2,45000,2,1,1,0.8,1
3,300,10,0,0,0.05,0
4,89000,1,1,1,0.9,1
5,1500,16,0,0,0.2,0
6,67000,23,1,0,0.7,1
7,220,11,0,0,0.03,0
8,54000,3,1,1,0.85,1
9,1800,18,0,0,0.15,0
10,76000,0,1,1,0.95,1
"""

# id -> (p, phi amount, phi hour, phi loc, phi dev, phi risk, decision, top 3)
GOLDEN = {
    1: (0.073930, 0.001686, -0.013464, 0, 0, 0.012907, "review", ["transaction_time", "merchant_risk", "amount"]),
    2: (0.910893, 0.151171, -0.004158, 0.283672, 0.140570, 0.266836, "block", ["location_change", "merchant_risk", "amount"]),
    3: (0.070137, 0.000410, -0.009362, 0, 0, 0.006287, "review", ["transaction_time", "merchant_risk", "amount"]),
    4: (0.968741, 0.283269, -0.001772, 0.237372, 0.118854, 0.258217, "block", ["amount", "merchant_risk", "location_change"]),
    5: (0.086222, 0.002275, -0.016648, 0, 0, 0.027794, "review", ["merchant_risk", "transaction_time", "amount"]),
    6: (0.806113, 0.249868, -0.050050, 0.295033, 0, 0.238461, "block", ["location_change", "amount", "merchant_risk"]),
    7: (0.066722, 0.000294, -0.010060, 0, 0, 0.003687, "review", ["transaction_time", "merchant_risk", "amount"]),
    8: (0.930239, 0.178599, -0.006000, 0.272794, 0.135330, 0.276716, "block", ["merchant_risk", "location_change", "amount"]),
    9: (0.077468, 0.002592, -0.017761, 0, 0, 0.019835, "review", ["merchant_risk", "transaction_time", "amount"]),
    10: (0.963552, 0.239578, 0, 0.244305, 0.122028, 0.284840, "block", ["merchant_risk", "location_change", "amount"]),
}


@pytest.fixture(scope="module")
def csv_table(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    (d / "ten_rows.csv").write_text(CSV)
    return read_transactions(spark, str(d / "ten_rows.csv"))


@pytest.fixture(scope="module")
def model(csv_table):
    return clf.fit_logistic(csv_table)


@pytest.mark.parametrize("solver", ["newton", "lbfgs"])
def test_scaler_and_fit(csv_table, solver):
    model = clf.fit_logistic(csv_table, solver=solver)
    assert model.mean == pytest.approx((33602, 9.8, 0.5, 0.4, 0.473))
    assert model.scale == pytest.approx((34413.8408, 7.61314652, 0.5, 0.489897949, 0.374647835), rel=1e-8)
    assert model.coef == pytest.approx((0.708468, -0.10728595, 0.79494077, 0.42494906, 0.70878793), abs=1e-5)
    assert model.intercept == pytest.approx(0.04598274, abs=1e-5)
    assert model.raw_intercept == pytest.approx(-2.54443705, abs=1e-5)


def test_gradient_vanishes(csv_table, model):
    g = clf.objective_gradient(csv_table, model).first()
    assert max(abs(v) for v in g) < 1e-9


def test_probability_decision_attribution(csv_table, model):
    df = clf.predict_proba(csv_table, model)
    df = dec.choose_action(expl.shapley_linear(df, model))
    rows = df.select("transaction_id", "fraud_probability", "decision", *[f"phi_{f}" for f in FEATURES], expl.top_features().alias("top")).collect()
    assert len(rows) == 10
    for r in rows:
        g = GOLDEN[r["transaction_id"]]
        assert r["fraud_probability"] == pytest.approx(g[0], abs=1e-5)
        assert [r[f"phi_{f}"] for f in FEATURES] == pytest.approx(list(g[1:6]), abs=1e-5)
        assert r["decision"] == g[6]
        assert list(r["top"]) == g[7]


def test_baseline_probability(model):
    assert 1 / (1 + math.exp(-model.raw_intercept)) == pytest.approx(0.0728011, abs=1e-6)


def test_form_defaults_request(spark, model):
    """FIXTURES F2: the dashboard's default request."""
    row = [(1, 5000.0, 12, 0, 0, 0.2)]
    df = spark.createDataFrame(row, "transaction_id long, amount double, transaction_time int, location_change int, device_change int, merchant_risk double")
    df = dec.choose_action(expl.shapley_linear(clf.predict_proba(df, model), model))
    r = df.select("fraud_probability", "decision", *[f"phi_{f}" for f in FEATURES], expl.explanation().alias("text")).first()
    assert r["fraud_probability"] == pytest.approx(0.096893, abs=1e-5)
    assert r["decision"] == "review"
    assert [r[f"phi_{f}"] for f in FEATURES] == pytest.approx([0.007996, -0.013186, 0, 0, 0.029282], abs=1e-5)
    assert r["text"] == "Transaction flagged primarily due to: merchant risk impact, transaction time impact, amount impact."


@pytest.mark.parametrize(
    "p, expected",
    [(0.0, "approve"), (0.01, "approve"), (0.02, "approve"), (1 / 21, "review"), (0.3, "review"), (0.6, "block"), (0.61, "block"), (1.0, "block")],
)
def test_decision_edges(spark, p, expected):
    df = spark.createDataFrame([(p,)], "fraud_probability double")
    assert dec.choose_action(df).first()["decision"] == expected


def test_decision_rejects_null_and_nan(spark):
    for v in (None, float("nan")):
        df = spark.createDataFrame([(v,)], "fraud_probability double")
        with pytest.raises(Exception, match="undecidable row"):
            dec.choose_action(df).collect()


def test_unknown_action(spark):
    with pytest.raises(ValueError, match="no cost is defined for the action"):
        dec.CostParams()(F.lit(0.5), "escalate")
    df = spark.createDataFrame([(0.5, "escalate")], "p double, a string")
    with pytest.raises(Exception, match="no cost is defined for the action"):
        df.select(dec.cost_of(F.col("p"), F.col("a"))).collect()


def test_one_class_fit_fails(spark):
    df = spark.createDataFrame([(i, float(i), 1, 0, 0, 0.1, 0) for i in range(5)], "transaction_id long, amount double, transaction_time int, location_change int, device_change int, merchant_risk double, is_fraud int")
    with pytest.raises(ValueError, match="both classes"):
        clf.fit_logistic(df)


def test_best_cost_map_and_terminal(spark):
    df = spark.createDataFrame([(0.3,)], "fraud_probability double")
    r = dec.choose_action(df, with_costs=True).select("decision", "costs", dec.is_terminal(F.col("decision")).alias("done")).first()
    assert r["costs"] == pytest.approx({"approve": 300.0, "block": 35.0, "review": 20.0})
    assert r["decision"] == "review" and r["done"] is True


def test_custom_cost_function(spark):
    def cost(p, action):
        # Reviews cost 500: the cheaper of approve and block always wins.
        return dec.CostParams(review_cost=500.0)(p, action)

    df = spark.createDataFrame([(0.02,), (0.3,), (0.9,)], "fraud_probability double")
    assert [r["decision"] for r in dec.choose_action(df, cost=cost).collect()] == ["approve", "block", "block"]


def test_request_response_end_to_end(spark, csv_table):
    """Train on the ten rows, then answer the dashboard's default request (F2)."""
    from costwise.plans.analyze import analyze_records, train

    models = train(csv_table)
    good = {"transaction_id": 1, "amount": 5000.0, "transaction_time": 12, "location_change": 0, "device_change": 0, "merchant_risk": 0.2}
    bad = {**good, "transaction_time": "12.5"}
    responses, rejected = analyze_records(spark, [good, bad], models)
    r = responses.first()
    assert responses.count() == 1
    assert r["fraud_probability"] == 0.0969
    assert r["decision"] == "review"
    assert r["explanation"] == "Transaction flagged primarily due to: merchant risk impact, transaction time impact, amount impact."
    assert r["feature_contributions"] == pytest.approx({"amount": 0.007996, "transaction_time": -0.013186, "location_change": 0.0, "device_change": 0.0, "merchant_risk": 0.029282}, abs=1e-5)
    assert -1.0 < r["anomaly_score"] < 1.0 and round(r["anomaly_score"], 4) == r["anomaly_score"]
    assert [x["reject_reason"] for x in rejected.collect()] == ["transaction_time is not an integer: 12.5"]
    # the forest on ten rows: psi = 10, every tree holds all rows, 2 of 10 flagged
    assert models.forest.psi == 10
    from costwise.operators.forest import anomaly_score

    flagged = anomaly_score(csv_table, models.forest).filter(F.col("anomaly_score") < 0).count()
    assert flagged == 2
