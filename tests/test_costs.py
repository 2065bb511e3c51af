"""Actions and costs as data, proposals, and rows without a decision."""

import random

import pytest

from costwise.operators import decision as dec

COSTS = "segment string, action string, rank int, if_fraud double, if_clean double, fixed double"


def offers():
    return [
        ("a", "approve", 0, 1000.0, None, None),
        ("a", "block", 1, None, 50.0, None),
        ("a", "review", 2, None, None, 20.0),
        ("a", "review", 2, None, None, 18.0),  # a second offer for one action
        ("a", "review", 2, None, None, 18.0),
        ("b", "approve", 0, 10.0, 0.0, 0.0),
        ("b", "wait", 5, 0.0, 0.0, 10.0),
        (None, "block", 1, 0.0, 0.0, 1.0),
        ("c", None, 0, 1.0, 1.0, 1.0),
    ]


def plain(segment, p):
    best = {}
    for s, a, r, f, c, x in offers():
        if s == segment and a is not None:
            cost = p * (f or 0.0) + (1 - p) * (c or 0.0) + (x or 0.0)
            best[a] = min(best.get(a, (float("inf"), 0, "")), (cost, r, a))
    return (min(best.values())[2] if best else None), {a: v[0] for a, v in best.items()}


@pytest.mark.parametrize("limit", [dec.BROADCAST_COSTS, 0])
def test_costs_by_segment(spark, limit):
    rows = [(i, s, p) for i, (s, p) in enumerate((s, p) for s in ("a", "b", "c", "none", None) for p in (0.0, 0.01, 0.018, 0.3, 0.64, 0.7, 1.0))] * 2  # repeated ids
    df = spark.createDataFrame(rows, "transaction_id long, segment string, fraud_probability double")
    out = dec.choose_by_table(df, spark.createDataFrame(offers(), COSTS), broadcast_rows=limit)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["transaction_id", "segment", "fraud_probability", "decision", "best_cost", "costs"]
    for r in got:
        decision, costs = plain(r.segment, r.fraud_probability)
        assert r.decision == decision, r
        assert (r.costs or {}) == pytest.approx(costs)
        assert r.best_cost == (pytest.approx(min(costs.values())) if costs else None)


def test_default_costs_as_a_table(spark):
    """The three fixed actions written as a table decide as ``choose_action`` does, ties included."""
    table = spark.createDataFrame([("x", "approve", 0, 1000.0, 0.0, 0.0), ("x", "block", 1, 0.0, 50.0, 0.0), ("x", "review", 2, 0.0, 0.0, 20.0)], COSTS)
    df = spark.createDataFrame([("x", p) for p in (0.0, 0.01, 0.02, 1 / 21, 0.3, 0.6, 0.61, 1.0)], "segment string, fraud_probability double")
    rows = dec.choose_action(dec.choose_by_table(df, table, out="by_table")).collect()
    assert [r.by_table for r in rows] == [r.decision for r in rows]
    with pytest.raises(Exception, match="undecidable"):
        dec.choose_by_table(df.selectExpr("segment", "CAST('NaN' AS DOUBLE) AS fraud_probability"), table).collect()


def test_cheapest_proposals(spark):
    r = random.Random(2)
    rows = [(k, r.choice("xyz"), r.randrange(3), float(r.randrange(6))) for k in [1] * 400 + [2] * 30 + [None] * 20]
    rows += [(3, "x", 1, None), (4, "x", 1, float("nan")), (4, "y", 1, 2.0), (5, None, 1, 1.0)]
    df = spark.createDataFrame(rows, "key int, action string, rank int, cost double").repartition(6)
    got = {row.key: row for row in dec.cheapest_proposals(df, ("key",)).collect()}
    known = [x for x in rows if x[3] is not None and x[3] == x[3] and x[1] is not None]
    assert set(got) == {x[0] for x in known}
    for key, row in got.items():
        mine = [(c, k, a) for kk, a, k, c in known if kk == key]
        assert (row.best_cost, row.decision) == (min(mine)[0], min(mine)[2])
        assert row.costs == {a: min(c for c, _, b in mine if b == a) for a in {m[2] for m in mine}}


def test_rejects_instead_of_failures(spark):
    df = spark.createDataFrame([(0.01,), (0.3,), (0.9,), (None,), (float("nan"),), (1.5,), (-0.5,), (float("inf"),)], "fraud_probability double")
    got = [(r.decision, r.reject_reason) for r in dec.decide_or_reject(df).collect()]
    assert got == [
        ("approve", None),
        ("review", None),
        ("block", None),
        (None, "fraud probability is null"),
        (None, "fraud probability is not a number"),
        (None, "fraud probability is outside [0, 1]: 1.5"),
        (None, "fraud probability is outside [0, 1]: -0.5"),
        (None, "fraud probability is outside [0, 1]: Infinity"),
    ]
