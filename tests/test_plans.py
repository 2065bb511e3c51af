"""Physical-plan checks: scoring is one narrow stage, scans are pruned."""

import pytest

from costwise.operators import forest as fst
from costwise.plans.analyze import Models, analyze
from costwise.plans.pinned import PINNED_CLASSIFIER
from costwise.sources.events import transactions_from_events
from costwise.sources.readers import read_transactions
from tests.conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tx_parquet(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tx") / "tx")
    transactions_from_events(spark.read.parquet(f"{SF001}/events.parquet")).write.parquet(path)
    return read_transactions(spark, path, fmt="parquet")


def test_analyze_has_no_shuffle(tx_parquet):
    models = Models(PINNED_CLASSIFIER, fst.fit_forest(tx_parquet, n_trees=10, max_samples=64))
    p = plan(analyze(tx_parquet, models))
    assert "Exchange" not in p
    assert p.count("ArrowEvalPython") == 1
    assert "is_fraud" not in p.split("ReadSchema")[1].split("\n")[0]


def test_view_shuffles_the_events_once(spark):
    """One shuffle of the events, by user and piece, which the second branch reuses; the other
    exchange is above the filter to the border rows of users that were cut; no join but the borders' broadcast."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(transactions_from_events(spark.read.parquet(f"{SF001}/events.parquet"), ranges=4))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "event_type" not in p
    assert p.count("FileScan parquet") == 1
    assert p.count("ReusedExchange") == 1
    # the ReusedExchange node prints the exchange it reuses
    assert p.count("Exchange hashpartitioning(user_id#") - p.count("ReusedExchange") == 2
    assert sum(line.count("hashpartitioning(user_id#") for line in p.splitlines() if "_piece" in line.split("hashpartitioning")[-1]) == 2
    assert "SortMergeJoin" not in p and "ShuffledHashJoin" not in p and p.count("BroadcastHashJoin") == 1


def test_filter_reaches_scan(tx_parquet):
    from pyspark.sql import functions as F

    p = plan(tx_parquet.filter(F.col("amount") > 100).select("transaction_id"))
    assert "PushedFilters: [IsNotNull(amount), GreaterThan(amount,100.0)]" in p


def test_shapley_expressions_share_coalitions(spark, tx_parquet):
    """2^5 coalition sigmoids, the empty one folded: 31 exp calls per row in the
    generated code, however many Shapley terms read them."""
    import re

    from costwise.operators import explain as expl

    df = expl.shapley_linear(tx_parquet, PINNED_CLASSIFIER)
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())
    assert len(re.findall(r"Math\.exp\(", code)) == 31
