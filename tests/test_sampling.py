"""The forest's sample: one pass, one rule for every row, and what a repeated row changes."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from costwise.operators import forest as fst
from costwise.schema import FEATURES, ID
from costwise.sources.events import transactions_from_events
from tests.conftest import SF001


@pytest.fixture(scope="module")
def tx(spark):
    return transactions_from_events(spark.read.parquet(f"{SF001}/events.parquet")).cache()


def rows_by_tree(sample):
    out = {}
    for r in sample.collect():
        out.setdefault(r.tree, []).append(tuple(r))
    return {t: sorted(v) for t, v in out.items()}


def test_fit_moves_candidates_only(spark, executed):
    """Over the whole of ``fit_forest``, no exchange has the table below it: the counts are combined into
    one row a task, the sample's exchange lies above the keys' test, the offset's above its histogram."""
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet").selectExpr("event_id AS transaction_id", *[f"value AS {f}" for f in FEATURES])
    plans = executed(lambda: fst.fit_forest(df))
    text = "\n".join(plans)
    assert "MapInPandas" in text and "FlatMapGroupsInPandas" in text
    kinds = set(re.findall(r"Arguments: (hashpartitioning\([a-z_]+|SinglePartition|rangepartitioning\([a-z_]+)", text))
    assert {"SinglePartition", "hashpartitioning(tree"} <= kinds  # what the pattern finds
    assert kinds <= {"SinglePartition", "hashpartitioning(tree", "hashpartitioning(b", "hashpartitioning(_groupingexpression", "hashpartitioning(v"}, kinds
    assert "hashpartitioning(transaction_id" not in text
    sampled = next(p for p in plans if "MapInPandas" in p)
    assert sampled.count("Exchange") and sampled.index("MapInPandas") < sampled.index("Exchange", sampled.index("MapInPandas"))


def test_one_repeated_row_changes_the_trees_it_enters(spark, tx):
    """One row twice: every tree keeps its rows, but for those that the second copy enters."""
    n_trees, psi = 100, 64
    before = rows_by_tree(fst.forest_sample(tx, n_trees, psi)[0])
    again = tx.unionByName(tx.filter(F.col(ID) == 17))
    # the copy is the second of its partition
    after = rows_by_tree(fst.forest_sample(again.coalesce(1), n_trees, psi)[0])
    changed = [t for t in range(n_trees) if before[t] != after[t]]
    for t in changed:
        entered = [r for r in after[t] if after[t].count(r) > before[t].count(r)]
        assert len(entered) == 1 and entered[0][1] == 17
    # a copy enters a tree with probability 64 / 1001
    assert len(changed) <= 20


def test_every_row_has_the_same_chance(spark):
    """Shares of the sample equal shares of the table, whether rows repeat in a task, across tasks, or not."""
    unique = spark.range(0, 2000).selectExpr("id AS transaction_id", "CAST(id % 97 AS DOUBLE) AS amount")
    copies = spark.range(0, 1000).selectExpr("5000 AS transaction_id", "CAST(1 AS DOUBLE) AS amount")
    spread = spark.range(0, 1000).selectExpr("6000 + id % 50 AS transaction_id", "CAST(2 AS DOUBLE) AS amount")
    table = unique.unionByName(copies).unionByName(spread)
    table = table.repartition(4).withColumns({f: F.lit(0.0) for f in FEATURES if f != "amount"})
    sample, psi = fst.forest_sample(table, 100, 128)
    got = {r.kind: r.n for r in sample.groupBy(F.when(F.col(ID) < 5000, "unique").when(F.col(ID) == 5000, "copies").otherwise("spread").alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = 100 * psi
    assert sum(got.values()) == total
    assert abs(got["unique"] / total - 0.5) < 0.03 and abs(got["copies"] / total - 0.25) < 0.03 and abs(got["spread"] / total - 0.25) < 0.03


def test_sample_of_named_keys_does_not_depend_on_partitions(spark, tx):
    view = tx.withColumn(ID, F.expr(f"{ID} div 4")).withColumn("event", F.monotonically_increasing_id()).cache()
    a, _ = fst.forest_sample(view, 10, 64, row_key=("event",))
    b, _ = fst.forest_sample(view.repartition(9), 10, 64, row_key=("event",))
    c, _ = fst.forest_sample(view, 10, 64)
    d, _ = fst.forest_sample(view.repartition(9), 10, 64)
    assert rows_by_tree(a) == rows_by_tree(b) and rows_by_tree(c) == rows_by_tree(d) and rows_by_tree(a) != rows_by_tree(c)


def test_copies_are_numbered_across_batches():
    """Runs of equal rows that go over batch borders: the first keeps its numbers, every further one has its own."""
    h1 = np.repeat([3, 3, 8, 9], [4, 3, 1, 5])
    h2 = np.repeat([1, 2, 1, 1], [4, 3, 1, 5])
    whole = fst.Copies(5)(h1, h2)
    cut = fst.Copies(5)
    parts = [cut(h1[i:j], h2[i:j]) for i, j in ((0, 1), (1, 6), (6, 9), (9, 13))]
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts), whole))
    pairs = list(zip(*whole))
    assert len(set(pairs)) == len(pairs)
    assert [pairs[i] for i in (0, 4, 7, 8)] == [(3, 1), (3, 2), (8, 1), (9, 1)]
    assert set(zip(*fst.Copies(6)(h1, h2))) & set(pairs) == {(3, 1), (3, 2), (8, 1), (9, 1)}


def test_a_task_holds_no_more_than_psi_rows_a_tree():
    r = np.random.default_rng(1)
    held = fst.Smallest(3, 4)
    rows = pd.DataFrame({"tree": r.integers(0, 3, 500), "_key": r.integers(0, 90, 500), "_h1": np.arange(500), "_h2": 0})
    for i in range(0, 500, 50):
        held.add(rows.iloc[i : i + 50])
        assert held.size <= 2 * 3 * 4 + 50
    got = held.prune()
    want = rows.sort_values(["tree", "_key", "_h1"]).groupby("tree").head(4)
    assert got[["tree", "_h1"]].values.tolist() == want[["tree", "_h1"]].values.tolist()
    assert fst.Smallest(3, 4).prune() is None


def test_walk_without_python_workers(spark, tx):
    """The column expressions give the same bits as the numpy walk, in a plan without Python; constant data and all."""
    for table, psi in ((tx, 64), (tx.limit(3), 256), (tx.withColumns({f: F.lit(1.0) for f in FEATURES}), 16)):
        forest = fst.fit_forest(table, n_trees=7, max_samples=psi)
        a = table.select(ID, fst.score_samples(forest, spark).alias("s"))
        b = table.select(ID, fst.score_samples(forest, spark, engine="jvm").alias("s"))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan
    with pytest.raises(ValueError, match="engine"):
        fst.score_samples(forest, spark, engine="gpu")


def test_whole_tables_are_walked_in_compiled_steps(spark, tx):
    """The walk of a table gives the numpy walk's bits, and only the sum of the paths is a fold."""
    for table, psi in ((tx, 64), (tx.limit(3), 256), (tx.withColumns({f: F.lit(1.0) for f in FEATURES}), 16)):
        forest = fst.fit_forest(table, n_trees=7, max_samples=psi)
        a = table.select(ID, fst.mean_path(forest, spark).alias("m"))
        walked = fst.with_mean_path_jvm(table, forest, "m")
        assert walked.columns == [*table.columns, "m"]
        b = walked.select(ID, "m")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "transform(" not in plan and plan.count("aggregate(") == 1
        scores = [r["s"] for r in fst.anomaly_score(table, forest, "s", engine="jvm").orderBy(ID).collect()]
        assert scores == [r["s"] for r in fst.anomaly_score(table, forest, "s").orderBy(ID).collect()]


def test_leaf_sets_give_the_walk(monkeypatch):
    """The same path lengths as step by step, at thresholds, NaN and infinities too, in one group, in several, and for forests too large for sets."""
    r = np.random.default_rng(3)
    for psi, n_trees in ((256, 9), (64, 3), (1, 2)):
        rows = [row for t in range(n_trees) for row in fst.grow_tree(np.c_[r.normal(size=psi), r.integers(0, 3, psi), np.ones(psi)], t, 42, fst.depth_limit(psi))]
        f = fst.Forest.from_nodes(pd.DataFrame(rows, columns=fst.NODE_SCHEMA.names), n_trees, psi, ("a", "b", "c"))
        cuts = f.threshold[f.feature == 0]
        X = np.c_[np.r_[cuts, np.nan, np.inf, -np.inf, r.normal(size=2000)], r.integers(-1, 4, len(cuts) + 2003), np.ones(len(cuts) + 2003)]
        want = fst.path_lengths(X, f.feature, f.threshold, f.path, f.max_depth)
        for size, groups in ((16 << 20, 1), (1 << 17, None), (1, 0)):
            monkeypatch.setattr(fst, "LEAF_SET_BYTES", size)
            walk = fst.TreeWalk(f.feature, f.threshold, f.path, f.max_depth)
            assert (walk(X) == want).all() and (walk.mean(X) == fst.mean_of_paths(want)).all()
            assert groups is None or len(walk.groups) == groups
        assert walk.mean(X[:0]).shape == (0,)
