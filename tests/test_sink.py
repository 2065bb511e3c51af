"""The stream's sink: both sides of a batch appear together or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from costwise.operators import forest as fst
from costwise.plans.analyze import Models, analyze, flatten_response
from costwise.plans.pinned import PINNED_CLASSIFIER
from costwise.session import scratch_path
from costwise.sources.events import transactions_from_events
from costwise.streaming import stream
from costwise.streaming.stream import analyze_stream, read_sink
from tests.conftest import SF001

COLUMNS = ["transaction_id", "amount", "transaction_time", "location_change", "device_change", "merchant_risk"]


@pytest.fixture(scope="module")
def setup(spark):
    tx = transactions_from_events(spark.read.parquet(f"{SF001}/events.parquet")).cache()
    return tx, Models(PINNED_CLASSIFIER, fst.fit_forest(tx, n_trees=5, max_samples=32))


def bodies(spark, tx, base):
    """Request bodies in six files, some of them broken."""
    amount = F.when(F.col("transaction_id") % 10 == 0, F.lit("lots")).otherwise(F.col("amount").cast("string"))
    tx.select(F.to_json(F.struct("transaction_id", amount.alias("amount"), *COLUMNS[2:])).alias("value")).repartition(6).write.text(f"{base}/in")


def run(spark, base, models, **kw):
    q = analyze_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", models, max_files_per_trigger=2, **kw)
    q.awaitTermination()
    return q


def check_whole(spark, tx, models, base):
    ok = flatten_response(read_sink(spark, f"{base}/out").drop("batch"))
    want = flatten_response(analyze(tx.filter("transaction_id % 10 <> 0"), models))
    assert ok.exceptAll(want).count() == 0 and want.exceptAll(ok).count() == 0
    bad = read_sink(spark, f"{base}/out", "rejected")
    assert sorted(r.transaction_id for r in bad.collect()) == sorted(r[0] for r in tx.filter("transaction_id % 10 = 0").select("transaction_id").collect())
    assert {r.reject_reason for r in bad.collect()} == {"amount is not a number: lots"}
    assert bad.columns == [*COLUMNS, "reject_reason", "batch"]
    assert read_sink(spark, f"{base}/out").select("batch").distinct().count() == 3


def test_crash_before_the_manifest_shows_neither_side(spark, setup, monkeypatch):
    tx, models = setup
    base = scratch_path(spark, "sink-crash")
    bodies(spark, tx, base)
    commit = stream.commit_manifest

    def crash(spark_, sink_dir, entry):
        if entry["batch"] == 1:
            raise RuntimeError("the driver dies here")
        commit(spark_, sink_dir, entry)

    monkeypatch.setattr(stream, "commit_manifest", crash)
    with pytest.raises(Exception, match="dies here"):
        run(spark, base, models)
    # batch 1 has written its rows, but no reader sees them
    assert os.listdir(f"{base}/out/data/batch=1")
    for part in ("accepted", "rejected"):
        assert {r.batch for r in read_sink(spark, f"{base}/out", part).select("batch").distinct().collect()} == {0}
    monkeypatch.setattr(stream, "commit_manifest", commit)
    run(spark, base, models)
    check_whole(spark, tx, models, base)


def test_a_committed_batch_is_not_done_again(spark, setup, monkeypatch):
    """A crash after the manifest, before Spark notes the batch as done: the repeated batch changes nothing."""
    tx, models = setup
    base = scratch_path(spark, "sink-twice")
    bodies(spark, tx, base)
    write = stream.write_batch
    calls = []

    def crash_after(rows, batch_id, sink_dir):
        write(rows, batch_id, sink_dir)
        calls.append(batch_id)
        if calls.count(1) == 1 and batch_id == 1:
            raise RuntimeError("the driver dies here")

    monkeypatch.setattr(stream, "write_batch", crash_after)
    with pytest.raises(Exception, match="dies here"):
        run(spark, base, models)
    folders = os.listdir(f"{base}/out/data/batch=1")
    run(spark, base, models)
    assert calls == [0, 1, 1, 2] and os.listdir(f"{base}/out/data/batch=1") == folders
    check_whole(spark, tx, models, base)


def test_manifests_count_their_rows(spark, setup):
    tx, models = setup
    base = scratch_path(spark, "sink-counts")
    bodies(spark, tx, base)
    run(spark, base, models)
    check_whole(spark, tx, models, base)
    entries = [json.loads(open(f"{base}/out/manifest/{n}").read()) for n in sorted(os.listdir(f"{base}/out/manifest")) if n.endswith(".json")]
    assert [e["batch"] for e in entries] == [0, 1, 2]
    assert sum(e["accepted"] for e in entries) == 900 and sum(e["rejected"] for e in entries) == 100


def test_each_batch_is_read_once(spark, setup, executed):
    """One write a batch, with both sides in it."""
    tx, models = setup
    base = scratch_path(spark, "sink-plan")
    bodies(spark, tx, base)
    plans = executed(lambda: run(spark, base, models))
    writes = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p]
    assert len(writes) == 3 and all("outcome" in p and p.count("Scan text") <= 2 for p in writes)


def test_empty_csv_folder(spark, setup):
    tx, models = setup
    base = scratch_path(spark, "sink-csv")
    os.makedirs(f"{base}/in")
    run(spark, base, models, source_format="csv")
    for part in ("accepted", "rejected"):
        assert read_sink(spark, f"{base}/out", part).count() == 0
    tx.select(*COLUMNS).write.mode("append").option("header", True).csv(f"{base}/in")
    run(spark, base, models, source_format="csv")
    assert read_sink(spark, f"{base}/out").count() == tx.count()
