"""The transactions view's lag under skew: ranges of users' events against a plain window."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from costwise.sources.events import previous_in_user, range_borders
from tests.conftest import SF001

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, k int"


def plain(events):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id", "k")
    return events.withColumn("prev_k", F.lag("k").over(w))


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    """Sixty percent of the events at one user, half of these at one timestamp; null users too."""
    r = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        kind = i % 10
        user = 7 if kind < 6 else None if kind == 6 else r.randrange(200)
        ts = day if kind < 3 else day + dt.timedelta(seconds=r.randrange(100_000))
        rows.append((i, ts, user, r.randrange(100)))
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("ranges", [None, 2, 50, 1000])
def test_hot_user_and_timestamp(hot, ranges):
    assert same(previous_in_user(hot, "k", ranges), plain(hot))


def test_no_range_is_large(spark, hot):
    """The hot user is cut into pieces of about a range each, also inside one timestamp."""
    ranges = 20
    key = ["ts", "event_id", "k", "_row"]
    numbered = hot.withColumn("_row", F.monotonically_increasing_id()).cache()
    borders = range_borders(numbered, key, ranges)
    assert borders.select(F.explode("_borders")).count() <= ranges - 1
    j = numbered.join(borders, F.col("user_id").eqNullSafe(F.col("_user")), "left")
    piece = F.coalesce(F.size(F.filter("_borders", lambda b: b <= F.struct(*key))), F.lit(0))
    largest = j.groupBy("user_id", piece.alias("p")).count().agg(F.max("count")).first()[0]
    assert largest < 3 * hot.count() / ranges


def test_rows_equal_in_everything(spark):
    """A third of all rows are one and the same event: they follow each other, and are cut too."""
    day = dt.datetime(2024, 1, 1)
    rows = [(5, day, 1, 42)] * 500 + [(i, day + dt.timedelta(hours=i), 1 + i % 3, i % 100) for i in range(1000)]
    events = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    assert same(previous_in_user(events, "k", 12), plain(events))
    numbered = events.withColumn("_row", F.monotonically_increasing_id()).cache()
    inside = [b for r in range_borders(numbered, ["ts", "event_id", "k", "_row"], 12).collect() for b in r._borders if b.event_id == 5]
    assert len(inside) >= 2


def test_nulls_and_empty(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(None, None, 1, None), (1, None, 1, 5), (2, day, 1, None), (3, day, 1, 7), (None, day, None, 9), (4, day, None, None)] * 3
    events = spark.createDataFrame(rows, SCHEMA)
    for ranges in (1, 3, 18):
        assert same(previous_in_user(events, "k", ranges), plain(events))
    assert previous_in_user(events.limit(0), "k", 4).collect() == []


def test_columns_stay(spark):
    events = spark.read.parquet(f"{SF001}/events.parquet").withColumn("k", F.lit(1))
    assert previous_in_user(events, "k").columns == [*events.columns, "prev_k"]
