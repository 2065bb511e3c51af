"""The transactions view over the ``events`` table (synthetic proxies).

``events`` carries no transactions, so we derive the service's seven
columns from it. The change flags, merchant risk and fraud label are
*synthetic proxies* with a learnable signal and 5 % label noise; they are
not real fraud data.

The only operator with a key here is ``lag`` per user. A single user may
hold a third of all events, even at one timestamp, so the window is not
partitioned by user alone: the users' events, in order, are cut into ranges
of about equal size. A range border inside a user cuts that user into pieces;
``lag`` runs inside each piece, and the first row of a piece takes the last
value of the piece before it from a small second window. The result equals a
plain ``lag`` over the whole user, but no task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ID, LABEL

# Fixed values of the proxy mapping: value range of k is 0..99.
LOCATION_BAND = 25  # k // 25 is the "location"
RISK_DIVISOR = 100.0  # merchant_risk = k / 100
NOISE_MULTIPLIER = 7919  # label noise: (id * 7919) mod 100 < 5
NOISE_PERCENT = 5
RULE_AMOUNT_DIVISOR = 50.0
RULE_NIGHT_HOUR = 6
RULE_THRESHOLD = 4.0


#: Sampled rows per range, from which the range borders are taken.
SAMPLE_PER_RANGE = 20
#: Ranges at most, so that the borders (and their sample, on the driver) stay small.
MAX_RANGES = 10_000


def range_borders(events: DataFrame, key: list[str], ranges: int) -> DataFrame:
    """(user_id, borders): for every user that a range border falls into, the borders in ascending order.

    Borders are the (user, key) of every 20th row of an even sample of about
    20 rows a range, ``ranges`` - 1 of them in all. They decide where the work
    is cut, never what comes out.
    """
    schema = T.StructType([T.StructField("_user", events.schema["user_id"].dataType), T.StructField("_borders", T.ArrayType(T.StructType([events.schema[k] for k in key])))])
    n, wanted = events.count(), SAMPLE_PER_RANGE * ranges
    sampled = events.select("user_id", *key)
    if n > wanted:
        sampled = sampled.filter(F.pmod(F.xxhash64("_row"), F.lit(1 << 40)) < int(wanted / n * (1 << 40)))
    null_first = lambda r: tuple((v is not None, v) for v in r)
    rows = sorted((tuple(r) for r in sampled.collect()), key=null_first)
    cut: dict = {}
    for r in dict.fromkeys(rows[-(-len(rows) // ranges) :: -(-len(rows) // ranges)] if rows else ()):
        cut.setdefault(r[0], []).append(r[1:])
    return events.sparkSession.createDataFrame(list(cut.items()), schema)


def previous_in_user(events: DataFrame, value: str, ranges: int | None = None) -> DataFrame:
    """Add ``prev_<value>``: the value of the user's previous event by (ts, event_id).

    Skew-safe ``lag(value) over (partition by user_id order by ts, event_id)``;
    events equal in user, ts and event_id follow each other by value. ``ranges``
    (default: the session's shuffle partitions) says into how many parts the
    events are cut.

    1. A small sample gives the range borders (``range_borders``). A row's
       piece is the number of its user's borders at or before it; users without
       a border inside have one piece. The borders are at most ``MAX_RANGES``
       rows, so they are broadcast.
    2. One shuffle by (user, piece); inside each piece ``lag`` is exact for
       every row but the first.
    3. Of the users that were cut, the first and last row of every piece (at
       most two a border and user) are windowed by user alone: for a piece's
       first row the previous edge row is the last row of the piece before.
    4. The union of both parts is the result. Both read the same window
       output, so the shuffle of the events is shared.
    """
    prev = f"prev_{value}"
    spark = events.sparkSession
    ranges = min(MAX_RANGES, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ["ts", "event_id", value, "_row"]  # a total order: rows equal in everything are told apart too
    numbered = events.withColumn("_row", F.monotonically_increasing_id())
    borders = F.broadcast(range_borders(numbered, key, ranges))
    piece = F.coalesce(F.size(F.filter("_borders", lambda b: b <= F.struct(*key))), F.lit(0))
    e = numbered.join(borders, F.col("user_id").eqNullSafe(F.col("_user")), "left").withColumn("_piece", piece).withColumn("_cut", F.col("_borders").isNotNull()).drop("_user", "_borders")
    w = Window.partitionBy("user_id", "_piece").orderBy(*key)
    e = e.withColumns({"_lag": F.lag(value).over(w), "_first": F.row_number().over(w) == 1, "_last": F.lead(F.lit(1)).over(w).isNull()})
    inner = e.filter(~(F.col("_cut") & F.col("_first"))).withColumn(prev, F.col("_lag"))
    edges = e.filter(F.col("_cut") & (F.col("_first") | F.col("_last")))
    by_user = Window.partitionBy("user_id").orderBy("_piece", *key)
    firsts = edges.withColumn(prev, F.lag(value).over(by_user)).filter("_first")
    return inner.unionByName(firsts).select(*events.columns, prev)


def transactions_from_events(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """``events`` → (transaction_id, amount, transaction_time, location_change,
    device_change, merchant_risk, is_fraud)."""
    e = events.select(
        "event_id",
        "ts",
        "user_id",
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    e = previous_in_user(e, "k", ranges)
    k, pk = F.col("k"), F.col("prev_k")
    loc = F.when(pk.isNull(), 0).when(F.floor(k / LOCATION_BAND) != F.floor(pk / LOCATION_BAND), 1).otherwise(0)
    dev = F.when(pk.isNull(), 0).when((k - pk) % 2 != 0, 1).otherwise(0)
    risk = k.cast("double") / RISK_DIVISOR
    hour = F.hour("ts")
    rule = (
        F.col("amount") / RULE_AMOUNT_DIVISOR
        + 2 * risk
        + loc
        + 0.5 * dev
        + F.when(hour < RULE_NIGHT_HOUR, 1).otherwise(0)
    ) > RULE_THRESHOLD
    noise = ((F.col("event_id") % 100) * NOISE_MULTIPLIER) % 100 < NOISE_PERCENT
    return e.select(
        F.col("event_id").alias(ID),
        F.col("amount").cast("double").alias("amount"),
        hour.cast("int").alias("transaction_time"),
        loc.cast("int").alias("location_change"),
        dev.cast("int").alias("device_change"),
        risk.alias("merchant_risk"),
        (rule != noise).cast("int").alias(LABEL),
    )

