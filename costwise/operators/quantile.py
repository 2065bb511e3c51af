"""Percentiles (A5): exact with linear interpolation, without a single-task
sort, or from a mergeable sketch in one pass.

Spark's exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer; on a large table that is one task holding everything.
Here each pass is a histogram over the current bracket (a group-by with at
most ``buckets`` keys, partially aggregated per task), which narrows the
bracket to the bucket holding the wanted rank. Once a bracket holds at most
``collect_limit`` rows (10,000 by default) they are fetched as distinct values with counts and the rank is read off. Ties are
no problem: a bracket with a single distinct value ends the search at once.
The result equals numpy's and DuckDB's linear interpolation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bracket_counts(values: DataFrame, lo: float, hi: float) -> list[tuple[float, int]]:
    """Distinct values in [lo, hi] with their counts, ascending (bounded: the
    bracket holds at most ``collect_limit`` rows, or a handful of adjacent doubles)."""
    v = F.col("v")
    rows = values.filter((v >= lo) & (v <= hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((float(r["v"]), int(r["n"])) for r in rows)


def _rank_pair(values: DataFrame, k: int, n: int, lo: float, hi: float, buckets: int, collect_limit: int) -> tuple[float, float | None]:
    """Values at 0-based ranks k and k+1 (None past the end)."""
    below, count = 0, n
    v = F.col("v")
    while count > collect_limit and lo < hi:
        width = (hi - lo) / buckets
        middle = lo / 2 + hi / 2
        if width > 0 and math.isfinite(width):
            b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1)).cast("int")
        elif lo < middle:  # the range overflows a double: halve it
            b = (v >= F.lit(middle)).cast("int")
        else:  # neighbouring doubles
            break
        hist = (
            values.filter((v >= lo) & (v <= hi))
            .groupBy(b.alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        # b is monotone in v, so a bucket's rows are exactly those in [its min, its max].
        for row in sorted(hist, key=lambda r: r["b"]):
            if below + row["n"] > k:
                lo, hi, count = row["lo"], row["hi"], row["n"]
                break
            below += row["n"]
    if lo == hi:
        first = lo
        second = lo if k + 1 < below + count else None
    else:
        first = second = None
        seen = below
        for val, cnt in _bracket_counts(values, lo, hi):
            if first is None and seen + cnt > k:
                first = val
            if seen + cnt > k + 1:
                second = val
                break
            seen += cnt
    if second is None and k + 1 < n:
        second = values.filter(v > hi).agg(F.min("v")).first()[0]
    return first, second


def exact_quantile(df: DataFrame, col: str, q: float, buckets: int = 4096, collect_limit: int = 10_000) -> float | None:
    """The q-quantile of ``col`` (null, NaN and infinite values ignored), linear interpolation
    between the closest ranks. Cache ``df`` first: it is scanned a few times."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must lie in [0, 1]")
    values = df.select(F.col(col).cast("double").alias("v")).filter(~F.isnan("v") & (F.abs("v") < float("inf")))
    st = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n = int(st["n"])
    if n == 0:
        return None
    pos = q * (n - 1)
    k = int(math.floor(pos))
    frac = pos - k
    a, b = _rank_pair(values, k, n, float(st["lo"]), float(st["hi"]), buckets, collect_limit)
    if frac == 0 or b is None:
        return a
    return a + (b - a) * frac


#: Default size of a sketch: a rank error of 0.13 % with 24 kB a sketch.
SKETCH_K = 4096
#: Groups of tasks whose sketches are merged first; the groups' sketches are merged at once.
MERGE_GROUPS = 256


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """Bound on the rank error of a KLL sketch of size ``k``, as a share of the rows (99 % confidence)."""
    return 2.296 / k**0.9021


def sketch_quantile(df: DataFrame, col: str, q: float, k: int = SKETCH_K) -> float | None:
    """The q-quantile of ``col`` from KLL sketches, in one pass (null, NaN and infinite values ignored).

    Every task sketches its rows, and the sketches are merged in a tree: by
    ``MERGE_GROUPS`` groups of tasks, then the groups. The result is a value of the column whose rank is off by at most
    ``sketch_rank_error(k)``; memory depends on ``k`` alone, whatever the table.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must lie in [0, 1]")
    values = df.select(F.col(col).cast("double").alias("v")).filter(~F.isnan("v") & (F.abs("v") < float("inf")))
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g")
    grouped = values.groupBy(group).agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("s"))
    merged = grouped.agg(F.kll_merge_agg_double("s").alias("s"))
    n = F.kll_sketch_get_n_double("s")
    return merged.select(F.when(n > 0, F.kll_sketch_get_quantile_double("s", F.lit(q)))).first()[0]
