"""Scalar column functions (F1–F12, P7, P10). All JVM-side except the two
display formats, which need Python's rounding rule (see ``fixed``)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DECISION_LABELS, EULER_GAMMA, EXPLANATION_END, EXPLANATION_PREFIX, EXPLANATION_SEPARATOR, REASON_SUFFIX


def zscore(x: Column, mean: float, scale: float) -> Column:
    """(x - mean) / scale."""
    return (x - F.lit(mean)) / F.lit(scale)


def logistic(x: Column) -> Column:
    """1 / (1 + e^-x)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def path_norm(n: Column) -> Column:
    """average unsuccessful-search path length c(n) of a binary search tree."""
    return (
        F.when(n <= 1, F.lit(0.0))
        .when(n == 2, F.lit(1.0))
        .otherwise(2.0 * (F.log(n - 1.0) + F.lit(EULER_GAMMA)) - 2.0 * (n - 1.0) / n)
    )


def round_to(x: Column, decimals: int) -> Column:
    """round half up to ``decimals`` places, keeping the sign of zero.

    Python's ``round`` (and DuckDB's) turn -0.00004 into -0.0; Spark's
    ``round`` gives +0.0. The sign is restored from the input.
    """
    r = F.round(x, decimals)
    return F.when(r == 0, F.lit(0.0) * F.signum(x)).otherwise(r)


def _fixed_series(decimals: int, scale: float, suffix: str):
    fmt = f"%.{decimals}f"

    @F.pandas_udf("string")
    def fmt_udf(s: pd.Series) -> pd.Series:
        v = s.to_numpy(dtype="float64", na_value=np.nan) * scale
        out = pd.Series(np.char.add(np.char.mod(fmt, v), suffix), index=s.index, dtype=object)
        out[s.isna()] = None
        return out

    return fmt_udf


def fixed(x: Column, decimals: int, scale: float = 1.0, suffix: str = "") -> Column:
    """``f"{x*scale:.{decimals}f}{suffix}"``.

    Python (and DuckDB's printf) round the exact binary value; Java's
    formatter, behind ``format_string``, rounds the shortest decimal form
    half up. The two differ whenever a value rounded to 4 places ends in 5
    and is formatted to 3, so this display helper runs as an Arrow-batched
    pandas UDF.
    """
    return _fixed_series(decimals, scale, suffix)(x)


def percent_text(p: Column) -> Column:
    """probability as a percentage with two decimals."""
    return fixed(p, 2, 100.0, "%")


def three_decimals(s: Column) -> Column:
    """score with three decimals."""
    return fixed(s, 3)


def decision_label(d: Column, labels: dict[str, str] = DECISION_LABELS) -> Column:
    """Dashboard label for a decision, the decision itself if unknown."""
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(m, d), d)


def name_map(names: Sequence[str], values: Sequence[Column]) -> Column:
    """Zip feature names with values into MAP<STRING, DOUBLE>."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[v.cast("double") for v in values]))


def reason_text(name: Column) -> Column:
    """'merchant_risk' -> 'merchant risk impact'."""
    return F.concat(F.regexp_replace(name, "_", " "), F.lit(REASON_SUFFIX))


def reason_texts(names: Column) -> Column:
    """F7 for an array of names."""
    return F.transform(names, reason_text)


def sentence(reasons: Column) -> Column:
    """F8: prefix + reasons joined by ', ' + full stop."""
    return F.concat(F.lit(EXPLANATION_PREFIX), F.array_join(reasons, EXPLANATION_SEPARATOR), F.lit(EXPLANATION_END))


C_CACHE: dict[int, float] = {}


def c_of(n: int) -> float:
    """c(n) as a Python float, cached."""
    if n not in C_CACHE:
        C_CACHE[n] = 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n
    return C_CACHE[n]
