"""Feature attribution and the explanation sentence.

Exact Shapley values of the fraud probability against a baseline row
(all zeros by default). For the linear-logistic model a coalition's
probability is sigma(b + sum_{j in S} beta_j x_j) on the raw scale, so the
2^M coalition probabilities are M-term column expressions and each value is
a weighted sum of their differences, all in one projection. For any other
model callable, ``shapley_values`` evaluates the coalitions batch-wise in
a scalar pandas UDF over the feature columns (Arrow batches, one model call per batch).

The baseline may be a whole background table (``background_table``): a
coalition's value is then the mean prediction over the background rows, each
lending its values to the absent features. Models of more than 12 features
are explained from antithetic pairs of feature orders (``permutations``)
instead of all 2^M coalitions, with a stated error bound; the values still add
up exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import logistic, name_map, reason_text, sentence
from ..schema import EXPLANATION_TOP_K, FEATURES
from ..session import ship_package
from .classifier import LinearModel


def shapley_terms(m: int) -> list[list[tuple[float, tuple[int, ...], tuple[int, ...]]]]:
    """For each feature i: the list of (w(|S|), S + i, S) over S not containing i,
    w(s) = s!(m-1-s)!/m!. Coalitions are sorted tuples; the order is fixed."""
    fact = math.factorial
    w = [fact(s) * fact(m - 1 - s) / fact(m) for s in range(m)]
    out = []
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        out.append([(w[size], tuple(sorted(S + (i,))), S) for size in range(m) for S in combinations(rest, size)])
    return out


def coalitions(m: int) -> list[tuple[int, ...]]:
    return [S for size in range(m + 1) for S in combinations(range(m), size)]


def _cname(S: tuple[int, ...]) -> str:
    return "_c_" + ("_".join(map(str, S)) if S else "e")


def coalition_columns(model: LinearModel, baseline: Sequence[float] | None = None) -> dict[str, Column]:
    """The 2^M coalition probabilities, ``_c_<members>``: present features at
    their value, absent ones at the baseline."""
    m = len(model.features)
    base = list(baseline) if baseline is not None else [0.0] * m
    beta = model.raw_coef
    x = [F.col(f).cast("double") for f in model.features]
    base_logit = model.raw_intercept + sum(b * v for b, v in zip(beta, base))
    cols = {}
    for S in coalitions(m):
        eta = F.lit(base_logit)
        for j in S:
            eta = eta + F.lit(beta[j]) * (x[j] - F.lit(base[j]))
        cols[_cname(S)] = logistic(eta)
    return cols


def _phi_sums(m: int, features: Sequence[str], coal: dict[str, Column], prefix: str) -> dict[str, Column]:
    out = {}
    for i, f in enumerate(features):
        acc = None
        for wgt, with_i, without_i in shapley_terms(m)[i]:
            term = F.lit(wgt) * (coal[_cname(with_i)] - coal[_cname(without_i)])
            acc = term if acc is None else acc + term
        out[f"{prefix}{f}"] = acc
    return out


def phi_columns(model: LinearModel, baseline: Sequence[float] | None = None, prefix: str = "phi_") -> dict[str, Column]:
    """X1 (expression form) as standalone column expressions.

    phi_i = sum over S without i of w(|S|) * (f(S + i) - f(S)); a feature at
    its baseline value gets exactly 0.
    """
    return _phi_sums(len(model.features), model.features, coalition_columns(model, baseline), prefix)


def shapley_linear(df: DataFrame, model: LinearModel, baseline: Sequence[float] | None = None, prefix: str = "phi_") -> DataFrame:
    """Add ``phi_<feature>`` columns for the linear-logistic model, all JVM-side.

    (Keeping the coalitions in a projection of their own measured slower:
    5.4 s inline against 6.7 s split, 2M rows, local[8].)
    """
    return df.withColumns(phi_columns(model, baseline, prefix))


#: Doubles of one expanded block of rows (rows x coalitions x background rows x M): 32 MB.
_BLOCK_VALUES = 1 << 22
#: Features up to which all 2^M coalitions are evaluated.
EXACT_FEATURES = 12
#: Different background rows that go to every executor (8 * M bytes each); more are refused.
MAX_BACKGROUND_ROWS = 10_000


@dataclass(frozen=True)
class Background:
    """Background rows (b, M) and their shares, which sum to 1."""

    rows: np.ndarray
    shares: np.ndarray

    @staticmethod
    def one(baseline: Sequence[float]) -> "Background":
        return Background(np.asarray([baseline], dtype="float64"), np.ones(1))


def background_table(df: DataFrame, features: Sequence[str] = FEATURES, weight_col: str | None = None, limit: int = MAX_BACKGROUND_ROWS) -> Background:
    """K8: a table of background rows, equal rows as one with their share of the weight (default: of the rows).

    The table is grouped in Spark and only its different rows come to the
    driver, ``limit`` at most: a larger table is refused, with nothing dropped
    (group it to fewer rows with a weight first). Null, NaN or infinite values
    and weights that are not positive are refused too.
    """
    x = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    names = [f"_x{i}" for i in range(len(features))]
    grouped = df.select(*x, weight.alias("_w")).groupBy(*names).agg(F.sum("_w").alias("_w"))
    rows = grouped.orderBy(*names).limit(limit + 1).collect()
    if not rows:
        raise ValueError("the background table is empty")
    if len(rows) > limit:
        raise ValueError(f"the background table has more than {limit} different rows")
    values = np.array([[np.nan if v is None else v for v in r] for r in rows], dtype="float64")
    if not np.isfinite(values).all() or (values[:, -1] <= 0).any():
        raise ValueError("the background table needs finite values in every feature and positive weights")
    return Background(np.ascontiguousarray(values[:, :-1]), values[:, -1] / values[:, -1].sum())


def feature_orders(m: int, pairs: int, seed: int) -> list[tuple[int, ...]]:
    """``pairs`` orders of the features, each by the md5 of 'seed:pair:feature'."""
    key = lambda k, i: hashlib.md5(f"{seed}:{k}:{i}".encode()).hexdigest()
    return [tuple(sorted(range(m), key=lambda i, k=k: key(k, i))) for k in range(pairs)]


def permutation_error(pairs: int, m: int, spread: float = 1.0, delta: float = 0.01) -> float:
    """Bound on the error of all ``m`` values of a row at once, with probability 1 - ``delta`` over the seed.

    A pair's contribution of a feature lies in [-spread, spread], where
    ``spread`` is the range of the predictions (1 for probabilities); the
    bound is Hoeffding's for the mean of ``pairs`` independent pairs.
    """
    return spread * math.sqrt(2.0 * math.log(2.0 * m / delta) / pairs)


def _exact_plan(m: int):
    subsets = coalitions(m)
    pos = {S: r for r, S in enumerate(subsets)}
    terms = shapley_terms(m)
    return subsets, [[pos[a] for _, a, _ in t] for t in terms], [[pos[b] for _, _, b in t] for t in terms], [[w for w, _, _ in t] for t in terms]


def _permutation_plan(m: int, pairs: int, seed: int):
    """Coalitions that the orders and their reversals pass through, and each feature's steps in them."""
    pos: dict[tuple[int, ...], int] = {}
    with_, without = [[] for _ in range(m)], [[] for _ in range(m)]
    for order in feature_orders(m, pairs, seed):
        for walk in (order, order[::-1]):
            seen: tuple[int, ...] = ()
            for i in walk:
                grown = tuple(sorted((*seen, i)))
                without[i].append(pos.setdefault(seen, len(pos)))
                with_[i].append(pos.setdefault(grown, len(pos)))
                seen = grown
    return list(pos), with_, without, [[0.5 / pairs] * (2 * pairs)] * m


class ShapleyBatch:
    """Shapley values for an (n, M) batch with any vectorised ``predict``.

    Expands the batch to its coalition rows (for each background row), scores
    them in blocks of bounded size and takes the weighted differences per
    feature: over all 2^M coalitions, or with ``permutations`` over the steps
    of that many antithetic pairs of feature orders. Against one baseline row,
    a feature at its baseline value gets exactly 0.
    """

    def __init__(self, predict: Callable[[np.ndarray], np.ndarray], m: int, baseline: Sequence[float] | Background | None = None, permutations: int | None = None, seed: int = 42):
        if permutations is None and m > EXACT_FEATURES:
            raise ValueError(f"exact Shapley values need 2^M model calls per row; M must be <= {EXACT_FEATURES}, or ask for permutations")
        if permutations is not None and permutations < 1:
            raise ValueError("permutations must be at least 1")
        self.predict, self.m = predict, m
        self.background = baseline if isinstance(baseline, Background) else Background.one(baseline if baseline is not None else [0.0] * m)
        subsets, with_, without, w = _exact_plan(m) if permutations is None else _permutation_plan(m, permutations, seed)
        self.masks = np.zeros((len(subsets), m), dtype=bool)
        for r, S in enumerate(subsets):
            self.masks[r, list(S)] = True
        self.with_idx, self.without_idx, self.w = np.array(with_), np.array(without), np.array(w)

    def values(self, X: np.ndarray) -> np.ndarray:
        """(n, coalitions): the mean prediction over the background with the coalition's features present."""
        rows, k = self.background.rows, len(self.masks)
        step = max(1, _BLOCK_VALUES // (len(X) * k * self.m))
        out = np.zeros((len(X), k))
        for i in range(0, len(rows), step):
            b = rows[i : i + step]
            Z = np.where(self.masks[None, :, None, :], X[:, None, None, :], b[None, None, :, :])
            p = np.asarray(self.predict(Z.reshape(-1, self.m)), dtype="float64").reshape(len(X), k, len(b))
            out += (p * self.background.shares[i : i + step]).sum(axis=2)
        return out

    def steps(self, X: np.ndarray) -> np.ndarray:
        """(n, M, terms): weighted differences, which sum to the values."""
        p = self.values(X)
        return (p[:, self.with_idx] - p[:, self.without_idx]) * self.w[None, :, :]

    def __call__(self, X: np.ndarray, with_error: bool = False) -> np.ndarray:
        """(n, M) values; with ``with_error`` (n, 2M), their standard errors over the pairs beside them."""
        n = len(X)
        if n == 0:
            return np.zeros((0, 2 * self.m if with_error else self.m))
        block = max(1, _BLOCK_VALUES // max(len(self.masks) * self.m, self.with_idx.size))
        if n > block:  # bounded memory whatever M and the batch size
            return np.concatenate([self(X[i : i + block], with_error) for i in range(0, n, block)])
        steps = self.steps(X)
        phi = steps.sum(axis=2)
        if not with_error:
            return phi
        pairs = steps.shape[2] // 2
        means = steps.reshape(n, self.m, pairs, 2).sum(axis=3) * pairs
        return np.concatenate([phi, means.std(axis=2, ddof=1) / math.sqrt(pairs) if pairs > 1 else np.full_like(phi, np.inf)], axis=1)


def shapley_values(
    df: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray],
    features: Sequence[str] = FEATURES,
    baseline: Sequence[float] | Background | None = None,
    prefix: str = "phi_",
    permutations: int | None = None,
    seed: int = 42,
    with_error: bool = False,
) -> DataFrame:
    """Shapley values for any vectorised model ``predict(X) -> p``.

    ``predict`` maps an (n, M) float array to n predictions. Each Arrow batch
    of the feature columns is expanded to its coalition rows in numpy, scored
    and reduced over the coalition pairs of each feature. ``baseline`` is one
    row or a ``Background``.

    Up to 12 features all 2^M coalitions are evaluated. Above, give
    ``permutations``: that many antithetic pairs of feature orders (drawn from
    ``seed``, the same for all rows), 2 * permutations * (M - 1) + 2 coalitions
    at most. The values of a row then still add up to its prediction less the
    baseline's, and lie within ``permutation_error`` of the exact ones;
    ``with_error`` adds their standard errors as ``se_<feature>``.
    """
    if with_error and permutations is None:
        raise ValueError("exact values have no standard error")
    explain_batch = ShapleyBatch(predict, len(features), baseline, permutations, seed)
    ship_package(df.sparkSession)
    names = [f"{prefix}{f}" for f in features] + ([f"se_{f}" for f in features] if with_error else [])
    schema = T.StructType([T.StructField(nm, T.DoubleType(), True) for nm in names])

    # Only the feature columns cross to Python; the rest of the row stays in the JVM.
    @F.pandas_udf(schema)
    def run(*cols: pd.Series) -> pd.DataFrame:
        phi = explain_batch(np.column_stack([c.to_numpy(dtype="float64") for c in cols]), with_error)
        return pd.DataFrame({nm: phi[:, i] for i, nm in enumerate(names)})

    out = df.withColumn("_phi", run(*[F.col(f).cast("double") for f in features]))
    return out.select(*[F.col(c) for c in df.columns], *[F.col(f"_phi.{nm}").alias(nm) for nm in names])


def linear_predictor(model: LinearModel) -> Callable[[np.ndarray], np.ndarray]:
    """The linear-logistic model as a numpy callable for ``shapley_values``."""
    beta = np.asarray(model.raw_coef)
    b = model.raw_intercept

    def predict(X: np.ndarray) -> np.ndarray:
        eta = np.full(len(X), b)
        for j, w in enumerate(beta):  # term by term: equal rows get equal bits wherever they stand in the batch
            eta += X[:, j] * w
        return 1.0 / (1.0 + np.exp(-eta))

    return predict


def ranked(features: Sequence[str] = FEATURES, prefix: str = "phi_") -> Column:
    """Array of (neg_abs, idx, feature, contribution) sorted by |phi| desc, then feature order."""
    items = [
        F.struct(
            (-F.abs(F.col(f"{prefix}{f}"))).alias("neg_abs"),
            F.lit(i).alias("idx"),
            F.lit(f).alias("feature"),
            F.col(f"{prefix}{f}").alias("contribution"),
        )
        for i, f in enumerate(features)
    ]
    return F.sort_array(F.array(*items))  # as array_sort (no item is null), without a comparison of its own per pair


def top_features(features: Sequence[str] = FEATURES, k: int = EXPLANATION_TOP_K, prefix: str = "phi_") -> Column:
    """Names of the k largest attributions by absolute value."""
    return F.transform(F.slice(ranked(features, prefix), 1, k), lambda s: s["feature"])


def explanation(features: Sequence[str] = FEATURES, k: int = EXPLANATION_TOP_K, prefix: str = "phi_") -> Column:
    """X2: 'Transaction flagged primarily due to: a impact, b impact, c impact.'

    The reasons are constants that are sorted with the values: no text is made per row but the sentence.
    """
    items = [F.struct((-F.abs(F.col(f"{prefix}{f}"))).alias("neg_abs"), F.lit(i).alias("idx"), reason_text(F.lit(f)).alias("reason")) for i, f in enumerate(features)]
    return sentence(F.slice(F.sort_array(F.array(*items)), 1, k)["reason"])


def contributions(features: Sequence[str] = FEATURES, prefix: str = "phi_") -> Column:
    """MAP<feature, contribution>, in feature order."""
    return name_map(features, [F.col(f"{prefix}{f}") for f in features])


def contributions_long(df: DataFrame, features: Sequence[str] = FEATURES, prefix: str = "phi_", keep=("transaction_id",)) -> DataFrame:
    """P8 + T3 + W1: one row per (transaction, feature), ranked by |phi| desc.

    The rank comes from a row-local sorted array and ``posexplode``, not a
    window over the transaction id: no shuffle, and duplicate ids stay apart.
    """
    return df.select(*keep, F.posexplode(ranked(features, prefix)).alias("pos", "item")).select(
        *keep,
        (F.col("pos") + 1).alias("rank"),
        F.col("item.feature").alias("feature"),
        F.col("item.contribution").alias("contribution"),
    )


def contributions_table(df: DataFrame, map_col: str = "feature_contributions", keep=("transaction_id",), features: Sequence[str] = FEATURES) -> DataFrame:
    """P8 + T3 from the response map: (transaction_id, rank, feature, contribution),
    largest |contribution| first, ties in feature order. Row-local, no shuffle."""
    order = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    entries = F.transform(
        F.map_entries(F.col(map_col)),
        lambda e: F.struct(
            (-F.abs(e["value"])).alias("neg_abs"),
            F.coalesce(F.element_at(order, e["key"]), F.lit(len(features))).alias("idx"),
            e["key"].alias("feature"),
            e["value"].alias("contribution"),
        ),
    )
    return df.select(*keep, F.posexplode(F.array_sort(entries)).alias("pos", "item")).select(
        *keep,
        (F.col("pos") + 1).alias("rank"),
        F.col("item.feature").alias("feature"),
        F.col("item.contribution").alias("contribution"),
    )
