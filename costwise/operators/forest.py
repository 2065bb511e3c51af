"""Isolation forest (A4–A6, M3, M4, F3, U3) as Spark jobs.

Fit
  1. Sample: each of T trees takes the psi rows with the smallest keys. Every
     physical row has keys of its own, by one rule at any table size: a tree's
     key is a linear function, the tree's own, of two md5-derived numbers of
     the row's id and features. Rows equal in these are told apart by where
     they lie: the first of them in a task carries that key, each further one
     a key derived from it, the task's partition and its number there. Tasks
     sort their own rows by the numbers, so equal rows are neighbours and
     numbering them takes no memory and no shuffle; a task keeps at most psi
     rows a tree, and about 4 * T * psi rows in all are ranked.
  2. Grow: ``groupBy("tree").applyInPandas``; each group is one tree's psi
     rows (bounded). Uniform numbers come from md5(seed:tree:node:salt), so
     a SQL twin can replay the growth exactly.
  3. The node table is at most T * 2^(depth+1) rows: it is collected once and
     broadcast as dense arrays.
  4. Offset: exact ``contamination`` percentile of the training scores.

Score
  A scalar pandas UDF walks all trees for an Arrow batch at once in numpy
  (depth-bounded), shipping only the five feature columns to Python; the
  rest of the row stays in the JVM. The score itself is a column expression.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import c_of
from ..schema import FEATURES, FOREST_CONTAMINATION, FOREST_MAX_SAMPLES, FOREST_SEED, FOREST_TREES, ID
from ..session import ship_package
from .quantile import exact_quantile, sketch_quantile

NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("is_leaf", T.BooleanType()),
        T.StructField("path", T.DoubleType()),
    ]
)


def uniform(seed: int, tree: int, node: int, salt: int) -> float:
    """U[0,1) from the first 8 hex digits of md5('seed:tree:node:salt')."""
    h = hashlib.md5(f"{seed}:{tree}:{node}:{salt}".encode()).hexdigest()
    return int(h[:8], 16) / 4294967296.0


def depth_limit(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


# Largest node table we broadcast: trees x 2^(depth+1) x 18 bytes. The default
# forest (100 x 256) needs 0.9 MB; the bound depends on the parameters only.
MAX_FOREST_BYTES = 256 * 1024 * 1024


def forest_bytes(n_trees: int, psi: int) -> int:
    return n_trees * 2 ** (depth_limit(psi) + 1) * (2 + 8 + 8)


def check_forest_size(n_trees: int, psi: int) -> None:
    size = forest_bytes(n_trees, psi)
    if size > MAX_FOREST_BYTES:
        raise ValueError(f"a forest of {n_trees} trees x {psi} rows needs {size} bytes per executor; the limit is {MAX_FOREST_BYTES}")


# ---------------------------------------------------------------- sample
PRIME = 2**31 - 1  # sums of two products below PRIME^2 stay within 64 bits


def tree_coefficients(seed: int, tree: int) -> tuple[int, int, int]:
    """(a, c, b) of the tree's key a * h1 + c * h2 + b mod PRIME, from md5('seed:tree')."""
    h = hashlib.md5(f"{seed}:{tree}".encode()).hexdigest()
    x, y, z = (int(h[i : i + 8], 16) for i in (0, 8, 16))
    return 1 + x % (PRIME - 1), 1 + y % (PRIME - 1), z % PRIME


#: Features and other fractional columns enter a key as whole multiples of 2^-20, which SQL engines write alike.
FRACTION = 1 << 20


def row_hash(seed: int, df: DataFrame, row_key, features=FEATURES) -> tuple[Column, Column]:
    """(h1, h2), two numbers below PRIME from the md5 of seed and row key."""

    def text(k: str) -> Column:
        number = k in features or isinstance(df.schema[k].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
        return (F.floor(F.col(k).cast("double") * FRACTION) if number else F.col(k)).cast("string")

    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(text(k), F.lit("")) for k in row_key]))
    return tuple((F.conv(F.substring(h, i, 8), 16, 10).cast("long") % PRIME) for i in (1, 9))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern (a finalizer of multiplications and shifts)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Copies:
    """Numbers rows equal in (h1, h2) in a sorted stream of batches, and gives all but the first numbers of their own."""

    def __init__(self, partition: int):
        self.place, self.last, self.seen = _mixed(np.array([partition + 1], np.uint64)), None, 0

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        goes_on = self.last == (int(h1[0]), int(h2[0]))
        at = np.arange(len(h1))
        number = at - np.maximum.accumulate(np.where(new, at, 0))
        if goes_on:  # the run of equal rows began in an earlier batch
            first_run = np.cumsum(new) == 1
            number[first_run] += self.seen
        self.last, self.seen = (int(h1[-1]), int(h2[-1])), int(number[-1]) + 1
        again = number > 0
        if not again.any():
            return h1, h2
        with np.errstate(over="ignore"):
            x = _mixed((h1.astype(np.uint64) << np.uint64(31) | h2.astype(np.uint64)) ^ self.place)
            x = _mixed(x + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        own = lambda y: (y % np.uint64(PRIME)).astype(np.int64)
        return np.where(again, own(x), h1), np.where(again, own(_mixed(x)), h2)


class Smallest:
    """Per tree, at most the ``psi`` rows with the smallest keys seen so far."""

    def __init__(self, n_trees: int, psi: int):
        self.n_trees, self.psi, self.held, self.size = n_trees, psi, [], 0

    def add(self, rows: pd.DataFrame) -> None:
        self.held.append(rows)
        self.size += len(rows)
        if self.size > 2 * self.n_trees * self.psi:
            self.prune()

    def prune(self) -> pd.DataFrame:
        rows = pd.concat(self.held, ignore_index=True) if self.held else None
        if rows is not None and len(rows):
            tree = rows["tree"].to_numpy()
            order = np.lexsort((rows["_h2"].to_numpy(), rows["_h1"].to_numpy(), rows["_key"].to_numpy(), tree))
            tree = tree[order]
            at = np.arange(len(tree))
            place = at - np.maximum.accumulate(np.where(np.r_[True, tree[1:] != tree[:-1]], at, 0))
            rows = rows.iloc[order[place < self.psi]].reset_index(drop=True)
        self.held, self.size = ([] if rows is None else [rows]), (0 if rows is None else len(rows))
        return rows


def _sample_plan(base: DataFrame, n_trees: int, psi: int, seed: int, features, id_col: str, frac: float) -> DataFrame:
    """The sample as a lazy plan, by one rule at every table size: each tree
    takes the ``psi`` rows with the smallest keys.

    Keys are tested against ``frac`` of their range where the rows are read,
    in one narrow pass that emits a row once per tree it may enter: at most
    ``T * psi`` rows a task and about ``T * psi * 4`` in all go on to the
    ranking, whatever the table size.
    """
    coef = np.array([tree_coefficients(seed, t) for t in range(n_trees)], dtype=np.int64)
    cut = PRIME if frac >= 1.0 else int(frac * PRIME)
    cols = [id_col, *features, "_h1", "_h2"]
    fields = [base.schema[c] for c in (id_col, *features)] + [T.StructField(c, T.LongType()) for c in ("_h1", "_h2", "_key")] + [T.StructField("tree", T.IntegerType())]
    ship_package(base.sparkSession)

    def test(batches):
        copies, smallest = Copies(TaskContext.get().partitionId()), Smallest(n_trees, psi)
        for pdf in batches:
            if not len(pdf):
                continue
            h1, h2 = copies(pdf["_h1"].to_numpy(np.int64), pdf["_h2"].to_numpy(np.int64))
            rows, trees, keys = [], [], []
            for t, (a, c, b) in enumerate(coef):
                key = (a * h1 + c * h2 + b) % PRIME
                at = np.flatnonzero(key < cut)
                if len(at) > psi:
                    at = at[key[at] <= np.partition(key[at], psi - 1)[psi - 1]]
                rows.append(at)
                trees.append(np.full(len(at), t, np.int32))
                keys.append(key[at])
            at = np.concatenate(rows)
            if len(at):
                out = pdf[cols].iloc[at].reset_index(drop=True)
                out["_h1"], out["_h2"], out["_key"], out["tree"] = h1[at], h2[at], np.concatenate(keys), np.concatenate(trees)
                smallest.add(out)
        found = smallest.prune()
        if found is not None and len(found):
            yield found

    near = base.select(*cols).sortWithinPartitions("_h1", "_h2").mapInPandas(test, T.StructType(fields))
    w = Window.partitionBy("tree").orderBy("_key", "_h1", "_h2", *features)
    return near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= psi).select("tree", id_col, *features)


def _sample_setup(df: DataFrame, n_trees: int, max_samples: int, features, id_col: str, n_rows: int | None, seed: int, row_key):
    from .classifier import invalid_count

    if n_rows is None:
        st = df.agg(F.count(F.lit(1)).alias("n"), *[invalid_count(f).alias(f"bad_{f}") for f in features]).first()
        bad = {f: int(st[f"bad_{f}"]) for f in features if st[f"bad_{f}"]}
        if bad:
            raise ValueError(f"fit needs finite values in every feature; null, NaN or infinite counts: {bad}")
        n_rows = int(st["n"])
    if n_rows == 0:
        raise ValueError("cannot fit a forest on an empty table")
    psi = min(max_samples, n_rows)
    h1, h2 = row_hash(seed, df, tuple(row_key or (id_col, *features)), features)
    base = df.select(F.col(id_col).alias(id_col), *[F.col(f).cast("double").alias(f) for f in features], h1.alias("_h1"), h2.alias("_h2"))
    return n_rows, psi, base, min(1.0, 4.0 * psi / n_rows)


def forest_sample(
    df: DataFrame,
    n_trees: int = FOREST_TREES,
    max_samples: int = FOREST_MAX_SAMPLES,
    seed: int = FOREST_SEED,
    features=FEATURES,
    id_col: str = ID,
    n_rows: int | None = None,
    row_key: tuple[str, ...] = (),
) -> tuple[DataFrame, int]:
    """(tree, id, features...) for every sampled row, and psi = min(max_samples, n).

    Every row has the same chance of psi / n in every tree, whether ids repeat
    or not. ``row_key`` names the columns that tell rows apart (default: the
    id and the features); among rows that differ in them the sample does not
    depend on how the table is partitioned. Rows equal in them enter with keys
    that depend on their partition and their number in it, only the first of
    a partition with the common one; a row added to the table changes no more
    than the trees it enters.
    """
    n, psi, base, frac = _sample_setup(df, n_trees, max_samples, features, id_col, n_rows, seed, row_key)
    while True:
        sample = _sample_plan(base, n_trees, psi, seed, features, id_col, frac).persist()  # T * psi rows
        if frac >= 1.0 or sample.count() == n_trees * psi:
            return sample, psi
        sample.unpersist()
        frac = min(1.0, 4.0 * frac)


# ---------------------------------------------------------------- grow
def grow_tree(X: np.ndarray, tree: int, seed: int, max_depth: int) -> list[tuple]:
    """One isolation tree in heap numbering (children 2k, 2k+1).

    A node splits on a feature drawn uniformly among those not constant in
    it, at lo + u * (hi - lo); rows with x <= threshold go left. Leaves get
    path = depth + c(size).
    """
    out = []
    stack = [(1, np.arange(len(X)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        size = len(idx)
        if size > 1 and depth < max_depth:
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            varying = np.nonzero(hi > lo)[0]
            if len(varying):
                u1, u2 = uniform(seed, tree, node, 0), uniform(seed, tree, node, 1)
                f = int(varying[min(int(u1 * len(varying)), len(varying) - 1)])
                thr = float(lo[f] + u2 * (hi[f] - lo[f]))
                right = sub[:, f] > thr
                out.append((tree, node, depth, f, thr, size, False, float("nan")))
                stack.append((2 * node, idx[~right], depth + 1))
                stack.append((2 * node + 1, idx[right], depth + 1))
                continue
        out.append((tree, node, depth, -1, float("nan"), size, True, depth + c_of(size)))
    return out


def grow_forest(sample: DataFrame, psi: int, seed: int = FOREST_SEED, features=FEATURES) -> DataFrame:
    """Node table (tree, node, depth, feature, threshold, size, is_leaf, path)."""
    max_depth = depth_limit(psi)
    feats = list(features)
    ship_package(sample.sparkSession)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        # Growth uses only minima, maxima and comparisons: row order does not matter.
        rows = grow_tree(pdf[feats].to_numpy(dtype="float64"), tree, seed, max_depth)
        return pd.DataFrame(rows, columns=NODE_SCHEMA.names)

    return sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


# ---------------------------------------------------------------- model
@dataclass
class Forest:
    """Dense node arrays (trees x 2^(depth+1)); a missing node is a leaf at its depth."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    psi: int
    features: tuple[str, ...] = FEATURES
    offset: float | None = None
    seed: int = FOREST_SEED
    contamination: float = FOREST_CONTAMINATION
    _bc: object = field(default=None, repr=False, compare=False)

    @property
    def n_trees(self) -> int:
        return self.feature.shape[0]

    @property
    def max_depth(self) -> int:
        return depth_limit(self.psi)

    @staticmethod
    def from_nodes(nodes: pd.DataFrame, n_trees: int, psi: int, features=FEATURES, seed: int = FOREST_SEED, contamination: float = FOREST_CONTAMINATION) -> "Forest":
        width = 2 ** (depth_limit(psi) + 1)
        depth_of = np.floor(np.log2(np.maximum(np.arange(width), 1))).astype("float64")
        feature = np.full((n_trees, width), -1, dtype=np.int16)
        threshold = np.full((n_trees, width), np.nan)
        path = np.tile(depth_of, (n_trees, 1))
        t = nodes["tree"].to_numpy()
        k = nodes["node"].to_numpy()
        feature[t, k] = nodes["feature"].to_numpy()
        threshold[t, k] = nodes["threshold"].to_numpy()
        leaf = nodes["is_leaf"].to_numpy(dtype=bool)
        path[t[leaf], k[leaf]] = nodes["path"].to_numpy()[leaf]
        return Forest(feature, threshold, path, psi, tuple(features), None, seed, contamination)

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        """The dense node arrays as a Parquet table (trees x 2^(depth+1) rows, bounded by the parameters)."""
        t, k = (i.ravel() for i in np.indices(self.feature.shape))
        nodes = {"tree": t.astype("int32"), "node": k.astype("int32"), "feature": self.feature[t, k].astype("int32"), "threshold": self.threshold[t, k], "path": self.path[t, k]}
        spark.createDataFrame(pd.DataFrame(nodes)).coalesce(1).write.mode(mode).parquet(path)

    def settings(self) -> dict:
        return {"psi": self.psi, "offset": self.offset, "seed": self.seed, "contamination": self.contamination, "n_trees": self.n_trees, "features": list(self.features)}

    @staticmethod
    def load(spark: SparkSession, path: str, settings: dict) -> "Forest":
        nodes = spark.read.parquet(path).toPandas()
        shape = (settings["n_trees"], 2 ** (depth_limit(settings["psi"]) + 1))
        arrays = np.full(shape, -1, dtype=np.int16), np.full(shape, np.nan), np.zeros(shape)
        for a, c in zip(arrays, ("feature", "threshold", "path")):
            a[nodes["tree"].to_numpy(), nodes["node"].to_numpy()] = nodes[c]
        return Forest(*arrays, settings["psi"], tuple(settings["features"]), settings["offset"], settings["seed"], settings["contamination"])

    def broadcast(self, spark: SparkSession):
        if self._bc is None:
            check_forest_size(self.n_trees, self.psi)
            self._bc = spark.sparkContext.broadcast(TreeWalk(self.feature, self.threshold, self.path, self.max_depth))
        return self._bc


#: Rows in one block of the tree walk (measured: 0.155 s -> 0.101 s for 10,000 rows x 100 trees).
WALK_ROWS = 250


def path_lengths(X: np.ndarray, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray, max_depth: int) -> np.ndarray:
    """(n, T) path length of every row in every tree, all trees at once.

    Node arrays are read flat (tree * width + node) with int32 indices: one
    1-D gather per array and level (measured 1.5x faster than 2-D indexing).
    Rows go through in blocks, so that a block's arrays stay in the cache.
    """
    if len(X) > WALK_ROWS:
        return np.concatenate([path_lengths(X[i : i + WALK_ROWS], feature, threshold, path, max_depth) for i in range(0, len(X), WALK_ROWS)])
    n, m = X.shape
    t_count, width = feature.shape
    ff = feature.ravel().astype(np.int32, copy=False)
    tf = threshold.ravel()
    pf = path.ravel()
    base = (np.arange(t_count, dtype=np.int32) * width)[None, :]
    row = (np.arange(n, dtype=np.int64) * m)[:, None]
    xf = np.ascontiguousarray(X, dtype="float64").ravel()
    node = np.ones((n, t_count), dtype=np.int32)
    for _ in range(max_depth):
        flat = base + node
        f = ff[flat]
        leaf = f < 0
        x = xf[row + np.maximum(f, 0)]
        node = np.where(leaf, node, 2 * node + (x > tf[flat]))
    return pf[base + node]


def _ones(n: np.ndarray) -> np.ndarray:
    """64-bit words whose lowest ``n`` bits are set."""
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


class LeafSets:
    """Where rows end in some trees, by sets of leaves instead of steps.

    A tree's leaves are numbered from left to right. A test that sends a row
    to the right rules out the leaves left of it; the lowest leaf that no test
    rules out is the row's. For every feature, the thresholds of all trees in
    order cut its values into intervals, and a table holds the leaves that a
    value in an interval leaves possible (as bits, for all trees). So a row
    reads one line of a table per feature and joins them, whatever the depth.
    """

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray, max_depth: int, m: int):
        self.n_trees, width = feature.shape
        k = np.arange(width)
        depth = np.floor(np.log2(np.maximum(k, 1))).astype(int)
        slot = (k - (1 << depth)) << (max_depth - depth)  # the first of 2^max_depth places below the node
        half = (1 << (max_depth - depth)) >> 1
        inner = np.zeros(feature.shape, bool)
        there = np.zeros(feature.shape, bool)
        there[:, 1] = True
        for d in range(max_depth + 1):
            at = np.arange(1 << d, 1 << (d + 1))
            if d < max_depth:
                inner[:, at] = there[:, at] & (feature[:, at] >= 0)
                there[:, 2 * at] = there[:, 2 * at + 1] = inner[:, at]
        t, at = np.nonzero(there & ~inner)
        taken = np.zeros((self.n_trees, (1 << max_depth) + 1), int)
        taken[t, slot[at] + 1] = 1
        before = np.cumsum(taken, axis=1)  # leaves left of a place
        most = int(before[:, -1].max())
        self.words = -(-most // 64)
        self.paths = np.zeros((self.n_trees, most))
        self.paths[t, before[t, slot[at]]] = path[t, at]
        self.first = (np.arange(self.n_trees) * most)[None, :]
        self.cuts, self.tables = [], []
        for f in range(m):
            t, at = np.nonzero(inner & (feature == f))
            cuts = np.unique(threshold[t, at])
            table = np.full((len(cuts) + 1, self.words, self.n_trees), ~np.uint64(0))
            row = np.searchsorted(cuts, threshold[t, at]) + 1
            begin, end = before[t, slot[at]], before[t, slot[at] + half[at]]
            for w in range(self.words):
                left = _ones(np.clip(end - 64 * w, 0, 64)) & ~_ones(np.clip(begin - 64 * w, 0, 64))
                np.bitwise_and.at(table[:, w, :], (row, t), ~left)
            np.bitwise_and.accumulate(table, axis=0, out=table)
            self.cuts.append(cuts)
            self.tables.append(table.reshape(len(cuts) + 1, -1))

    def __call__(self, X: np.ndarray) -> np.ndarray:
        """(n, trees) path lengths."""
        left = None
        for x, cuts, table in zip(X.T, self.cuts, self.tables):
            row = np.searchsorted(cuts, x)  # thresholds below x
            row[np.isnan(x)] = 0  # never above a threshold
            lines = table[row]
            left = lines if left is None else np.bitwise_and(left, lines, out=left)
        left = left.reshape(len(X), self.words, self.n_trees)
        word, number = left[:, -1], self.first + 64 * (self.words - 1)
        for w in reversed(range(self.words - 1)):  # the first word with a leaf in it
            some = left[:, w] != 0
            word, number = np.where(some, left[:, w], word), np.where(some, self.first + 64 * w, number)
        lowest = word & (~word + np.uint64(1))
        bit = (lowest.astype(np.float64).view(np.int64) >> 52) - 1023  # the exponent of a power of two
        return self.paths.ravel()[number + bit]


#: Rows in one block (measured: 15.7-20 us a row by ``path_lengths``, 5.6-8 us by sets; 21,222 nodes in 100 trees).
SET_ROWS = 1000
#: Bytes of one group's tables in ``LeafSets``; trees are taken in groups that stay below.
LEAF_SET_BYTES = 16 << 20
#: Groups at most, so that a worker's tables stay below 64 MB.
LEAF_SET_GROUPS = 4


class TreeWalk:
    """The forest's arrays, as broadcast; path lengths of a batch, all trees at once.

    Trees go by ``LeafSets`` in groups whose tables stay below ``LEAF_SET_BYTES``
    (built once a worker); a forest that needs more than ``LEAF_SET_GROUPS`` of them goes by
    ``path_lengths``. The values are the same.
    """

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray, max_depth: int):
        self.arrays, self.max_depth, self.groups = (feature, threshold, path), max_depth, None

    def __getstate__(self):
        return {**self.__dict__, "groups": None}

    def _prepare(self, m: int) -> None:
        feature, threshold, path = self.arrays
        inner = int((feature >= 0).sum(axis=1).max(initial=0))
        size = int((LEAF_SET_BYTES / (8 * (inner + m) * (inner // 64 + 1))) ** 0.5)  # g trees: g * inner lines of g * words
        self.groups = [LeafSets(feature[i : i + size], threshold[i : i + size], path[i : i + size], self.max_depth, m) for i in range(0, len(feature), size)] if size * LEAF_SET_GROUPS >= len(feature) else []

    def __call__(self, X: np.ndarray) -> np.ndarray:
        if self.groups is None:
            self._prepare(X.shape[1])
        if not self.groups:
            return path_lengths(X, *self.arrays, self.max_depth)
        return np.concatenate([g(X) for g in self.groups], axis=1) if len(self.groups) > 1 else self.groups[0](X)

    def mean(self, X: np.ndarray) -> np.ndarray:
        """Mean path length of every row, in blocks that stay in the cache."""
        if not len(X):
            return np.empty(0)
        return np.concatenate([mean_of_paths(self(X[i : i + SET_ROWS])) for i in range(0, len(X), SET_ROWS)])


def mean_of_paths(paths: np.ndarray) -> np.ndarray:
    """E[h] per row, independent of tree order: the row's path lengths are
    sorted and added one after another, so two rows with the same lengths in
    different trees get the same bits (and a score tied with the offset
    gives exactly 0). A SQL twin gets the same sum from ``sum(x ORDER BY x)``."""
    p = np.sort(paths, axis=1)
    total = p[:, 0].copy()
    for j in range(1, p.shape[1]):
        total += p[:, j]
    return total / p.shape[1]


def mean_path(forest: Forest, spark: SparkSession) -> Column:
    """Average path length over the trees, as an Arrow-batched column."""
    bc = forest.broadcast(spark)
    ship_package(spark)

    @F.pandas_udf("double")
    def avg_path(*cols: pd.Series) -> pd.Series:
        return pd.Series(bc.value.mean(np.column_stack([c.to_numpy(dtype="float64") for c in cols])))

    return avg_path(*[F.col(f).cast("double") for f in forest.features])


def _literal(values: np.ndarray, kind: str) -> Column:
    """A constant array column: parsed from one text when the query is planned, not built value by value."""
    text = json.dumps([v if math.isfinite(v) else str(v) for v in values.tolist()])  # Spark reads "Infinity" and "NaN" as text
    return F.from_json(F.lit(text.replace('"inf"', '"Infinity"').replace('"nan"', '"NaN"')), f"array<{kind}>")


def mean_path_jvm(forest: Forest) -> Column:
    """A6 without Python workers: the same mean as ``mean_path``, bit for bit, as one column.

    The forest's node arrays are constants of the plan. Every tree is walked by
    a fold over as many levels as it has at most; a leaf is its own child, so
    a row that has arrived stays. The paths are sorted and added in sequence.
    Folds are not compiled: for whole tables, ``with_mean_path_jvm`` is the faster form.
    """
    check_forest_size(forest.n_trees, forest.psi)
    n_trees, width = forest.feature.shape
    here = np.arange(n_trees * width)
    node = here % width
    feature = forest.feature.ravel().astype(int)
    leaf = (feature < 0) | (2 * node + 1 >= width)
    left = np.where(leaf, here, here + node)  # tree * width + 2 * node
    children = [_literal(c, "int") for c in (left, np.where(leaf, here, left + 1))]
    split = _literal(np.where(leaf, 0, feature), "int")
    threshold = _literal(np.where(leaf, 0.0, forest.threshold.ravel()), "double")
    path = _literal(forest.path.ravel(), "double")
    roots = _literal(np.arange(n_trees) * width + 1, "int")
    levels = F.sequence(F.lit(1), F.lit(forest.max_depth))

    def walk(x: Column, root: Column) -> Column:
        step = lambda n, _: F.when(F.get(x, F.get(split, n)) > F.get(threshold, n), F.get(children[1], n)).otherwise(F.get(children[0], n))
        return F.get(path, F.aggregate(levels, root, step))

    row = F.array(F.array(*[F.col(f).cast("double") for f in forest.features]))  # bound once a row, not once a step
    paths = F.get(F.transform(row, lambda x: F.transform(roots, lambda root: walk(x, root))), 0)
    return _mean_in_order(paths, n_trees)


def _mean_in_order(paths: Column, n_trees: int) -> Column:
    return F.aggregate(F.sort_array(paths), F.lit(0.0), lambda total, p: total + p) / F.lit(float(n_trees))


def _numbered(forest: Forest, tree: int) -> tuple[dict[str, np.ndarray], int]:
    """A tree's own nodes, numbered level by level from the root (0), and its depth; a leaf is its own child."""
    width = forest.feature.shape[1]
    is_leaf = lambda k: forest.feature[tree, k] < 0 or 2 * k + 1 >= width
    nodes = [1]
    for k in nodes:
        if not is_leaf(k):
            nodes += [2 * k, 2 * k + 1]
    place = {k: i for i, k in enumerate(nodes)}
    leaf = np.array([is_leaf(k) for k in nodes])
    child = lambda side: np.array([place.get(2 * k + side, i) for i, k in enumerate(nodes)])
    arrays = {
        "left": child(0),
        "right": child(1),
        "split": np.where(leaf, 0, forest.feature[tree, nodes].astype(int)),
        "threshold": np.where(leaf, 0.0, forest.threshold[tree, nodes]),
        "path": forest.path[tree, nodes],
    }
    return arrays, nodes[-1].bit_length() - 1


def with_mean_path_jvm(df: DataFrame, forest: Forest, out: str = "mean_path") -> DataFrame:
    """A6 without Python workers for a whole table: adds ``out``, equal to ``mean_path`` bit for bit.

    All trees go down one level a projection: a tree's node is a column, and a
    level looks its split and children up in the tree's arrays, which are
    constants of the plan. So the steps are compiled expressions and not folds.
    A row's columns are as many as the trees, whatever the table.
    """
    check_forest_size(forest.n_trees, forest.psi)
    kinds = {"left": "int", "right": "int", "split": "int", "threshold": "double", "path": "double"}
    numbered = [_numbered(forest, t) for t in range(forest.n_trees)]
    trees = [{name: _literal(values, kinds[name]) for name, values in arrays.items()} for arrays, _ in numbered]
    depths = [depth for _, depth in numbered]
    keep, nodes, x = [F.col(f"`{c}`") for c in df.columns], [f"_walk_{t}" for t in range(forest.n_trees)], F.col("_walk_x")
    walked = df.select(*keep, F.array(*[F.col(f).cast("double") for f in forest.features]).alias("_walk_x"))

    def step(tree: dict[str, Column], n: Column) -> Column:
        return F.when(F.get(x, F.get(tree["split"], n)) > F.get(tree["threshold"], n), F.get(tree["right"], n)).otherwise(F.get(tree["left"], n))

    for level in range(max(depths, default=0)):
        at = [F.lit(0) if level == 0 else F.col(c) for c in nodes]
        walked = walked.select(*keep, x, *[(step(tree, n) if level < depth else n).alias(c) for tree, n, depth, c in zip(trees, at, depths, nodes)])
    ends = [F.get(tree["path"], F.col(c) if any(depths) else F.lit(0)) for tree, c in zip(trees, nodes)]
    paths = F.array(*[F.coalesce(p, F.lit(0.0)) for p in ends])  # never null: says so to the sort
    return walked.select(*keep, _mean_in_order(paths, forest.n_trees).alias(out))


def score_samples(forest: Forest, spark: SparkSession, engine: str = "arrow", walked: str | None = None) -> Column:
    """-2^(-E[h] / c(psi)); lower is more anomalous.

    ``engine="arrow"`` walks the trees in numpy over Arrow batches,
    ``engine="jvm"`` in column expressions, without Python workers. ``walked``
    names the column of mean paths when the table went through
    ``with_mean_path_jvm``.
    """
    if engine not in ("arrow", "jvm"):
        raise ValueError("engine must be 'arrow' or 'jvm'")
    if walked is not None and engine != "jvm":
        raise ValueError("only engine='jvm' takes walked paths")
    mean = F.col(walked) if walked is not None else mean_path(forest, spark) if engine == "arrow" else mean_path_jvm(forest)
    return -F.pow(F.lit(2.0), -mean / F.lit(c_of(forest.psi)))


def fit_forest(
    df: DataFrame,
    n_trees: int = FOREST_TREES,
    max_samples: int = FOREST_MAX_SAMPLES,
    contamination: float = FOREST_CONTAMINATION,
    seed: int = FOREST_SEED,
    features=FEATURES,
    id_col: str = ID,
    persist: bool = True,
    row_key: tuple[str, ...] = (),
    quantile: str = "exact",
) -> Forest:
    """A4 + A5: grow the forest on a bounded sample, then set the offset.

    ``quantile="sketch"`` takes the offset from a mergeable sketch: one pass
    over the scores, a rank off by at most ``quantile.sketch_rank_error()``.

    The input is read three times (count, sample, training scores), so unless
    the caller already holds it, only the id and feature columns are persisted
    (memory, spilling to disk) for the duration of the fit.
    """
    from pyspark.storagelevel import StorageLevel

    if quantile not in ("exact", "sketch"):
        raise ValueError("quantile must be 'exact' or 'sketch'")
    spark = df.sparkSession
    source = df.select(*dict.fromkeys((id_col, *row_key, *features)))
    if persist:
        source = source.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, psi, base, frac = _sample_setup(source, n_trees, max_samples, features, id_col, None, seed, row_key)
        check_forest_size(n_trees, psi)
        while True:
            nodes = grow_forest(_sample_plan(base, n_trees, psi, seed, features, id_col, frac), psi, seed, features).toPandas()
            # Every tree's root holds its whole sample: the cut let enough rows through
            # iff the roots hold T * psi rows (at most T * 2^(depth+1) nodes come back).
            if frac >= 1.0 or int(nodes.loc[nodes["node"] == 1, "size"].sum()) == n_trees * psi:
                break
            frac = min(1.0, 4.0 * frac)
        forest = Forest.from_nodes(nodes, n_trees, psi, features, seed, contamination)
        scores = source.select(score_samples(forest, spark).alias("score"))
        if quantile == "sketch":
            forest.offset = sketch_quantile(scores, "score", contamination)
            return forest
        scores = scores.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            forest.offset = exact_quantile(scores, "score", contamination)
        finally:
            scores.unpersist()
    finally:
        if persist:
            source.unpersist()
    return forest


def anomaly_score(df: DataFrame, forest: Forest, out: str = "anomaly_score", engine: str = "arrow") -> DataFrame:
    """M3: score_samples - offset (the decision function); negative = anomaly."""
    if forest.offset is None:
        raise ValueError("forest has no offset; fit it with fit_forest")
    if engine == "jvm":
        walked = with_mean_path_jvm(df, forest, "_mean_path")
        return walked.withColumn(out, score_samples(forest, df.sparkSession, engine, "_mean_path") - F.lit(forest.offset)).drop("_mean_path")
    return df.withColumn(out, score_samples(forest, df.sparkSession, engine) - F.lit(forest.offset))


def anomaly_label(score: Column, decimals: int | None = None) -> Column:
    """M4: -1 for an anomaly (score < 0), else 1."""
    s = F.round(score, decimals) if decimals is not None else score
    return F.when(s < 0, -1).otherwise(1)
