"""Hard-negative mining by inner product: a BOND scan over vertical blocks.

For every anchor: its positives are the best rows of its own label; a hard
negative of a positive is a row of another label whose score lies in a window
below the positive's (by default 50 % to 95 % of it), the best few of these.

Rows lie in blocks, stored by column: a block holds its rows in label order,
one line of integers per dimension, and the least and greatest value of every
dimension. An anchor reads the dimensions in the order of its own components'
descending magnitude and adds up partial scores of a candidate bitmap. After
each step the dimensions not yet read can add no more and no less than the
anchor's components times the block's extremes; candidates that can no longer
matter leave the bitmap. Only the survivors are read to the last dimension.

1. Positives: the bitmap starts with the anchor's label (a run of the block). A
   candidate leaves once it cannot reach the best ``positives`` found so far.
2. Negatives: the bitmap starts with the other labels. A candidate leaves once
   it can be in no positive's window, or only below the window's best
   ``negatives``, until the exact windows resolve.

On Spark, anchors lie in blocks too, and row blocks in bounded groups; one unit
of work is an anchor block and a group, so neither all rows nor all anchors
ever sit in one place. A unit keeps running lists per anchor, so each block
starts from the cutoffs of the blocks before it, and sends its few best rows;
these merge by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costwise.llm.common import finite_vector, python_ready, scaled_floor, slices, stage

POSITIVES, NEGATIVES = 5, 3
#: A negative's score times 100 lies between these multiples of its positive's.
LOW, HIGH = 50, 95
ROWS_PER_BLOCK, BLOCKS_PER_GROUP, ANCHORS_PER_BLOCK = 8192, 16, 1024
#: Shares of the dimensions after which candidates are tested.
STEPS = (0.375, 0.5, 0.625, 0.75, 0.875)
_EXACT = 1 << 53
_BLOCK = "rows binary, ids binary, names array<string>, starts binary, columns binary, dim int, kind string"
_POSITIVE = "anchor_row long, positive_row long, positive_id long, positive_score long"
_NEGATIVE = "anchor_row long, positive_row long, negative_id long, negative_score long"


class Block:
    """A vertical block: ``columns`` (dim, n) in label order, label i in [starts[i], starts[i + 1])."""

    def __init__(self, rows, ids, names, starts, columns):
        self.rows, self.ids, self.columns = rows, ids, columns
        self.runs = {name: (int(starts[i]), int(starts[i + 1])) for i, name in enumerate(names)}
        self.least = columns.min(axis=1) if columns.size else np.zeros(len(columns))
        self.most = columns.max(axis=1) if columns.size else np.zeros(len(columns))

    @staticmethod
    def read(row: dict, exact: bool) -> "Block":
        raw = np.frombuffer(row["columns"], row["kind"])
        columns = raw.reshape(row["dim"], -1) if row["dim"] else np.zeros((0, len(row["ids"]) // 8), np.int64)
        return Block(*[np.frombuffer(row[c], np.int64) for c in ("rows", "ids")], row["names"], np.frombuffer(row["starts"], np.int64), columns.astype(np.float64 if exact else object))


def scan(block: Block, a: np.ndarray, at: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the candidates ``at`` that ``keep`` lets through.

    ``keep(low, high, last)`` gets the candidates' least and greatest possible
    scores and says which stay; at the end both are the score itself.
    """
    order = np.argsort(-np.abs(a), kind="stable")
    a, dim = a[order], len(a)
    ends = sorted({max(1, int(dim * s)) for s in STEPS if dim > 8} | {dim})
    one, two = a * block.least[order], a * block.most[order]
    low, high = np.minimum(one, two), np.maximum(one, two)
    rest_low = np.concatenate([np.cumsum(low[::-1])[::-1], [0]])
    rest_high = np.concatenate([np.cumsum(high[::-1])[::-1], [0]])
    score, begin = np.zeros(len(at), block.columns.dtype), 0
    run = len(at) and at[-1] - at[0] + 1 == len(at)  # a run of rows is read without gathering
    for end in ends:
        read = block.columns[order[begin:end]]
        score = score + a[begin:end] @ (read[:, at[0] : at[-1] + 1] if run else read[:, at])
        stay = keep(score + rest_low[end], score + rest_high[end], end == dim)
        if not stay.all():
            at, score, run = at[stay], score[stay], False
        if not len(at):
            break
        begin = end
    return at, score


def kth(values: np.ndarray, k: int):
    """The k-th greatest value, None if there are fewer."""
    if len(values) < k:
        return None
    return sorted(values, reverse=True)[k - 1] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= kth(score, k))
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


class Best:
    """A running list of the k best (score, id, row)."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.rows = k, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def cutoff(self):
        return self.score[-1] if len(self.score) == self.k else None

    def add(self, score, ids, rows) -> None:
        if len(score):
            score, ids, rows = np.concatenate([self.score, score]), np.concatenate([self.ids, ids]), np.concatenate([self.rows, rows])
            at = best(score, ids, self.k)
            self.score, self.ids, self.rows = score[at], ids[at], rows[at]


def add_positives(block: Block, label: str, row: int, a: np.ndarray, found: Best) -> None:
    """The anchor's label run of a block, into its list; its own row is no candidate."""
    if label not in block.runs:
        return
    at = np.arange(*block.runs[label])
    at = at[block.rows[at] != row]

    def keep(low, high, last):
        floor = found.cutoff
        here = kth(low, found.k)
        if here is not None:
            floor = here if floor is None else max(floor, here)
        return np.ones(len(low), bool) if floor is None else np.asarray(high >= floor, bool)

    if len(at):
        at, score = scan(block, a, at, keep)
        found.add(score, block.ids[at], block.rows[at])


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest integer s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def add_negatives(block: Block, label: str, a: np.ndarray, windows: list[tuple[int, int]], found: list[Best]) -> None:
    """Rows of other labels, into the list of every window they lie in."""
    n = len(block.ids)
    first, last_ = block.runs.get(label, (0, 0))
    at = np.concatenate([np.arange(first), np.arange(last_, n)])
    open_ = [(lo, hi, f) for (lo, hi), f in zip(windows, found) if lo <= hi]
    if not len(at) or not open_:
        return

    def floor_of(lo, f):
        return lo if f.cutoff is None else max(lo, f.cutoff)

    def keep(low, high, last):
        least, most = min(floor_of(lo, f) for lo, _, f in open_), max(hi for _, hi, _ in open_)
        stay = np.asarray((high >= least) & (low <= most), bool)
        places = np.flatnonzero(stay)
        if last or not len(places):
            return stay
        low, high, some = low[places], high[places], np.zeros(len(places), bool)
        for lo, hi, f in open_:
            inside = low[np.asarray((low >= lo) & (high <= hi), bool)]  # surely in the window
            floor, here = floor_of(lo, f), kth(inside, f.k)
            floor = floor if here is None else max(floor, here)
            some |= np.asarray((high >= floor) & (low <= hi), bool)
        stay[places] = some
        return stay

    at, score = scan(block, a, at, keep)
    for lo, hi, f in open_:
        mine = np.flatnonzero(np.asarray((score >= lo) & (score <= hi), bool))
        f.add(score[mine], block.ids[at[mine]], block.rows[at[mine]])


# ---------------------------------------------------------------- tasks
def _pack(batches: Iterator[pa.RecordBatch], rows_per_block: int, kind: str) -> Iterator[pa.RecordBatch]:
    """(row, vec_id, label, ints, block), clustered by block number and in label order -> vertical blocks of integers of a kind."""

    def block(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ints = t.column("ints")
        lengths, flat = np.diff(ints.offsets.to_numpy()), ints.flatten().to_numpy(zero_copy_only=False)
        n, dim = t.num_rows, int(lengths.max(initial=0))
        m = np.zeros((n, dim), kind)  # shorter vectors are filled up with zeros: no product changes
        m[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        labels = t.column("label").to_pylist()
        starts = [i for i in range(n) if not i or labels[i] != labels[i - 1]]
        cols = [t.column("row").to_numpy().tobytes(), t.column("vec_id").to_numpy().tobytes(), [labels[i] for i in starts], np.array([*starts, n], np.int64).tobytes(), np.ascontiguousarray(m.T).tobytes(), dim, kind]
        types = [pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([c], ty) for c, ty in zip(cols, types)], [f.split()[0] for f in _BLOCK.split(", ")])

    held, now, count = [], None, 0
    for b in slices(batches, rows_per_block):
        numbers = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for i, j in zip(cuts, cuts[1:]):
            if held and (numbers[i] != now or count + j - i > 2 * rows_per_block):
                yield block(held)
                held, count = [], 0
            held.append(b.slice(i, j - i))
            now, count = numbers[i], count + j - i
    if held:
        yield block(held)


def _table(schema: str, cols: list[list]) -> pa.Table:
    arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols]
    return pa.Table.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])


def _as_long(score: np.ndarray) -> np.ndarray:
    ends = np.iinfo(np.int64)
    return np.array([min(max(int(s), ends.min), ends.max) for s in score], np.int64) if score.dtype == object else score.astype(np.int64)


def _padded(a: list[int], dim: int, exact: bool) -> np.ndarray:
    return np.array(a + [0] * (dim - len(a)), np.float64 if exact else object)[:dim]  # what the block lacks is zero there


def _positives(anchors: pa.Table, blocks: pa.Table, k: int, exact: bool) -> pa.Table:
    lists = [(r, Best(k)) for r in anchors.select(["row", "label", "ints"]).to_pylist()]
    for b in blocks.to_batches():
        for row in b.to_pylist():
            block = Block.read(row, exact)
            for r, found in lists:
                add_positives(block, r["label"], r["row"], _padded(r["ints"], row["dim"], exact), found)
    out = [(np.full(len(f.ids), r["row"]), f.rows, f.ids, _as_long(f.score)) for r, f in lists if len(f.ids)]
    return _table(_POSITIVE, [list(c) for c in zip(*out)] or [[]] * 4)


def _negatives(anchors: pa.Table, blocks: pa.Table, k: int, low: int, high: int, exact: bool) -> pa.Table:
    lists = [(r, [window(p["positive_score"], low, high) for p in r["positives"]], [Best(k) for _ in r["positives"]]) for r in anchors.select(["row", "label", "ints", "positives"]).to_pylist()]
    for b in blocks.to_batches():
        for row in b.to_pylist():
            block = Block.read(row, exact)
            for r, windows, found in lists:
                add_negatives(block, r["label"], _padded(r["ints"], row["dim"], exact), windows, found)
    out = [(np.full(len(f.ids), r["row"]), np.full(len(f.ids), p["positive_row"]), f.ids, _as_long(f.score)) for r, _, found in lists for p, f in zip(r["positives"], found) if len(f.ids)]
    return _table(_NEGATIVE, [list(c) for c in zip(*out)] or [[]] * 4)


# ---------------------------------------------------------------- the job
def mine(
    vectors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    every: int = 50,
    low: int = LOW,
    high: int = HIGH,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    rows_per_block: int = ROWS_PER_BLOCK,
    blocks_per_group: int = BLOCKS_PER_GROUP,
    anchors_per_block: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; a positive is one
    of the ``positives`` best other rows of the anchor's label, and each comes
    with its ``negatives`` best rows of other labels with ``low`` * positive
    score <= 100 * score <= ``high`` * positive score. Scores are inner
    products of the components times ``scale``, rounded down; ties go to the
    smaller id, fewer rows are all returned, a positive without a negative has
    no row. Rows with a null id, label, vector or component, or a non-finite
    one, take no part. Rows that repeat an id are rows of their own: each is a
    candidate, and an anchor where its id is one's; copies of an anchor are
    its positives. Vectors of unequal length share the components that both
    have. A positive's score beyond 64 bits is held at the end of the range.
    An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    fine = F.when(finite_vector(F.col(vec_col)), scaled_floor(F.col(vec_col), scale))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), fine.alias("ints")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND ints IS NOT NULL")
    rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "mine-rows")  # written, so a row keeps its number
    is_anchor = F.col("vec_id") % every == 0
    reach = F.greatest(F.abs(F.coalesce(F.array_max("ints").cast("double"), F.lit(0.0))), F.abs(F.coalesce(F.array_min("ints").cast("double"), F.lit(0.0))))
    n, n_anchors, dim, most = rows.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1)), F.max(F.size("ints")), F.max(reach)).first()
    exact = (dim or 0) * float(most or 0) ** 2 < _EXACT  # doubles hold every partial sum, else Python integers
    n_blocks = max(1, -(-n // rows_per_block))
    groups = -(-n_blocks // blocks_per_group)
    if anchors_per_block is None:  # four units a core at least; every anchor block reads all rows once, so no smaller than that needs
        wanted = -(-4 * spark.sparkContext.defaultParallelism // groups)
        anchors_per_block = min(ANCHORS_PER_BLOCK, max(1, n_anchors // wanted))
    anchor_blocks = max(1, -(-n_anchors // anchors_per_block))
    kind = next((t for t in ("int16", "int32") if (most or 0) < np.iinfo(t).max), "int64")

    number = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")
    dealt = rows.withColumn("block", number).repartition(n_blocks, "block").sortWithinPartitions("block", "label")
    packed = stage(dealt.mapInArrow(lambda it: _pack(it, rows_per_block, kind), _BLOCK), "mine-blocks")
    numbered = packed.withColumn("group", F.pmod(F.xxhash64("rows"), F.lit(groups)).cast("int"))
    anchors = rows.filter(is_anchor).withColumn("anchors", F.pmod(F.xxhash64("row"), F.lit(anchor_blocks)).cast("int"))

    def in_units(asked: DataFrame, fn, schema: str, name: str) -> DataFrame:
        left = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = numbered.withColumn("anchors", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
        return stage(left.groupBy("anchors", "group").cogroup(right.groupBy("anchors", "group")).applyInArrow(fn, schema), name)

    found = in_units(anchors, lambda a, b: _positives(a, b, positives, exact), _POSITIVE, "mine-positives")
    top = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    chosen = found.withColumn("_place", F.row_number().over(top)).filter(F.col("_place") <= positives).drop("_place")
    lists = chosen.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("positive_row", "positive_id", "positive_score"))).alias("positives"))  # ``positives`` at most
    asked = stage(anchors.join(lists, "row"), "mine-anchors")

    hits = in_units(asked, lambda a, b: _negatives(a, b, negatives, low, high, exact), _NEGATIVE, "mine-negatives")
    rank = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), "negative_id")
    kept = hits.withColumn("rank", F.row_number().over(rank).cast("int")).filter(F.col("rank") <= negatives)
    pairs = asked.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.inline("positives"))
    return kept.join(pairs, ["anchor_row", "positive_row"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH base AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM base a JOIN base r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT p.*, s.vec_id, s.score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
) WHERE place <= 3
"""
