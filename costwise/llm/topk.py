"""Exact top-k search by inner product: three phases with a uniform threshold.

Vectors are integers (each component times ``scale``, rounded down) and lie in
row blocks; queries are rows too and lie in query blocks. A unit of work is a
bounded group of query blocks and a bounded group of row blocks, so neither all
rows nor all queries ever sit in one place. Blocks are dealt to units by
shuffles, never broadcast: a query block goes once to every group of row blocks.

1. Gather: in every row block a few rows a query are picked by the leading
   components (a quarter of the work) and scored exactly; a unit sends the best
   of these scores. The k-th best score over the lists of all units is a safe
   cutoff for the query, because the true k-th best over all rows cannot be
   lower; it tightens as the table grows.
2. Collect: the cutoffs travel with the query blocks to all row blocks, the same
   threshold to each. More components are multiplied out; the rest adds at most
   the product of the two remaining norms. Entries whose bound reaches the
   cutoff suffice.
3. Resolve: those entries are scored exactly, and each unit keeps its best k per
   query (ties to the smaller id); these raise the cutoffs of the unit's further
   blocks. The lists merge by rank.

Products are taken in floating point that is exact for them: single precision
while sums of products stay below 2^24, double precision below 2^53; a block
whose norms allow more is computed in Python integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costwise.llm.common import discard, python_ready, slices, stage

ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 2048
#: Bytes of row blocks and of query blocks in a unit at most (one block at least).
ROW_BYTES, QUERY_BYTES = 16 << 20, 8 << 20
#: Pairs of a query and a row whose products are held at once.
_PAIRS = 1 << 21
_SINGLE, _EXACT = float(1 << 24), float(1 << 53)
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Scores that a unit sends for a query at least, the rows a block scores for it, and the share of the components they are picked by.
FEW, PICKS, PICK = 4, 32, 0.25
_INTS = "vec_id long, ints binary, dim int, bytes int"
_PACKED = "block int, ids binary, vectors binary, dim int, kind string"
_LISTS = "block int, scores binary"
_CUTS = "block int, cuts binary"
_HITS = "query_id long, vec_id long, score long"


def _reach(m: np.ndarray) -> float:
    """The greatest absolute value (the least integer of a type has none in it)."""
    return max(-float(m.min(initial=0)), float(m.max(initial=0)))


def _width(reach: float) -> str:
    """The narrowest integers that hold the range."""
    return next((t for t in ("int8", "int16", "int32") if reach <= np.iinfo(t).max), "int64")


def _integers(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(vec_id, vec) -> (vec_id, components times ``scale`` rounded down, their number, bytes each);
    vectors with a null or non-finite component are left out."""
    for b in slices(batches, 2048):
        ids, vectors = b.columns
        lengths = np.diff(vectors.offsets.to_numpy())
        v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
        fine = np.isfinite(v)
        missing = np.concatenate([[0], np.cumsum(~fine)])[np.concatenate([[0], np.cumsum(lengths)])]
        keep = np.diff(missing) == 0
        with np.errstate(over="ignore"):
            v = np.floor(v[np.repeat(keep, lengths)] * scale)
        ints = np.where(np.abs(v) < 2.0**63, v, 0).astype(np.int64)
        ints[v >= 2.0**63], ints[v <= -(2.0**63)] = _MOST, _LEAST  # held at the ends of the range
        ints, lengths = ints.astype(_width(_reach(ints))), lengths[keep]
        size = ints.itemsize
        ends = np.concatenate([[0], np.cumsum(lengths * size)]).astype(np.int32)
        cols = [ids.filter(pa.array(keep)), pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(ints.tobytes())])]
        cols += [pa.array(lengths, pa.int32()), pa.array(np.full(len(lengths), size), pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, _names(_INTS))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows clustered by block (block, vec_id, ints, dim, bytes) -> one row per block.

    Vectors of another length share no inner product with a query; they are
    padded with zeros to the longest of the block, which changes no product.
    """
    now, held = None, []

    def close():
        t = pa.Table.from_batches(held).combine_chunks()
        ids, lengths, sizes = (t.column(c).to_numpy() for c in ("vec_id", "dim", "bytes"))
        n, dim, raw = len(ids), int(lengths.max(initial=0)), t.column("ints").to_pylist()
        m = np.zeros((n, dim), f"int{8 * sizes.max()}")
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            flat, long = np.frombuffer(b"".join(raw[i] for i in at), f"int{8 * size}"), lengths[at]
            m[np.repeat(at, long), np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long)] = flat
        m = m.astype(_width(_reach(m)))
        values = [now, ids.tobytes(), m.tobytes(), dim, m.dtype.name]
        types = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], ty) for v, ty in zip(values, types)], _names(_PACKED))

    for b in slices(batches, 2048):
        numbers = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for i, j in zip(cuts, cuts[1:]):
            if held and numbers[i] != now:
                yield close()
                held = []
            now = numbers[i]
            held.append(b.slice(i, j - i))
    if held:
        yield close()


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _blocks(table: pa.Table) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(row, matrix, ids) of each packed block."""
    for b in table.to_batches(max_chunksize=1):
        for r in b.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            yield r, np.frombuffer(r["vectors"], r["kind"]).reshape(len(ids), r["dim"]), ids


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _pair(q: np.ndarray, x: np.ndarray):
    """Both blocks at the same width, and the kind of numbers that is exact for their products."""
    width = max(q.shape[1], x.shape[1])
    top = _reach(q) * _reach(x) * max(1, width)
    kind = np.float32 if top < _SINGLE else np.float64 if top < _EXACT else object  # object: Python's integers, exact at any size
    return _padded(q, width), _padded(x, width), kind


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~scores[at]))[:k]]  # ~: the smallest long has no negative


def _long(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; what does not fit is held at the ends of the range."""
    if scores.dtype == object:
        return np.array([min(max(int(s), _LEAST), _MOST) for s in scores], np.int64)
    return scores.astype(np.int64)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))


def local_lists(q: np.ndarray, q_ids: np.ndarray, cut: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, lead: int):
    """(query place, row ids, scores) of each query's sufficient entries in one row block, in Python's integers.

    ``cut``: a safe cutoff per query (below it nothing counts).
    """
    if not len(q) or not len(x):
        return
    qf, xf = q.astype(object), x.astype(object)
    head = qf[:, :lead] @ xf[:, :lead].T
    tail_q, tail_x = _norms(q[:, lead:]), _norms(x[:, lead:])
    for i in range(len(q)):
        tail = tail_q[i] * tail_x * (1 + 1e-9)  # a little more than the bound: norms are rounded
        # integers only: a sum with a double is rounded and may fall below the cutoff
        at = np.flatnonzero(_long(head[i] + np.array([math.ceil(t) + 1 for t in tail], object)) >= cut[i])
        if not len(at):
            continue
        scores = head[i][at] + xf[at, lead:] @ qf[i, lead:]
        own = (x_ids[at] != q_ids[i]) & (_long(scores) >= cut[i])
        at, scores = at[own], scores[own]
        best = _best(_long(scores), x_ids[at], k)
        if len(best):
            yield i, x_ids[at[best]], scores[best]


def picked(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, picks: int, share: float) -> np.ndarray:
    """Exact scores (queries, picks) of a few rows of a block: of each of ``picks`` runs of
    rows the one that leads in the first components. The least long: no such row."""
    q, x, kind = _pair(q, x)
    n = min(picks, len(x))
    if not len(q) or not n:
        return np.zeros((len(q), 0), np.int64)
    run, lead = len(x) // n, math.ceil(q.shape[1] * share)
    loose = np.float64 if kind is object else kind  # doubles are good enough to pick by
    qf, xf = q.astype(kind), x.astype(kind)
    head_q, head_x = q[:, :lead].astype(loose), x[: n * run, :lead].astype(loose).T
    out, step = np.full((len(q), n), _LEAST), max(1, _PAIRS // len(x))
    products = np.empty((min(step, len(q)), n * run), loose)
    for a in range(0, len(q), step):
        head = np.matmul(head_q[a : a + step], head_x, out=products[: len(q) - a])
        at = head.reshape(len(head), n, run).argmax(axis=2) + np.arange(n) * run
        if kind is object:
            scores = np.array([_long(xf[at[i]] @ qf[a + i]) for i in range(len(at))])
        else:
            scores = np.einsum("isj,ij->is", xf[at], qf[a : a + step]).astype(np.int64)
        out[a : a + step] = np.where(x_ids[at] != q_ids[a : a + step, None], scores, _LEAST)
    return out


def _set(flags: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` flags that are set; few are, so eight at a time are looked at. Their number is a multiple of 8."""
    eights = np.flatnonzero(flags[: -(-n // 8) * 8].view(np.uint64))
    at = (eights[:, None] * 8 + np.arange(8)).ravel()
    return at[flags[at] & (at < n)]


class Lists:
    """The k best entries of each query of a block so far, and the cutoffs that follow."""

    def __init__(self, cut: np.ndarray, k: int):
        self.k, self.cut, self.last = k, cut.copy(), np.full(len(cut), _MOST)
        self.held, self.count = [], 0

    def add(self, places: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Entries that reach the cutoff and, at a full list's last score, its last id."""
        cut = self.cut[places]
        may = (scores > cut) | ((scores == cut) & (ids <= self.last[places]))
        self.held.append((places[may], ids[may], scores[may]))
        self.count += len(self.held[-1][0])
        if self.count > 2 * self.k * len(self.cut) + (1 << 16):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query places, row ids, scores), by place and rank."""
        if not self.held:
            return (np.zeros(0, np.int64),) * 3
        places, ids, scores = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, ~scores, places))
        rank = np.arange(len(order)) - np.searchsorted(places[order], places[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        places, ids, scores = places[order], ids[order], scores[order]
        full = rank == self.k - 1
        self.cut[places[full]], self.last[places[full]] = scores[full], ids[full]
        self.held, self.count = [(places, ids, scores)], len(places)
        return self.held[0]


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, lists: Lists, lead: int) -> None:
    """All sufficient entries of one row block, into the lists of a query block."""
    q, x, kind = _pair(q, x)
    if not len(q) or not len(x):
        return
    if kind is object:
        for i, ids, scores in local_lists(q, q_ids, lists.cut, x, x_ids, lists.k, lead):
            lists.add(np.full(len(ids), i), ids, _long(scores))
        return
    qf, xf = q.astype(kind), x.astype(kind)
    tail_q, tail_x = _norms(q[:, lead:]), _norms(x[:, lead:])
    unit = float(np.finfo(kind).eps)
    # the remaining norms as one more component: the product is the bound, within the rounding of its sum
    bound_q = np.column_stack([qf[:, :lead], (tail_q * (1 + 4 * unit)).astype(kind)])
    bound_x = np.column_stack([xf[:, :lead], (tail_x * (1 + 4 * unit)).astype(kind)]).T
    slack = 2 * (q.shape[1] + 4) * unit * _norms(q).max() * _norms(x).max()
    step = max(1, _PAIRS // len(x))
    products = np.empty((min(step, len(q)), len(x)), kind)
    reached = np.zeros(-(-products.size // 8) * 8, bool)
    for a in range(0, len(q), step):
        here = min(step, len(q) - a)
        floor = np.nextafter((lists.cut[a : a + step].astype(np.float64) - slack).astype(kind), kind(-np.inf))
        np.greater_equal(np.matmul(bound_q[a : a + step], bound_x, out=products[:here]), floor[:, None], out=reached[: here * len(x)].reshape(here, len(x)))
        i, j = np.divmod(_set(reached, here * len(x)), len(x))
        if not len(i):
            continue
        if len(i) > here * len(x) // 32:
            scores = (qf[a : a + step] @ xf.T)[i, j]
        else:
            some = max(1, _PAIRS // max(1, q.shape[1]))
            scores = np.concatenate([np.einsum("ij,ij->i", qf[a + i[c : c + some]], xf[j[c : c + some]]) for c in range(0, len(i), some)])
        i, ids, scores = i + a, x_ids[j], scores.astype(np.int64)
        other = ids != q_ids[i]
        lists.add(i[other], ids[other], scores[other])


def _groups(row_blocks: int, query_blocks: int, row_bytes: int, query_bytes: int, wanted: int) -> tuple[int, int]:
    """Numbers of groups of row blocks and of query blocks: within the bytes of a unit, and
    ``wanted`` units if there are as many pairs of blocks. Each group of the one kind goes to all groups of the other."""
    r, q = min(row_blocks, max(1, ROW_BYTES // row_bytes)), min(query_blocks, max(1, QUERY_BYTES // query_bytes))
    while True:
        groups = -(-row_blocks // r), -(-query_blocks // q)
        if groups[0] * groups[1] >= wanted or r == q == 1:
            return groups
        if q == 1 or (r > 1 and query_blocks * query_bytes * groups[0] <= row_blocks * row_bytes * groups[1]):  # what moves less
            r = -(-r // 2)
        else:
            q = -(-q // 2)


def top_k(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
    lead: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by integer inner product.

    Queries are the rows whose id is divisible by ``every``; a query's
    candidates are all rows of another id. Rows with a null id, a null vector
    or a null or non-finite component take no part. Ties go to the smaller
    id; with fewer candidates all are returned. Repeated ids are repeated
    candidates; a repeated query id is one query per distinct vector row and
    its lists merge by rank. An empty table gives no rows. ``lead``: leading
    components multiplied before the cutoff is applied (default: all but the
    last eighth).
    """
    spark = vectors.sparkSession
    python_ready(spark)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    if given.schema["vec"].dataType.simpleString() not in ("array<float>", "array<double>"):
        given = given.withColumn("vec", F.col("vec").cast("array<double>"))
    ints = stage(given.mapInArrow(lambda it: _integers(it, scale), _INTS), "topk-ints")
    is_query = F.col("vec_id") % every == 0
    n, n_q, dim, wide = ints.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max("dim"), F.max("bytes")).first()
    row_blocks, query_blocks = max(1, -(-n // rows_per_block)), max(1, -(-n_q // queries_per_block))
    lead = max(1, (dim or 1) - (dim or 1) // 8) if lead is None else lead
    each, cores = (dim or 0) * (wide or 1) + 8, spark.sparkContext.defaultParallelism  # each: bytes of a row
    groups, asked_groups = _groups(row_blocks, query_blocks, rows_per_block * each, queries_per_block * each, 4 * cores)
    units = groups * asked_groups

    def packed(df: DataFrame, blocks: int, seed: int, name: str) -> DataFrame:
        # a row's place is hashed from where it lies in the written table, so that repeated rows spread
        at = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")
        dealt = df.select(at, "*").repartition(max(min(blocks, 2 * cores), -(-blocks // 16)), "block")
        return stage(dealt.sortWithinPartitions("block").mapInArrow(_pack, _PACKED), name)

    rows = packed(ints, row_blocks, 1, "topk-rows")
    asked = packed(ints.filter(is_query), query_blocks, 2, "topk-queries")
    discard(ints)
    few = max(FEW, -(-2 * k // groups))

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        out, some = [], max(PICKS, -(-2 * few * groups // row_blocks))
        for r, q, q_ids in _blocks(left):
            best = np.full((len(q), few), _LEAST)
            for _, m, ids in _blocks(right):
                best = np.concatenate([best, picked(q, q_ids, m, ids, some, PICK)], axis=1)
                best = np.partition(best, best.shape[1] - few, axis=1)[:, -few:]
            out.append((r["block"], best.tobytes()))
        return pa.Table.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([s for _, s in out], pa.binary())], _names(_LISTS))

    def cutoffs(lists: pa.Table) -> pa.Table:
        scores = np.concatenate([np.frombuffer(s, np.int64).reshape(-1, few) for s in lists.column("scores").to_pylist()], axis=1)
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), _LEAST)
        return pa.Table.from_arrays([pa.array([lists.column("block")[0].as_py()], pa.int32()), pa.array([cut.tobytes()], pa.binary())], _names(_CUTS))

    def collect(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r, q, q_ids in _blocks(left):
            lists = Lists(np.frombuffer(r["cuts"], np.int64), k)
            for _, m, ids in _blocks(right):
                search(q, q_ids, m, ids, lists, lead)
            places, ids, scores = lists.best()
            out.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q_ids[places], ids, scores)], _names(_HITS)))
        return pa.Table.from_batches(out, pa.schema([(c, pa.int64()) for c in _names(_HITS)]))

    def in_units(asked: DataFrame, fn, schema: str, name: str) -> DataFrame:
        """Every group of query blocks with every group of row blocks."""
        unit = F.col("_row_group") * asked_groups + F.col("_query_group")
        left = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_row_group"), (F.col("block") % asked_groups).alias("_query_group"))
        right = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(asked_groups - 1))).alias("_query_group"), (F.col("block") % groups).alias("_row_group"))
        left, right = (d.withColumn("unit", unit).drop("_row_group", "_query_group").repartition(units, "unit") for d in (left, right))
        return stage(left.groupBy("unit").cogroup(right.groupBy("unit")).applyInArrow(fn, schema), name)

    lists = in_units(asked, gather, _LISTS, "topk-lists")
    cuts = lists.groupBy("block").applyInArrow(cutoffs, _CUTS)
    pairs = stage(asked.join(cuts.hint("merge"), "block"), "topk-cutoffs")
    found = in_units(pairs, collect, _HITS, "topk-hits")
    for done in (lists, asked, rows, pairs):
        discard(done)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


SQL = """
WITH ints AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM ints q JOIN ints r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""
