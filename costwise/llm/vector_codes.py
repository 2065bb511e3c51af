"""Vector code compression: product codes from integer k-means, with
norm-of-sum bounds.

Vectors are integers (each component times ``scale``, rounded down), cut into
``parts`` equal parts. Every part position has a codebook of ``entries``
entries, refined by ``rounds`` rounds of k-means; a vector's code is the index
of the nearest entry per part.

Most parts need no search in most rounds. A part carries an upper bound on the
distance to its entry and a lower bound on the distance to all others, each
with the stamp of the round in which it was exact. The whole codebook history
is kept (it is tiny), so a bound of round T is brought to round t by the true
net displacement |c(t) - c(T)| of an entry: the norm of the summed moves. That
is never more, and usually far less, than the moves of the single rounds added
up, because entries turn back and forth. Only where the two bounds meet is the
upper one made exact, and only where they still meet are all entries searched
again. Distances and sums are exact integers throughout.

On Spark: vectors lie in blocks that tasks write and read; a round is one
narrow pass that rewrites the blocks with their bounds and, per block, the sums
of its parts by entry. The sums are added up in one small aggregation
(parts x entries x components rows, whatever the table), and the driver holds
nothing but codebooks. A round reads the files of the round before it from the
shared folder, so a lost executor repeats its tasks and nothing else; files of
older rounds are deleted as soon as the next ones are written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.llm.common import discard, finite_vector, python_ready, scaled_floor, slices, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
BLOCK_ROWS = 8192
#: Label groups up to this many are broadcast (16 bytes each and the label), more are joined by a shuffle.
BROADCAST_LABELS = 100_000
_EXACT = 1 << 53
_LOW = (1 << 32) - 1


# ---------------------------------------------------------------- one block
def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(n, entries) squared distances of one part, exact: doubles below 2^53, else Python integers."""
    if x.dtype == object:
        return ((x[:, None, :] - book.astype(object)[None, :, :]) ** 2).sum(axis=2)
    c = book.astype(np.float64)
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def displacements(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From (rounds, parts, entries, d): per round T, part and entry the net way to
    the newest codebook, and the longest such way of the part's other entries."""
    own = np.sqrt(((history[-1][None].astype(np.float64) - history.astype(np.float64)) ** 2).sum(axis=3))
    other = np.zeros_like(own)
    if own.shape[2] > 1:
        ranked = np.sort(own, axis=2)
        top, second = ranked[:, :, -1:], ranked[:, :, -2:-1]
        at = own.argmax(axis=2)[:, :, None]
        other = np.where(np.arange(own.shape[2])[None, None, :] == at, second, top)
    return own, other


class Bounds:
    """Code, bounds and stamps of a block's parts, all (n, parts)."""

    def __init__(self, code, upper, lower, upper_at, lower_at):
        self.code, self.upper, self.lower, self.upper_at, self.lower_at = code, upper, lower, upper_at, lower_at

    @staticmethod
    def none(n: int, parts: int) -> "Bounds":
        """Nothing known: an upper bound without end meets every lower one."""
        return Bounds(np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf), np.zeros((n, parts)), np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.uint8))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.code, self.upper, self.lower, self.upper_at, self.lower_at


def _apart(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Upper bounds surely below lower ones, rounding included."""
    return upper * (1 + 1e-9) + 1e-6 < lower * (1 - 1e-9)


def assign(x: np.ndarray, bounds: Bounds, history: np.ndarray) -> int:
    """Bring the codes of a block (n, parts, d) to the newest codebook, in place.

    Returns how many parts were searched in full. The nearest entry is exact,
    ties go to the lower index: a part skipped by its bounds has one entry
    strictly nearer than all others, the one it has already.
    """
    own, other = displacements(history)
    now, searched = len(history) - 1, 0
    for p in range(x.shape[1]):
        a = bounds.code[:, p].astype(np.int64)
        if x.dtype == object:  # beyond doubles: no bounds
            bounds.code[:, p] = distances(x[:, p], history[-1][p]).argmin(axis=1)
            searched += len(a)
            continue
        lower = bounds.lower[:, p] - other[bounds.lower_at[:, p], p, a]
        upper = bounds.upper[:, p] + own[bounds.upper_at[:, p], p, a]
        near = np.flatnonzero(~_apart(upper, lower))
        if not len(near):
            continue
        book = history[-1][p]
        known = near[np.isfinite(bounds.upper[near, p])]  # make the upper bound exact first
        if len(known):
            gap = x[known, p] - book[a[known]].astype(np.float64)
            bounds.upper[known, p], bounds.upper_at[known, p] = np.sqrt((gap * gap).sum(axis=1)), now
            near = near[~_apart(bounds.upper[near, p], lower[near])]
        if not len(near):
            continue
        searched += len(near)
        d = distances(x[near, p], book)
        best = d.argmin(axis=1)
        rows = np.arange(len(near))
        least = d[rows, best]
        d[rows, best] = np.inf
        bounds.code[near, p] = best
        bounds.upper[near, p], bounds.upper_at[near, p] = np.sqrt(least), now
        bounds.lower[near, p], bounds.lower_at[near, p] = np.sqrt(d.min(axis=1)), now
    return searched


def part_sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """(parts, entries, d + 1, 2) longs: sums by entry and the count, each as high and low 32 bits."""
    n, parts, d = x.shape
    out = np.zeros((parts, entries, d + 1, 2), np.int64)
    for p in range(parts):
        if x.dtype == object:
            total = np.zeros((entries, d), object)
            np.add.at(total, code[:, p], x[:, p])
        else:
            member = np.zeros((entries, n))
            member[code[:, p], np.arange(n)] = 1.0
            total = (member @ x[:, p]).astype(np.int64)
        out[p, :, :d, 0], out[p, :, :d, 1] = total >> 32, total & _LOW
        out[p, :, d, 1] = np.bincount(code[:, p], minlength=entries)
    return out


def next_book(book: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries moved to the floor of their parts' mean; entries without parts stay."""
    out = book.copy()
    for p, e in np.ndindex(*book.shape[:2]):
        *total, n = [int(h) * (1 << 32) + int(lo) for h, lo in sums[p, e]]
        if n:
            out[p, e] = [t // n for t in total]
    return out


# ---------------------------------------------------------------- tasks
def _numbers(m: np.ndarray, exact: bool) -> np.ndarray:
    """Integers as doubles where these are exact, else as Python's."""
    return m.astype(np.float64 if exact else object)


_STATE = ("code", np.uint8), ("upper", np.float64), ("lower", np.float64), ("upper_at", np.uint8), ("lower_at", np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, dtype: str, block_rows: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, ints) -> one row per block; shorter vectors are filled up with zeros."""
    for b in slices(batches, block_rows):
        if not b.num_rows:
            continue
        lists = b.column(2)
        n, lengths = b.num_rows, np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if (lengths == width).all():
            m = flat.reshape(n, width)
        else:
            m = np.zeros((n, width), np.int64)
            m[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        held = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in (b.column(0), b.column(1))]
        yield pa.RecordBatch.from_arrays([*held, pa.array([m.astype(dtype).tobytes()], pa.binary()), *[pa.array([None], pa.binary())] * 6], _NAMES)


_NAMES = ["ids", "labels", "vectors", *[n for n, _ in _STATE], "sums"]


def _open(row: dict, parts: int, dtype: str, exact: bool) -> tuple[np.ndarray, Bounds]:
    raw = np.frombuffer(row["vectors"], dtype)
    n = len(row["ids"])
    x = _numbers(raw, exact).reshape(n, parts, -1)
    if row["code"] is None:
        return x, Bounds.none(n, parts)
    return x, Bounds(*[np.frombuffer(row[name], t).reshape(n, parts).copy() for name, t in _STATE])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """Block rows one by one, as Python values (ids and labels stay Arrow in the batch)."""
    for b in slices(batches, 1):
        yield {n: (b.column(i)[0].values if n in ("ids", "labels") else b.column(i)[0].as_py()) for i, n in enumerate(b.schema.names)}, b


def _round(batches, history: np.ndarray, dtype: str, exact: bool) -> Iterator[pa.RecordBatch]:
    parts, entries = history.shape[1:3]
    for row, b in _rows(batches):
        x, bounds = _open(row, parts, dtype, exact)
        assign(x, bounds, history)
        state = [pa.array([a.tobytes()], pa.binary()) for a in bounds.arrays()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *state, pa.array([part_sums(x, bounds.code, entries).tobytes()], pa.binary())], _NAMES)


def _add_sums(batches) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for raw in b.column(0).to_pylist():
            s = np.frombuffer(raw, np.int64)
            total = s.copy() if total is None else total + s
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["slot", "value"])


def _final(batches, history: np.ndarray, dtype: str, exact: bool, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    parts = history.shape[1]
    digits = np.array([f"{i:02x}" for i in range(256)])
    for row, _ in _rows(batches):
        x, bounds = _open(row, parts, dtype, exact)
        assign(x, bounds, history)
        error = 0
        for p in range(parts):
            gap = x[:, p] - _numbers(history[-1][p][bounds.code[:, p]], exact)
            error = error + (gap * gap).sum(axis=1)
        if not exact:
            error = [min(int(e), (1 << 63) - 1) for e in error]
        code = pa.array(["".join(c) for c in digits[bounds.code]], pa.string())
        yield pa.RecordBatch.from_arrays([row["ids"].cast(types[0]), row["labels"].cast(types[1]), code, pa.array(np.asarray(error, np.int64))], ["vec_id", "label", "code", "error"])


# ---------------------------------------------------------------- the job
def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: one row per vector that takes part.

    Rows whose vector is null or holds null or non-finite components take no
    part. The first codebook holds the parts of the ``entries`` vectors of the
    smallest ids (null ids last, rows of one id by their components), or of all
    vectors where there are fewer. Rows that repeat an id, or have none, are
    vectors of their own. Vectors whose length is not the longest one's, or
    does not divide by ``parts``, are filled up with zeros at the end.
    ``code`` has two hex digits per part, ``error`` is the squared distance
    and ``label_error`` its sum over equal labels, null labels together (beyond
    64 bits both are held at the end of the range); ``codebooks_sha256`` is
    the SHA-256 of the final codebooks' integers, joined by commas. An empty
    table gives no rows; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    python_ready(spark)
    fine = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.when(finite_vector(F.col(vec_col)), scaled_floor(F.col(vec_col), scale)).alias("ints")).filter("ints IS NOT NULL")
    least, most = F.coalesce(F.array_min("ints"), F.lit(0)), F.coalesce(F.array_max("ints"), F.lit(0))
    n, longest, low, high = fine.agg(F.count(F.lit(1)), F.max(F.size("ints")), F.min(least), F.max(most)).first()
    label_type = vectors.schema[label_col].dataType.simpleString()
    out_schema = f"vec_id long, label {label_type}, code string, error long"
    if not n:
        return spark.createDataFrame([], f"{out_schema}, label_error long, codebooks_sha256 string")
    width = max(parts, -(-longest // parts) * parts)
    d, reach = width // parts, max(abs(low), abs(high)) + 1
    exact = width * (2 * reach) ** 2 < _EXACT
    dtype = next(t for t in ("int16", "int32", "int64") if max(-low, high) <= np.iinfo(t).max)

    first = fine.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()  # ``entries`` rows
    book = np.array([list(r[0]) + [0] * (width - len(r[0])) for r in first], np.int64).reshape(len(first), parts, d).transpose(1, 0, 2)
    history = book[None]  # (rounds so far, parts, entries, d)

    state_schema = f"ids array<long>, labels array<{label_type}>, vectors binary, {', '.join(f'{c} binary' for c, _ in _STATE)}, sums binary"
    state = fine.mapInArrow(lambda it: _blocks(it, width, dtype, block_rows), state_schema)
    older = None
    for turn in range(rounds):
        done = stage(state.mapInArrow(lambda it, h=history: _round(it, h, dtype, exact), state_schema), f"codes-round{turn}")
        slots = done.select("sums").mapInArrow(_add_sums, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).orderBy("slot").collect()  # bounded by the codebooks
        sums = np.array([r["value"] for r in slots], np.int64).reshape(*history.shape[1:3], d + 1, 2)
        history = np.concatenate([history, next_book(history[-1], sums)[None]])
        if older is not None:
            discard(older)
        older = state = done
    types = [pa.int64(), _arrow_type(vectors, label_col)]
    coded = stage(state.mapInArrow(lambda it: _final(it, history, dtype, exact, types), out_schema), "codes")
    if older is not None:
        discard(older)
    sha = hashlib.sha256(",".join(str(int(c)) for c in history[-1].ravel()).encode()).hexdigest()

    per_label = stage(coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit((1 << 63) - 1).cast("decimal(30,0)")).cast("long").alias("label_error")), "codes-labels")
    if per_label.count() <= BROADCAST_LABELS:
        per_label = F.broadcast(per_label)
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _arrow_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)


def _sql(rounds: int = ROUNDS) -> str:
    """Plain k-means without bounds, one pair of CTEs per round."""
    width = "CAST(len(v) / 8 AS BIGINT)"
    square = "CAST(list_dot_product(q.x, q.x) - 2 * list_dot_product(q.x, b.c) + list_dot_product(b.c, b.c) AS BIGINT)"
    ctes = [
        """base AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(4096 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"part AS MATERIALIZED (SELECT r, p, v[p * {width} + 1 : (p + 1) * {width}] AS x FROM base CROSS JOIN (SELECT unnest(range(8)) AS p))",
        "b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM part WHERE r <= 16)",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"""a{k} AS MATERIALIZED (
  SELECT r, p, x, d, e FROM (SELECT q.r, q.p, q.x, {square} AS d, b.e, row_number() OVER (PARTITION BY q.r, q.p ORDER BY {square}, b.e) AS place
  FROM part q JOIN b{k} b ON b.p = q.p) WHERE place = 1)"""
        )
        if k < rounds:
            ctes.append(
                f"""m{k} AS MATERIALIZED (
  SELECT p, e, list(f ORDER BY i) AS c FROM (
    SELECT p, e, i, floor(sum(x[i]) / count(*)) AS f FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e)"""
            )
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)")
    return "WITH " + ",\n".join(ctes) + f""",
coded AS (SELECT r, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(CAST(CAST(f AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS s FROM (SELECT p, e, unnest(c) AS f, unnest(range(len(c))) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM base JOIN coded USING (r) CROSS JOIN books"""


SQL = _sql()
