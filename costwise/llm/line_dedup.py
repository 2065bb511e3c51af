"""Line dedup: repeated lines leave all documents but the last that holds them.

1. Every distinct key of a document is hashed (128 bits); counts of documents
   and the largest id per hash come from one grouping (partly summed in the
   map tasks, so a line of every document is no burden).
2. The distinct hashes are dealt into shards. A shard's index is a minimal
   perfect hash and, by slot, arrays of fingerprints, document counts and last
   ids: about 16 bytes a line and no keys. Shards are rows of a written table.
3. Documents probe the arrays: their hashes go to the shard, which answers
   with those to drop. Lines of more than a set share of all occurrences are
   at most ``HOT_LINES``; they are probed where the documents are, against one
   broadcast index, so that no shard sees them.
4. Documents with lines to drop are cut and joined again.

A line that probes its shard is a member of the shard's hash, so its slot is
its own and the answer exact (up to collisions of 128-bit hashes); the
fingerprints guard probes with foreign lines (an index of an earlier table):
2^-32 pass. The hot index is probed by all lines, members or not, so it holds
the whole 128-bit hash of every line and compares it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.llm.common import python_ready, slices, stage
from costwise.llm.perfect_hash import PerfectHash

MIN_CHARS, MIN_DOCS = 20, 3
LINES_PER_SHARD = 1 << 16
#: Bound of the broadcast index of hot lines (29 bytes each).
HOT_LINES = 1_000_000
_HOT_FLOOR = 1000  # documents that a line needs at least to be called hot
_NO_ID = -(1 << 63)
_WHITE = b" \t\n\x0b\x0c\r"
_INDEX = "shard int, hash binary, fingerprints binary, counts binary, last_ids binary"


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """A line's key (UTF-8), or None if it has fewer than ``min_chars`` code points."""
    key = line.strip(_WHITE).lower()  # of bytes, lower() folds A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return key


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _texts(column: pa.Array) -> list:
    return pc.cast(column, pa.binary()).to_pylist()


def _hash_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        counts, out = [], []
        for text in _texts(b.column(1)):
            own = set()
            for line in (text or b"").split(b"\n"):
                key = key_of(line, min_chars)
                if key is not None:
                    own.add(digest(key))
            counts.append(len(own))
            out.extend(own)
        pairs = np.frombuffer(b"".join(out), ">i8").astype(np.int64).reshape(-1, 2)
        ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "hi", "lo"])


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (keys[:, 1] >> np.uint64(32)).astype("<u4")


def _keys(hi, lo) -> np.ndarray:
    return np.stack([np.asarray(hi), np.asarray(lo)], axis=1).astype(np.int64).view(np.uint64)


def build_index(hi, lo, n_docs, last) -> dict:
    keys = _keys(hi, lo)
    mph = PerfectHash.build(keys)
    at = mph.slots(keys)
    fp, counts, last_ids = np.empty(len(keys), "<u4"), np.empty(len(keys), "<u4"), np.empty(len(keys), "<i8")
    fp[at], counts[at], last_ids[at] = _fingerprint(keys), np.minimum(n_docs, 0xFFFFFFFF), last
    return {"hash": mph.dump(), "fingerprints": fp.tobytes(), "counts": counts.tobytes(), "last_ids": last_ids.tobytes()}


def probe(index: dict, hi, lo) -> tuple[np.ndarray, np.ndarray]:
    """(documents that hold the line, largest id) per probe; 0 documents for lines that are not in the index."""
    keys = _keys(hi, lo)
    at = PerfectHash.load(index["hash"]).slots(keys)
    fp, counts, last = (np.frombuffer(index[n], t) for n, t in (("fingerprints", "<u4"), ("counts", "<u4"), ("last_ids", "<i8")))
    if not len(fp):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    known = (at >= 0) & (fp[at] == _fingerprint(keys))
    return np.where(known, counts[at].astype(np.int64), 0), last[at]


def build_exact(hi, lo, n_docs, last) -> dict:
    """The same with whole keys instead of fingerprints, for probes with lines that are no members."""
    keys = _keys(hi, lo)
    mph = PerfectHash.build(keys)
    at = mph.slots(keys)
    whole, counts, last_ids = np.empty((len(keys), 2), "<u8"), np.empty(len(keys), "<u4"), np.empty(len(keys), "<i8")
    whole[at], counts[at], last_ids[at] = keys, np.minimum(n_docs, 0xFFFFFFFF), last
    return {"hash": mph.dump(), "keys": whole.tobytes(), "counts": counts.tobytes(), "last_ids": last_ids.tobytes()}


class ExactIndex:
    """Opened once per worker: (documents, largest id) of members, (0, 0) of any other line."""

    def __init__(self, index: dict):
        self.hash = PerfectHash.load(index["hash"])
        self.keys = np.frombuffer(index["keys"], "<u8").reshape(-1, 2)
        self.counts, self.last = np.frombuffer(index["counts"], "<u4").astype(np.int64), np.frombuffer(index["last_ids"], "<i8")

    def probe(self, hi, lo) -> tuple[np.ndarray, np.ndarray]:
        keys = _keys(hi, lo)
        at = self.hash.slots(keys)
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        known = (at >= 0) & (self.keys[at] == keys).all(axis=1)
        return np.where(known, self.counts[at], 0), np.where(known, self.last[at], 0)


def _build_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All hot lines (at most ``HOT_LINES``) -> one row."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if held:
        index = build_exact(*(np.concatenate(c) for c in zip(*held)))
        yield pa.RecordBatch.from_pylist([index], pa.schema([(n, pa.binary()) for n in index]))


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> one index row a shard."""
    now, held = None, []

    def close():
        hi, lo, n, last = (np.concatenate(c) for c in zip(*held))
        index = build_index(hi, lo, n, last)
        return pa.RecordBatch.from_pylist([{"shard": now, **index}], pa.schema([("shard", pa.int32())] + [(n, pa.binary()) for n in index]))

    for b in batches:
        shard, *cols = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for lo_, hi_ in zip([0, *cuts], [*cuts, len(shard)]):
            if lo_ == hi_:
                continue
            if now is not None and shard[lo_] != now:
                yield close()
                held.clear()
            now = int(shard[lo_])
            held.append(tuple(c[lo_:hi_] for c in cols))
    if held:
        yield close()


def _drops(ids: np.ndarray, hi, lo, n: np.ndarray, last: np.ndarray, min_docs: int) -> pa.Table:
    gone = (n >= min_docs) & (last != ids)
    return pa.table({"id": pa.array(ids[gone], pa.int64()), "hi": pa.array(np.asarray(hi)[gone], pa.int64()), "lo": pa.array(np.asarray(lo)[gone], pa.int64())})


def _rebuild(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """Last columns: text and the hashes to drop. Returns the others, text, n_lines and n_dropped."""
    for b in slices(batches):
        texts, n_lines, n_dropped = [], [], []
        drops = b.column("_ld_drop")
        for text, gone in zip(_texts(b.column("_ld_text")), drops.to_pylist()):
            text = text or b""
            if not gone:
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(0)
                texts.append(text)
                continue
            gone = set(gone)
            lines = text.split(b"\n")
            kept = [x for x in lines if (k := key_of(x, min_chars)) is None or digest(k) not in gone]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            texts.append(b"\n".join(kept))
        cols = [c for n, c in zip(b.schema.names, b.columns) if n not in ("_ld_text", "_ld_drop")]
        names = [n for n in b.schema.names if n not in ("_ld_text", "_ld_drop")]
        new = [pc.cast(pa.array(texts, pa.binary()), pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols + new, [*names, "_ld_kept", "_ld_n_lines", "_ld_n_dropped"])


def line_index(lines: DataFrame, lines_per_shard: int = LINES_PER_SHARD) -> tuple[DataFrame, DataFrame, int]:
    """(id, hi, lo) -> the written index, the distinct lines with their counts, the number of shards."""
    per_line = stage(lines.groupBy("hi", "lo").agg(F.countDistinct("id").alias("n_docs"), F.max("id").alias("last")), "line-counts")
    n_shards = max(1, -(-per_line.count() // lines_per_shard))
    shard = F.pmod("hi", F.lit(n_shards)).cast("int").alias("shard")
    dealt = per_line.select(shard, "hi", "lo", "n_docs", "last").repartition("shard").sortWithinPartitions("shard")
    return stage(dealt.mapInArrow(_build_shards, _INDEX), "line-index"), per_line, n_shards


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    lines_per_shard: int = LINES_PER_SHARD,
    hot_lines: int = HOT_LINES,
    hot_floor: int = _HOT_FLOOR,
) -> DataFrame:
    """The input with the text cut, plus columns n_lines (before) and n_dropped.

    A key is a line without white space (U+0020, U+0009-U+000D) at its ends,
    A-Z folded. Keys of at least ``min_chars`` code points in at least
    ``min_docs`` documents leave all documents except the largest id, with
    every repetition. A null or empty text is one empty line and comes back as
    an empty text. Rows of one id are one document (each row is cut by itself);
    null ids are together one document, below all others. If the input has
    columns n_lines or n_dropped, the new ones replace them. An empty table
    stays empty.
    """
    python_ready(docs.sparkSession)
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    text = F.col(text_col).cast("string")
    lines = stage(docs.select(ident.alias("id"), text.alias("text")).mapInArrow(lambda it: _hash_lines(it, min_chars), "id long, hi long, lo long"), "line-hashes")
    index, per_line, n_shards = line_index(lines, lines_per_shard)
    total = lines.count()
    # at most ``hot_lines`` lines can hold more than that share of all occurrences each
    hot_docs = max(hot_floor, -(-total // hot_lines))
    hot = per_line.filter(F.col("n_docs") > hot_docs).select("hi", "lo", "n_docs", "last").repartition(1)
    built = stage(hot.mapInArrow(_build_hot, "hash binary, keys binary, counts binary, last_ids binary"), "line-hot").take(1)
    drops_type = "id long, hi long, lo long"
    hot_index = docs.sparkSession.sparkContext.broadcast(built[0].asDict()) if built else None

    def at_home(batches, answer: bool):
        """Answers the hot lines (``answer``) or passes on the others."""
        index = ExactIndex(hot_index.value)
        for b in batches:
            ids, hi, lo = (c.to_numpy() for c in b.columns)
            n, last = index.probe(hi, lo)
            if answer:
                yield from _drops(ids, hi, lo, n, last, min_docs).to_batches()
            else:
                yield b.filter(pa.array(n == 0))

    def in_shard(probes: pa.Table, shard_index: pa.Table) -> pa.Table:
        ids, hi, lo = (probes[c].to_numpy() for c in ("id", "hi", "lo"))
        if not shard_index.num_rows:
            return _drops(ids[:0], hi[:0], lo[:0], ids[:0], ids[:0], min_docs)
        return _drops(ids, hi, lo, *probe(shard_index.to_pylist()[0], hi, lo), min_docs)

    cold = lines if hot_index is None else lines.mapInArrow(lambda it: at_home(it, False), drops_type)
    shard = F.pmod("hi", F.lit(n_shards)).cast("int")
    drops = cold.withColumn("shard", shard).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(in_shard, drops_type)
    if hot_index is not None:
        drops = drops.unionByName(lines.mapInArrow(lambda it: at_home(it, True), drops_type))
    packed = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("hi", "lo")])
    per_doc = drops.groupBy(F.col("id").alias("_ld_drop_id")).agg(F.collect_set(packed).alias("_ld_drop"))

    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    sent = docs.select(*others, text.alias("_ld_text"), ident.alias("_ld_id")).join(per_doc, F.col("_ld_id") == F.col("_ld_drop_id"), "left").drop("_ld_id", "_ld_drop_id")
    kept_fields = [f for f in sent.schema.fields if f.name not in ("_ld_text", "_ld_drop")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields), "_ld_kept string, _ld_n_lines long, _ld_n_dropped long"])
    cut = sent.mapInArrow(lambda it: _rebuild(it, min_chars), schema)
    order = [F.col("_ld_kept").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cut.select(*order, F.col("_ld_n_lines").alias("n_lines"), F.col("_ld_n_dropped").alias("n_dropped"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.last AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
