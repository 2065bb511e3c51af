"""Best-fit packing planned on a histogram of lengths.

Pieces are counted by length (at most ``capacity`` counts, whatever the number
of documents). Best-fit decreasing runs over those counts on the driver:
sequences with the same room left form ranges, and a count of equal pieces
takes ranges of sequences at once. The plan is a list of slots "the pieces of
length L with ranks a to b lie at offset o of sequences s, s + 1, ...". Pieces
then find their slot by their rank within their length.

Ranks need no window over a length: each task numbers its own pieces by
length, and the tasks' counts give each (task, length) its first rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costwise.llm.common import python_ready, stage, text_slices
from costwise.llm.tokens import encoder, vocabulary_path

CAPACITY, END_ID = 1024, 2
#: The plan is broadcast: a slot is five numbers. Every (length, room) step splits one range at most.
MAX_SLOTS = 2_000_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts -> slots (length, first rank, end rank, first sequence, offset).

    The longest pieces go first, each into the open sequence with the least
    room that holds it; of those with equal room the lowest numbers.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> heap of (first sequence, number)
    opened = 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a capacity of {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:  # open sequences and fill each with as many as it holds
                each = capacity // length
                full, rest = divmod(left, each)
                for n, per in ((full, each), (1, rest)):
                    if n and per:
                        for i in range(per):
                            slots.append((length, rank, rank + n, opened, i * length))
                            rank += n
                        _give(rooms, capacity - per * length, opened, n)
                        opened += n
                break
            heap = rooms[room]
            first, n = heappop(heap)
            take = min(n, left)
            if take < n:
                heappush(heap, (first + take, n - take))
            elif not heap:
                del rooms[room]
            slots.append((length, rank, rank + take, first, capacity - room))
            _give(rooms, room - length, first, take)
            rank, left = rank + take, left - take
    return slots


def _give(rooms: dict, room: int, first: int, n: int) -> None:
    if room > 0:
        heappush(rooms.setdefault(room, []), (first, n))


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", part_col: str = "part", rank_col: str = "local_rank") -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces that carries, per row,
    the task that wrote it and the piece's rank among that task's pieces of its length."""
    per_task = pieces.groupBy(F.col(part_col).alias("_part"), F.col(length_col).alias("_length")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stage(per_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-ranks")
    counts = {r["_length"]: r["n"] for r in firsts.groupBy("_length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = plan(counts, capacity)
    if len(slots) > MAX_SLOTS:
        raise ValueError(f"{len(slots)} slots are too many to broadcast")
    spark = pieces.sparkSession
    # slots by length and first rank: a piece's slot is the last that starts at or before its rank
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)
    ranked = pieces.join(firsts, (F.col(part_col) == F.col("_part")) & (F.col(length_col) == F.col("_length"))).withColumn("_rank", F.col(rank_col) + F.col("first"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shared.value
        # one sortable number for (length, rank): ranks are below 2^50
        key = t[:, 0] * (1 << 50) + t[:, 1]
        at = np.searchsorted(key, length.to_numpy() * (1 << 50) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": t[at, 3] + rank.to_numpy() - t[at, 1], "offset": t[at, 4]})

    keep = [c for c in pieces.columns if c not in (part_col, rank_col)]
    return ranked.withColumn("_slot", slot(F.col(length_col), F.col("_rank"))).select(*keep, "_slot.sequence_id", "_slot.offset")


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    enc, part = encoder(path), TaskContext.get().partitionId()
    ranks: dict[int, int] = {}
    for b in text_slices(batches, 1):
        rows, at = [], 0
        flat, counts = enc.encode_batch(b.column(1), end_id)
        view = memoryview(flat.astype("<u4").tobytes())
        for doc_id, n in zip(b.column(0).to_pylist(), counts.tolist()):
            ids = view[4 * at : 4 * (at + n)]
            at += n
            start, stop, piece = 0, n % capacity or capacity, 0  # the first piece takes what does not fill one
            while start < n:
                length = stop - start
                rank = ranks.get(length, 0)
                ranks[length] = rank + 1
                rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), part, rank))
                start, stop, piece = stop, stop + capacity, piece + 1
        cols = list(zip(*rows)) or [[]] * 7
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [f.split()[0] for f in _PIECES.split(", ")])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id`` (a null text is empty, so one id). A
    longer one is cut into pieces of ``capacity`` ids, of which the first may
    be shorter. Pieces lie in their sequence without gaps. Rows of one id (or
    a null id) are documents of their own. An empty table gives no rows; other
    columns are ignored.
    """
    python_ready(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()
    sent = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stage(sent.mapInArrow(lambda it: _cut(it, vocabulary, end_id, capacity), _PIECES), "pack-pieces")
    return pack(pieces, capacity)
