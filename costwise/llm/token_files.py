"""Token-ID output: whole texts as Huffman-coded blocks of ids.

A token file set is a folder of Parquet files whose rows are independent
blocks, and a codebook. A block holds whole documents in ascending id order:
their ids and token counts, the place of its first id in the whole sequence,
the coded ids and the bit offset of every 64th id. Any block can be decoded
alone, from any checkpoint.

Texts are encoded once, where they are read, into a written table of packed
ids (two bytes an id for vocabularies of up to 65,536). Global counts of the ids
(one sum per vocabulary entry, so bounded) give the codes. Then the packed ids,
not the texts, go to ranges of document ids, and each task codes its range
block by block. Blocks carry their place within their task; the tasks' sums
give each task's first place (one small row a task beside the blocks).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costwise.llm import huffman
from costwise.llm.common import python_ready, slices, stage, text_slices
from costwise.llm.tokens import encoder, vocabulary_path
from costwise.session import scratch_path

END_ID = 2
BLOCK_TOKENS = 1 << 17
_PACKED = "doc_id long, tie long, width int, ids binary"
_BLOCK = "part int, before long, n_tokens long, doc_ids binary, no_id binary, counts binary, payload binary, checkpoints binary"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _batch(schema: str, *cols) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, types[t]) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


def _encode_texts(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, text) -> the packed ids of every document, its end included."""
    enc = encoder(path)
    for b in text_slices(batches, 2):
        ids, counts = enc.encode_batch(b.column(2), end_id)
        offsets = (np.concatenate(([0], np.cumsum(counts))) * enc.dtype.itemsize).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
        yield _batch(_PACKED, b.column(0), b.column(1), np.full(len(counts), enc.dtype.itemsize, np.int32), packed)


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, ids) -> how often each id occurs in the task."""
    total = np.zeros(0, np.int64)
    for b in text_slices(batches, 1):
        for width in set(b.column(0).to_pylist()):
            raw = b"".join(x for w, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if w == width)
            n = np.bincount(np.frombuffer(raw, f"<u{width}"))
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total[: len(n)] += n
    used = np.flatnonzero(total)
    yield _batch("id long, n long", used, total[used])


def _encode_blocks(batches: Iterator[pa.RecordBatch], lengths_bytes: bytes, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Documents in order (doc_id, width, ids) -> coded blocks, with the ids before them in this task."""
    lengths = np.frombuffer(lengths_bytes, np.uint8)
    codes, part, before = huffman.canonical(lengths), TaskContext.get().partitionId(), 0
    docs, counts, held, size = [], [], [], 0

    def block():
        ids = np.concatenate(held)
        payload, checkpoints = huffman.encode(ids, lengths, codes)
        no_id = np.array([d is None for d in docs], np.uint8).tobytes()
        names = np.array([d or 0 for d in docs], "<i8").tobytes()
        return _batch(_BLOCK, [part], [before], [len(ids)], [names], [no_id], [np.array(counts, "<u4").tobytes()], [payload], [checkpoints.astype("<u8").tobytes()])

    for b in text_slices(batches, 2):
        for doc_id, width, raw in zip(*(c.to_pylist() for c in b.columns)):
            own = np.frombuffer(raw, f"<u{width}")
            docs.append(doc_id)
            counts.append(len(own))
            held.append(own)
            size += len(own)
            if size >= block_tokens:
                yield block()
                before += size
                docs, counts, held, size = [], [], [], 0
    if docs:
        yield block()


def _decode_blocks(batches: Iterator[pa.RecordBatch], lengths_bytes: bytes, starts: dict[int, int]) -> Iterator[tuple]:
    """(document ids, counts, start, ids) of each block."""
    table = huffman.decode_table(np.frombuffer(lengths_bytes, np.uint8))
    for b in slices(batches, 1):
        for part, before, n, docs, no_id, counts, payload, checkpoints in zip(*(c.to_pylist() for c in b.columns)):
            ids = huffman.decode(payload, n, np.frombuffer(checkpoints, "<u8"), table)
            doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(docs, "<i8"), no_id)]
            yield doc_ids, np.frombuffer(counts, "<u4").astype(np.int64), starts[part] + before, ids


def _digests(batches: Iterator[pa.RecordBatch], lengths_bytes: bytes, starts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for doc_ids, counts, start, ids in _decode_blocks(batches, lengths_bytes, starts):
        ends = np.cumsum(counts)
        view = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(view[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
        yield _batch(_READ, doc_ids, start + ends - counts, counts, crc)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, max_bits: int = huffman.MAX_BITS) -> str:
    """Encodes every whole text (null: empty), appends ``end_id`` and writes the file set below ``path``.

    Documents lie in ascending id order, null ids first; rows of one id are
    ordered by a hash of their text. Blocks hold whole documents, about
    ``block_tokens`` ids each (a longer document is a block of its own). An
    empty table gives an empty file set. Other columns are ignored.
    """
    spark = docs.sparkSession
    python_ready(spark)
    vocabulary = vocabulary or vocabulary_path()
    text = F.col(text_col).cast("string")
    sent = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    packed = stage(sent.mapInArrow(lambda it: _encode_texts(it, vocabulary, end_id), _PACKED), "token-ids")
    counted = packed.select("width", "ids").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    counts = np.zeros(max((r["id"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = huffman.code_lengths(counts, max_bits).tobytes()
    ordered = packed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "width", "ids")
    ordered.mapInArrow(lambda it: _encode_blocks(it, lengths, block_tokens), _BLOCK).write.parquet(f"{path}/blocks")
    # one sum per task: partition numbers follow the ranges, so the sums give each task's first place
    sums = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for r in sums:
        starts.append((r["part"], at))
        at += r["n"]
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{path}/starts")
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    return path


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, dict[int, int]]:
    python_ready(spark)
    lengths = bytes(spark.read.schema("lengths binary").parquet(f"{path}/codebook").first()[0])
    starts = {r["part"]: r["start"] for r in spark.read.schema("part int, start long").parquet(f"{path}/starts").collect()}  # one row a writing task
    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks"), lengths, starts


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array) of every document of a file set."""
    blocks, lengths, starts = _open(spark, path)

    def run(it):
        for doc_ids, counts, start, ids in _decode_blocks(it, lengths, starts):
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + offsets[:-1], pa.int64()), arrays], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the file set."""
    blocks, lengths, starts = _open(spark, path)
    return blocks.mapInArrow(lambda it: _digests(it, lengths, starts), _READ)


def new_path(spark: SparkSession) -> str:
    path = scratch_path(spark, "token-files")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
