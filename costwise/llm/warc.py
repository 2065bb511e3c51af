"""WARC archives of web pages: one record per page, dictionary-compressed.

An archive is a ``.warc.zst`` file: a skippable frame that holds a Zstandard
dictionary trained on the archive's own records, then a warcinfo record, then
one record per page, every record a Zstandard frame of its own, so that each
can be read from its offset with nothing but the dictionary. Pages with equal
payloads are archived once: the others are ``revisit`` records that name the
first by its record id and carry its HTTP header without a payload.

Payloads are compared by their SHA-256, which a grouping reduces to the first
page of each repeated payload. These firsts reach the writing tasks by a
broadcast while they are few (checked), else the pages of the largest groups
by a broadcast and the rest by a join on the digest. Tasks write archives
where the pages are read: no page is shuffled in the first case. Spark commits
the manifest, the list of finished archives, as a table; readers open only
files it names, so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costwise.llm.common import python_ready, slices, stage
from costwise.session import scratch_path

#: Payload bytes of one archive (a longer page is never cut).
ARCHIVE_BYTES = 64 << 20
#: The dictionary and what it is trained on: the first records of the archive, each cut to ``SAMPLE_RECORD`` bytes.
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_RECORD = 64 << 10, 2 << 20, 128 << 10
LEVEL = 3
#: Payloads below this size are archived again every time.
REVISIT_BYTES = 100
#: First pages of repeated payloads up to this many are broadcast (about 200 bytes each with a long url).
BROADCAST_FIRSTS = 100_000
#: Beyond that, only firsts of groups that hold this share of all pages (at most its inverse of them).
HOT_SHARE = 1e-3
#: Frame type of an embedded dictionary (skippable frames are 0x184D2A50 to 0x184D2A5F).
DICTIONARY_FRAME = 0x184D2A5D
_READ_BYTES = 64 << 10
_CUT = 1 << 12  # pages in one chunk of equal ones

MANIFEST = "archive string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- records
def uri(url: str | None) -> str:
    """The url as a header value: blanks and control characters percent-encoded; no url is about:blank."""
    return "about:blank" if not url else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}\n{digest}\n{uri(url)}'.encode()).digest(), version=4)}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, first: tuple[int | None, str | None] | None, date: str) -> bytes:
    """A response record, or with ``first`` (id and url of the response) a revisit record, which needs the payload's length ``n`` only.

    The page's id travels in the extension field ``Page-Id``, absent for a null id.
    """
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    if first is not None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(*first, digest)), ("WARC-Refers-To-Target-URI", uri(first[1]))]
        if first[0] is not None:
            fields.append(("Refers-To-Page-Id", str(first[0])))
    return _record(fields, _HTTP % n + (payload if first is None else b""))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; raises ValueError where it is not one."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not sep or not version.startswith(b"WARC/1."):
        raise ValueError(f"not a WARC record: {record[:40]!r}")
    fields = dict(line.decode().split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} does not end where its Content-Length says")
    return fields, rest[:n]


def parse_page(record: bytes) -> tuple | None:
    """(page_id, url, type, payload bytes, digest, refers_to, payload) of a page's record, None for other records.

    A response's digest and length are taken from the payload itself and must agree with its headers.
    """
    fields, block = parse_record(record)
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    said, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != said):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload it names")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("Page-Id"), fields["WARC-Target-URI"], kind, n, said, number("Refers-To-Page-Id"), payload if kind == "response" else None


# ---------------------------------------------------------------- archives
def train(records: list[bytes]) -> bytes:
    """A dictionary from records; empty where they are too few or too short to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:SAMPLE_RECORD] for r in records], k=200, d=8, f=18, accel=4).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Collects the first records, trains the dictionary on them, then compresses record by record."""

    def __init__(self, out, name: str, date: str):
        self.out, self.waiting, self.sampled, self.compressor = out, [], 0, None
        self.records = self.payload = self.written = 0
        self.info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        raw = train(self.waiting)
        if raw:
            frame = zstandard.ZstdCompressor(level=19).compress(raw)
            self._write(struct.pack("<II", DICTIONARY_FRAME, len(frame)) + frame)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
        for record in [self.info, *self.waiting]:
            self._write(self.compressor.compress(record))
        self.waiting = []

    def add(self, record: bytes, payload: int) -> None:
        self.records, self.payload = self.records + 1, self.payload + payload
        if self.compressor is not None:
            self._write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.sampled += min(len(record), SAMPLE_RECORD)
        if self.sampled >= SAMPLE_BYTES:
            self._begin()

    def close(self) -> None:
        if self.compressor is None:
            self._begin()
        self.out.close()


def read_records(stream) -> Iterator[bytes]:
    """Records of an archive from a readable stream, one at a time."""
    head = stream.read(8)
    dictionary, data = None, head
    if len(head) == 8 and (magic_size := struct.unpack("<II", head))[0] == DICTIONARY_FRAME:
        raw, data = stream.read(magic_size[1]), b""
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw, max_output_size=16 * DICTIONARY_BYTES))
    context = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := stream.read(_READ_BYTES)):
        frame, out = context.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(_READ_BYTES)):
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


# ---------------------------------------------------------------- tasks
def _location(uri_: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri_) if re.match(r"\w+:/", uri_) else (fs.LocalFileSystem(), uri_)


def _write_archives(batches: Iterator[pa.RecordBatch], path: str, archive_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    """(page_id, url, payload, n, digest, first_id, first_url, revisit) -> archives, and a manifest row for each.

    A file name is used once: a repeated task writes files of its own.
    """
    store, folder = _location(path)
    store.create_dir(folder, recursive=True)
    writer = name = None

    def done():
        writer.close()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.records], pa.int64()), pa.array([writer.written], pa.int64())], ["archive", "records", "bytes"])

    for b in slices(batches):
        columns = [c.to_pylist() for c in b.columns]
        for page_id, url, payload, n, digest, first_id, first_url, revisit in zip(*columns):
            if writer is None:
                name = f"pages-{uuid.uuid4().hex}.warc.zst"
                writer = ArchiveWriter(store.open_output_stream(f"{folder}/{name}", compression=None), name, date)
            writer.add(page_record(page_id, url, payload, n, digest, (first_id, first_url) if revisit else None, date), len(payload or b""))
            if writer.payload >= archive_bytes:
                yield done()
                writer = None
    if writer is not None:
        yield done()


def _read_archives(batches: Iterator[pa.RecordBatch], path: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, folder = _location(path)
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def batch(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    for b in batches:
        for archive, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows, held, seen = [], 0, 0
            with store.open_input_stream(f"{folder}/{archive}", compression=None) as stream:
                for record in read_records(stream):
                    page = parse_page(record)
                    if page is None:
                        continue
                    seen += 1
                    rows.append(page if payloads else (*page[:-1], None))
                    held += len(page[-1] or b"") if payloads else 0
                    if len(rows) >= 1024 or held >= 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            if seen != expected:
                raise ValueError(f"{archive} holds {seen} pages, the manifest says {expected}")
            if rows:
                yield batch(rows)


# ---------------------------------------------------------------- the jobs
def new_path(spark: SparkSession) -> str:
    path = scratch_path(spark, "warc")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def _order(page_id: Column, url: Column) -> Column:
    """Which of equal payloads comes first: the smallest id (nulls last), then the smallest url (nulls last)."""
    return F.struct(page_id.isNull().alias("no_id"), page_id.alias("id"), url.isNull().alias("no_url"), url.alias("url"))


def with_firsts(pages: DataFrame, least_bytes: int = REVISIT_BYTES, broadcast_rows: int = BROADCAST_FIRSTS) -> DataFrame:
    """(page_id, url, payload) -> page_id, url, payload (null for revisits), n, digest, first_id, first_url, revisit.

    Exactly one page of each group of equal payloads of ``least_bytes`` or more is no revisit.
    """
    rows = pages.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n"))
    place = _order(F.col("page_id"), F.col("url"))
    # copies of one row are one row with a count here, whatever their number
    copies = rows.filter(F.col("n") >= least_bytes).groupBy("digest", place.alias("place")).agg(F.count(F.lit(1)).alias("copies"))
    groups = copies.groupBy("digest").agg(F.sum("copies").alias("pages"), F.min(F.struct("place", "copies")).alias("least"))
    firsts = stage(groups.filter("pages > 1").select(F.col("digest").alias("_digest"), F.col("least.place").alias("first"), F.col("least.copies").alias("tied"), "pages"), "warc-firsts")
    n_firsts, n_tied = firsts.agg(F.count(F.lit(1)), F.count(F.when(F.col("tied") > 1, 1))).first()

    def marked(met: DataFrame, revisit: Column) -> DataFrame:
        return met.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "n", "digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), revisit.alias("revisit"))

    def joined(df: DataFrame, found: DataFrame) -> DataFrame:
        return df.join(found, F.col("digest") == F.col("_digest"), "left")

    if n_firsts <= broadcast_rows:
        met = joined(rows, F.broadcast(firsts))
    else:
        least = pages.count() * HOT_SHARE
        first_try = joined(rows, F.broadcast(firsts.filter(F.col("pages") >= least)))  # at most 1 / HOT_SHARE groups
        rest = first_try.filter("_digest IS NULL").select(*rows.columns)
        met = first_try.filter("_digest IS NOT NULL").unionByName(joined(rest, firsts.filter(F.col("pages") < least)))
    met = met.withColumn("_first", F.coalesce(place.eqNullSafe(F.col("first")), F.lit(False)))
    if not n_tied:
        return marked(met, F.col("_digest").isNotNull() & ~F.col("_first"))
    # a first that is there several times, as rows equal in id, url and payload: one of them is the response
    again = F.col("_first") & (F.col("tied") > 1)
    out = marked(met.filter(~F.coalesce(again, F.lit(False))), F.col("_digest").isNotNull() & ~F.col("_first"))
    one = met.filter(again).groupBy("digest", "first").agg(F.max("payload").alias("payload"), F.max("n").alias("n"), F.max("tied").alias("tied"))  # payloads are equal
    one = stage(one.withColumns({"page_id": F.col("first.id"), "url": F.col("first.url")}), "warc-tied")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tied - 2) div {_CUT}"))).alias("_chunk")
    rest = one.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "n", "digest", "first", "tied", chunk).repartition("digest", "_chunk")
    rest = rest.withColumn("_at", F.explode(F.sequence(F.col("_chunk") * _CUT, F.least((F.col("_chunk") + 1) * _CUT, F.col("tied") - 1) - 1)))
    return out.unionByName(marked(one, F.lit(False))).unionByName(marked(rest, F.lit(True)))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = REVISIT_BYTES, date: str | None = None, broadcast_rows: int = BROADCAST_FIRSTS) -> str:
    """Archives every page below ``path`` (archives/ and manifest/) and returns the path.

    A payload is the text in UTF-8, null an empty one. Of pages with equal
    payloads of at least ``least_bytes`` bytes, the one with the smallest id is
    the response (null ids last; of equal ids the smallest url, null last; of
    rows equal in all three any one), all others revisit it. Shorter payloads
    are all responses. A null id is left out of its record, a null url is
    about:blank. An empty table gives an empty manifest; other columns are
    ignored. ``date`` is the WARC-Date (now by default).
    """
    spark = pages.sparkSession
    python_ready(spark)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    marked = with_firsts(rows, least_bytes, broadcast_rows)
    marked.mapInArrow(lambda it: _write_archives(it, f"{path}/archives", archive_bytes, date), MANIFEST).write.parquet(f"{path}/manifest")
    return path


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All page records of a set of archives, read and verified: page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, payload (null for revisits, or without ``payloads``)."""
    python_ready(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    n = max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism))
    return manifest.repartition(n).mapInArrow(lambda it: _read_archives(it, f"{path}/archives", payloads), RECORD)


SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN least_id END AS refers_to
FROM (
  SELECT page_id, html, least_id, strlen(coalesce(html, '')) >= 100 AND page_id <> least_id AS revisit
  FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least_id FROM pages)
)
"""
