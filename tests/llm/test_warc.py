"""WARC archives: written, read back, and read by an independent reader."""

import hashlib
import os
import random
import struct
from collections import Counter, defaultdict

import pytest
import zstandard

from costwise.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest string, n int, first string, tied int"


def frame(spark, rows):
    """Other columns clash with names used inside."""
    return spark.createDataFrame([(i, u, h, "p", "d", 3, "f", 9) for i, u, h in rows], SCHEMA)


def brute(rows):
    """(page_id, bytes, digest, type, refers_to); exactly one response per repeated payload."""
    groups = defaultdict(list)
    for place, (i, u, h) in enumerate(rows):
        groups[(h or "").encode()].append((i is None, i or 0, u is None, u or "", place, i))
    out = Counter()
    for payload, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            revisit = k > 0 and len(payload) >= 100
            out[(m[5], len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", members[0][5] if revisit else None)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    page = lambda n: "<html>" + " ".join(r.choice(["alpha", "beta", "gamma", "größe", "<p>", "</p>"]) for _ in range(n)) + "</html>"
    big = page(60)
    out = [(i, f"http://a.example/{i}", page(r.randrange(1, 200))) for i in range(200)]
    out += [(300 - i, f"http://copy.example/{i}", big) for i in range(40)]
    out += [(400, "http://x/1", "short"), (401, "http://x/2", "short"), (402, "http://x/3", None), (403, None, ""), (404, "http://x/4", "")]
    out += [(None, "http://null/1", big + "a"), (None, "http://null/2", big + "a"), (500, "http://null/3", big + "b"), (None, None, big + "b")]
    out += [(None, None, big + "c")] * 3  # rows without an id, equal in everything
    out += [(510, "http://x/5", big + "d")] * 5 + [(511, "http://x/6", big + "d")]  # the first page five times
    out += [(512, "http://x/7", big + "e"), (512, "http://x/0", big + "e"), (512, None, big + "e")]  # one id, three urls
    out += [(520, "http://x/bad url\r\nWARC-Type: response", page(50)), (521, "", page(3)), (522, "http://x/ü", "\r\n\r\nWARC/1.1\r\n" * 20)]
    out += [(530, "http://x/long", page(400_000)), (531, "http://x/exact", "x" * 100), (532, "http://x/exact", "x" * 100), (533, "u", "x" * 99), (534, "u", "x" * 99)]
    r.shuffle(out)
    return out


def digests(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_pages_come_back(spark, rows):
    path = warc.write_archives(frame(spark, rows).repartition(3), warc.new_path(spark), archive_bytes=100_000)
    back = warc.read_archives(spark, path)
    assert digests(back) == brute(rows)
    assert digests(warc.read_archives(spark, path, payloads=False)) == brute(rows)
    assert spark.read.parquet(f"{path}/manifest").count() > 3
    payloads = {r.payload_digest: bytes(r.payload) for r in back.collect() if r.record_type == "response"}
    assert {(h or "").encode() for *_, h in rows} == set(payloads.values())
    urls = {r.page_id: r.url for r in back.collect() if r.page_id is not None}
    assert urls[403] == urls[521] == "about:blank" and urls[520] == "http://x/bad%20url%0D%0AWARC-Type:%20response" and urls[522] == "http://x/ü"


def test_firsts_beyond_the_broadcast_limit(spark, rows, monkeypatch):
    path = warc.write_archives(frame(spark, rows), warc.new_path(spark), broadcast_rows=0)
    assert digests(warc.read_archives(spark, path)) == brute(rows)
    monkeypatch.setattr(warc, "HOT_SHARE", 0.05)  # some groups are hot, others not
    path = warc.write_archives(frame(spark, rows), warc.new_path(spark), broadcast_rows=0)
    assert digests(warc.read_archives(spark, path)) == brute(rows)


def test_many_equal_rows_have_one_response(spark):
    rows = [(1, "http://a", "y" * 200)] * 9000 + [(2, "http://b", "y" * 200)] * 3
    path = warc.write_archives(frame(spark, rows).repartition(5), warc.new_path(spark))
    assert digests(warc.read_archives(spark, path)) == brute(rows)


def test_empty(spark):
    path = warc.write_archives(frame(spark, []), warc.new_path(spark))
    assert warc.read_archives(spark, path).collect() == []


def test_archive_by_an_independent_reader(spark, rows):
    """The leading frame is skippable and holds the dictionary; every record is a frame of its own."""
    path = warc.write_archives(frame(spark, rows).coalesce(1), warc.new_path(spark), date="2024-01-02T03:04:05Z")
    records = []
    for entry in spark.read.parquet(f"{path}/manifest").collect():
        raw = open(f"{path}/archives/{entry.archive}", "rb").read()
        assert len(raw) == entry.bytes
        dictionary, at = None, 0
        if entry.records > 100:  # too few records train none
            magic, size = struct.unpack("<II", raw[:8])
            assert magic == 0x184D2A5D
            dictionary, at = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]), 8 + size
            assert struct.unpack("<I", dictionary[:4])[0] == 0xEC30A437  # a trained dictionary
            with pytest.raises(zstandard.ZstdError):  # and needed
                zstandard.ZstdDecompressor().decompressobj().decompress(raw[at:])
        d = zstandard.ZstdDecompressor(dict_data=dictionary and zstandard.ZstdCompressionDict(dictionary))
        own = []
        while at < len(raw):
            one = d.decompressobj()
            own.append(one.decompress(raw[at:]))
            assert one.eof
            at = len(raw) - len(one.unused_data)
        assert own[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and len(own) == 1 + entry.records
        records += own[1:]
    assert len(records) == len(rows)
    ids = [dict(x.split(b": ", 1) for x in r.split(b"\r\n\r\n")[0].split(b"\r\n")[1:]) for r in records]
    responses = {h[b"WARC-Record-ID"]: h for h in ids if h[b"WARC-Type"] == b"response"}
    for h in ids:
        assert h[b"WARC-Date"] == b"2024-01-02T03:04:05Z"
        if h[b"WARC-Type"] == b"revisit":
            assert responses[h[b"WARC-Refers-To"]][b"WARC-Payload-Digest"] == h[b"WARC-Payload-Digest"]


def test_dictionary_pays():
    r = random.Random(4)
    pages = [("<html><head><title>" + str(r.random()) + "</title></head><body class='main'><div id='nav'>menu</div>" + "".join(r.choice("abcdef ") for _ in range(200))).encode() for _ in range(500)]
    raw = zstandard.ZstdCompressionDict(warc.train(pages))
    sizes = [sum(len(zstandard.ZstdCompressor(level=3, dict_data=d).compress(p)) for p in pages) for d in (raw, None)]
    assert sizes[0] < 0.8 * sizes[1]
    assert warc.train([b"x"]) == b"" and warc.train([]) == b""


def test_damage_and_strays(spark, rows):
    path = warc.write_archives(frame(spark, rows).coalesce(1), warc.new_path(spark))
    folder = f"{path}/archives"
    name = spark.read.parquet(f"{path}/manifest").orderBy("records").collect()[-1].archive
    open(f"{folder}/pages-stray.warc.zst", "wb").write(b"left behind by a lost task")
    assert digests(warc.read_archives(spark, path)) == brute(rows)
    raw = open(f"{folder}/{name}", "rb").read()
    open(f"{folder}/{name}", "wb").write(raw[: len(raw) // 2])
    with pytest.raises(Exception, match="within a record|pages, the manifest"):
        warc.read_archives(spark, path).collect()
    os.rename(f"{folder}/{name}", f"{folder}/gone")
    record = warc.page_record(1, "u", b"abc", 3, hashlib.sha256(b"abc").hexdigest(), None, "d")
    assert warc.parse_page(record)[0] == 1
    with pytest.raises(ValueError):
        warc.parse_page(record.replace(b"abc", b"abd"))
