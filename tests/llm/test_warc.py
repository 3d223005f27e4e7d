"""Archives written, normalised and read back, damaged streams, and odd pages."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib

import numpy as np
import pytest

from gradelake.llm import warc
from tests.oracle_check import compare, duck

SCHEMA = "page_id long, url string, html string, archive string, number long, digest string"


def plain(rows):
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every row."""
    firsts = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        known = firsts.get(payload, (True, 0))
        firsts[payload] = min(known, (i is None, i or 0))
    result, met = [], set()
    for i, url, html in rows:
        payload = (html or "").encode()
        first = None if firsts[payload][0] else firsts[payload][1]
        response = i == first and payload not in met
        if response:
            met.add(payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        result.append(
            (i, url, len(payload), digest, "response" if response else "revisit",
             None if response else first)
        )
    return sorted(result, key=repr)


def found(frame):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted([tuple(r[n] for n in names) for r in frame.collect()], key=repr)


@pytest.fixture(scope="module")
def odd():
    rows = [
        (1, "http://a/?q=1%20%C3%A9", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nX: y", None),
        (4, "", ""), (5, " é ", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://b", "ü€\U0001f600" * 90_000),
        (7, "http://c", "ü€\U0001f600" * 90_000), (None, "http://d", "<p>x</p>"),
        (None, "n", "alone"), (None, "n", "alone"), (8, "same", "twice"), (8, "same", "twice"),
        (-5, "low", "twice"), (9, "http://e/\x00%", "\x00\x1f\x8b"),
    ]
    return rows + [(100 + i, f"http://many/{i}", "hot" if i % 3 else f"page {i}") for i in range(90)]


@pytest.mark.parametrize("size, records", [(1 << 26, 1 << 16), (200, 1 << 16), (1 << 26, 1)])
def test_round_trip(spark, odd, size, records):
    pages = spark.createDataFrame([(*r, "a", 1, "d") for r in odd], SCHEMA).repartition(3)
    made, folder = warc.archive_pages(pages, archive_bytes=size, archive_records=records)
    result = warc.read_archives(made, folder)
    assert found(result) == plain(odd)
    ids = [r["record_id"] for r in result.collect()]
    assert len(set(ids)) == len(ids)
    # Any gzip reader reads the archives whole, and every indexed member alone.
    for archive, sidecar, count in made.collect():
        with open(f"{folder}/{archive}", "rb") as file:
            data = file.read()
        with open(f"{folder}/{sidecar}") as file:
            index = [json.loads(line) for line in file]
        assert len(index) == count
        whole = gzip.decompress(data)
        alone = [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in index]
        assert b"".join(alone) == whole
        assert sum(e["length"] for e in index) == len(data)
        assert all(a.startswith(b"WARC/1.1\r\nWARC-Type: " + e["type"].encode())
                   for a, e in zip(alone, index, strict=True))


def test_least_shared_payload(spark):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    result = {r["page_id"]: r["refers_to"] for r in warc.archived(pages, 5).collect()}
    assert result == {1: None, 2: None, 3: None, 4: 3}


def test_no_rows(spark, odd):
    pages = spark.createDataFrame([(*r, "a", 1, "d") for r in odd], SCHEMA)
    empty = warc.archived(pages.where("page_id > 1000"))
    assert empty.count() == 0
    assert empty.columns == warc.archived(pages).columns


def test_table(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, duck(folder), warc.op12, warc.ORACLE, folder) == []


def record(number, payload):
    return warc.response_head(warc.record_id("x", number), str(number), "u", payload) + payload + b"\r\n\r\n"


def streams():
    payloads = [b"", b"a" * 5, b"\r\n\r\n", bytes(range(256)) * 5000, b"z" * 3_000_000]
    records = [record(i, p) for i, p in enumerate(payloads)]
    whole = gzip.compress(b"".join(records))
    single = b"".join(gzip.compress(r) for r in records)
    # Members that do not end where records end.
    joined = b"".join(records)
    odd = b"".join(gzip.compress(joined[at : at + 700_001]) for at in range(0, len(joined), 700_001))
    return records, [whole, single, odd]


@pytest.mark.parametrize("kind", range(3))
def test_streams(kind, monkeypatch):
    records, kinds = streams()
    for chunk in (1, 7, 1 << 18):
        if chunk < 100:
            data, expected = gzip.compress(b"".join(records[:3])), records[:3]
        else:
            data, expected = kinds[kind], records
        monkeypatch.setattr(warc.Inflated.__init__, "__defaults__", (chunk,))
        sink = io.BytesIO()
        index = warc.normalise_stream(io.BytesIO(data), sink, {})
        out = sink.getvalue()
        assert [
            gzip.decompress(out[e["offset"] : e["offset"] + e["length"]]) for e in index
        ] == expected


def test_damage():
    records, (whole, _, _) = streams()
    rng = np.random.default_rng(5)
    for cut in [0, 1, 20, *rng.integers(30, len(whole) - 1, 20).tolist()]:
        if cut == 0:
            assert warc.normalise_stream(io.BytesIO(b""), io.BytesIO(), {}) == []
            continue
        with pytest.raises(warc.DamagedArchive):
            warc.normalise_stream(io.BytesIO(whole[:cut]), io.BytesIO(), {})
    for bad in (b"no archive", gzip.compress(b"HTTP/1.1 200\r\n\r\n"), gzip.compress(records[1][:-1])):
        with pytest.raises(warc.DamagedArchive):
            warc.normalise_stream(io.BytesIO(bad), io.BytesIO(), {})
    wrong = records[1].replace(b"aaaaa", b"aaaab")
    with pytest.raises(warc.DamagedArchive):
        warc._row(*warc.read_member(gzip.compress(wrong)))
    with pytest.raises(warc.DamagedArchive):
        warc.read_member(gzip.compress(records[1]) + zlib.compress(b"more"))


def test_memory_is_bounded():
    """A record much longer than a chunk is passed through in pieces."""
    size = 60 << 20
    head = warc.response_head("id", "1", None, b"")
    fields = warc.parse_head(head.split(b"\r\n\r\n")[0])
    fields["Content-Length"] = str(size)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = packer.compress(warc.head_bytes(list(fields.items())))
    data += b"".join(packer.compress(b"\0" * (1 << 20)) for _ in range(60))
    data += packer.compress(b"\r\n\r\n") + packer.flush()
    inflated = warc.Inflated(io.BytesIO(data))
    inflated.line_block()
    longest = max(len(piece) for piece in inflated.take(size))
    assert longest <= warc.CHUNK
