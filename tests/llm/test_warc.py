"""WARC: exact round trips, whole-file streams, members and sidecar offsets."""
import base64
import gzip
import hashlib
import io
import json
import os

import pytest

from carelens.llm import warc
from carelens.session import scratch_path

SCHEMA = "page_id long, url string, html string, offset long, archive string, payload string"
PAGES = [
    (5, "http://a.example/x y", "<p>one</p>"), (3, "http://b.example/", "<p>one</p>"),
    (9, None, "<p>one</p>"), (1, "http://c.example/\r\nX: 1", "é\r\n\r\nContent-Length: 7\r\n\r\n"),
    (2, "u", None), (4, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 40), (8, "u", "퟿😀" * 50_000),
    (None, "u", "<p>one</p>"), (None, "u", "alone"), (3, "http://b.example/", "<p>one</p>"),
]


def table(spark, pages=PAGES):
    return spark.createDataFrame([(*p, 1, "x", "y") for p in pages], SCHEMA).repartition(3)


def want():
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and f != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "revisit" if again else "response", f if again else None,
                    None if again else b))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = warc.archive_round_trip(table(spark), payloads=True).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"],
                   r["refers_to"], r["payload"] and bytes(r["payload"])
                   if r["payload"] is not None else None) for r in rows), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want()]
    assert [x[5] or b"" for x in got] == [x[5] or b"" for x in want()]


def test_members_and_sidecar(spark):
    whole, own = scratch_path(spark, "t-whole"), scratch_path(spark, "t-own")
    warc.write_archives(table(spark), whole, records=4)
    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(whole)
    index = warc.normalise(source, own).collect()
    folder = own.removeprefix("file:")
    names = [n for n in os.listdir(folder) if n.endswith(".warc.gz")]
    assert len(index) == len(PAGES)
    for name in names:
        data = open(os.path.join(folder, name), "rb").read()
        side = [json.loads(x) for x in open(os.path.join(folder, name + ".index.jsonl"))]
        parts = [gzip.decompress(data[s["offset"]:s["offset"] + s["length"]]) for s in side]
        assert b"".join(parts) == gzip.decompress(data)
        assert sum(s["length"] for s in side) == len(data)
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)
    streams = b"".join(gzip.decompress(bytes(r["content"])) for r in source.collect())
    assert streams.count(b"WARC-Record-ID") == len(PAGES)


def test_empty_table(spark):
    assert warc.archive_round_trip(table(spark, [])).collect() == []


def test_streams_in_pieces():
    records = [f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n"
               for n in (0, 5, 70_000, 3)]
    one = gzip.compress(b"".join(records))
    many = b"".join(gzip.compress(r) for r in records)
    for data in (one, many):
        assert list(warc.split_records(warc.inflate(io.BytesIO(data), 7))) == records
    with pytest.raises(ValueError):
        list(warc.split_records([records[1][:-6]]))
    blank = gzip.compress(bytes(3_000_000))        # a piece inflates to far more than it holds
    sizes = [len(x) for x in warc.inflate(io.BytesIO(blank + blank), 1000)]
    assert sum(sizes) == 6_000_000 and max(sizes) <= 1000
    assert list(warc.inflate(io.BytesIO(b""))) == []
    for cut in (5, len(blank) // 2, len(blank) - 1, len(blank) + 4):
        with pytest.raises(ValueError):
            list(warc.inflate(io.BytesIO((blank + blank)[:cut]), 1000))
