"""WARC archives: writing, normalising a whole-file gzip stream into per-record members, reading.

``write_archives`` turns pages into records (a response each, a revisit where an equal payload
has a smaller page_id) and writes them with Spark's text writer: a record is a line, the line
separator is the record terminator, and the codec makes each file one monolithic gzip stream.
``normalise`` inflates every such stream once, in pieces, and rewrites each record as a gzip
member of its own, with a sidecar of offsets beside the archive. ``read_records`` fetches records
by offset through that index.

All files lie under the shared checkpoint folder; a task names its archive anew on every attempt
and only the files named by the committed index count, so a lost executor leaves no half file in
use. Paths of any file system that pyarrow can open work.

Defined results: null html is the empty payload; a null url is left out of the record; rows that
repeat a page_id and payload are responses alike when that page_id is the payload's smallest; a
row without page_id is a revisit of any equal payload that has one, else a response; an empty
table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.session import scratch_path

from .common import BROADCAST_BYTES, materialize

RECORDS_PER_FILE = 20_000
MIN_REVISIT_BYTES = 0           # smaller payloads are always responses
WRITTEN_AT = "2024-01-01T00:00:00Z"     # WARC-Date of the records (a parameter, not a clock)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
PIECE = 1 << 20                 # compressed bytes inflated at a time


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest); null html becomes ''."""

    def run(batches):
        for batch in batches:
            size, digest = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                size.append(len(text))
                digest.append(payload_digest(text))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(size, pa.int64()), pa.array(digest, pa.string())],
                ["page_id", "url", "html", "payload_bytes", "payload_digest"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
            .mapInArrow(run, "page_id long, url string, html string, payload_bytes long, "
                             "payload_digest string"))


def _urn(col):
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(col.cast("string"), F.lit("")), F.lit(">"))


def record_texts(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One WARC record per page, without the terminator, as column ``value``."""
    rows = with_digests(pages)
    first = materialize(
        rows.groupBy("payload_digest").agg(
            F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 and first_id is not null").select("payload_digest", "first_id"), "first")
    # only payloads that occur more than once are joined; sent to every task when few
    small = first.count() * 64 <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(first) if small else first, "payload_digest", "left")
    revisit = (F.col("first_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)
               & ~F.col("first_id").eqNullSafe(F.col("page_id")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "[\\x00-\\x1F\\x7F]", ""), " ", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    line("Content-Length", F.col("payload_bytes").cast("string")),
                    F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return rows.select(F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(WRITTEN_AT)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)),
                                 line("WARC-Refers-To", _urn(F.col("first_id")))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, records: int = RECORDS_PER_FILE) -> None:
    (record_texts(pages).write.option("compression", "gzip").option("lineSep", END)
     .option("maxRecordsPerFile", records).text(path))


_LENGTH = re.compile(rb"\r\nContent-Length:\s*(\d+)", re.I)


def split_records(stream):
    """Records (bytes with their terminator) of a stream of decompressed pieces."""
    held = bytearray()
    for piece in stream:
        held += piece
        at = 0
        while (head := held.find(b"\r\n\r\n", at)) >= 0:
            found = _LENGTH.search(held, at, head + 2)
            if not found:
                raise ValueError("a record without Content-Length")
            end = head + 4 + int(found[1]) + len(END)
            if end > len(held):
                break
            yield bytes(held[at:end])
            at = end
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(stream, piece: int = PIECE):
    """The decompressed bytes of a gzip file (one member or several) read from ``stream``, at most
    ``piece`` bytes read and inflated at a time."""
    d, inside = zlib.decompressobj(31), False
    while part := stream.read(piece):
        while part:
            yield d.decompress(part, piece)
            part, inside = d.unconsumed_tail or d.unused_data, not d.eof
            if d.eof:
                d = zlib.decompressobj(31)
    while inside and (rest := d.decompress(d.unconsumed_tail, piece)):
        yield rest
        inside = not d.eof
    if inside:
        raise ValueError("the archive ends inside a member")


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of ``uri``; Spark writes local ones with a single slash."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Rewrite every archive that ``archives`` (path) names under ``path``; the sidecar index as
    rows (archive, offset, length, record_id). An archive is read as a stream: a task holds a piece
    of it and one record, whatever its size."""

    def run(batches):
        store, root = _file_system(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                offset, rows = 0, []
                whole, place = _file_system(uri)
                with whole.open_input_stream(place, compression=None) as data, \
                        store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for record in split_records(inflate(data)):
                        coder = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = coder.compress(record) + coder.flush()
                        out.write(member)
                        rows.append((offset, len(member), headers(record)["warc-record-id"]))
                        offset += len(member)
                with store.open_output_stream(f"{root}/{name}.index.jsonl",
                                              compression=None) as side:
                    side.write("".join(json.dumps({"offset": o, "length": n, "id": i}) + "\n"
                                       for o, n, i in rows).encode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()),
                     pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.string())],
                    ["archive", "offset", "length", "record_id"])

    return materialize(archives.select("path").mapInArrow(
        run, "archive string, offset long, length long, record_id string"), "warc-index")


def headers(record: bytes) -> dict[str, str]:
    head = record[:record.index(b"\r\n\r\n")].decode("utf-8", "replace")
    return {k.strip().lower(): v.strip() for k, _, v in
            (x.partition(":") for x in head.split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def read_records(index: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of the
    records that ``index`` names under ``path``. A response's size and digest are computed from
    its payload, a revisit's are those it declares."""

    def run(batches):
        store, root = _file_system(path)
        opened, name = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(batch.column("archive").to_pylist(),
                                               batch.column("offset").to_pylist(),
                                               batch.column("length").to_pylist()):
                if archive != name:
                    if opened:
                        opened.close()
                    opened, name = store.open_input_file(f"{root}/{archive}"), archive
                record = zlib.decompress(opened.read_at(length, offset), 31)
                h = headers(record)
                start = record.index(b"\r\n\r\n") + 4
                block = record[start:start + int(h["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                if h["warc-type"] == "response":
                    size, digest, refers = len(payload), payload_digest(payload), None
                else:
                    size = int(_LENGTH.search(http + b"\r\n")[1])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    refers, payload = _page(h["warc-refers-to"]), None
                out.append((_page(h["warc-record-id"]), h.get("warc-target-uri"),
                            h["warc-type"], size, digest, refers, payload))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(),
                     pa.binary()]
            n = 7 if payloads else 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols[:n], kinds)], names[:n])

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to",
             "payload"]
    schema = ("page_id long, url string, record_type string, payload_bytes long, "
              "payload_digest string, refers_to long" + (", payload binary" if payloads else ""))
    return index.select("archive", "offset", "length").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write ``pages``, normalise the archives, read them back."""
    spark = pages.sparkSession
    whole, own = scratch_path(spark, "warc-whole"), scratch_path(spark, "warc-members")
    write_archives(pages, whole)
    archives = (spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(whole))
    return read_records(normalise(archives, own), own, payloads)
