"""WARC archives: records with revisits and segments are written, read back and reassembled.

Each record is a gzip member of its own. A response carries an HTTP message
whose body is in chunked transfer framing; a record over the segment limit is
split into a first segment and continuation records that name its origin. A
revisit has the HTTP header alone, with the full payload's length and digest.
An archive is a row (archive, segmented, data); archives that hold segments are
apart, so only their records meet in a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import map_batches, utf8
from .common import stage

#: Bytes of a record's block above which it is segmented, of a transfer chunk, and of an archive.
SEGMENT_BYTES = 1 << 12
CHUNK_BYTES = 1 << 10
ARCHIVE_BYTES = 8 << 20
#: WARC-Date of all records, since the pages have no time of their own.
DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"
_ARCHIVE = T.StructType([T.StructField("archive", T.StringType()), T.StructField("segmented", T.BooleanType()), T.StructField("data", T.BinaryType())])
_RECORD = T.StructType([T.StructField(n, t) for n, t in (("page", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.StringType()))])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.index(_CRLF, at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        if len(out[-1]) != size:
            raise ValueError("a chunk ends early")
        at = end + 4 + size


def _record(fields: list[tuple[str, str]], block: bytes, date: str = DATE) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Date", date), ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + _CRLF + block + _CRLF + _CRLF) + pack.flush()


def _clean(value: str | None) -> str:
    return " ".join((value or "").split())


def info_record(archive: str, date: str = DATE) -> bytes:
    """The record that an archive begins with."""
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{archive}>"), ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")], b"software: citaforge\r\nformat: WARC File Format 1.1\r\n", date)


def response_records(record_id: str, url: str | None, payload: bytes, limit: int = SEGMENT_BYTES, date: str = DATE) -> list[bytes]:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    common = [("WARC-Target-URI", _clean(url))]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *common, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= limit:
        return [_record(first, block, date)]
    out, parts = [], [block[i : i + limit] for i in range(0, len(block), limit)]
    for n, part in enumerate(parts, 1):
        fields = first if n == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{n}>"), *common, ("WARC-Segment-Origin-ID", f"<{record_id}>")]
        out.append(_record([*fields, ("WARC-Segment-Number", str(n)), *([("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else [])], part, date))
    return out


def revisit_record(record_id: str, url: str | None, payload_digest: str, payload_bytes: int, refers_to: str, date: str = DATE) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", _clean(url)), ("WARC-Profile", profile), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http;msgtype=response")], block, date)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, pieces = zlib.decompressobj(31), []
        while not unpack.eof:  # fed by pieces, since what follows the member is copied
            if at >= len(view):
                raise ValueError("an archive ends early")
            pieces.append(unpack.decompress(view[at : at + 8192]))
            at += min(8192, len(view) - at)
        raw = b"".join(pieces)
        at -= len(unpack.unused_data)
        cut = raw.index(b"\r\n\r\n")
        lines = raw[:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        block = raw[cut + 4 : cut + 4 + size]
        if len(block) != size:
            raise ValueError("a record ends early")
        yield fields, block


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header and payload of a block, transfer framing removed."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:])}
    return http, unchunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body


def _page(record_id: str) -> str | None:
    """The page of a record id `urn:page:<page, percent-encoded>:<partition>.<number>`."""
    return unquote(record_id.strip("<>").split(":")[2]) or None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    http, payload = payload_of(block)
    if fields["warc-type"] == "revisit":
        return _page(fields["warc-record-id"]), "revisit", int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), _page(fields["warc-refers-to"])
    found = digest(payload)
    if found != fields["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError("a payload does not match its digest")
    return _page(fields["warc-record-id"]), fields["warc-type"], len(payload), found, None


def _columns(rows: list[tuple]) -> dict[str, list]:
    return dict(zip(_RECORD.names, map(list, zip(*rows)) if rows else [[] for _ in _RECORD.names]))


def write_archives(pages: DataFrame, least: int = 0, limit: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Archives (archive, segmented, data) with a record for each row (page_id, url, html), or more where its block is over `limit`.

    Of pages with equal payloads of at least `least` bytes the one with the
    smallest page_id is the response; the others revisit it. Rows that repeat a
    page_id with an equal payload are all alike. Null html is empty; pages with
    a null id are responses unless an equal payload has an id. Ids may hold any
    characters; an empty table gives no archive; other columns are not read. The
    html is shuffled once, by digest; the join may split a hot digest.
    """
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.concat_ws(":", F.sha1(data), F.length(data)).alias("mark"), F.length(data).alias("size"))
    copies = stage(marked.where(F.col("size") >= least).groupBy("mark").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("mark").alias("of"), "first"), "revisits")
    rows = marked.join(copies, F.col("mark") == F.col("of"), "left").select(F.col("page_id").cast("string").alias("page"), "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).cast("string").alias("refers_to"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, number, open_ = TaskContext.get().partitionId(), 0, {False: [], True: []}
        made, size = {False: 0, True: 0}, {False: 0, True: 0}

        def flush(segmented: bool) -> dict:
            name = f"part-{part:05d}-{made[segmented]:05d}{'-segments' * segmented}.warc.gz"
            data = b"".join([info_record(name, date), *open_[segmented]])
            open_[segmented], made[segmented], size[segmented] = [], made[segmented] + 1, 0
            return {"archive": [name], "segmented": [segmented], "data": [data]}

        for b in batches:
            for page, url, html, refers in zip(b.column("page").to_pylist(), b.column("url").to_pylist(), utf8(b, "html"), b.column("refers_to").to_pylist()):
                name, payload = f"urn:page:{quote(page or '', safe='')}:{part}.{number}", html or b""
                number += 1
                records = response_records(name, url, payload, limit, date) if refers is None else [revisit_record(name, url, digest(payload), len(payload), f"urn:page:{quote(refers, safe='')}", date)]
                segmented = len(records) > 1
                open_[segmented] += records
                size[segmented] += sum(map(len, records))
                if size[segmented] > archive_bytes:
                    yield flush(segmented)
        for segmented in (False, True):
            if open_[segmented]:
                yield flush(segmented)

    return map_batches(rows, body, _ARCHIVE)


def reassemble(segments: DataFrame) -> DataFrame:
    """Records from segments (origin, number, total, fields, block): the segments of an origin in the order of their numbers.

    Repeated segments count once; a missing one, or a total length that does
    not match, raises an error. A group holds one record.
    """
    grouped = segments.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "fields", "block"))).alias("parts"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                parts = {p["number"]: p for p in b.column("parts")[i].as_py()}
                block = b"".join(parts[n]["block"] for n in sorted(parts))
                totals = {p["total"] for p in parts.values()} - {None}
                if sorted(parts) != list(range(1, len(parts) + 1)) or totals != {len(block)}:
                    raise ValueError(f"segments of {b.column('origin')[i]} do not make up its length")
                rows.append(_row(json.loads(parts[1]["fields"]), block))
            yield _columns(rows)

    return map_batches(grouped, body, _RECORD)


def read_archives(archives: DataFrame) -> DataFrame:
    """(page, record_type, payload_bytes, payload_digest, refers_to) per record; digests are verified."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for data in b.column("data"):
                yield _columns([_row(f, block) for f, block in parse_archive(data.as_buffer()) if f["warc-type"] != "warcinfo"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for data in b.column("data"):
                rows = [(f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, json.dumps(f), block) for f, block in parse_archive(data.as_buffer()) if f["warc-type"] != "warcinfo"]
                yield dict(zip(("origin", "number", "total", "fields", "block"), map(list, zip(*rows))))

    segment = T.StructType([T.StructField("origin", T.StringType()), T.StructField("number", T.LongType()), T.StructField("total", T.LongType()), T.StructField("fields", T.StringType()), T.StructField("block", T.BinaryType())])
    whole_rows = map_batches(archives.where("not segmented").select("data"), whole, _RECORD)
    return whole_rows.unionByName(reassemble(map_batches(archives.where("segmented").select("data"), parts, segment)))


def round_trip(pages: DataFrame, least: int = 0, limit: int = SEGMENT_BYTES) -> DataFrame:
    """Writes archives into the shared folder and reads them back."""
    found = read_archives(stage(write_archives(pages, least, limit), "warc"))
    kind = pages.schema["page_id"].dataType
    return found.withColumn("page_id", F.col("page").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind)).drop("page")
