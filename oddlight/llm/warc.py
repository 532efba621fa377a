"""WARC archives: records written through Spark, read back, and assembled into one nested row per capture.

Every page gives a request, a response (or a revisit, when an equal payload has a response already) and a metadata
record. Request and metadata name the capture's response or revisit in WARC-Concurrent-To, and a reader joins them by
that identifier wherever they lie. Each record is a gzip member of its own. The files are written by Spark's text
writer (so to any file system that Spark reaches), whose line separator is an empty gzip member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage_table, tune

#: Compressed bytes fed to the decompressor at a time, and rows that may be broadcast (about 20 MB).
WINDOW, BROADCAST_ROWS = 8192, 200_000
_KINDS = ("response", "revisit", "request", "metadata")
_GAP = gzip.compress(b"", 9, mtime=0)  # an empty member
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, row: int, kind: str) -> str:
    """A version-8 UUID that holds the page id (zero, with a mark, for a null id), the row number and the kind of record."""
    if not 0 <= row < 1 << 55:
        raise ValueError(f"row number {row} does not fit in a record id")
    n = (page or 0) & (2**64 - 1)
    bits = (n >> 16) << 80 | 8 << 76 | (n >> 4 & 0xFFF) << 64 | 2 << 62 | (n & 15) << 58 | row << 3 | (page is None) << 2 | _KINDS.index(kind)
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def page_of(identifier: str | None) -> int | None:
    """The page id in a record id of ours."""
    if not identifier:
        return None
    bits = int(identifier[10:-1].replace("-", ""), 16)
    if bits >> 2 & 1:
        return None
    n = (bits >> 80) << 16 | (bits >> 64 & 0xFFF) << 4 | (bits >> 58 & 15)
    return n - 2**64 if n >> 63 else n


def page_of_column(identifier: Column) -> Column:
    """page_of as a column expression: the id's bits are the UUID's first 12 hex digits, then 3, then 1."""
    digits = F.regexp_replace(F.substring(identifier, 11, 36), "-", "")
    bits = F.concat(F.substring(digits, 1, 12), F.substring(digits, 14, 3), F.lower(F.hex(F.shiftright(F.conv(F.substring(digits, 17, 2), 16, 10).cast("int"), 2).bitwiseAND(15))))
    null = F.conv(F.substring(digits, 32, 1), 16, 10).cast("int").bitwiseAND(4) != 0
    return F.when(~null, F.conv(bits, 16, -10).cast("long"))


def record(kind: str, identifier: str, url: str, block: bytes, content_type: str, **more: str) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": identifier, "WARC-Date": _DATE, "WARC-Target-URI": url, "Content-Type": content_type, "Content-Length": str(len(block))}
    fields |= {k.replace("_", "-"): v for k, v in more.items() if v}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _clean_url(url: str | None) -> str:
    return re.sub(r"\s", "%20", url or "about:blank")


def _digests(batches):
    for b in batches:
        html = [h or b"" for h in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([payload_digest(h) for h in html])], [*b.schema.names, "digest"])


def _records(batches):
    for b in batches:
        out, members = [], []
        for page, url, html, digest, row, first, first_row, first_url in zip(*(c.to_pylist() for c in (b.column(0), b.column(1), b.column(2).cast(pa.binary()), *b.columns[3:])), strict=True):
            html, url = html or b"", _clean_url(url)
            kind = "response" if row == first_row or (page is not None and page == first) else "revisit"
            own = record_id(page, row, kind)
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
            path = re.sub(r"^[a-z]+://[^/]*", "", url) or "/"
            host = (re.match(r"^[a-z]+://([^/]*)", url) or ["", "unknown"])[1]
            members = [record("request", record_id(page, row, "request"), url, f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), "application/http; msgtype=request", WARC_Concurrent_To=own)]
            if kind == "response":
                members.append(record(kind, own, url, http + html, "application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{digest}"))
            else:
                members.append(record(kind, own, url, http, "application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{digest}", WARC_Profile=_PROFILE, WARC_Refers_To=record_id(first, first_row, "response"), WARC_Refers_To_Target_URI=_clean_url(first_url), WARC_Refers_To_Date=_DATE))
            members.append(record("metadata", record_id(page, row, "metadata"), url, f"page_id: {'' if page is None else page}\r\npayload_bytes: {len(html)}\r\n".encode(), "application/warc-fields", WARC_Concurrent_To=own))
            out.append(_GAP.join(members))
        yield pa.record_batch([pa.array(out, pa.binary())], ["members"])


def write_warc(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the archives of a table of pages.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest id (null ids last, then the
    first row) is a response and the others revisit it; smaller payloads are all responses. Every row is a capture of
    its own: rows that repeat a page id keep their records apart by the row number in the record ids, and rows that
    repeat the response's id with its payload are responses too. A null html is an empty payload, a null url about:blank.
    """
    spark = pages.sparkSession
    tune(spark)
    cols = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = stage_table(cols.mapInArrow(_digests, "page long, url string, html string, digest string").withColumn("row", F.monotonically_increasing_id()), "digested")
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    first = rows.where(size >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page").isNull().alias("none"), "page", "row", "url")).alias("f")).where("n > 1")
    # only rows with a repeated payload meet the first rows; the rest of the pages never move unless these rows are many
    repeated = rows.select("digest", "row").join(first.drop("n"), "digest").select("row", F.col("f.page").alias("first"), F.col("f.row").alias("first_row"), F.col("f.url").alias("first_url"))
    repeated = stage_table(repeated, "repeated")
    few = repeated.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(repeated) if few else repeated, "row", "left").select("page", "url", "html", "digest", "row", "first", F.coalesce("first_row", "row").alias("first_row"), "first_url")
    alone = F.when(size < least, F.col("row")).otherwise(F.col("first_row"))
    members = joined.withColumn("first_row", alone).mapInArrow(_records, "members binary")
    members.select(F.col("members").cast("string").alias("value")).write.option("lineSep", _GAP.decode("iso-8859-1")).option("encoding", "ISO-8859-1").text(path)


def _fields(head: bytes) -> dict[str, str] | None:
    """Header fields by name, in lower case; null where the version line is missing. Repeated fields are joined by a space."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    fields: dict[str, str] = {}
    for name, colon, value in (x.partition(":") for x in lines[1:]):
        if colon:
            name = name.strip().lower()
            fields[name] = f"{fields[name]} {value.strip()}" if name in fields else value.strip()
    return fields


def _length(fields: dict[str, str] | None) -> int | None:
    """The stated block length; null where type, id or length is missing or is no number."""
    size = (fields or {}).get("content-length", "")
    return int(size) if size.isdecimal() and fields.get("warc-type") and fields.get("warc-record-id") else None


def _seek(view: memoryview, at: int, mark: bytes, limit: int | None = None) -> int:
    """Position of the next mark from at on (within limit bytes), or -1."""
    end = len(view) if limit is None else min(len(view), at + limit)
    while at < end:
        found = bytes(view[at : min(at + (1 << 16) + len(mark), end)]).find(mark)
        if found >= 0:
            return at + found
        at += 1 << 16
    return -1


def _invalid(data: bytes) -> tuple[dict[str, str], bytes]:
    return {"warc-type": "invalid"}, data


def parse_members(raw: bytes):
    """(fields, block) of every record in a file, one in memory at a time; field names are in lower case.

    Records are gzip members, or lie uncompressed. What can't be read as a record (no version line, type, id or length, a
    block shorter than stated, a broken member) comes as a record of type ``invalid`` with its bytes; reading goes on
    at the next member or version line.
    """
    view, at = memoryview(raw), 0
    while at < len(view):
        begin = at
        if bytes(view[at : at + 2]) == b"\x1f\x8b":
            member, parts = zlib.decompressobj(31), []
            try:
                while not member.eof and at < len(view):  # a window at a time: what follows a member is not copied again and again
                    window = view[at : at + WINDOW]
                    parts.append(member.decompress(window))
                    at += len(window) - len(member.unused_data)
                data = b"".join(parts)
            except zlib.error:
                data = None
            if data is None or not member.eof:
                at = _seek(view, begin + 2, b"\x1f\x8b\x08")
                at = len(view) if at < 0 else at
                yield _invalid(bytes(view[begin:at]))
            elif data:
                head, _, rest = data.partition(b"\r\n\r\n")
                fields = _fields(head)
                size = _length(fields)
                yield _invalid(data) if size is None or size > len(rest) else (fields, rest[:size])
            continue
        if bytes(view[at : at + 1]) in (b"\r", b"\n"):  # between uncompressed records
            at += 1
            continue
        head = _seek(view, at, b"\r\n\r\n", 1 << 20)
        fields = _fields(bytes(view[at:head])) if head >= 0 else None
        size = _length(fields)
        if size is None or head + 4 + size > len(view):
            at = _seek(view, begin + 1, b"\r\nWARC/1.")
            at = len(view) if at < 0 else at + 2
            yield _invalid(bytes(view[begin:at]))
        else:
            at = head + 4 + size
            yield fields, bytes(view[head + 4 : at])


def _stated_bytes(block: bytes) -> int | None:
    """payload_bytes of a metadata record's block; null where it is not stated as a number."""
    for name, _, value in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()):
        if name.strip() == "payload_bytes" and value.strip().isdecimal():
            return int(value)
    return None


_RECORD = "type string, record_id string, anchor string, target_uri string, refers_to string, payload_digest string, block binary, payload_bytes long"


def _parsed(with_block: bool):
    def run(batches):
        for b in batches:
            for raw in b.column(0):
                rows: list[tuple] = []
                held = 0
                for f, block in parse_members(raw.as_buffer()):
                    kind, own, size = f["warc-type"], f.get("warc-record-id"), None
                    digest = f.get("warc-payload-digest", "").partition(":")[2]
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, size = payload_digest(payload), len(payload)
                    elif kind == "metadata":
                        size = _stated_bytes(block)
                    named = [] if kind in ("response", "revisit") else f.get("warc-concurrent-to", "").split()
                    for anchor in named or [own]:
                        rows.append((kind, own, anchor, f.get("warc-target-uri"), f.get("warc-refers-to"), digest or None, block if with_block or kind != "response" else None, size))
                    held += len(block)
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.binary(), pa.int64()]
    names = ["type", "record_id", "anchor", "target_uri", "refers_to", "payload_digest", "block", "payload_bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """The records of all archives under path; anchor is the concurrent-to identifier, or a record's own.

    A response's digest and size are recomputed from the bytes that were read. A record that names several others as
    concurrent gives a row for each. Bytes that are no record give a row of type ``invalid`` without ids.
    """
    tune(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed(with_block), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, and the structs capture, request and metadata (null where absent).

    Records join by their anchor. A capture is a response or revisit; requests and metadata that name no capture in the
    input have a null capture struct. Invalid records take no part.
    """
    records = records.where("type <> 'invalid'")
    body = F.struct("type", "record_id", "target_uri", "refers_to", "payload_digest", "block", "payload_bytes")

    def one(*kinds: str):
        return F.first(F.when(F.col("type").isin(*kinds), body), ignorenulls=True)

    return records.groupBy(F.col("anchor").alias("capture_id")).agg(one("response", "revisit").alias("capture"), one("request").alias("request"), one("metadata").alias("metadata"))
