"""ARC archives, versions 1 and 2, converted to WARC 1.0, and both read again.

Archives are gzip files that Spark's text sink writes and its text source
reads, on any file system; a gzip file isn't split, so its lines come to one
task in order, however long it is, and a record is put together from lines
until its declared length is reached.  No archive is held in memory.

The version block at the head of an ARC file names the fields of its header
lines: version 1 has URL, IP address, date, content type and length, version 2
also result code, checksum, location, offset and file name.  A record that ends
before its declared length, or a header line with other fields, is an error.

Converting makes identifiers from page and digest, so that a rerun gives the
same ones, ISO timestamps from the 14-digit ones, and SHA-256 digests.  Of
records with equal payloads of ``least`` bytes or more the one with the
smallest page id is a response, the others revisit it and keep only their HTTP
headers.  Records without page id are responses.  Nulls count as empty
payloads, shorter payloads are all responses, repeated rows give repeated
records, an empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import new_path, stored

# Fixed field names of ARC header lines, by version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:wakeline:archive")


# --- writing lines and reading them again


def _write(lines: DataFrame, path: str) -> str:
    lines.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(path)
    return path


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value: the lines of archives; those of a file are in order within one task."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


class _Feed:
    """The bytes of one file after the other, from batches of lines."""

    def __init__(self, batches):
        self.rows = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        self.next = next(self.rows, None)

    def line(self) -> bytes:
        value = self.next[1]
        self.next = next(self.rows, None)
        return value

    def take(self, size: int, file: str) -> bytes:
        """``size`` bytes and the line end behind them."""
        parts, have = [], -1
        while have < size:
            if self.next is None or self.next[0] != file:
                raise ValueError(f"{file}: a record ends before its declared length")
            parts.append(self.line())
            have += 1 + len(parts[-1])
        data = b"\n".join(parts)
        if len(data) > size and data[size:].strip(b"\r\n"):
            raise ValueError(f"{file}: a record is longer than its declared length")
        return data[:size]


# --- ARC


def _arc_lines(version: int, date: str):
    def run(batches):
        import pyarrow as pa

        head = f"{version} 0 wakeline\n{' '.join(FIELDS[version])}\n".encode()
        first = True
        for batch in batches:
            out = [b"filedesc://wakeline.arc 0.0.0.0 %s text/plain %s%d\n%s" % (date.encode(), b"200 - - 0 wakeline.arc " if version == 2 else b"", len(head), head)] if first else []
            first = False
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body = (html or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n%s" % (len(body), b"" if page is None else b"X-Page-Id: %d\r\n" % page, body)
                link = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:none"
                more = f"200 {hashlib.md5(block).hexdigest()} - 0 wakeline.arc " if version == 2 else ""
                out.append(f"{link} 0.0.0.0 {date} text/html {more}{len(block)}\n".encode() + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Pages as ARC records whose blocks are HTTP responses."""
    return _write(pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(_arc_lines(version, date), "value binary"), path)


def arc_records(lines: Iterator[bytes], feed: _Feed | None = None) -> Iterator[dict]:
    """url, date, type, version, block of each ARC record in a run of (file, line) batches."""
    feed = feed or _Feed(lines)
    file = fields = None
    while feed.next is not None:
        if feed.next[0] != file:
            file, fields = feed.next[0], None
        head = feed.line().decode("utf-8", "surrogateescape").rstrip("\r")
        if not head:
            continue
        values = head.split(" ")
        if fields is None:
            if not head.startswith("filedesc://"):
                raise ValueError(f"{file}: no version block")
            version, names = feed.take(int(values[-1]), file).decode().split("\n")[:2]
            version, fields = int(version.split(" ")[0]), names.split(" ")
            if tuple(fields) != FIELDS.get(version):
                raise ValueError(f"{file}: version {version} has other fields")
            continue
        if len(values) != len(fields):
            raise ValueError(f"{file}: a header line has {len(values)} fields, not {len(fields)}")
        record = dict(zip(fields, values, strict=True))
        yield {"url": record["URL"], "date": record["Archive-date"], "type": record["Content-type"], "version": version, "block": feed.take(int(record["Archive-length"]), file)}


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header values by lower-case name, head with its empty line, body."""
    head, mark, body = block.partition(b"\r\n\r\n")
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, head + mark, body


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, date, content_type, version, digest (of the payload), bytes, block."""

    def run(batches):
        import pyarrow as pa

        names = ["page_id", "url", "date", "content_type", "version", "digest", "bytes", "block"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
        held, size = [], 0

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for r in arc_records(batches):
            values, _, body = http_parts(r["block"])
            page = values.get("x-page-id")
            held.append((int(page) if page else None, r["url"], r["date"], r["type"], r["version"], hashlib.sha256(body).hexdigest(), len(body), r["block"]))
            size += len(r["block"])
            if size > 8_000_000:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    return _lines(spark, path).mapInArrow(run, "page_id long, url string, date string, content_type string, version int, digest string, bytes long, block binary")


# --- WARC


def record_id(page: int | None, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page if page is not None else url}:{digest}')}>"


def warc_record(r: dict) -> bytes:
    """A WARC record with the line ends behind it, but for the last one."""
    _, head, _ = http_parts(r["block"])
    iso = re.sub(r"(....)(..)(..)(..)(..)(..)", r"\1-\2-\3T\4:\5:\6Z", r["date"])
    revisit = r["refers_to"] is not None
    block = head if revisit else r["block"]
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(r['page_id'], r['digest'], r['url'])}",
        f"WARC-Date: {iso}",
        f"WARC-Target-URI: {r['url']}",
        f"WARC-Payload-Digest: sha256:{r['digest']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(r['refers_to'], r['digest'], '')}", f"X-Refers-To-Page-Id: {r['refers_to']}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block + b"\r\n\r"


def convert(arc: DataFrame, path: str, least: int = 100) -> str:
    """ARC records, as ``read_arc`` gives them, written as WARC archives."""
    known = stored(arc.select("page_id", "digest", "bytes"), "digests").where(F.col("page_id").isNotNull() & (F.col("bytes") >= least))
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    # repeats alone, each by its own page, so that records meet them without a hot key
    repeats = stored(known.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "repeats")
    rows = arc.join(repeats, ["page_id", "digest"], "left").select("page_id", "url", "date", "digest", "block", "refers_to")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(warc_record, batch.to_pylist()), pa.binary())], ["value"])

    return _write(rows.mapInArrow(run, "value binary"), path)


def warc_records(batches) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header values by lower-case name, and block, of each record."""
    feed = _Feed(batches)
    while feed.next is not None:
        file, head = feed.next[0], feed.line().rstrip(b"\r")
        if not head:
            continue
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{file}: no WARC record where one is due")
        values: dict[str, str] = {}
        while line := feed.line().rstrip(b"\r"):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            values[name.strip().lower()] = value.strip()
        yield values, feed.take(int(values["content-length"]), file)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date; digests are recomputed."""

    def run(batches):
        import pyarrow as pa

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def sent(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        held = []
        for values, block in warc_records(batches):
            http, _, body = http_parts(block)
            digest, kind = values["warc-payload-digest"].removeprefix("sha256:"), values["warc-type"]
            size = int(http["content-length"])
            if kind == "response" and (size, digest) != (len(body), hashlib.sha256(body).hexdigest()):
                raise ValueError(f"{values['warc-record-id']}: the payload differs from its digest or length")
            page, refers = http.get("x-page-id"), values.get("x-refers-to-page-id")
            held.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, values["warc-record-id"], values["warc-target-uri"], values["warc-date"]))
            if len(held) == 5_000:
                yield sent(held)
                held = []
        if held:
            yield sent(held)

    return _lines(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string")


def through_archives(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages written as ARC, converted to WARC, and read from there."""
    spark = pages.sparkSession
    arc = write_arc(pages, new_path(spark, "arc"), version)
    return read_warc(spark, convert(read_arc(spark, arc), new_path(spark, "warc")))
