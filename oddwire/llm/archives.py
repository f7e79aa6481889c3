"""Web archives: legacy ARC files of both versions, their conversion to WARC, and reading WARC.

Archives are gzip files, read by Spark line by line in one task each and never held whole. Records
are cut by their declared lengths alone, so contents may hold anything, also header lines.

The converter gives each ARC record what WARC asks for: an identifier made from the place of the
record, an ISO timestamp, a type (warcinfo for the file description, response for HTTP answers,
resource for the rest) and SHA-1 digests of block and payload. Records of equal payload become one
response and revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddwire.llm.shared import new_path, written

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
    "Archive-length",
}
NO_URL = "urn:none"

REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

RECORD = (
    "archive string, at long, url string, ip string, date string, type string, truncated boolean, "
    "number long, block binary, payload_at long, payload_bytes long, payload_digest string, "
    "block_digest string, payload_sha256 string"
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Writing ARC


def _arc_headers(version: int, date: str):
    """Puts the file description before the records of a task, which become one file."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body = f"{version} 0 oddwire\n{ARC_FIELDS[version]}\n".encode()
        name = f"filedesc://{uuid.uuid4().hex}.arc"
        middle = "" if version == 1 else "200 - - 0 - "
        head = f"{name} 0.0.0.0 {date} text/plain {middle}{len(body)}\n".encode()
        yield pa.RecordBatch.from_arrays([pa.array([head + body], pa.binary())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("value")], ["value"])

    return task


def write_arc(captures: DataFrame, path: str, version: int, date: str = "20240101000000") -> None:
    """Write (number, url, payload) as ARC records of HTTP answers, one file a task.

    A null payload is empty, a null or blank url is ``urn:none``, blanks in urls become %20. The
    number travels in an HTTP header.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"\s", "%20")
    url = F.when(url == "", F.lit(NO_URL)).otherwise(url)
    answer = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Number: "),
        F.coalesce(F.col("number").cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
        payload,
    )
    middle = F.lit(" " if version == 1 else " 200 - - 0 - ")
    head = F.concat(url, F.lit(f" 0.0.0.0 {date} text/html"), middle)
    value = F.concat(head, F.octet_length(answer).cast("string"), F.lit("\n"), answer)
    rows = captures.select(value.cast("binary").alias("value"))
    _write(rows.mapInArrow(_arc_headers(version, date), "value binary"), path, "\n")


def _write(rows: DataFrame, path: str, end: str) -> None:
    text = rows.select(F.col("value").cast("string").alias("value"))
    text.write.option("compression", "gzip").option("lineSep", end).text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("line")
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        yield from zip(batch.column("archive").to_pylist(), batch.column("line").to_pylist())


class Body:
    """Content of a declared length, gathered from lines."""

    def __init__(self, length: int):
        if length < 0:
            raise ValueError("negative length")
        self.missing = length
        self.parts: list[bytes] = []

    def add(self, line: bytes) -> None:
        part = (line + b"\n")[: self.missing]
        self.parts.append(part)
        self.missing -= len(part)

    def bytes(self) -> bytes:
        return b"".join(self.parts)


# Reading ARC


def arc_records(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
    """(archive, at, fields by name, content, truncated) of each record.

    The first record of a file describes it: its version chooses the header line of the others.
    A file that ends inside a record gives what there is, marked as truncated.
    """
    archive, at, start, names, fields, body = None, 0, 0, None, None, None
    for path, line in lines:
        if path != archive:
            if body is not None:
                yield archive, start, fields, body.bytes(), True
            archive, at, names, body = path, 0, None, None
        begins, at = at, at + len(line) + 1
        if body is None:
            if not line.strip():
                continue
            start = begins
            fields, length = _arc_head(line, names, path, start)
            body = Body(length)
        else:
            body.add(line)
        if not body.missing:
            content = body.bytes()
            if names is None:
                names = _arc_names(content, path)
            yield archive, start, fields, content, False
            body = None
    if body is not None:
        yield archive, start, fields, body.bytes(), True


def _arc_head(line: bytes, names: list[str] | None, path: str, at: int):
    """Fields of a header line, counted from its end, as urls may hold blanks."""
    text = line.decode("utf-8", "replace").rstrip("\r")
    try:
        if names is None:
            parts = text.split(" ")
            names = ARC_FIELDS[1 if len(parts) == 5 else 2].split(" ")
        parts = text.rsplit(" ", len(names) - 1)
        fields = dict(zip(names, parts, strict=True))
        return fields, int(fields["Archive-length"])
    except (ValueError, KeyError) as error:
        raise ValueError(f"no ARC header line in {path} at byte {at}: {text[:200]!r}") from error


def _arc_names(content: bytes, path: str) -> list[str]:
    lines = content.decode("utf-8", "replace").splitlines()
    version = lines[0].split(" ")[0] if lines else ""
    if version not in ("1", "2"):
        raise ValueError(f"{path} does not say its ARC version")
    own = lines[1].split(" ") if len(lines) > 1 else []
    return own if own[-1:] == ["Archive-length"] else ARC_FIELDS[int(version)].split(" ")


def split_http(block: bytes) -> tuple[dict[str, str], int]:
    """HTTP headers by lower-case name, and where the payload begins; none: all is payload."""
    if not block.startswith(b"HTTP/"):
        return {}, 0
    end, width = block.find(b"\r\n\r\n"), 4
    if end < 0:
        end, width = block.find(b"\n\n"), 2
    if end < 0:
        end, width = len(block), 0
    headers = {}
    for line in block[:end].decode("utf-8", "replace").splitlines()[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, end + width


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20):
    """Rows in batches of about ``size`` bytes of content."""
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += 200 + sum(len(v) for v in row if isinstance(v, bytes))
        if held >= size:
            yield _batch(waiting, schema)
            waiting, held = [], 0
    if waiting:
        yield _batch(waiting, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in text.split(", "))])


def _read_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for archive, at, fields, content, truncated in arc_records(_pairs(batches)):
            headers, payload_at = split_http(content)
            payload = content[payload_at:]
            url, date = fields.get("URL", NO_URL), fields.get("Archive-date", "")
            if url.startswith("filedesc:"):
                kind = "warcinfo"
            else:
                kind = "response" if content.startswith(b"HTTP/") else "resource"
            yield (
                archive,
                at,
                url,
                fields.get("IP-address"),
                date,
                kind,
                truncated,
                _number(headers.get("x-number")),
                content,
                payload_at,
                len(payload),
                digest(payload),
                digest(content),
                hashlib.sha256(payload).hexdigest(),
            )

    yield from _batches(rows(), _schema(RECORD))


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per ARC record with what WARC needs; file descriptions are of type warcinfo."""
    return _lines(spark, path).mapInArrow(_read_arc, RECORD)


# Conversion


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record_id(archive: Column, at: Column) -> Column:
    """The same identifier at each conversion of the same file."""
    hash_ = F.md5(F.concat_ws("#", archive, at))
    parts = [F.substring(hash_, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def convert(records: DataFrame, path: str) -> None:
    """Write ARC records as WARC.

    Of HTTP answers with equal payloads, empty ones included, the one with the largest number (null
    is least; then by place) is the response; the others become revisits, which keep their HTTP
    headers and refer to it. Dates that are not 14 digits become the epoch.
    """
    order = F.struct(F.coalesce("number", F.lit(-(2**63))).alias("number"), "archive", "at")
    answers = records.where("type = 'response'")
    first = answers.groupBy("payload_sha256", "payload_bytes").agg(
        F.max(order).alias("first"), F.count("*").alias("copies")
    )
    first = first.where("copies > 1").select("payload_sha256", "payload_bytes", "first")
    joined = records.join(
        written(first, "equal-payloads"), ["payload_sha256", "payload_bytes"], "left"
    )
    revisit = (F.col("type") == "response") & (
        (F.col("archive") != F.col("first.archive")) | (F.col("at") != F.col("first.at"))
    )
    revisit = F.coalesce(revisit, F.lit(False))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.col("type"))
    whole = F.col("block")
    block = F.when(revisit, F.substring(whole, F.lit(1), F.col("payload_at").cast("int"))).otherwise(
        whole
    )
    iso = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    iso = F.when(F.col("date").rlike(r"^\d{14}$"), iso).otherwise(F.lit("1970-01-01T00:00:00Z"))
    media = (
        F.when(F.col("type") == "response", F.lit("application/http; msgtype=response"))
        .when(F.col("type") == "warcinfo", F.lit("text/plain"))
        .otherwise(F.lit("application/octet-stream"))
    )
    sha1 = F.lit("sha1:")
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", record_id(F.col("archive"), F.col("at"))),
        _field("WARC-Date", iso),
        _field("WARC-Target-URI", F.when(F.col("type") != "warcinfo", F.col("url"))),
        _field("WARC-IP-Address", F.when(F.col("type") == "response", F.col("ip"))),
        _field("WARC-Payload-Digest", F.concat(sha1, F.col("payload_digest"))),
        _field("WARC-Block-Digest", F.when(~revisit, F.concat(sha1, F.col("block_digest")))),
        _field("WARC-Truncated", F.when(F.col("truncated"), F.lit("unspecified"))),
        _field("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _field(
            "WARC-Refers-To",
            F.when(revisit, record_id(F.col("first.archive"), F.col("first.at"))),
        ),
        _field("Content-Type", media),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    value = F.concat(head.cast("binary"), block, F.lit("\r\n").cast("binary"))
    _write(joined.select(value.alias("value")), path, "\r\n")


# Reading WARC

WARC_RECORD = (
    "record_id string, record_type string, refers_to string, url string, date string, "
    "number long, payload binary, payload_bytes long, payload_digest string"
)


def warc_records(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by declared lengths."""
    archive, headers, body = None, None, None
    for path, line in lines:
        if path != archive:
            if headers is not None or body is not None:
                raise ValueError(f"{archive} ends inside a record")
            archive = path
        if body is not None:
            body.add(line)
        elif headers is None:
            if line.startswith(b"WARC/"):
                headers = {}
            elif line.strip():
                raise ValueError(f"no WARC record in {path}: {line[:200]!r}")
            continue
        elif line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
            continue
        else:
            body = Body(int(headers["content-length"]))
        if not body.missing:
            yield headers, body.bytes()
            headers = body = None
    if headers is not None or body is not None:
        raise ValueError(f"{archive} ends inside a record")


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for headers, block in warc_records(_pairs(batches)):
            http, payload_at = split_http(block)
            kind, payload = headers.get("warc-type"), block[payload_at:]
            if kind == "revisit":
                said = headers.get("warc-payload-digest", "").rpartition(":")[2]
                length, payload = _number(http.get("content-length")), None
            else:
                said, length = digest(payload), len(payload)
            yield (
                headers.get("warc-record-id"),
                kind,
                headers.get("warc-refers-to"),
                headers.get("warc-target-uri"),
                headers.get("warc-date"),
                _number(http.get("x-number")),
                payload,
                length,
                said,
            )

    yield from _batches(rows(), _schema(WARC_RECORD))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record; a revisit has length and digest of the payload, not the payload."""
    return _lines(spark, path).mapInArrow(_read_warc, WARC_RECORD)


def archive_pages(captures: DataFrame) -> DataFrame:
    """Store (number, url, payload) in ARC files of both versions, convert them, read the WARCs.

    Returns the HTTP records as ``read_warc`` does. Even numbers go to version 1, odd and null ones
    to version 2. Each row gives one record; repeated rows are revisits of each other; an empty
    table gives archives without HTTP records.
    """
    spark = captures.sparkSession
    even = F.coalesce(F.col("number") % 2 == 0, F.lit(False))
    old, new, out = (new_path(spark, name) for name in ("arc-1", "arc-2", "warc"))
    write_arc(captures.where(even), old, 1)
    write_arc(captures.where(~even), new, 2)
    convert(read_arc(spark, old).union(read_arc(spark, new)), out)
    return read_warc(spark, out).where("record_type IN ('response', 'revisit')")
