import gzip

import pytest

from oddwire.llm import archives

V1 = (
    b"filedesc://a.arc 0.0.0.0 20020101000000 text/plain 76\n"
    b"1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n\n"
)
V2 = (
    b"filedesc://b.arc 0.0.0.0 20020101000000 text/plain 200 - - 0 b.arc 122\n2 0 X\n"
    b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
    b"Archive-length\n"
)
TRICK = b"http://fake/ 1.2.3.4 20200101000000 text/html 5\nWARC/1.0\r\n\xff\x00\n\n"


def v1(url, date, content, length=None):
    size = len(content) if length is None else length
    return f"{url} 1.2.3.4 {date} text/html {size}\n".encode() + content + b"\n"


def http(payload, number=""):
    return b"HTTP/1.0 200 OK\nX-Number: %s\nA: b\n\n" % str(number).encode() + payload


def store(path, name, data):
    path.mkdir(exist_ok=True)
    (path / f"{name}.arc.gz").write_bytes(gzip.compress(data))


def test_both_versions_by_declared_lengths(spark, tmp_path):
    old = tmp_path / "old"
    body2 = b"HTTP/1.1 200 OK\r\n\r\nzwei"
    head2 = b"http://two/ 4.3.2.1 20030405060708 text/html 200 - - 99 b.arc %d\n" % len(body2)
    length = V2.index(b"2 0 X")
    two = V2.replace(b"122", str(len(V2) - length).encode()) + b"\n" + head2 + body2 + b"\n"
    one = V1.rstrip(b"\n") + b"\n\n"
    store(
        old,
        "a",
        one
        + v1("http://with blank/x", "20020101000001", http(TRICK, 1))
        + v1("http://same/", "20020101000002", http(TRICK, 2))
        + v1("dns:x", "2002", b"")
        + v1("http://cut/", "20020101000003", b"HTTP/1.0 200 OK", 500),
    )
    store(old, "b", two)
    rows = {r.url: r for r in archives.read_arc(spark, str(old)).collect()}
    assert rows["http://with blank/x"].block == http(TRICK, 1)
    assert rows["http://with blank/x"].payload_digest == archives.digest(TRICK)
    assert (rows["http://two/"].date, rows["http://two/"].payload_bytes) == ("20030405060708", 4)
    assert rows["dns:x"].type == "resource" and rows["http://cut/"].truncated
    assert rows["filedesc://a.arc"].type == "warcinfo"
    out = str(tmp_path / "warc")
    archives.convert(archives.read_arc(spark, str(old)), out)
    made = {r.url: r for r in archives.read_warc(spark, out).collect()}
    assert made["http://same/"].payload == TRICK
    assert made["http://with blank/x"].record_type == "revisit"
    assert made["http://with blank/x"].refers_to == made["http://same/"].record_id
    assert made["http://two/"].date == "2003-04-05T06:07:08Z"
    assert made["dns:x"].date == "1970-01-01T00:00:00Z"
    assert len(archives.read_warc(spark, out).select("record_id").distinct().collect()) == 7


def test_pages_come_back(spark):
    pages = [
        (1, "http://a/", "x\r\n\r\nHTTP/1.1 200 OK\n"),
        (2, None, None),
        (3, "", ""),
        (4, "http://b c/", "é" * 40_000),
        (6, "http://d/", "x\r\n\r\nHTTP/1.1 200 OK\n"),
        (6, "http://d/", "x\r\n\r\nHTTP/1.1 200 OK\n"),
        (None, "u", "lone"),
        (8, "u", "\n"),
    ]
    frame = spark.createDataFrame(pages, "number long, url string, payload string").repartition(2)
    rows = archives.archive_pages(frame).collect()
    got = sorted(((r.number, r.payload_bytes, r.payload_digest) for r in rows), key=str)
    assert got == sorted(
        (
            (n, len((p or "").encode()), archives.digest((p or "").encode()))
            for n, _, p in pages
        ),
        key=str,
    )
    kinds = sorted(((r.number, r.record_type) for r in rows), key=str)
    assert [k for k in kinds if k[1] == "revisit"] == [(1, "revisit"), (2, "revisit"), (6, "revisit")]
    texts = {r.number: r.payload for r in rows if r.record_type == "response"}
    assert texts[4].decode() == "é" * 40_000 and texts[8] == b"\n"
    assert archives.archive_pages(frame.limit(0)).count() == 0


def test_broken_archives_are_named():
    with pytest.raises(ValueError, match="no ARC header"):
        list(archives.arc_records(iter([("f", b"nonsense")])))
    with pytest.raises(ValueError, match="inside a record"):
        list(archives.warc_records(iter([("f", b"WARC/1.0\r"), ("f", b"Content-Length: 9\r")])))
