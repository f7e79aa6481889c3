import pytest
from pyspark.sql import functions as F

from oddwire import schema
from oddwire.functions import http


def evaluate(spark, function, value):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "uri, path, query",
    [
        ("http://h:8080/a/b.jsp?x=1&y=2#top", "/a/b.jsp", "x=1&y=2"),
        ("https://u:p@h/a", "/a", ""),
        ("http://h", "", ""),
        ("http://h?x=1/2", "", "x=1/2"),
        ("HTTP://h/a|b?c||d", "/a|b", "c||d"),
        ("http://[::1]:80/a?b?c", "/a", "b?c"),
        ("/relative/path?x=1", "", ""),
        ("gopher9://h/a", "", ""),
        ("http://h:port/a", "", ""),
        ("", "", ""),
    ],
)
def test_url_parts(spark, uri, path, query):
    assert evaluate(spark, http.url_path, uri) == path
    assert evaluate(spark, http.url_query, uri) == query


@pytest.mark.parametrize(
    "query, parameters",
    [
        ("", {}),
        ("&", {}),
        ("a=1&", {"a": "1"}),
        ("=x", {"=x": ""}),
        ("a", {"a": ""}),
        ("a=", {"a": ""}),
        ("a=b=c", {"a": "b=c"}),
        ("a=1&b=2&a=3", {"a": "3", "b": "2"}),
        ("a=1&a&a=2&b&a", {"a": "", "b": ""}),
    ],
)
def test_parameters(spark, query, parameters):
    assert evaluate(spark, http.parse_parameters, query) == parameters


@pytest.mark.parametrize("query, bad", [("a=1&&b=2", True), ("&a", True), ("a&", False), ("&&", False), ("", False)])
def test_empty_parameter(spark, query, bad):
    assert evaluate(spark, http.has_empty_parameter, query) is bad


def test_many_repeated_parameters(spark):
    query = "&".join(f"k{i % 500}={i}" for i in range(20_000))
    parsed = evaluate(spark, http.parse_parameters, query)
    assert parsed == {f"k{i % 500}": str(i) for i in range(20_000)}


def test_headers(spark):
    lines = ["A: 1", "B:x", "C: ", "no colon", "A: a:b", "D:"]
    frame = spark.createDataFrame([(lines,)], "l array<string>")
    parsed, bad_key, bad_value = frame.select(
        http.parse_headers(F.col("l")),
        F.exists("l", http.header_without_key),
        F.exists("l", http.header_without_value),
    ).first()
    assert parsed == {"A": "a:b", "B": "", "C": "", "no colon": "", "D": ""}
    assert bad_key is False and bad_value is True


def test_header_lookup(spark):
    headers = {"Accept": "text/html,b", "Empty": "", "Connection": "Keep-Alive"}
    frame = spark.createDataFrame([(headers,)], "h map<string,string>")
    h = F.col("h")
    row = frame.select(
        http.header_or_default(h, "Accept"), http.header_or_default(h, "Empty"),
        http.header_or_default(h, "accept"), http.is_persistent_connection(h),
        http.standard_header_count(h),
    ).first()
    assert tuple(row) == ("text/html", "", "no_content", 0, 2)


@pytest.mark.parametrize(
    "line, valid, parts",
    [
        ("GET http://h/a HTTP/1.1", True, ("GET", "http://h/a", "HTTP/1.1")),
        ("GET http://h/a b HTTP/1.1", False, None),
        ("GET", False, None),
        ("  ", False, None),
        ("GET  ", True, ("GET", "", "GET")),
        ("GET /x ", True, ("GET", "/x", "/x")),
        ("  HTTP/1.0", True, ("", "", "HTTP/1.0")),
    ],
)
def test_request_line(spark, line, valid, parts):
    assert evaluate(spark, http.has_two_spaces, line) is valid
    if valid:
        got = tuple(evaluate(spark, f, line) for f in (http.method, http.uri, http.standard))
        assert got == parts


@pytest.mark.parametrize(
    "path, extension, is_file, segments",
    [
        ("/a.b/c", "no_file_extension", 0, 2),
        ("/x.gif~", ".gif~", 1, 1),
        ("", "no_file_extension", 0, 0),
        ("/a/b.jsp.OLD", ".OLD", 1, 2),
        ("/a.", ".", 1, 1),
    ],
)
def test_path(spark, path, extension, is_file, segments):
    assert evaluate(spark, http.file_extension, path) == extension
    assert evaluate(spark, http.is_file, path) == is_file
    assert evaluate(spark, http.segment_count, path) == segments


def test_feature_schema():
    assert len(schema.FEATURES) == 270
    assert len(set(schema.FEATURE_COLUMNS)) == 270
    assert len(schema.NUMERIC_FEATURES) == 265
    assert len(schema.STANDARD_HEADERS) == 34
    assert "length_header_content_md5" in schema.FEATURE_COLUMNS
    assert schema.column_suffix("Content-MD5 é") == "content_md5__"
    assert len(schema.CONNECTIONS) == 42
    assert len(schema.ATTACK_CLASSES) == 22
