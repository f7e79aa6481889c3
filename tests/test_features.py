import pytest

from oddwire.operators import features, statistics
from oddwire.schema import FEATURE_COLUMNS, FEATURES
from oddwire.sources import tables
from oddwire.sources.traffic import read_requests, tag
from traffic_samples import request

LINES = request(
    "POST http://h:80/a/b.jsp?x=1&y=%20 HTTP/1.1",
    ["Host: h1", "X-Odd: ñ", "Accept: a,b", "Host: h2", "Connection: keep-alive", "Content-Type: text/x, y"],
    ["k=ñ1", "two"],
) + request("GET /relative HTTP/1.0", [])


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("features") / "a.txt"
    path.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return read_requests(spark, str(path), label="normal").cache()


def test_golden_rows(requests):
    table = features.request_features(requests)
    assert table.schema.fieldNames() == FEATURE_COLUMNS
    assert [f.dataType for f in table.schema] == [f.dataType for f in FEATURES]
    full, bare = [r.asDict() for r in table.orderBy("id").collect()]
    expected = {
        "id": 1, "method": "POST", "length_path": 8, "printable_characters_ratio_path": 1.0,
        "non_printable_characters_ratio_path": 0.0, "letter_ratio_path": 0.63, "digit_ratio_path": 0.0,
        "symbol_ratio_path": 0.38, "num_segment": 2, "is_file": 1, "file_extension": ".jsp",
        "num_parameters": 2, "length_query": 9, "letter_ratio_query": 0.22, "digit_ratio_query": 0.33,
        "symbol_ratio_query": 0.44, "num_headers": 5, "standard_headers_ratio": 0.8,
        "non_standard_headers_ratio": 0.2, "length_header_host": 1, "digit_ratio_header_host": 0.5,
        "letter_ratio_header_host": 0.5, "is_standard_header_host": 1, "length_header_accept": 1,
        "symbol_ratio_header_accept": 0.33, "length_header_cookie": 0, "letter_ratio_header_cookie": 0.0,
        "is_standard_header_cookie": 1, "is_persistent_connection": 1, "content_type": "text/x",
        "length_body": 8, "printable_characters_ratio_body": 0.75, "letter_ratio_body": 0.63,
        "non_printable_characters_ratio_body": 0.25, "digit_ratio_body": 0.13, "symbol_ratio_body": 0.0,
        "num_line": 2, "num_word": 3, "label": "normal",
    }
    assert {k: full[k] for k in expected} == expected
    assert (bare["id"], bare["method"], bare["length_path"], bare["num_headers"]) == (10, "GET", 0, 0)
    assert (bare["standard_headers_ratio"], bare["non_standard_headers_ratio"]) == (0.0, 0.0)
    assert (bare["num_line"], bare["num_word"], bare["content_type"]) == (1, 1, "no_content")


def test_csv_round_trip(spark, requests, tmp_path):
    table = features.request_features(requests)
    path = str(tmp_path / "train.csv")
    tables.write_features_csv(table, path)
    back = tables.read_features_csv(spark, path)
    assert back.exceptAll(table).count() == 0 and table.exceptAll(back).count() == 0
    text = spark.read.text(path).orderBy("value").first()[0]
    assert text.startswith("1,POST,8,1.00,0.00,0.63,0.00,0.38,2,1,.jsp,2,9,")
    assert len(text.split(",")) == 270
    with pytest.raises(ValueError):
        tables.read_features_csv(spark, str(tmp_path / "train.parquet"))


def test_empty_category_becomes_null(spark, tmp_path):
    lines = request(" http://h/a HTTP/1.1", ["Content-Type: ,x"])
    path = tmp_path / "a.txt"
    path.write_text("\n".join(lines) + "\n")
    row = features.request_features(read_requests(spark, str(path))).first()
    assert row["method"] is None and row["content_type"] is None


def test_column_names(spark, tmp_path):
    tables.write_column_names(spark, str(tmp_path / "names"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "names")).collect()] == FEATURE_COLUMNS


def test_unused_columns_are_not_counted(requests):
    plan = (
        features.request_features(requests).select("length_path")._jdf.queryExecution().optimizedPlan().toString()
    )
    assert "try_element_at" not in plan and "body" not in plan.split("InMemoryRelation")[0]


def test_long_features(requests):
    parameters = {r["parameter"]: r for r in features.parameter_features(requests).collect()}
    assert set(parameters) == {"x", "y"}
    assert parameters["y"]["symbol_ratio_parameter"] == 0.33
    headers = {r["header"]: r for r in features.header_features(requests).collect()}
    assert headers["X-Odd"]["is_standard_header"] == 0 and headers["Host"]["is_standard_header"] == 1
    assert headers["X-Odd"]["symbol_ratio_header"] == -1.0
    named = features.named_parameter_features(requests, ["x", "it's"]).orderBy("id").collect()
    assert [r["length_parameter_x"] for r in named] == [1, 0]
    assert [r["length_parameter_it_s"] for r in named] == [0, 0]


def test_basic_statistics(spark, requests):
    counts, values = statistics.basic_statistics(requests)
    counted = {r["kind"]: r["num_unique"] for r in counts.collect()}
    assert counted == {
        "path": 2, "parameter": 2, "header": 5, "standard": 2, "MIME type": 2, "encoding": 1,
        "charset": 1, "language": 1, "content type": 2,
    }
    listed = [tuple(r) for r in values.collect()]
    assert listed == sorted(listed)
    assert ("MIME type", "a") in listed and ("path", "") in listed
    assert statistics.request_count(requests).first()[0] == 2


def test_tag(spark):
    assert tag(spark.range(2), "anomaly").select("label").distinct().collect()[0][0] == "anomaly"


def test_rename(spark):
    assert tables.rename_columns(spark.createDataFrame([(1, 2)], "_c0 int, _c1 int"), ["a", "b"]).columns == ["a", "b"]
