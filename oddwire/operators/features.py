"""Requests to the feature table: 270 flat columns per request.

Two projections: the first counts the character classes of every text (path, query, body,
and one array with the values of the 34 standard headers), the second is compiled arithmetic
on those counts. Nothing shuffles, and a selection of fewer feature columns drops the counts
it does not need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddwire.functions import http, text
from oddwire.schema import (
    FEATURES,
    STANDARD_HEADERS,
    header_columns,
    parameter_columns,
    ratio_columns,
)


def _text_fields(profile: str, part: str) -> dict[str, str]:
    """Column name to SQL: length and ratios of a text that is always there."""
    ratios = text.profile_ratios_sql(profile).values()
    return {f"length_{part}": f"{profile}.length", **dict(zip(ratio_columns(part), ratios))}


def _value_fields(profile: str, length: str, ratios: list[str]) -> dict[str, str]:
    """Column name to SQL: the columns of one key. Its "length" is its number of values:
    only the last one is kept, so 1, or 0 for an absent key, as are then the ratios."""
    return {
        length: f"if({profile} IS NULL, 0, 1)",
        **dict(zip(ratios, text.profile_ratios_sql(profile).values())),
    }


def _value_profiles_sql(container: str, keys: list[str]) -> str:
    """Array of the profiles of some keys of a map, null for a key the map lacks."""
    listed = ", ".join("'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'" for key in keys)
    return (
        f"transform(transform(array({listed}), key -> try_element_at({container}, key)), "
        f"value -> if(value IS NULL, NULL, {text.profile_sql('value')}))"
    )


def _select(table: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    return table.selectExpr(*keep, *[f"{sql} AS `{name}`" for name, sql in columns.items()])


def request_features(requests: DataFrame) -> DataFrame:
    """The feature table of a request table, in the fixed column order.

    An empty method, extension or content type becomes null, so the table is the same
    whether or not it went through a CSV file.
    """
    headers = F.col("headers")
    counted = requests.select(
        "id",
        "method",
        "path",
        "label",
        F.size("params").alias("num_parameters"),
        F.size(headers).alias("num_headers"),
        http.standard_header_count(headers).alias("_standard"),
        http.is_persistent_connection(headers).alias("is_persistent_connection"),
        http.header_or_default(headers, "Content-Type").alias("content_type"),
        http.file_extension(F.col("path")).alias("file_extension"),
        http.segment_count(F.col("path")).alias("num_segment"),
        http.is_file(F.col("path")).alias("is_file"),
        text.line_count(F.col("body")).alias("num_line"),
        text.word_gap_count(F.col("body")).alias("num_word"),
        text.profile("path").alias("_path"),
        text.profile("query").alias("_query"),
        text.profile("body").alias("_body"),
        F.expr(_value_profiles_sql("headers", STANDARD_HEADERS)).alias("_headers"),
    )
    columns = {
        **_text_fields("_path", "path"),
        **_text_fields("_query", "query"),
        **_text_fields("_body", "body"),
        "standard_headers_ratio": text.two_decimals_sql("_standard", "num_headers"),
        "non_standard_headers_ratio": text.two_decimals_sql(
            "(num_headers - _standard)", "num_headers"
        ),
    }
    for name in ("method", "file_extension", "content_type"):
        columns[name] = f"nullif({name}, '')"
    for i, name in enumerate(STANDARD_HEADERS):
        length, *ratios, is_standard = header_columns(name)
        columns.update(_value_fields(f"_headers[{i}]", length, ratios))
        columns[is_standard] = "1"
    return counted.selectExpr(
        *[
            f"cast({columns.get(f.name, f.name)} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in FEATURES
        ]
    )


def _request_keys(requests: DataFrame) -> list[str]:
    return [c for c in ("file", "request_no", "id") if c in requests.columns]


def parameter_features(requests: DataFrame) -> DataFrame:
    """Long form: one row per request and parameter with its number of values and ratios."""
    keys = _request_keys(requests)
    entries = requests.select(*keys, F.explode("params").alias("parameter", "value"))
    counted = entries.select(*keys, "parameter", text.profile("value").alias("_value"))
    columns = _value_fields("_value", "length_parameter", ratio_columns("parameter"))
    return _select(counted, columns, *keys, "parameter")


def header_features(requests: DataFrame) -> DataFrame:
    """Long form: one row per request and header, standard or not."""
    keys = _request_keys(requests)
    entries = requests.select(*keys, F.explode("headers").alias("header", "value"))
    counted = entries.select(*keys, "header", text.profile("value").alias("_value"))
    columns = _value_fields("_value", "length_header", ratio_columns("header"))
    features = _select(counted, columns, *keys, "header")
    return features.withColumn("is_standard_header", http.is_standard_header(F.col("header")))


def named_parameter_features(requests: DataFrame, parameters: list[str]) -> DataFrame:
    """Wide form for chosen parameters, named like the header columns; absent ones are 0."""
    keys = _request_keys(requests)
    counted = requests.select(*keys, F.expr(_value_profiles_sql("params", parameters)).alias("_params"))
    columns: dict[str, str] = {}
    for i, name in enumerate(parameters):
        length, *ratios = parameter_columns(name)
        columns.update(_value_fields(f"_params[{i}]", length, ratios))
    return _select(counted, columns, *keys)


def url_features(table: DataFrame, url: str, *keep: str) -> DataFrame:
    """The path and query columns of the feature table for any table with a URL column."""
    located = table.select(
        *keep, http.url_path(F.col(url)).alias("path"), http.url_query(F.col(url)).alias("query")
    )
    counted = located.select(
        *keep,
        "path",
        "query",
        http.segment_count(F.col("path")).alias("num_segment"),
        http.is_file(F.col("path")).alias("is_file"),
        http.file_extension(F.col("path")).alias("file_extension"),
        F.size(http.parse_parameters(F.col("query"))).alias("num_parameters"),
        text.profile("path").alias("_path"),
        text.profile("query").alias("_query"),
    )
    return _select(
        counted,
        {**_text_fields("_path", "path"), **_text_fields("_query", "query")},
        *keep, "path", "query", "num_segment", "is_file", "file_extension", "num_parameters",
    )


def text_features(table: DataFrame, column: str, *keep: str) -> DataFrame:
    """Length and the five ratios of any text column, named like the body columns."""
    counted = table.select(*keep, text.profile(column).alias("_text"))
    return _select(counted, _text_fields("_text", column), *keep)
