"""Assembled requests to request columns, with a check of every rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddwire.functions import http

# What makes a request malformed.
REASONS = {
    "request_line": "request line must contain exactly two spaces",
    "header_key": "header key must not be empty",
    "header_value": "header value must begin two characters after the colon",
    "parameter_key": "parameter key must not be empty",
}


def corrupt_reason(request_line: Column, header_lines: Column, query: Column) -> Column:
    """Name of the first broken rule, null for a well-formed request."""
    return (
        F.when(~http.has_two_spaces(F.coalesce(request_line, F.lit(""))), "request_line")
        .when(F.exists(header_lines, http.header_without_key), "header_key")
        .when(F.exists(header_lines, http.header_without_value), "header_value")
        .when(http.has_empty_parameter(query), "parameter_key")
    )


def parse_requests(assembled: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Request columns of assembled requests (``head`` and ``body_lines`` arrays).

    FAILFAST raises on a malformed request. PERMISSIVE keeps every row and names the broken
    rule in ``_corrupt_reason``; see ``well_formed`` and ``quarantined``.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode must be FAILFAST or PERMISSIVE, not {mode}")
    line = F.coalesce(F.get("head", F.lit(0)), F.lit(""))
    kept = [name for name in assembled.columns if name not in ("head", "body_lines")]
    split = assembled.select(
        *kept,
        http.method(line).alias("method"),
        http.uri(line).alias("uri"),
        http.standard(line).alias("standard"),
        line.alias("_line"),
        F.slice("head", 2, F.greatest(F.size("head"), F.lit(1))).alias("_header_lines"),
        F.array_join("body_lines", "\n").alias("body"),
    )
    located = split.withColumns(
        {"path": http.url_path(F.col("uri")), "query": http.url_query(F.col("uri"))}
    )
    checked = located.withColumn(
        "_corrupt_reason", corrupt_reason(F.col("_line"), F.col("_header_lines"), F.col("query"))
    )
    if mode == "FAILFAST":
        # A filter, because no use of the table can prune it away.
        message = F.concat(F.lit("malformed request, rule "), "_corrupt_reason", F.lit(": "), "_line")
        checked = checked.where(
            F.when(F.col("_corrupt_reason").isNull(), F.lit(True)).otherwise(
                F.raise_error(message).cast("boolean")
            )
        )
    parsed = checked.select(
        *kept,
        "method",
        "uri",
        "standard",
        "path",
        "query",
        http.parse_parameters(F.col("query")).alias("params"),
        http.parse_headers(F.col("_header_lines")).alias("headers"),
        "body",
        *(["_corrupt_reason"] if mode == "PERMISSIVE" else []),
    )
    return parsed


def well_formed(requests: DataFrame) -> DataFrame:
    """The requests of a PERMISSIVE load that can be used."""
    return requests.where(F.col("_corrupt_reason").isNull()).drop("_corrupt_reason")


def quarantined(requests: DataFrame) -> DataFrame:
    """The malformed requests of a PERMISSIVE load, with their reason."""
    return requests.where(F.col("_corrupt_reason").isNotNull())
