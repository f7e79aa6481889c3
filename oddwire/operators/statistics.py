"""Distinct-value statistics of a request table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddwire.functions import http

# The headers looked at and the names of their statistics.
HEADER_KINDS = {
    "MIME type": "Accept",
    "encoding": "Accept-Encoding",
    "charset": "Accept-Charset",
    "language": "Accept-Language",
    "content type": "Content-Type",
}
KINDS = ["path", "parameter", "header", "standard", *HEADER_KINDS]


def request_count(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("num_requests"))


def distinct_values(requests: DataFrame) -> DataFrame:
    """Every distinct value of every kind, with its number of occurrences.

    All kinds are taken in one pass. Values are counted before they are shuffled, and the
    shuffle is keyed by kind and value, so a value on a third of all requests is one row
    per task. The result stays a table: the list of all paths has no bound.
    """
    headers = F.col("headers")

    def one(kind: str, value) -> F.Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    def many(kind: str, keys) -> F.Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("value")))

    observed = F.concat(
        one("path", F.col("path")),
        many("parameter", F.map_keys("params")),
        many("header", F.map_keys(headers)),
        one("standard", F.col("standard")),
        *[one(kind, http.header_or_default(headers, name)) for kind, name in HEADER_KINDS.items()],
    )
    return (
        requests.select(F.inline(observed))
        .groupBy("kind", "value")
        .agg(F.count("*").alias("occurrences"))
    )


def distinct_counts(values: DataFrame) -> DataFrame:
    """Number of distinct values per kind; ``values`` holds each one once."""
    return values.groupBy("kind").agg(F.count("*").alias("num_unique"))


def sorted_values(values: DataFrame) -> DataFrame:
    """The distinct values in order, by kind."""
    return values.select("kind", "value").orderBy("kind", "value")


def basic_statistics(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct counts per kind, and the sorted distinct values."""
    values = distinct_values(requests)
    return distinct_counts(values), sorted_values(values)
