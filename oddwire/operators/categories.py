"""Categories as numbers: rank by frequency, for columns of any number of values.

The ranks of all columns are one stored table (column, value, index, count). Values are sorted
by range partitions; a rank is the place in the partition plus the sizes of the partitions
before it, so no list of values is ever on the driver or in the metadata of a column. Rows meet
their ranks in a join, which spreads a value with a large part of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddwire.session import materialise

#: What happens to rows whose category is null or unknown.
HANDLE_INVALID = ("skip", "error", "keep")


def value_counts(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count) of all values but nulls."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    long = table.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*")
    return long.dropna(subset=["value"]).groupBy("column", "value").agg(F.count("*").alias("count"))


def category_index(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, index, count): index from 0 by falling count, ties in order of value."""
    counts = materialise(value_counts(table, columns))
    order = ["column", F.desc("count"), "value"]
    sorted_ = materialise(
        counts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "*",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    earlier = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_.groupBy("column", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    offsets = parts.select(
        "column", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    index = sorted_.join(offsets, ["column", "part"]).select(
        "column", "value", (F.col("place") + F.col("shift")).alias("index"), "count"
    )
    return materialise(index)


def widths(index: DataFrame) -> dict[str, int]:
    """Number of values of each column."""
    return {r["column"]: r["n"] for r in index.groupBy("column").agg(F.count("*").alias("n")).collect()}


def with_category_index(
    table: DataFrame,
    index: DataFrame,
    columns: Sequence[str],
    handle_invalid: str = "skip",
    also: Sequence[str] = (),
) -> DataFrame:
    """Add ``<column>_index``, and ``<column>_<name>`` for every further name of the index.

    Rows with a null or unknown category go (skip), end the job (error) or have nulls (keep).
    Stored ranks are sent to the rows if there are few, else both are shuffled by value and
    adaptive execution splits the values that most rows have.
    """
    if handle_invalid not in HANDLE_INVALID:
        raise ValueError(f"handle_invalid must be one of {HANDLE_INVALID}, not {handle_invalid}")
    for column in columns:
        names = ["index", *also]
        own = index.where(F.col("column") == column).select(
            F.col("value").alias(f"_{column}_value"), *[F.col(n).alias(f"{column}_{n}") for n in names]
        )
        same = F.col(column).cast("string") == F.col(f"_{column}_value")
        how = "inner" if handle_invalid == "skip" else "left"
        table = table.join(own, same, how).drop(f"_{column}_value")
        if handle_invalid == "error":
            message = F.concat(F.lit(f"unknown category of {column}: "), F.coalesce(column, F.lit("null")))
            known = F.coalesce(f"{column}_index", F.raise_error(message).cast("long"))
            table = table.withColumn(f"{column}_index", known)
    return table


def sparse_layout(size: Column, entries: Column) -> Column:
    """What a sparse vector is made of, from an array of structs (i, x) sorted by i without its
    zeros; see ``as_vectors``."""
    used = F.filter(entries, lambda e: e["x"] != 0)
    return F.struct(
        F.lit(0).cast("byte").alias("type"),
        size.cast("int").alias("size"),
        F.transform(used, lambda e: e["i"].cast("int")).alias("indices"),
        F.transform(used, lambda e: e["x"]).alias("values"),
    )


def as_vectors(table: DataFrame, *names: str) -> DataFrame:
    """The table with its columns of layouts as vectors, without attributes in their metadata.

    SQL makes no sparse vectors, but their type is stored as its layout: a table is written and
    read back with the type. A stream, which cannot be written here, takes the longer way over
    the text form of the layout.
    """
    if table.isStreaming:
        for name in names:
            kind = T.StructType([T.StructField("v", VectorUDT())])
            text = F.to_json(F.struct(F.col(name).alias("v")))
            table = table.withColumn(name, F.from_json(text, kind)["v"])
        return table
    stored = materialise(table)
    fields = [T.StructField(f.name, VectorUDT()) if f.name in names else f for f in table.schema]
    return table.sparkSession.read.schema(T.StructType(fields)).parquet(*stored.inputFiles())


def one_hot_entry(index: Column, width: int, value: Column, offset: int = 0) -> Column:
    """(i, x) of a category among ``width`` elements; beyond them, and for a null, x is zero."""
    inside = F.coalesce(index < width, F.lit(False))
    return F.struct(
        F.when(inside, index + offset).otherwise(F.lit(offset)).cast("long").alias("i"),
        F.when(inside, value).otherwise(F.lit(0.0)).alias("x"),
    )


def one_hot(index: Column, width: int) -> Column:
    """Layout of an indicator vector; the category of rank ``width`` and nulls have none."""
    return sparse_layout(F.lit(width), F.array(one_hot_entry(index, width, F.lit(1.0))))


def all_known(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))
