"""Written tables between the steps of an operator."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddwire.session import shared_folder


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT, _BATCH_BYTES = "67108864b", "4194304b"


def small_batches(spark: SparkSession) -> None:
    """Let 4 MB at most go to a Python worker at once, unless the session has a setting.

    Spark's own 64 MB are held by the JVM, off its heap, and by the worker, for every running task.
    """
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, _BATCH_BYTES)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(table: DataFrame, name: str) -> DataFrame:
    """Write a table and go on from the copy: lineage ends here and lost executors lose nothing."""
    spark = table.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _place(docs: DataFrame) -> tuple[Column, Column]:
    meta = docs.metadataColumn("_metadata")
    return meta["file_path"], meta["row_index"]


def stored(docs: DataFrame, name: str = "rows") -> DataFrame:
    """The table itself if its rows lie in Parquet files, else a written copy of it."""
    try:
        docs.select(*_place(docs))
    except AnalysisException:
        return written(docs, name)
    return docs


def row_key(docs: DataFrame) -> Column:
    """A number of each row of a stored table, the same whatever splits its files are read in.

    It is a hash of the file's path plus the row's index in the file. A file takes as many numbers
    as it has rows; the hash gets another seed until no two files share a number. The driver holds
    two numbers a file for this, the footers alone are read.
    """
    path, index = _place(docs)
    files = docs.select(path.alias("path"), index.alias("at")).groupBy("path")
    files = files.agg(F.max("at").alias("last"))

    def start(seed: int, path: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), path), 2)

    seeds = [F.array(*(start(seed, F.col("path")) for seed in range(8))).alias("starts")]
    found = files.select(*seeds, "last").toArrow()
    last = found.column("last").to_numpy()
    starts = np.array(found.column("starts").to_pylist(), dtype=np.int64).reshape(-1, 8)
    for seed in range(8):
        order = np.argsort(starts[:, seed])
        begin = starts[order, seed]
        if (begin[1:] > begin[:-1] + last[order][:-1]).all():
            return start(seed, path) + index
    raise ValueError("no hash tells the files apart")


def with_row_key(docs: DataFrame, columns: list, key: str = "row_key") -> DataFrame:
    """The columns and a key of each row that any later read of the same files computes again.

    Ids may repeat or be null, so rows are told apart by where they are stored, see ``row_key``.
    """
    return docs.select(row_key(docs).alias(key), *columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
