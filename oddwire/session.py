"""Where intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables, in ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; a cluster must name one,
    since a folder of one machine is gone with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="oddwire-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(table: DataFrame) -> DataFrame:
    """Write a table once and go on from the written copy.

    Cuts the lineage before iterative or repeated use. A Parquet table, unlike a cache,
    survives lost executors and can be read column by column.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
