"""Traffic text files as a table of lines, and as requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddwire.operators.assemble import assemble_requests, assign_ids
from oddwire.operators.parse import parse_requests

#: Lines of a split, at most; a file that cannot be split by bytes is cut by them.
SPLIT_LINES = 1 << 18
_LEAST_PARTITIONS = "spark.sql.files.minPartitionNum"


def named_line(name: Column, line: Column) -> Column:
    """A line of a file that holds several logs: the log's name as in a URL, a tab, the line."""
    return F.concat(F.url_encode(name), F.lit("\t"), line)


def log_name(file: Column) -> Column:
    """Name of the log, from the column ``file`` of lines or requests read with their names."""
    return F.url_decode(F.substring_index(file, "#", -1))


def read_lines(
    spark: SparkSession, *paths: str, split_lines: int = SPLIT_LINES, named: bool = False
) -> DataFrame:
    """One row per line: (file, split, seq, value).

    ``split`` says where the block of the line begins in its file, and which stretch of about
    ``split_lines`` lines of it the line is in, so that a compressed file, which is one block, is
    cut as well. ``seq`` counts the lines of a block without gaps; where it begins is told by the
    counts per split, and a line that does not fit them ends the job.

    Blocks follow ``spark.sql.files.maxPartitionBytes`` and the number of cores. The latter may
    change while a job runs, so it is fixed for the session at the first call, unless
    ``spark.sql.files.minPartitionNum`` is set.

    With ``named`` a file may hold any number of logs, one behind the other, each line as
    ``named_line`` makes it. Each log then counts as a file, called by the path, ``#`` and the
    encoded name; a line without a name ends the job. Opening a file costs more than reading a
    small one, so many small logs belong into few files.
    """
    if spark.conf.get(_LEAST_PARTITIONS, None) is None:
        spark.conf.set(_LEAST_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    in_task = F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    stretch = F.floor(in_task / split_lines)
    file, value = F.col("_metadata.file_path"), F.col("value")
    if named:
        tab = F.instr("value", "\t")
        message = F.concat(F.lit("line without the name of its log in "), file)
        tab = F.when(tab > 0, tab).otherwise(F.raise_error(message).cast("int"))
        file = F.concat(file, F.lit("#"), F.substring(value, F.lit(1), tab - 1))
        value = F.substr(value, tab + 1)
    lines = spark.read.text(list(paths)).select(
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        value.alias("value"),
    )
    return lines.select("file", (F.shiftleft("block", 20) + stretch).alias("split"), "seq", "value")


def read_requests(
    spark: SparkSession,
    *paths: str,
    label: str = "",
    mode: str = "FAILFAST",
    split_lines: int = SPLIT_LINES,
    named: bool = False,
) -> DataFrame:
    """Requests of traffic files, every one tagged with the same label.

    ``mode`` works like that of the Spark readers: FAILFAST ends the job at the first
    malformed request, PERMISSIVE keeps it with its reason in ``_corrupt_reason``.
    """
    assembled = assemble_requests(read_lines(spark, *paths, split_lines=split_lines, named=named))
    return tag(assign_ids(parse_requests(assembled, mode=mode)), label)


def tag(requests: DataFrame, label: str) -> DataFrame:
    """Set the label of a whole set."""
    return requests.withColumn("label", F.lit(label))


def union_sets(*sets: DataFrame) -> DataFrame:
    """Bag union of labelled sets: nothing is deduplicated, ids repeat between files."""
    combined, *others = sets
    for other in others:
        combined = combined.unionByName(other)
    return combined
