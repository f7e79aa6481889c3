"""Exact duplicates by Grace hashing over complete contents.

1. Each task keeps the first copy of a content and lets later copies in the same task point to
   it, so a content with a third of all rows leaves a task at most once for each filling of a
   small table. The result is written: these are the spill files of level 0.
2. First copies go to buckets by their hash. Buckets whose distinct contents do not fit the
   limit are partitioned again by further hash digits into spill files of the next level, until
   all fit or hold a single hash. Sizes are sums over hashes, so many copies do not count.
3. A task streams a bucket through an open-addressing table that compares complete contents.

Only first copies carry their content through the one shuffle of step 3.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddwire.llm import words
from oddwire.llm.members import without
from oddwire.llm.shared import stored, with_row_key, written

#: Deleted before texts are compared.
SEPARATORS = b" \t\n\x0b\x0c\r"
#: Distinct bytes of a bucket, and of the table of first copies in a task.
BUCKET_BYTES = 8 << 20
#: Parts of a bucket that does not fit.
FAN_OUT = 16

FIRST = (
    "row_key long, doc_id long, n_points long, text_sha256 string, hash long, "
    "first_key long, n_bytes long, content binary"
)


class ContentTable:
    """Open addressing with linear probing; entries are equal only if all their bytes are."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.mask = 1023
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.owners: list[int] = []
        self.bytes = 0

    def owner(self, hash_: int, content: bytes, owner: int) -> int:
        """Who put this content in first; from now on ``owner``, if nobody did."""
        at = hash_ & self.mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == hash_ and self.contents[entry] == content:
                return self.owners[entry]
            at = (at + 1) & self.mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(hash_)
        self.contents.append(content)
        self.owners.append(owner)
        self.bytes += len(content)
        if 2 * len(self.hashes) > self.mask:
            self._grow()
        return owner

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = array("q", [-1]) * (self.mask + 1)
        for entry, hash_ in enumerate(self.hashes):
            at = hash_ & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _first_copies(limit: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in words.slices(batches):
            rows: list[tuple] = []
            texts = words.raw_texts(batch.column("text"))
            for key, text in zip(batch.column("row_key").to_pylist(), texts):
                content = text.tobytes().translate(None, SEPARATORS)
                hash_ = xxhash.xxh3_64_intdigest(content)
                if table.bytes > limit:
                    table.clear()
                first = table.owner(hash_, content, key)
                rows.append(
                    (
                        int(np.count_nonzero((text & 0xC0) != 0x80)),
                        hashlib.sha256(content).hexdigest(),
                        _signed(hash_),
                        first,
                        len(content),
                        content if first == key else None,
                    )
                )
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id")]
                + [words.arrow(c, k) for c, k in zip(columns, kinds)],
                names=[field.split()[0] for field in FIRST.split(", ")],
            )

    return task


def _same_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bucket after bucket; a new bucket begins with an empty table."""
    table, bucket = ContentTable(), None
    for batch in batches:
        groups = []
        columns = (batch.column(k).to_pylist() for k in ("path", "hash", "first_key"))
        for path, hash_, key, content in zip(*columns, batch.column("content")):
            if path != bucket:
                table.clear()
                bucket = path
            groups.append(table.owner(hash_ & (2**64 - 1), content.as_py(), key))
        yield pa.RecordBatch.from_arrays(
            [batch.column("first_key"), words.arrow(groups, pa.int64())], ["first_key", "group_key"]
        )


def _oversized(records: DataFrame, limit: int) -> DataFrame:
    """Paths of the buckets with more than the limit in contents of different hashes."""
    by_hash = records.groupBy("path", "hash").agg(F.max("n_bytes").alias("n_bytes"))
    sizes = by_hash.groupBy("path").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    return sizes.where((F.col("b") > limit) & (F.col("n") > 1)).select("path")


def buckets(firsts: DataFrame, bucket_bytes: int, fan_out: int) -> DataFrame:
    """First copies with the path of a bucket that fits, partitioned as often as needed."""
    spark = firsts.sparkSession
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    count = max(-(-total // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = firsts.withColumn("path", F.pmod("hash", F.lit(count)).cast("string"))
    fitting, level = [], 0
    while not (over := _oversized(records, bucket_bytes)).isEmpty():
        level += 1
        over = written(over, "grace-oversized")
        fitting.append(records.join(over, "path", "left_anti"))
        digit = F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(fan_out)).cast("string")
        split = records.join(over, "path", "left_semi")
        records = written(
            split.withColumn("path", F.concat_ws(".", "path", digit)), f"grace-level-{level}"
        )
    for table in fitting:
        records = records.unionByName(table)
    return records


def exact_dedup(
    docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, fan_out: int = FAN_OUT
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and row_key).

    Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``; a null
    counts as empty, so null, empty and blank texts form one group. The longest original stays,
    then the smallest doc_id (null last), then the row read first: of repeated rows one is kept.
    Columns other than ``doc_id`` and ``text`` are not looked at; an empty table gives no rows.
    ``row_key`` is the place of the row in ``docs``, see ``with_row_key``.
    """
    docs = stored(docs)
    rows = with_row_key(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"])
    first = written(rows.mapInArrow(_first_copies(bucket_bytes), FIRST), "grace-level-0")
    contents = first.where(F.col("content").isNotNull()).select(
        "first_key", "hash", "n_bytes", "content"
    )
    bucketed = buckets(contents, bucket_bytes, fan_out).select(
        "path", "hash", "first_key", "content"
    )
    same = written(
        bucketed.repartition("path")
        .sortWithinPartitions("path")
        .mapInArrow(_same_content, "first_key long, group_key long"),
        "grace-groups",
    )
    choice = F.struct(
        (-F.col("n_points")).alias("shorter"),
        F.col("doc_id").isNull().alias("no_id"),
        "doc_id",
        "row_key",
    )
    in_task = first.groupBy("first_key").agg(
        F.min(choice).alias("choice"), F.count("*").alias("copies")
    )
    groups = (
        in_task.join(same, "first_key")
        .groupBy("group_key")
        .agg(F.min("choice").alias("choice"), F.sum("copies").alias("group_size"))
    )
    chosen = same.join(groups, "group_key").select("first_key", "choice", "group_size")
    return first.join(chosen, "first_key").select(
        "row_key",
        "doc_id",
        F.col("choice.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_key") == F.col("choice.row_key")).alias("kept"),
        "text_sha256",
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; ``docs`` must be a stored table."""
    docs = stored(docs)
    return without(docs, exact_dedup(docs).where("NOT kept"))
