"""A set of numbers as a bit table of fixed size that may hold too much but never too little.

Tasks use it to drop rows before a shuffle; an exact join follows. Its size is a parameter and
does not grow with the set: a fuller table lets more rows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddwire.llm import words
from oddwire.llm.shared import row_key, written

LOG2_BITS = 26
BLOCK = 1 << 18


def _cells(values: np.ndarray, log2_bits: int) -> np.ndarray:
    spread = words.mix(values.view(np.uint64) + np.uint64(0x51ED270B))
    return (spread >> np.uint64(64 - log2_bits)).astype(np.int64)


def _blocks(log2_bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block of bits once a batch, if any of its bits is set."""
        for batch in batches:
            used = np.unique(_cells(batch.column(0).to_numpy(), log2_bits))
            block = used // BLOCK
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            ends = np.concatenate([starts[1:], [len(used)]])
            places = (used % BLOCK).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    words.arrow(block[starts].astype(np.int32)) if len(used) else words.arrow([], pa.int32()),
                    words.arrow(
                        [places[a:b].tobytes() for a, b in zip(starts, ends)] if len(used) else [],
                        pa.binary(),
                    ),
                ],
                ["block", "places"],
            )

    return task


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, total = None, np.zeros(BLOCK, dtype=bool)

    def merged() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [words.arrow([current], pa.int32()), words.arrow([np.packbits(total).tobytes()], pa.binary())],
            ["block", "bits"],
        )

    for batch in batches:
        for block, places in zip(batch.column("block").to_pylist(), batch.column("places")):
            if block != current:
                if current is not None:
                    yield merged()
                current, total[:] = block, False
            total[np.frombuffer(places.as_py(), np.int32)] = True
    if current is not None:
        yield merged()


def bit_table(numbers: DataFrame, log2_bits: int = LOG2_BITS):
    """Broadcast table of the numbers in the first column (longs, none null)."""
    rows = (
        numbers.mapInArrow(_blocks(log2_bits), "block int, places binary")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_merge, "block int, bits binary")
        .toArrow()
    )
    bits = np.zeros((max((1 << log2_bits) // BLOCK, 1), BLOCK // 8), dtype=np.uint8)
    for block, row in zip(rows.column("block"), rows.column("bits")):
        bits[block.as_py()] = np.frombuffer(row.as_py(), np.uint8)
    return numbers.sparkSession.sparkContext.broadcast((log2_bits, bits.reshape(-1)))


def maybe_in(table: tuple[int, np.ndarray], values: np.ndarray) -> np.ndarray:
    """Whether each number may be in the set; false only if it is not."""
    log2_bits, bits = table
    cell = _cells(values, log2_bits)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


def _maybe(table, number: Column) -> Column:
    """Whether a number may be in the broadcast set; only the number goes to Python."""

    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        return words.arrow(maybe_in(table.value, values.to_numpy(zero_copy_only=False)))

    return test(number)


def only(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows whose ``name`` (a long) is among the ids; others are left out before the shuffle."""
    ids = written(ids.select(F.col(name).cast("long").alias(name)).dropna().distinct(), "ids")
    near = rows.where(_maybe(bit_table(ids), F.coalesce(F.col(name), F.lit(0))))
    return near.join(ids, name, "left_semi")


def split(rows: DataFrame, ids: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``name`` may be among the ids, and rows where it surely is not."""
    maybe = _maybe(bit_table(ids.select(name)), F.col(name))
    return rows.where(maybe), rows.where(~maybe)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a stored table but those whose place is in the ``row_key`` of ``dropped``.

    Rows that surely stay are not shuffled; the others are told apart by an exact join.
    """
    key = "__row_key"
    dropped = written(dropped.select(F.col("row_key").alias(key)).distinct(), "dropped")
    near, far = split(docs.withColumn(key, row_key(docs)), dropped, key)
    return far.unionByName(near.join(dropped, key, "left_anti")).drop(key)
