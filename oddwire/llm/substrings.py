"""Removal of word passages that occur more than once, behind a count-min prefilter.

Pass 1 sketches how often windows of ``size`` words may occur. The sketch counts a window by its
anchor, the smallest hash among its runs of a third as many words: two equal windows have equal anchors at
different places, so an anchor's count is never below a window's, and there are only about three
anchors in each window length. Tasks send their non-zero cells; merged cells are kept as one bit,
"two or more", so the sketch that reaches every task has a fixed size whatever the input is.

Pass 2 groups exactly (by 95-bit hashes of their word sequences) only windows whose anchor the
sketch estimates at two or more. The sketch never underestimates, so no repeated window is lost;
where it is too small for the input it only lets more windows through to the exact pass.
Only documents that lose words are shuffled with their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddwire.llm import words
from oddwire.llm.members import split
from oddwire.llm.shared import stored, with_row_key, written

WINDOW = 35
DEPTH = 3
#: Cells in each of the sketch's rows; one bit of each is sent to the tasks.
LOG2_CELLS = 25
BLOCK = 1 << 16
#: Anchors a task gathers before it sends its cells.
FLUSH = 250_000

_ROWS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _sliding(values: np.ndarray, size: int, choose) -> np.ndarray:
    """Least or greatest of every ``size`` consecutive values, by doubling."""
    reach = 1
    while 2 * reach <= size:
        values = choose(values[:-reach], values[reach:])
        reach *= 2
    rest = size - reach
    return choose(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the anchors at all places where some window has its own."""
    run = max(size // 3, 1)
    grams = words.runs(hashes, run)
    width = size - run + 1
    if len(grams) < width:
        return grams[:0], grams[:0]
    least = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    cover = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return least, grams[grams == cover]


def cells(values: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    return (words.mix(values * _ROWS[row]) >> np.uint64(64 - log2_cells)).astype(np.int64)


def _sketch(size: int, log2_cells: int):
    blocks = max((1 << log2_cells) // BLOCK, 1)

    def send(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate(found)
        for row in range(DEPTH):
            used, counts = np.unique(cells(values, row, log2_cells), return_counts=True)
            block = used // BLOCK
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            ends = np.concatenate([starts[1:], [len(used)]])
            places = (used % BLOCK).astype(np.uint16)
            several = np.minimum(counts, 2).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    words.arrow((row * blocks + block[starts]).astype(np.int32)),
                    words.arrow([places[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    words.arrow([several[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ],
                ["block", "places", "counts"],
            )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], 0
        for batch in words.slices(batches):
            for text in words.raw_texts(batch.column("text")):
                own = anchors(words.hashes(text, *words.spans(text)), size)[1]
                if len(own):
                    found.append(own)
                    count += len(own)
                if count > FLUSH:
                    yield from send(found)
                    found, count = [], 0
        if found:
            yield from send(found)

    return task


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive in order; the sum of a block is held alone, however many tasks sent it."""
    current, total = None, np.zeros(BLOCK, dtype=np.uint8)

    def merged() -> pa.RecordBatch:
        bits = np.packbits(total >= 2).tobytes()
        return pa.RecordBatch.from_arrays(
            [words.arrow([current], pa.int32()), words.arrow([bits], pa.binary())], ["block", "bits"]
        )

    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in ("block", "places", "counts"))
        for block, places, counts in zip(*columns):
            if block != current:
                if current is not None:
                    yield merged()
                current, total[:] = block, 0
            at = np.frombuffer(places, np.uint16)
            total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
    if current is not None:
        yield merged()


def sketch(docs: DataFrame, size: int, log2_cells: int) -> np.ndarray:
    """One bit for each cell of each row: whether two or more anchors fell into it."""
    rows = (
        docs.select("text")
        .mapInArrow(_sketch(size, log2_cells), "block int, places binary, counts binary")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_merge, "block int, bits binary")
        .toArrow()
    )
    blocks = max((1 << log2_cells) // BLOCK, 1)
    bits = np.zeros((DEPTH * blocks, BLOCK // 8), dtype=np.uint8)
    for block, row in zip(rows.column("block"), rows.column("bits")):
        bits[block.as_py()] = np.frombuffer(row.as_py(), np.uint8)
    return bits.reshape(DEPTH, -1)


def _candidates(size: int, log2_cells: int, shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in words.slices(batches):
            texts = words.raw_texts(batch.column("text"))
            for key, text in zip(batch.column("row_key").to_pylist(), texts):
                hashes = words.hashes(text, *words.spans(text))
                least, _ = anchors(hashes, size)
                maybe = np.arange(len(least))
                for row in range(DEPTH):
                    cell = cells(least[maybe], row, log2_cells)
                    byte = bits[row][cell >> 3]
                    maybe = maybe[(byte >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1]
                if len(maybe):
                    second = words.runs(hashes, size, 1)[maybe] >> np.uint64(33)
                    yield pa.RecordBatch.from_arrays(
                        [
                            words.arrow(words.runs(hashes, size)[maybe].view(np.int64)),
                            words.arrow(second.astype(np.int32)),
                            words.arrow(np.full(len(maybe), key)),
                            words.arrow(maybe.astype(np.int32)),
                        ],
                        ["h1", "h2", "row_key", "at"],
                    )

    return task


def _batched(task, rows: int = 200_000):
    """Join the small batches of a task into larger ones."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in task(batches):
            waiting.append(batch)
            count += len(batch)
            if count >= rows:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, count = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return joined


def _keep(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            n_words, n_removed, kept = [], [], []
            starts = batch.column("starts")
            texts = words.raw_texts(batch.column("text"))
            for row, text in enumerate(texts):
                all_words = text.tobytes().split()
                n_words.append(len(all_words))
                removed = 0
                if starts[row].is_valid and len(at := starts[row].values.to_numpy()):
                    change = np.zeros(len(all_words) + 1, dtype=np.int32)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + size, -1)
                    stays = np.cumsum(change[:-1]) == 0
                    removed = len(all_words) - int(stays.sum())
                    all_words = list(compress(all_words, stays.tolist()))
                n_removed.append(removed)
                kept.append(b" ".join(all_words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_key"),
                    batch.column("doc_id"),
                    words.arrow(n_words, pa.int64()),
                    words.arrow(n_removed, pa.int64()),
                    words.arrow(kept, pa.binary()).cast(pa.string()),
                ],
                ["row_key", "doc_id", "n_words", "n_removed", "kept_text"],
            )

    return task


def remove_repeats(
    docs: DataFrame, size: int = WINDOW, log2_cells: int = LOG2_CELLS
) -> DataFrame:
    """One row per document: row_key, doc_id, n_words, n_removed, kept_text.

    Words are taken unchanged. A word goes if any window of ``size`` words that covers it has the
    same word sequence as another window, of the same document or of any other; repeated rows are
    documents like any other. The kept words are joined by one space. Null, empty and blank texts
    have no words; documents shorter than a window keep all. ``docs`` must give the same rows at
    each reading (see ``with_row_key``); columns other than doc_id and text are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, size, log2_cells))
    docs = stored(docs)
    rows = with_row_key(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"])
    windows = rows.select("row_key", "text").mapInArrow(
        _batched(_candidates(size, log2_cells, shared)), "h1 long, h2 int, row_key long, at int"
    )
    repeated = windows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    starts = written(
        windows.join(repeated, ["h1", "h2"])
        .groupBy("row_key")
        .agg(F.collect_list("at").alias("starts")),
        "starts",
    )
    shared.unpersist()
    near, far = split(rows, starts, "row_key")
    far = far.withColumn("starts", F.lit(None).cast("array<int>"))
    return near.join(starts, "row_key", "left").unionByName(far).mapInArrow(
        _keep(size),
        "row_key long, doc_id long, n_words long, n_removed long, kept_text string",
    )
