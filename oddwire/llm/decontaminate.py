"""Benchmark passages in documents by greedy string tiling.

Seeds are the runs of ``min_match`` words of the benchmark. A document keeps only its stretches
of seeds: a match of at least that many words lies wholly inside one. A tile of L words holds
L - min_match + 1 seeds of the item, so a document and an item become a pair if the item's places
with a shared seed, ``min_match`` words each, could make up the coverage; seeds that an item
repeats count at each of their places. Each pair is tiled: the longest common stretches are marked
first, without overlap, found by running Karp-Rabin over word hashes with a falling length.
Tiles may lie in any order, so reordered passages count like whole ones. The share of an item's
words under tiles is its coverage.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddwire.llm import words
from oddwire.llm.members import bit_table, maybe_in, without
from oddwire.llm.shared import stored, with_row_key, written

MIN_MATCH = 5
MIN_COVERAGE = 0.6
#: First length the tiling looks for.
FIRST_LENGTH = 20
_BASE = 0x100000001B3
_MOD = (1 << 61) - 1


class _Rolling:
    """Karp-Rabin hashes of the unmarked stretches of a sequence."""

    def __init__(self, tokens: Sequence[int]):
        self.tokens = tokens
        self.marked = [False] * len(tokens)

    def stretches(self, length: int) -> Iterator[tuple[int, int]]:
        """(start, hash) of every stretch of that many unmarked tokens."""
        high = pow(_BASE, length - 1, _MOD)
        value, run = 0, 0
        for at, token in enumerate(self.tokens):
            if self.marked[at]:
                value = run = 0
                continue
            if run == length:
                value = (value - self.tokens[at - length] * high) % _MOD
                run -= 1
            value = (value * _BASE + token) % _MOD
            run += 1
            if run == length:
                yield at - length + 1, value


def tile(item: Sequence[int], text: Sequence[int], min_match: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (place in item, place in text, length), the longest marked first."""
    left, right = _Rolling(item), _Rolling(text)
    tiles: list[tuple[int, int, int]] = []
    length = max(FIRST_LENGTH, min_match)
    while True:
        matches, longest = _matches(left, right, length)
        if longest > 2 * length:
            length = longest
            continue
        found = bool(matches)
        heapq.heapify(matches)
        while matches:
            size, a, b = heapq.heappop(matches)
            size = -size
            taken = [m or n for m, n in zip(left.marked[a : a + size], right.marked[b : b + size])]
            if any(taken):
                # What is left of the match starts behind its last marked word.
                behind = size - taken[::-1].index(True)
                if size - behind >= length:
                    heapq.heappush(matches, (behind - size, a + behind, b + behind))
                continue
            left.marked[a : a + size] = right.marked[b : b + size] = [True] * size
            tiles.append((a, b, size))
        if length == min_match:
            if not found:
                return tiles
        else:
            length = max(length // 2, min_match)


def _matches(left: _Rolling, right: _Rolling, length: int):
    """Matches (-size, place in left, place in right) of at least that length, as long as they can
    be extended to either side, and the longest size."""
    places = defaultdict(list)
    for at, value in right.stretches(length):
        places[value].append(at)
    matches, longest = [], 0
    before, last = {}, -1
    for a, value in left.stretches(length):
        here = {}
        for b in places.get(value, ()):
            if a == last + 1 and b - 1 in before:
                here[b] = before[b - 1] - 1
                continue
            size = 0
            while (
                a + size < len(left.tokens)
                and b + size < len(right.tokens)
                and left.tokens[a + size] == right.tokens[b + size]
                and not left.marked[a + size]
                and not right.marked[b + size]
            ):
                size += 1
            if size >= length:
                here[b] = size
                matches.append((-size, a, b))
                longest = max(longest, size)
        before, last = here, a
    return matches, longest


def _item_words(min_match: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in words.raw_texts(batch.column("text")):
                text = words.lower(text)
                found.append(words.hashes(text, *words.spans(text)))
            runs = [np.unique(words.runs(h, min_match), return_counts=True) for h in found]
            seeds, places = ([r[k] for r in runs] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in ("item_key", "item_id")),
                    *map(_lists, (found, seeds, places)),
                ],
                ["item_key", "item_id", "item_words", "seeds", "places"],
            )

    return task


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(words.arrow(ends), words.arrow(flat.view(np.int64)))


def _regions(min_match: int, wanted):
    """Documents with seeds: their stretches of seeds, each ended by a zero, and the seeds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            rows, stretches, seeds = [], [], []
            for row, text in enumerate(words.raw_texts(batch.column("text"))):
                text = words.lower(text)
                hashes = words.hashes(text, *words.spans(text))
                runs = words.runs(hashes, min_match)
                hit = maybe_in(wanted.value, runs.view(np.int64))
                if not hit.any():
                    continue
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                parts = []
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    parts += [hashes[a : b + min_match - 1], np.zeros(1, np.uint64)]
                rows.append(row)
                stretches.append(np.concatenate(parts))
                seeds.append(np.unique(runs[hit]))
            taken = batch.take(words.arrow(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column("row_key"), taken.column("doc_id"), _lists(stretches), _lists(seeds)],
                ["row_key", "doc_id", "stretches", "seeds"],
            )

    return task


def _tiled(min_match: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, tiles = [], []
            for item, text in zip(batch.column("item_words"), batch.column("stretches")):
                found = tile(item.as_py(), text.as_py(), min_match)
                covered.append(sum(size for _, _, size in found))
                tiles.append(len(found))
            names = ["row_key", "doc_id", "item_id", "item_size"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in names]
                + [words.arrow(covered, pa.int64()), words.arrow(tiles, pa.int64())],
                [*names, "covered", "tiles"],
            )

    return task


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = MIN_MATCH,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """Pairs of a document and an item it contains: row_key, doc_id, item_id, item_words, covered,
    tiles, coverage.

    Words are lower-cased in A-Z. A pair is returned if tiles of at least ``min_match`` words cover
    ``min_coverage`` of the item. Null, empty and blank texts and items of fewer than ``min_match``
    words match nothing; repeated rows on either side each give their pairs. ``docs`` must give the
    same rows at each reading; other columns than doc_id, item_id and text are not looked at.
    """
    items = written(
        benchmark.select(
            F.monotonically_increasing_id().alias("item_key"),
            F.col("item_id").cast("long").alias("item_id"),
            "text",
        ).mapInArrow(
            _item_words(min_match),
            "item_key long, item_id long, item_words array<long>, seeds array<long>, "
            "places array<long>",
        ),
        "items",
    )
    seeds = items.select(
        F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("places"))),
        "item_key",
        F.size("item_words").alias("item_size"),
    )
    wanted = bit_table(seeds.select("seed"))
    docs = stored(docs)
    rows = with_row_key(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"])
    regions = written(
        rows.mapInArrow(
            _regions(min_match, wanted),
            "row_key long, doc_id long, stretches array<long>, seeds array<long>",
        ),
        "regions",
    )
    wanted.unpersist()
    shared = (
        regions.select("row_key", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .groupBy("row_key", "item_key", "item_size")
        .agg(F.sum("places").alias("places"))
    )
    enough = F.col("places") * min_match / F.col("item_size") >= min_coverage
    pairs = written(shared.where(enough).drop("places"), "seed-pairs")
    tiled = (
        pairs.join(regions.drop("seeds"), "row_key")
        .join(items.drop("seeds", "places"), "item_key")
        .mapInArrow(
            _tiled(min_match),
            "row_key long, doc_id long, item_id long, item_size int, covered long, tiles long",
        )
    )
    return tiled.withColumn("coverage", F.col("covered") / F.col("item_size")).where(
        F.col("coverage") >= min_coverage
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages, all columns; ``docs`` must be a stored table."""
    docs = stored(docs)
    return without(docs, contaminated(docs, benchmark))
