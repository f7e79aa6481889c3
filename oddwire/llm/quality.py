"""Document quality by a factorisation machine.

A document is its distinct hashed words, binned statistics of its structure, and its metadata: the
binned length ``n_chars`` that the table states, with a bin of its own where it is null, negative or
not a column of the table. The score is ``sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))``: all
pairwise interactions of low rank, in time linear in the features.

The machine is fitted on at most ``SAMPLE_ROWS`` labelled rows, taken by a hash of their id; this
bound is all that reaches the driver. Every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddwire.llm import words

#: Labelled rows the fit reads at most.
SAMPLE_ROWS = 8000
WORD_BUCKETS = 1 << 16
#: Weight of the binned statistics against all words together, whose squares sum to one.
STATISTIC_VALUE = 0.5
BINS = 16
RANK = 8
EPOCHS = 12
BATCH = 64
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _WIDE = range(6)
_CLASS = np.full(256, _MARK)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _WIDE
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASSES = np.eye(6, dtype=np.int64)[_CLASS]


def statistics(text: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 that describe the structure of a text."""
    size, count = max(len(text), 1), max(len(hashes), 1)
    bytes_ = np.bincount(text, minlength=256)
    kinds = bytes_ @ _CLASSES
    lines = text.tobytes().split(b"\n")
    pairs = words.runs(hashes, 2)
    letters = max(kinds[_UPPER] + kinds[_LOWER] + kinds[_WIDE], 1)
    ends = bytes_[[33, 46, 63]].sum()
    return np.array(
        [
            kinds[_UPPER] / letters,
            kinds[_DIGIT] / size,
            4 * kinds[_MARK] / size,
            kinds[_WIDE] / size,
            kinds[_SPACE] / size,
            len(np.unique(hashes)) / count,
            len(np.unique(pairs)) / max(len(pairs), 1),
            len(set(lines)) / len(lines),
            np.log2(size) / 24,
            np.log2(count) / 20,
            (lengths.mean() if len(lengths) else 0) / 20,
            (lengths.std() if len(lengths) else 0) / 20,
            (lengths.max() if len(lengths) else 0) / 40,
            4 * ends / count,
            bytes_.max() / size,
            len(lines) / count,
        ]
    )


N_STATISTICS = 16
#: First feature of the stated length; the last of its bins stands for none.
STATED = WORD_BUCKETS + N_STATISTICS * BINS
N_FEATURES = STATED + BINS + 1


def stated_length(docs: DataFrame) -> Column:
    """``n_chars`` as a whole number; null if it is missing, negative or no number."""
    kinds = {field.name.lower(): field.dataType for field in docs.schema}
    if not isinstance(kinds.get("n_chars"), (T.NumericType, T.StringType)):
        return F.lit(None).cast("long")
    length = F.col("n_chars").try_cast("long")
    return F.when(length >= 0, length)


def features(text: np.ndarray, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their values; a text without words has statistics and length alone."""
    starts, ends = words.spans(text)
    hashes = words.hashes(text, starts, ends)
    lower = words.lower(text)
    buckets, counts = np.unique(
        (words.hashes(lower, starts, ends) & np.uint64(WORD_BUCKETS - 1)).astype(np.int64),
        return_counts=True,
    )
    weight = np.log1p(counts)
    weight /= max(np.sqrt((weight**2).sum()), 1e-9)
    bins = statistics(text, hashes, ends - starts)
    bins = np.clip((bins * BINS).astype(np.int64), 0, BINS - 1)
    own = WORD_BUCKETS + np.arange(N_STATISTICS) * BINS + bins
    length = BINS if n_chars is None else min(int(np.log2(1 + n_chars) / 24 * BINS), BINS - 1)
    values = np.concatenate([weight, np.full(N_STATISTICS + 1, STATISTIC_VALUE)])
    return np.concatenate([buckets, own, [STATED + length]]).astype(np.int32), values.astype(np.float32)


@dataclass
class Machine:
    """Weights of a fitted factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, index: np.ndarray, value: np.ndarray, first: np.ndarray):
        """Margin of each row and the factor sums that its gradient needs."""
        rows = self.factors[index] * value[:, None]
        sums = np.add.reduceat(rows, first, axis=0)
        squares = np.add.reduceat((rows**2).sum(axis=1), first)
        linear = np.add.reduceat(self.linear[index] * value, first)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(self.margins(index, value, first)[0])


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """AdaGrad on the logistic loss with decay; without rows every score is one half."""
    draw = np.random.default_rng(7)
    machine = Machine(
        0.0,
        np.zeros(N_FEATURES, np.float32),
        draw.normal(0, 0.02, (N_FEATURES, RANK)).astype(np.float32),
    )
    if not rows:
        return machine
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    machine.bias = float(np.log(share / (1 - share)))
    seen_linear = np.full(N_FEATURES, 1e-6, np.float32)
    seen_factors = np.full((N_FEATURES, RANK), 1e-6, np.float32)
    for epoch in range(EPOCHS):
        rate = 0.1 / (1 + 0.3 * epoch)
        for chosen in np.array_split(draw.permutation(len(rows)), -(-len(rows) // BATCH)):
            index = np.concatenate([rows[k][0] for k in chosen])
            value = np.concatenate([rows[k][1] for k in chosen])
            lengths = np.array([len(rows[k][0]) for k in chosen])
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            margin, sums = machine.margins(index, value, first)
            error = ((sigmoid(margin) - labels[chosen]) / len(chosen)).astype(np.float32)
            machine.bias -= rate * float(error.sum())
            slope = np.repeat(error, lengths) * value
            used, place = np.unique(index, return_inverse=True)
            step = np.bincount(place, slope, len(used)).astype(np.float32)
            step += 1e-5 * machine.linear[used]
            seen_linear[used] += step**2
            machine.linear[used] -= rate * step / np.sqrt(seen_linear[used])
            inner = np.repeat(sums, lengths, axis=0) - machine.factors[index] * value[:, None]
            pull = slope[:, None] * inner
            step = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(RANK)], 1)
            step = step.astype(np.float32) + 1e-4 * machine.factors[used]
            seen_factors[used] += step**2
            machine.factors[used] -= 0.3 * rate * step / np.sqrt(seen_factors[used])
    return machine


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels the fit must not see; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches):
        texts = words.raw_texts(batch.column("text"))
        found = [features(*row) for row in zip(texts, batch.column("length").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("quality"),
                words.arrow([i.tobytes() for i, _ in found], pa.binary()),
                words.arrow([v.tobytes() for _, v in found], pa.binary()),
            ],
            ["quality", "index", "value"],
        )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most ``sample_rows`` labelled ids outside the held-out fold.

    Labels without id or quality are left out; of contradictory labels of an id the higher counts,
    of several rows of an id the one with the least hash of its text, then text and length.
    """
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    row = F.struct(F.xxhash64("text").alias("hash"), "text", "length")
    rows = (
        docs.select("doc_id", "text", stated_length(docs).alias("length"))
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min(row).alias("row"))
        .select("quality", "row.text", "row.length")
        .mapInArrow(_feature_rows, "quality int, index binary, value binary")
        .toArrow()
    )
    pairs = [
        (np.frombuffer(i.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32))
        for i, v in zip(rows.column("index"), rows.column("value"))
    ]
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0].tobytes(), pairs[k][1].tobytes()))
    known = np.array(rows.column("quality").to_pylist(), dtype=np.float32)
    return fit([pairs[k] for k in order], known[order])


def score(
    docs: DataFrame,
    machine: Machine,
    threshold: float = THRESHOLD,
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """All columns of the documents with score and prediction, under the given names.

    Null, empty and blank texts are scored by their statistics and stated length. Columns of these
    two names are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop(*names)
    kept, stated = docs.schema.fields, "stated"
    while stated in [field.name.lower() for field in kept]:
        stated += "_"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            scores = []
            texts = words.raw_texts(batch.column("text"))
            for index, value in map(features, texts, batch.column(stated).to_pylist()):
                scores.append(model.value.scores(index, value, np.zeros(1, np.int64))[0])
            table = batch.drop_columns([stated])
            table = table.append_column(names[0], words.arrow(scores, pa.float64()))
            yes = words.arrow([int(s >= threshold) for s in scores], pa.int32())
            yield table.append_column(names[1], yes)

    added = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    docs = docs.withColumn(stated, stated_length(docs))
    return docs.mapInArrow(task, T.StructType([*kept, *added]))
