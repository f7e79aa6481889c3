"""Languages of a document as a mixture, by expectation maximisation.

Training counts byte 4-grams by language. A word of a document is drawn from one language with
the product of its n-grams' probabilities there; the document's language proportions maximise the
likelihood of its words. Of the nested sets of its 1, 2, ... most likely languages a document
keeps the one with the best likelihood less ``log(words) / 2`` for each further language. A set
is left untried only if no mixture at all could make up for its penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddwire.llm import words
from oddwire.llm.quality import held_out

BUCKETS = 1 << 16
#: Added to every count.
SMOOTHING = 0.5
#: A document's mixture is done once no other can exceed its log likelihood by more than the first,
#: or a round adds less than the second.
GAP, GAIN = 1e-4, 1e-6
#: Bytes of text whose n-grams are looked up at once; documents are cut at words only.
CHUNK_BYTES = 1 << 19
#: Words whose mixtures are fitted at once.
CHUNK_WORDS = 200_000
UNKNOWN = "und"

_PRIMES = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)


def gram_buckets(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One bucket for each byte of a word: the byte before it, itself and the next two."""
    padded = np.full(len(text) + 3, 32, dtype=np.uint32)
    padded[1:-2] = words.lower(text)
    padded[(padded >= 9) & (padded <= 13)] = 32
    hash_ = np.zeros(len(text), dtype=np.uint32)
    for k in range(4):
        hash_ += padded[k : k + len(text)] * _PRIMES[k]
        hash_ ^= hash_ >> np.uint32(15)
    inside = np.zeros(len(text) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    return ((hash_ * _PRIMES[0]) >> np.uint32(16))[np.cumsum(inside[:-1]).astype(bool)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        texts = words.raw_texts(batch.column("text"))
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for piece, starts, ends in pieces(text):
                total += np.bincount(gram_buckets(piece, starts, ends), minlength=BUCKETS)
    for lang, total in totals.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(total[used])],
            ["lang", "bucket", "n"],
        )


def pieces(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The text cut before words into pieces of about ``CHUNK_BYTES``, with their words."""
    starts, ends = words.spans(text)
    at = 0
    while at < len(starts):
        to = max(np.searchsorted(ends, starts[at] + CHUNK_BYTES), at + 1)
        low, high = starts[at], ends[to - 1]
        yield text[low:high], starts[at:to] - low, ends[at:to] - low
        at = to


@dataclass
class Profiles:
    """Languages and the logarithms of their n-gram probabilities, one row a bucket."""

    languages: list[str]
    logs: np.ndarray

    def word_logs(self, text: np.ndarray) -> np.ndarray:
        """Logarithm of each word's probability in each language."""
        found = []
        for piece, starts, ends in pieces(text):
            grams = self.logs[gram_buckets(piece, starts, ends)]
            first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
            found.append(np.add.reduceat(grams, first, axis=0))
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)), np.float32)


def train(docs: DataFrame) -> Profiles:
    """Counts of all documents outside the held-out fold that have text and language."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    counts = (
        known.select(F.col("lang").cast("string").alias("lang"), "text")
        .mapInArrow(_counts, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = np.array(counts.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(langs.tolist()))
    totals = np.full((BUCKETS, len(languages)), SMOOTHING)
    buckets, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    for k, lang in enumerate(languages):
        own = langs == lang
        totals[buckets[own], k] += n[own]
    return Profiles(languages, np.log(totals / totals.sum(axis=0)).astype(np.float32))


def mixtures(
    likelihood: np.ndarray, first: np.ndarray, counts: np.ndarray, allowed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Language shares and log likelihood of each document, over its allowed languages only.

    ``likelihood`` has a row for each word, relative to the word's most likely language; the
    words of document d are ``counts[d]`` rows from ``first[d]`` on. The likelihood has no other
    maxima, and rises every round; each document goes on until it is at the top, see ``GAP``.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    value = np.full(len(counts), -np.inf)
    left, rows, n = np.arange(len(counts)), likelihood, counts
    while len(left):
        total = np.maximum((rows * np.repeat(share[left], n, axis=0)).sum(axis=1), 1e-30)
        found = np.add.reduceat(np.log(total), first)
        ratio = np.add.reduceat(rows / total[:, None], first, axis=0) / n[:, None]
        gap = n * np.log((ratio * allowed[left]).max(axis=1))
        more = (gap > GAP) & (found - value[left] > GAIN)
        value[left] = found
        share[left[more]] *= ratio[more]
        rows, left, n = rows[np.repeat(more, n)], left[more], n[more]
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    return share, value


def best_likelihood(
    likelihood: np.ndarray, first: np.ndarray, counts: np.ndarray, share: np.ndarray
) -> np.ndarray:
    """What no mixture's log likelihood exceeds, for each document, by its shares in one mixture.

    Another mixture gains ``sum(log(other / this))`` over the words, at most ``words * log(mean(other
    / this))``, and that mean is largest for a single language.
    """
    total = np.maximum((likelihood * np.repeat(share, counts, axis=0)).sum(axis=1), 1e-30)
    ratio = np.add.reduceat(likelihood / total[:, None], first, axis=0) / counts[:, None]
    found = np.add.reduceat(np.log(total), first)
    return found + counts * np.log(ratio.max(axis=1))


def detect(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shares in the chosen set of languages of each document with words, and the set's size."""
    counts = np.array([len(t) for t in tables])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    logs = np.concatenate(tables).astype(np.float64)
    top = logs.max(axis=1, keepdims=True)
    likelihood = np.exp(np.maximum(logs - top, -60.0))
    width = logs.shape[1]
    full, _ = mixtures(likelihood, first, counts, np.ones((len(counts), width)))
    alone = np.add.reduceat(logs - top, first, axis=0)
    order = np.argsort(-full, axis=1, kind="stable")
    order[:, 0] = alone.argmax(axis=1)
    for d in range(len(counts)):
        rest = [k for k in np.argsort(-full[d], kind="stable") if k != order[d, 0]]
        order[d, 1:] = rest
    best = np.zeros((len(counts), width))
    best[np.arange(len(counts)), order[:, 0]] = 1.0
    value = alone.max(axis=1)
    size = np.ones(len(counts), dtype=np.int64)
    penalty = np.log(np.maximum(counts, 2)) / 2
    most = best_likelihood(likelihood, first, counts, full) + 1e-6
    for k in range(2, width + 1):
        tried = np.flatnonzero(most - (k - 1) * penalty > value)
        if not len(tried):
            break
        allowed = np.zeros((len(tried), width))
        np.put_along_axis(allowed, order[tried, :k], 1.0, axis=1)
        rows = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in tried])
        starts = np.concatenate([[0], np.cumsum(counts[tried])[:-1]])
        share, found = mixtures(likelihood[rows], starts, counts[tried], allowed)
        found -= (k - 1) * penalty[tried]
        better = found > value[tried]
        best[tried[better]], value[tried[better]] = share[better], found[better]
        size[tried[better]] = k
    return best, size


def has_letter(text: np.ndarray) -> bool:
    folded = text | 32
    if ((folded >= 97) & (folded <= 122)).any():
        return True
    return any(c.isalpha() for c in text[text >= 128].tobytes().decode("utf-8", "ignore"))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score (the share of that language) and languages (the chosen set).

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no
    language was learned. Ties go to the first language by name.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.value.languages
        for batch in batches:
            n = len(batch)
            label, score, chosen = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]

            def settle(waiting):
                shares, _ = detect([logs for _, logs in waiting])
                for (row, _), share in zip(waiting, shares):
                    k = int(share.argmax())
                    label[row], score[row] = names[k], min(float(share[k]), 1.0)
                    chosen[row] = [names[i] for i in np.flatnonzero(share)]

            waiting, size = [], 0
            for row, text in enumerate(words.raw_texts(batch.column("text"))):
                if names and has_letter(text):
                    waiting.append((row, model.value.word_logs(text)))
                    size += len(waiting[-1][1])
                if size > CHUNK_WORDS:
                    settle(waiting)
                    waiting, size = [], 0
            if waiting:
                settle(waiting)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(label, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(chosen, pa.list_(pa.string())),
                ],
                ["doc_id", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        task, "doc_id long, lang_pred string, score double, languages array<string>"
    )
