"""Token totals by source, language and tokenizer, kept up to date by signed changes.

A ledger is a folder of numbered batches. A batch has two tables. ``rows`` holds a row for each
document and tokenizer that it changes: documents +1 or -1 and tokens and characters added or taken
away. ``sums`` is the rollup: the same numbers added up by source, language and tokenizer. Totals
add the rollups of the batches alone, ranges of batches are compacted into one rollup, and changes
look up the rows of the documents that they name.

Commits are idempotent. A batch is written below a fresh folder and counts from the moment its line
is in the manifest, so an attempt that fails at any point leaves what was there. A batch is computed
from those before it alone; committing it again replaces it by the same numbers. One writer at a
time commits to a ledger; the manifest has a line a commit, which the driver reads.

Counts are additive: inserting a document that is already there counts it twice, ``revise``
replaces it. Null and empty texts have no tokens, null keys stay null, rows with a null doc_id are
counted but neither revised nor deleted.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from oddwire.llm import members, words
from oddwire.llm.shared import written

TOKENIZERS = "/opt/tokenizers"

# Fixed value: how the public tokenizers of both vocabularies cut texts before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Tokenizer versions that are counted: a vocabulary file of byte pairs, or words.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k", "words")

COUNTS = (
    "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, chars long"
)
ROLLUP = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
KEY = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]

#: A line says which folder holds a batch, or the rollup of all batches from first to last.
MANIFEST = "seq long, first long, last long, compacted boolean, folder string"

#: Rollups of so many single batches are compacted into one.
COMPACT_AFTER = 64


@lru_cache(maxsize=4)
def byte_pairs(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: np.ndarray, version: str, folder: str) -> int:
    if version == "words":
        return len(words.spans(text)[0])
    encoding = byte_pairs(f"{folder}/{version}.tiktoken")
    return len(encoding.encode_ordinary(text.tobytes().decode("utf-8", "replace")))


def counted(
    docs: DataFrame, versions: tuple[str, ...] = VERSIONS, folder: str = TOKENIZERS
) -> DataFrame:
    """One row per document and tokenizer; a null text counts as empty, null keys stay null.

    Columns other than doc_id, source, lang and text are not looked at.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(words.raw_texts(batch.column("text")))
            chars = words.arrow([int(np.count_nonzero((t & 0xC0) != 0x80)) for t in texts], pa.int64())
            one = words.arrow(np.ones(len(batch), np.int64))
            for version in versions:
                tokens = [count_tokens(text, version, folder) for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k) for k in ("doc_id", "source", "lang")),
                        words.arrow([version] * len(batch), pa.string()),
                        one,
                        words.arrow(tokens, pa.int64()),
                        chars,
                    ],
                    [field.split()[0] for field in COUNTS.split(", ")],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        "text",
    )
    return rows.mapInArrow(task, COUNTS)


def _added(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(*(F.sum(k).alias(k) for k in SUMS))


def _negated(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", *KEY, *((-F.col(k)).alias(k) for k in SUMS))


class Ledger:
    """Batches of signed counts below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.root, self.compact_after = spark, root, compact_after

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Write a batch and its rollup, then point to them; a repetition takes its place."""
        folder = self._folder()
        changes.select(*(F.col(k) for k in ("doc_id", *KEY, *SUMS))).write.parquet(f"{folder}/rows")
        rows = self.spark.read.schema(COUNTS).parquet(f"{folder}/rows")
        _added(rows, *KEY).write.parquet(f"{folder}/sums")
        self._point(batch, batch, False, folder)
        if len(self._rollups()) > self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Replace the rollups of all batches by one. Committing one of them again undoes this."""
        batches = self._batches()
        if batches:
            folder = self._folder()
            _added(self._sums(), *KEY).write.parquet(f"{folder}/sums")
            self._point(min(batches), max(batches), True, folder)

    def _folder(self) -> str:
        return f"{self.root}/parts/{uuid.uuid4().hex}"

    def _point(self, first: int, last: int, compacted: bool, folder: str) -> None:
        seq = max((line.seq for line in self._manifest()), default=0) + 1
        line = self.spark.createDataFrame([(seq, first, last, compacted, folder)], MANIFEST)
        line.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _manifest(self) -> list[Row]:
        try:
            lines = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException:  # nothing was committed yet
            return []
        return lines.orderBy("seq").collect()

    def _batches(self) -> dict[int, Row]:
        """The last line of each batch."""
        return {line.first: line for line in self._manifest() if not line.compacted}

    def _rollups(self) -> list[str]:
        """Folders of the last compacted rollup that no later commit touched, and of the batches
        outside it."""
        batches = self._batches()
        for line in reversed(self._manifest()):
            inside = {n for n in batches if line.first <= n <= line.last}
            if line.compacted and all(batches[n].seq < line.seq for n in inside):
                rest = [batches[n].folder for n in sorted(batches) if n not in inside]
                return [line.folder, *rest]
        return [batches[n].folder for n in sorted(batches)]

    def _tables(self, folders: list[str], name: str, schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{folder}/{name}" for folder in folders))

    def _sums(self) -> DataFrame:
        return self._tables(self._rollups(), "sums", ROLLUP)

    def rows(self, before: int | None = None) -> DataFrame:
        """The signed rows of all batches, or of those before one."""
        batches = self._batches()
        numbers = [n for n in sorted(batches) if before is None or n < before]
        return self._tables([batches[n].folder for n in numbers], "rows", COUNTS)

    def current(self, batch: int, ids: DataFrame | None = None) -> DataFrame:
        """What the batches before this one say about each document that is still there.

        With ``ids``, about the documents they name in ``doc_id``: other rows are not shuffled.
        """
        rows = self.rows(batch)
        if ids is not None:
            rows = members.only(rows, ids, "doc_id")
        return _added(rows, "doc_id", *KEY).where("docs > 0")

    def insert(self, batch: int, counts: DataFrame) -> None:
        """Add documents; one that is already there counts once more."""
        self.commit(batch, counts)

    def delete(self, batch: int, ids: DataFrame) -> None:
        """Take documents out: all rows of the given doc_ids; unknown and null ids do nothing."""
        self.commit(batch, _negated(self.current(batch, ids)))

    def revise(self, batch: int, counts: DataFrame) -> None:
        """Replace what is known of the counted documents, which may also change their keys.

        Documents that are not there, or not any more, stay away. Texts are counted once: the
        counts are written before they are compared.
        """
        counts = written(counts, "revised-counts")
        old = written(self.current(batch, counts), "counts-before")
        new = counts.join(old.select("doc_id").distinct(), "doc_id", "left_semi")
        changes = _added(new.unionByName(_negated(old)), "doc_id", *KEY)
        self.commit(batch, changes.where("docs <> 0 OR tokens <> 0 OR chars <> 0"))

    def totals(self) -> DataFrame:
        """Documents, tokens and characters by source, language and tokenizer, where any are left."""
        return _added(self._sums(), *KEY).where("docs > 0")
