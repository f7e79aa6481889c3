"""A corpus from raw documents in stages; each works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddwire.llm import decontaminate, exact_dedup, jaccard, pieces, quality
from oddwire.llm.shared import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, machine, names=("__score", "__predicted"))
    return scored.where("__predicted = 1").drop("__score", "__predicted")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar shingle sets."""
    return jaccard.one_of_each_class(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as sentence pieces: ids and scores of the N best segmentations, whether
    decoding restores it from each."""
    encoded = pieces.encode(docs.select("doc_id", "text"), all_ids=True, verify=True)
    n_pieces = F.size("ids").cast("long").alias("n_pieces")
    return encoded.select("doc_id", n_pieces, "scores", "ids", "alternatives", "restored")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("sentence pieces", segmented),
]

#: Fitted weights and the piece lattice have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
