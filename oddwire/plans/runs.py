"""The three complete runs: traffic files in, models and reports out.

Each traffic file is parsed once, and its features are written to the shared folder before
they are used by statistics, training and reports.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession

from oddwire.operators import cluster, evaluate, prepare, score, statistics
from oddwire.operators.features import request_features
from oddwire.schema import ANOMALY, NORMAL
from oddwire.session import materialise
from oddwire.sources import tables
from oddwire.sources.traffic import read_requests, union_sets


@dataclass
class Sets:
    """Feature tables and prepared tables of one run."""

    requests: DataFrame
    train_features: DataFrame
    test_features: DataFrame
    training: DataFrame
    testing: DataFrame


def load_sets(
    spark: SparkSession,
    normal_training: str,
    normal_test: str,
    anomalous: str,
    out: str,
    refit: bool = False,
) -> Sets:
    """Parse the three files, write the feature tables and prepare both sets.

    The anomalous requests are part of the training and of the test set.
    """
    requests = [
        materialise(read_requests(spark, path, label=label))
        for path, label in ((normal_training, NORMAL), (normal_test, NORMAL), (anomalous, ANOMALY))
    ]
    training, test, anomalies = [materialise(request_features(r)) for r in requests]
    train_features = union_sets(training, anomalies)
    test_features = union_sets(test, anomalies)
    tables.write_features_csv(train_features, f"{out}/train.csv")
    tables.write_features_csv(test_features, f"{out}/test.csv")
    tables.write_column_names(spark, f"{out}/column_names")
    train, testing, preparation = prepare.prepare_sets(train_features, test_features, refit=refit)
    tables.save_preparation(preparation, f"{out}/preparation")
    if refit:  # centred, so not written yet
        train, testing = materialise(train), materialise(testing)
    return Sets(union_sets(*requests), train_features, test_features, train, testing)


def report_statistics(requests: DataFrame, out: str) -> None:
    counts, values = statistics.basic_statistics(requests)
    statistics.request_count(requests).show()
    counts.orderBy("kind").show(truncate=False)
    tables.write_parquet(counts, f"{out}/statistics_counts")
    tables.write_parquet(values, f"{out}/statistics_values")


def tune_and_report(
    spark: SparkSession,
    training: DataFrame,
    out: str,
    k_values: Sequence[int],
    max_iter_values: Sequence[int],
    tol_values: Sequence[float],
    seed: int,
    parallelism: int,
) -> KMeansModel:
    search = cluster.tune(
        training, k_values, max_iter_values, tol_values, seed=seed, parallelism=parallelism
    )
    results = cluster.tuning_results(spark, search)
    tables.show_tuning_results(results)
    tables.write_tuning_results(results, f"{out}/results_tuning")
    tables.save_model(search.bestModel, f"{out}/model")
    return search.bestModel


def report_evaluation(scored: DataFrame, out: str) -> DataFrame:
    by_threshold = evaluate.precision_recall(evaluate.score_and_label(scored))
    tables.write_evaluation(by_threshold, f"{out}/results_evaluation")
    return by_threshold


def report_detection(scored: DataFrame, out: str, threshold: float) -> DataFrame:
    """Distances, threshold sweep and final detection."""
    tables.write_distances(scored, f"{out}/results_distances")
    tables.write_threshold_sweep(score.threshold_sweep(scored), f"{out}/results_tests")
    summary = score.detection_summary(scored, threshold)
    summary.show()
    tables.show_anomalies(score.detect(scored, threshold))
    return summary


def run_application(
    spark: SparkSession,
    normal_training: str,
    normal_test: str,
    anomalous: str,
    out: str,
    *,
    seed: int,
    k_values: Sequence[int] = range(30, 271, 30),
    max_iter_values: Sequence[int] = range(20, 61, 10),
    tol_values: Sequence[float] = (1e-4, 1e-5, 1e-6),
    threshold: float = 1.0,
    parallelism: int = 2,
    refit: bool = False,
) -> DataFrame:
    """Statistics, tuning, evaluation, distances, sweep and detection with the best model."""
    sets = load_sets(spark, normal_training, normal_test, anomalous, out, refit)
    report_statistics(sets.requests, out)
    model = tune_and_report(
        spark, sets.training, out, k_values, max_iter_values, tol_values, seed, parallelism
    )
    scored = materialise(score.score(model, sets.testing))
    report_evaluation(scored, out)
    return report_detection(scored, out, threshold)


def run_evaluation(
    spark: SparkSession,
    normal_training: str,
    normal_test: str,
    anomalous: str,
    out: str,
    *,
    seed: int,
    k_values: Sequence[int] = range(10, 21),
    max_iter_values: Sequence[int] = range(20, 61, 5),
    tol_values: Sequence[float] = (1e-4, 1e-5, 1e-6),
    parallelism: int = 2,
    refit: bool = False,
) -> DataFrame:
    """Statistics, tuning and evaluation."""
    sets = load_sets(spark, normal_training, normal_test, anomalous, out, refit)
    report_statistics(sets.requests, out)
    model = tune_and_report(
        spark, sets.training, out, k_values, max_iter_values, tol_values, seed, parallelism
    )
    return report_evaluation(materialise(score.score(model, sets.testing)), out)


def run_scoring(
    spark: SparkSession,
    normal_training: str,
    normal_test: str,
    anomalous: str,
    out: str,
    *,
    seed: int,
    k: int = 20,
    max_iter: int = 60,
    tol: float = 1e-6,
    threshold: float = 3.0,
    refit: bool = False,
) -> DataFrame:
    """Statistics, one model with given parameters, distances, sweep and detection."""
    sets = load_sets(spark, normal_training, normal_test, anomalous, out, refit)
    report_statistics(sets.requests, out)
    model = cluster.fit_kmeans(sets.training, k, max_iter, tol, seed=seed)
    tables.save_model(model, f"{out}/model")
    return report_detection(materialise(score.score(model, sets.testing)), out, threshold)
