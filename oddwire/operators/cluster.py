"""k-means: fit, grid search and the reports of a grid search."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = "scaled_features"


def fit_kmeans(
    table: DataFrame,
    k: int = 2,
    max_iter: int = 20,
    tol: float = 1e-4,
    *,
    seed: int,
    features: str = FEATURES,
    init_steps: int = 2,
) -> KMeansModel:
    """More ``init_steps`` find clusters that lie close together among some that lie far apart."""
    kmeans = KMeans(
        k=k, maxIter=max_iter, tol=tol, seed=seed, featuresCol=features, initSteps=init_steps
    )
    return kmeans.fit(table)


def silhouette(predictions: DataFrame, features: str = FEATURES) -> float:
    """Silhouette with squared Euclidean distance."""
    return ClusteringEvaluator(featuresCol=features).evaluate(predictions)


def named_by_first(predictions: DataFrame, id: str = "id") -> DataFrame:
    """Clusters named after their smallest id, so that two fits can be compared."""
    # A row per cluster of the model, fewer than its centres hold numbers.
    names = predictions.groupBy("prediction").agg(F.min(id).alias("_name"))
    named = predictions.join(F.broadcast(names), "prediction")
    return named.withColumn("prediction", F.col("_name")).select(*predictions.columns)


def parameter_grid(
    k_values: Sequence[int], max_iter_values: Sequence[int], tol_values: Sequence[float]
) -> list[dict]:
    """Grid in report order: tol outermost, then k, then maxIter."""
    return [
        {"k": int(k), "maxIter": int(max_iter), "tol": float(tol)}
        for tol in tol_values
        for k in k_values
        for max_iter in max_iter_values
    ]


@dataclass(frozen=True)
class GridSearch:
    """Grid points, their metrics, and the best point fitted on the whole table."""

    points: list[dict]
    metrics: list[float]
    bestModel: KMeansModel


def split_share(id: Column, seed: int) -> Column:
    """A number from 0 to 1 for each id, from the first 32 bits of the MD5 of ``seed:id``.

    A row keeps its side of the split however often, and from whatever partitions, it is read;
    rows with the same id are on the same side.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


def tune(
    table: DataFrame,
    k_values: Sequence[int] = (2,),
    max_iter_values: Sequence[int] = (20,),
    tol_values: Sequence[float] = (1e-4,),
    *,
    seed: int,
    train_ratio: float = 0.8,
    parallelism: int = 2,
    features: str = FEATURES,
    id: str = "id",
    init_steps: int = 2,
) -> GridSearch:
    """Fit every grid point on one part and keep the one with the best silhouette on the
    rest, the first of equals; it is fitted again on all rows.

    The parts are told by the ids, see ``split_share``. The table is read once or more for every
    point, so it should come from storage; see ``oddwire.session.materialise``.
    """
    in_training = split_share(F.col(id), seed) < train_ratio
    training, validation = table.where(in_training), table.where(~in_training)
    points = parameter_grid(k_values, max_iter_values, tol_values)

    def fit(rows: DataFrame, point: dict) -> KMeansModel:
        k, max_iter, tol = point["k"], point["maxIter"], point["tol"]
        return fit_kmeans(rows, k, max_iter, tol, seed=seed, features=features, init_steps=init_steps)

    @inheritable_thread_target(table.sparkSession)
    def metric(point: dict) -> float:
        return silhouette(fit(training, point).transform(validation), features)

    with ThreadPoolExecutor(parallelism) as threads:
        metrics = list(threads.map(metric, points))
    best = max(range(len(points)), key=lambda i: metrics[i])
    return GridSearch(points, metrics, fit(table, points[best]))


def tuning_grid(spark: SparkSession, search: GridSearch) -> DataFrame:
    """(grid_idx, k, maxIter, tol, silhouette), one row per grid point."""
    rows = [
        (i, point["k"], point["maxIter"], point["tol"], float(metric))
        for i, (point, metric) in enumerate(zip(search.points, search.metrics))
    ]
    schema = "grid_idx int, k int, maxIter int, tol double, silhouette double"
    return spark.createDataFrame(rows, schema)


def running_mean(grid: DataFrame) -> DataFrame:
    """Add ``avg``: the mean of all metrics up to this point, in grid order.

    A report figure only. It depends on the order of the grid, so models are chosen by
    ``silhouette``. A grid has a few hundred rows: one window over all of them.
    """
    so_far = Window.orderBy("grid_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.withColumn("avg", F.avg("silhouette").over(so_far))


def tuning_results(spark: SparkSession, search: GridSearch) -> DataFrame:
    return running_mean(tuning_grid(spark, search))


def best_by(results: DataFrame, metric: str) -> DataFrame:
    """The row with the largest metric, the first in grid order of equals."""
    return results.orderBy(F.desc(metric), "grid_idx").limit(1)


def best_tol_block(results: DataFrame) -> DataFrame:
    """The rows that share the tol of the row with the largest running mean."""
    best = best_by(results, "avg").select("tol").scalar()
    return results.where(F.col("tol") == best)


def tuning_pivot(results: DataFrame, k_values: Sequence[int]) -> DataFrame:
    """Running means of the best tol block: one row per maxIter, one column per k."""
    return (
        best_tol_block(results)
        .groupBy("maxIter")
        .pivot("k", list(k_values))
        .agg(F.first("avg"))
        .orderBy("maxIter")
    )
