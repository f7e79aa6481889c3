"""Feature tables, models and reports: read, write, show.

Every writer of a table or report is distributed and overwrites its target; a path names a
directory of part files, as always with Spark. Models are kept in versions: a path holds all
that were saved to it and loads the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddwire.operators import cluster, evaluate, score
from oddwire.operators.prepare import Preparation, Statistics
from oddwire.schema import FEATURE_COLUMNS, FEATURES


SWEEP = "threshold double, detected long, actual long, error_rate double"
EVALUATION = "threshold double, precision double, recall double"


def write_features_csv(features: DataFrame, path: str) -> None:
    """Feature rows without a header row, ratios with two decimals."""
    columns = [
        F.col(f.name).cast("decimal(20,2)") if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in features.schema
    ]
    features.select(*columns).write.mode("overwrite").csv(path, header=False, emptyValue="")


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows written without a header, with the fixed schema and no inference pass."""
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError("file must be a CSV file")
    return spark.read.schema(FEATURES).csv(path, header=False)


def rename_columns(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename all columns by position."""
    return table.toDF(*names)


def write_column_names(spark: SparkSession, path: str) -> None:
    names = spark.createDataFrame([(name,) for name in FEATURE_COLUMNS], "value string")
    names.coalesce(1).write.mode("overwrite").text(path)


def write_parquet(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def _stored(path: str, write: Callable[[str], None]) -> None:
    """Write a version below a fresh name, then point to it.

    The pointer is a row appended to a small table, so a write that fails leaves the version
    before it in place, and readers see a whole version at any time.
    """
    spark = SparkSession.active()
    name = f"{path}/{uuid.uuid4().hex}"
    write(name)
    number = max((r["number"] for r in _versions(spark, path)), default=0) + 1
    pointer = spark.createDataFrame([(number, name)], "number long, version string")
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def _versions(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema("number long, version string").parquet(f"{path}/pointer").collect()
    except AnalysisException:
        return []


def current_version(path: str) -> str:
    """Where the last version that was written whole lies."""
    versions = _versions(SparkSession.active(), path)
    if not versions:
        raise FileNotFoundError(f"nothing was saved to {path}")
    return max((r["number"], r["version"]) for r in versions)[1]


def save_model(model: KMeansModel, path: str) -> None:
    _stored(path, lambda name: model.write().save(name))


def load_model(path: str) -> KMeansModel:
    return KMeansModel.load(current_version(path))


def save_pipeline(pipeline: Pipeline | PipelineModel, path: str) -> None:
    _stored(path, lambda name: pipeline.write().save(name))


def load_pipeline(path: str) -> Pipeline:
    return Pipeline.load(current_version(path))


def load_pipeline_model(path: str) -> PipelineModel:
    return PipelineModel.load(current_version(path))


_PREPARATION = (
    "columns array<string>, means array<double>, deviations array<double>, "
    "encoded array<string>, widths array<long>, handle_invalid string"
)


def save_preparation(model: Preparation, path: str) -> None:
    """A row of statistics, and the categories as a table."""
    spark = SparkSession.active()

    def write(name: str) -> None:
        model.index.write.parquet(f"{name}/categories")
        numeric = model.numeric
        row = (
            numeric.columns,
            [float(x) for x in numeric.means],
            [float(x) for x in numeric.deviations],
            model.encoded,
            model.widths,
            model.handle_invalid,
        )
        spark.createDataFrame([row], _PREPARATION).coalesce(1).write.parquet(f"{name}/statistics")

    _stored(path, write)


def load_preparation(path: str) -> Preparation:
    spark, name = SparkSession.active(), current_version(path)
    row = spark.read.parquet(f"{name}/statistics").first()
    statistics = Statistics(row["columns"], row["means"], row["deviations"])
    index = spark.read.parquet(f"{name}/categories")
    return Preparation(statistics, row["encoded"], row["widths"], row["handle_invalid"], index)


def write_tuning_results(results: DataFrame, path: str) -> None:
    """Running means of the best tol: a row per maxIter, a column per k."""
    k_values = [r["k"] for r in results.select("k").distinct().orderBy("k").collect()]
    pivot = cluster.tuning_pivot(results, k_values).withColumnRenamed("maxIter", " ")
    pivot.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_tuning_results(spark: SparkSession, path: str) -> DataFrame:
    """(maxIter, k, avg) of a tuning file; cells without a grid point are left out."""
    wide = spark.read.csv(path, header=True)
    first, *k_values = wide.columns
    cells = F.explode(F.create_map(*[x for k in k_values for x in (F.lit(int(k)), F.col(f"`{k}`"))]))
    long = wide.select(F.col(f"`{first}`").cast("int").alias("maxIter"), cells.alias("k", "avg"))
    return long.withColumn("avg", F.col("avg").cast("double")).dropna(subset=["avg"])


def write_threshold_sweep(sweep: DataFrame, path: str) -> None:
    named = sweep.orderBy("threshold").select(
        "threshold",
        F.col("detected").alias("anomalies detected"),
        F.col("actual").alias("actual anomalies"),
        F.format_string("%.2f", "error_rate").alias("error rate"),
    )
    named.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_threshold_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Sweep as it was written: the error rate has two decimals, NaN where nothing was detected."""
    return spark.read.schema(SWEEP).csv(path, header=True, enforceSchema=True)


def write_distances(scored: DataFrame, path: str) -> None:
    scored.select("distance").write.mode("overwrite").csv(path)


def write_evaluation(by_threshold: DataFrame, path: str) -> None:
    """Two tables below ``path``: precision_recall and f_measure (pivoted).

    The small table of thresholds is kept, so that the scored rows are read once.
    """
    by_threshold = by_threshold.persist()
    ordered = by_threshold.orderBy(F.desc("threshold"))
    ordered.coalesce(1).write.mode("overwrite").csv(f"{path}/precision_recall", header=True)
    pivot = evaluate.f_beta_pivot(evaluate.f_beta(by_threshold))
    pivot.coalesce(1).write.mode("overwrite").csv(f"{path}/f_measure", header=True)
    by_threshold.unpersist()


def read_precision_recall(spark: SparkSession, path: str) -> DataFrame:
    """The first table of an evaluation: a row per threshold."""
    return spark.read.schema(EVALUATION).csv(f"{path}/precision_recall", header=True)


def _show_all(report: DataFrame) -> None:
    """Print a report whole: one row per threshold or grid point, not per row of traffic."""
    report.show(max(report.count(), 1), truncate=False)


def show_tuning_results(results: DataFrame, only_best: bool = True) -> None:
    if not only_best:
        _show_all(results.orderBy("grid_idx"))
    cluster.best_by(results, "avg").show(truncate=False)


def show_threshold_sweep(sweep: DataFrame, num_rows: int = 11) -> None:
    """The first lines of the sweep; the header counts as one of them, 0 shows all."""
    ordered = sweep.orderBy("threshold")
    _show_all(ordered if num_rows == 0 else ordered.limit(num_rows - 1))


def show_distances(scored: DataFrame, num_rows: int) -> None:
    """The first distances, as many as asked for; ``write_distances`` carries them all."""
    score.distances(scored).show(num_rows, truncate=False)


def show_evaluation(by_threshold: DataFrame) -> None:
    _show_all(by_threshold.orderBy(F.desc("threshold")))
    _show_all(evaluate.f_beta(by_threshold).orderBy("beta", F.desc("threshold")))


def show_anomalies(anomalies: DataFrame, num_rows: int = 3) -> None:
    anomalies.show(num_rows)
