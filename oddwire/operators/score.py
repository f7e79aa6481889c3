"""Distances to centroids, detection by threshold, and the threshold sweep.

Every report is one aggregation over the scored table, not one job per threshold.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddwire.schema import ANOMALY
from oddwire.session import materialise

#: Centres of neighbouring norm that are ruled out together.
CENTRES_PER_BLOCK = 64
#: Numbers of the centres that one pass over the rows carries along.
PASS_NUMBERS = 500_000


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of doubles."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, d: total + d
    )


def centres_table(spark: SparkSession, model: KMeansModel) -> DataFrame:
    rows = [(i, [float(x) for x in centre]) for i, centre in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "prediction int, centre array<double>")


def with_distance(predictions: DataFrame, model: KMeansModel, features: str = "scaled_features") -> DataFrame:
    """Add ``distance``, the squared distance to the centroid of the own cluster."""
    # The model has put its centres on every executor already; they are as many as its k.
    centres = F.broadcast(centres_table(predictions.sparkSession, model))
    joined = predictions.join(centres, "prediction")
    distance = squared_distance(vector_to_array(features), F.col("centre"))
    return joined.withColumn("distance", distance).drop("centre")


def score(model: KMeansModel, table: DataFrame) -> DataFrame:
    """Predictions of a prepared table with their distances."""
    return with_distance(model.transform(table), model, model.getFeaturesCol())


def distances(scored: DataFrame) -> DataFrame:
    return scored.select("id", "label", "distance")


def detect(scored: DataFrame, threshold: float) -> DataFrame:
    """The rows at or beyond a distance."""
    return scored.where(F.col("distance") >= F.lit(float(threshold)))


def mean_centres(table: DataFrame, features: str, cluster: str) -> DataFrame:
    """Mean vector per cluster of a table with an array column, as (cluster, centre).

    The summarizer adds up on the map side: one vector per cluster and task is shuffled.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    vector = array_to_vector(F.col(features).cast("array<double>"))
    return table.groupBy(cluster).agg(vector_to_array(Summarizer.mean(vector)).alias("centre"))


def with_own_centre_distance(
    table: DataFrame, centres: DataFrame, features: str, cluster: str
) -> DataFrame:
    """Add ``distance`` to the centre of the given cluster of each row, null without a centre.

    A plain join on the cluster: few centres are broadcast at run time, many are shuffled and
    a large cluster is split.
    """
    own = centres.select(F.col(cluster), F.col("centre").alias("_centre"))
    placed = table.join(own, cluster, "left")
    distance = squared_distance(F.col(features).cast("array<double>"), F.col("_centre"))
    return placed.withColumn("distance", distance).drop("_centre").select(*table.columns, "distance")


def _centre_blocks(centres: DataFrame, cluster: str) -> Iterator[list[dict]]:
    """The centres in blocks of rising norm, a pass over the rows each of at most
    ``PASS_NUMBERS`` numbers. Centres are read from a written table, one block at a time."""
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda t, x: t + x * x))
    named = centres.select(F.col(cluster).alias("cluster"), "centre", norm.alias("norm"))
    stored = materialise(named.where("centre IS NOT NULL"))
    passes: list[list[dict]] = [[]]
    held, block = 0, []
    for row in stored.orderBy("norm", "cluster").toLocalIterator():
        block.append(row.asDict())
        held += len(row["centre"]) + 1
        if len(block) == CENTRES_PER_BLOCK or held >= PASS_NUMBERS:
            passes[-1].append(_block(block))
            block = []
        if held >= PASS_NUMBERS:
            yield passes.pop()
            passes.append([])
            held = 0
    if block:
        passes[-1].append(_block(block))
    if passes[-1]:
        yield passes[-1]


def _block(centres: list[dict]) -> dict:
    return {"low": centres[0]["norm"], "high": centres[-1]["norm"], "centres": centres}


def _nearer(best: Column, point: Column, norm: Column, blocks: Column) -> Column:
    """The best of so far and a pass of blocks; what the norms rule out is not looked at.

    ``(|x| - |c|)^2`` is never above the distance, less a little for rounding.
    """

    def bound(low: Column, high: Column) -> Column:
        gap = F.greatest(low - norm, norm - high, F.lit(0.0))
        return gap * gap * (1 - 1e-9) - 1e-9 * norm * norm

    def over_centres(best: Column, centre: Column) -> Column:
        found = F.struct(
            squared_distance(point, centre["centre"]).alias("distance"), centre["cluster"].alias("cluster")
        )
        ruled_out = bound(centre["norm"], centre["norm"]) > best["distance"]
        return F.when(ruled_out, best).otherwise(F.least(best, found))

    def over_blocks(best: Column, block: Column) -> Column:
        ruled_out = bound(block["low"], block["high"]) > best["distance"]
        return F.when(ruled_out, best).otherwise(F.aggregate(block["centres"], best, over_centres))

    return F.aggregate(blocks, best, over_blocks)


def with_nearest_centre(
    table: DataFrame, centres: DataFrame, features: str, cluster: str
) -> DataFrame:
    """Add ``prediction`` and ``distance`` of the nearest centre, the smaller cluster number
    on a tie; both null for a null vector and without centres.

    Rows keep the best centre so far while blocks of centres go by, as constants of the plan: no
    join, and no vector is shuffled. More centres than a pass holds are further passes, with
    the rows written in between.
    """
    kind = centres.schema[cluster].dataType
    best = T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("cluster", kind)])
    centre = T.StructType(
        [
            T.StructField("cluster", kind),
            T.StructField("centre", T.ArrayType(T.DoubleType())),
            T.StructField("norm", T.DoubleType()),
        ]
    )
    block = T.StructType(
        [
            T.StructField("low", T.DoubleType()),
            T.StructField("high", T.DoubleType()),
            T.StructField("centres", T.ArrayType(centre)),
        ]
    )
    far = F.struct(F.lit(math.inf).alias("distance"), F.lit(None).cast(kind).alias("cluster"))
    point = F.col(features).cast("array<double>")
    norm = F.sqrt(F.aggregate("_point", F.lit(0.0), lambda t, x: t + x * x))
    rows = table.withColumn("_point", point).withColumns({"_norm": norm, "_best": far.cast(best)})
    for number, blocks in enumerate(_centre_blocks(centres, cluster)):
        if number:
            rows = materialise(rows)
        constant = F.from_json(F.lit(json.dumps(blocks)), T.ArrayType(block))
        nearer = _nearer(F.col("_best"), F.col("_point"), F.col("_norm"), constant)
        rows = rows.withColumn("_best", F.when(F.col("_point").isNotNull(), nearer).otherwise(F.col("_best")))
    found = F.col("_best.distance") < math.inf
    return rows.select(
        *table.columns,
        F.when(found, F.col("_best.cluster")).alias("prediction"),
        F.when(found, F.col("_best.distance")).alias("distance"),
    )


def threshold_range(last: int = 10, per_unit: int = 10) -> list[float]:
    """0.0, 0.1, … 10.0: divided, not added up, so every threshold is the nearest double."""
    return [i / per_unit for i in range(last * per_unit + 1)]


def error_rate(detected: Column, actual: Column) -> Column:
    """Percentage of false alarms among the detections, NaN without any detection."""
    share = F.try_divide(F.abs(actual - detected).cast("double"), detected) * 100
    return F.coalesce(share, F.lit(float("nan")))


def threshold_sweep(
    scored: DataFrame, thresholds: Sequence[float] | None = None, anomaly: str | Column = ANOMALY
) -> DataFrame:
    """(threshold, detected, actual, error_rate) for every threshold.

    Each row falls into the bucket of the largest threshold it reaches. Counts per bucket,
    at most one row per threshold, are then added up from the top.
    """
    steps = sorted(set(threshold_range() if thresholds is None else map(float, thresholds)))
    is_anomaly = F.col("label") == anomaly if isinstance(anomaly, str) else anomaly
    buckets = Bucketizer(
        splits=[-math.inf, *steps, math.inf], inputCol="distance", outputCol="_bucket",
        handleInvalid="skip",
    )
    counts = (
        buckets.transform(scored.select("distance", is_anomaly.alias("_anomaly")))
        .groupBy(F.col("_bucket").cast("int").alias("step"))
        .agg(F.count("*").alias("n"), F.count_if("_anomaly").alias("n_anomaly"))
    )
    table = scored.sparkSession.createDataFrame(
        list(enumerate(steps, start=1)), "step int, threshold double"
    )
    upwards = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = table.join(counts, "step", "left").select(
        "threshold",
        F.coalesce(F.sum("n").over(upwards), F.lit(0)).alias("detected"),
        F.coalesce(F.sum("n_anomaly").over(upwards), F.lit(0)).alias("actual"),
    )
    return totals.withColumn("error_rate", error_rate(F.col("detected"), F.col("actual")))


def detection_summary(
    scored: DataFrame, threshold: float, anomaly: str | Column = ANOMALY
) -> DataFrame:
    """One row: anomalies in the set, rows detected, anomalies among them, error rate."""
    is_anomaly = F.col("label") == anomaly if isinstance(anomaly, str) else anomaly
    found = F.col("distance") >= F.lit(float(threshold))
    counts = scored.agg(
        F.count_if(is_anomaly).alias("total_anomalies"),
        F.count_if(found).alias("detected"),
        F.count_if(found & is_anomaly).alias("actual"),
    )
    return counts.withColumn("error_rate", error_rate(F.col("detected"), F.col("actual")))
