"""Score a stream of requests with models fitted in batch.

Features, preparation and distance are the same row-wise expressions as in batch, so the
stream needs neither state nor watermark.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from oddwire.operators.features import request_features
from oddwire.operators.prepare import Preparation, prepared
from oddwire.operators.score import detect, score


def score_requests(requests: DataFrame, preparation: Preparation, model: KMeansModel) -> DataFrame:
    """Scored rows (id, label, prediction, distance) of a batch or streaming request table."""
    scored = score(model, prepared(preparation, request_features(requests)))
    return scored.select("id", "label", "prediction", "distance")


def write_anomalies(
    requests: DataFrame,
    preparation: Preparation,
    model: KMeansModel,
    threshold: float,
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Append the anomalies of a stream of requests to a Parquet table."""
    writer = detect(score_requests(requests, preparation, model), threshold).writeStream
    if trigger:
        writer = writer.trigger(**trigger)
    return (
        writer.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .start()
    )
