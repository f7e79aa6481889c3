"""Time every table query and print one JSON line.

Each query is run once to warm up and then timed, its result going to a sink that keeps
nothing. BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from table_queries.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "char_class_counts",
    "char_class_ratios",
    "line_word_counts",
    "url_features",
    "text_parameters",
    "request_assembly",
    "request_features",
    "parameter_features",
    "malformed_requests",
    "distinct_values",
    "string_index",
    "one_hot",
    "standard_scale",
    "prepared_vectors",
    "centroid_distance",
    "nearest_centroid",
    "threshold_sweep",
    "anomaly_counts",
    "precision_recall",
    "f_beta",
    "areas_under_curves",
    "silhouette",
    "tuning_report",
    "kmeans_fit",
    "tune",
    "traffic_anomalies",
    "traffic_2s",
    "traffic_last100",
    "connection_quarantine",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(query, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        timed(QUERIES[name], spark, sf_dir)
        seconds[name] = round(timed(QUERIES[name], spark, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
