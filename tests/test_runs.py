import math
import subprocess
import sys
from pathlib import Path

import pytest

from oddwire import session
from oddwire.operators import cluster, prepare
from oddwire.operators.features import request_features
from oddwire.plans import runs
from oddwire.schema import REQUESTS
from oddwire.sources import tables
from oddwire.sources.traffic import read_requests
from oddwire.streaming.scoring import score_requests, write_anomalies
from traffic_samples import shop_traffic


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("traffic")
    sets = {
        "normal_training": shop_traffic(1, 40),
        "normal_test": shop_traffic(2, 30),
        "anomalous": shop_traffic(3, 20, attack=True),
    }
    paths = {}
    for name, lines in sets.items():
        path = folder / f"{name}.txt"
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
        paths[name] = str(path)
    return paths


def test_application_run(spark, files, tmp_path):
    out = str(tmp_path / "out")
    summary = runs.run_application(
        spark, **files, out=out, seed=3, k_values=[4, 6], max_iter_values=[10], tol_values=[1e-4], threshold=1.0
    ).first()
    assert summary["total_anomalies"] == 20
    sweep = spark.read.csv(f"{out}/results_tests", header=True, inferSchema=True).orderBy("threshold").collect()
    assert len(sweep) == 101
    detected = [r["anomalies detected"] for r in sweep]
    assert detected == sorted(detected, reverse=True)
    assert detected[10] == summary["detected"]
    assert detected[0] == tables.read_features_csv(spark, f"{out}/test.csv").count() == 50
    assert tables.read_features_csv(spark, f"{out}/train.csv").count() == 60
    distances = [float(r[0]) for r in spark.read.csv(f"{out}/results_distances").collect()]
    assert len(distances) == 50 and all(d >= 0 for d in distances)
    assert tables.load_model(f"{out}/model").hasSummary is False
    assert spark.read.parquet(f"{out}/statistics_counts").count() == 9


def test_evaluation_and_scoring_runs(spark, files, tmp_path):
    by_threshold = runs.run_evaluation(
        spark, **files, out=str(tmp_path / "e"), seed=3, k_values=[3], max_iter_values=[5], tol_values=[1e-4]
    ).orderBy("threshold").collect()
    assert by_threshold[0]["recall"] == 1.0
    assert by_threshold[0]["precision"] == pytest.approx(30 / 50)
    summary = runs.run_scoring(spark, **files, out=str(tmp_path / "s"), seed=3, k=5, max_iter=10).first()
    assert summary["total_anomalies"] == 20
    assert summary["detected"] > 0 or math.isnan(summary["error_rate"])


def test_stream_scores_like_a_batch(spark, files, tmp_path):
    requests = session.materialise(read_requests(spark, files["anomalous"], label="anomaly"))
    features = session.materialise(request_features(requests))
    preparation = prepare.fit_preparation(features)
    model = cluster.fit_kmeans(prepare.prepared(preparation, features), k=3, seed=1)
    source = str(tmp_path / "requests")
    requests.select(REQUESTS.fieldNames()).write.parquet(source)
    stream = spark.readStream.schema(REQUESTS).parquet(source)
    query = write_anomalies(
        stream, preparation, model, 0.5, str(tmp_path / "anomalies"), str(tmp_path / "state"), availableNow=True
    )
    query.awaitTermination(120)
    batch = score_requests(requests, preparation, model).where("distance >= 0.5")
    streamed = spark.read.parquet(str(tmp_path / "anomalies"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_intermediate_tables_go_to_the_named_folder(spark):
    folder = session.shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    before = set(Path(folder).iterdir())
    table = session.materialise(spark.range(5))
    assert table.count() == 5
    assert len(set(Path(folder).iterdir()) - before) == 1


def test_command_line_help():
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run(
        [sys.executable, "-m", "oddwire", "--help"], cwd=root, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0 and "application" in done.stdout
