import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.evaluation import BinaryClassificationMetrics
from pyspark.sql import functions as F

from oddwire.operators import categories, cluster, evaluate, prepare, score
from oddwire.sources import tables


@pytest.fixture(scope="module")
def feature_table(spark):
    draw = random.Random(5)
    rows = [
        (
            i, "normal" if i % 3 else "anomaly", draw.choice(["GET", "GET", "POST"]),
            draw.choice([".jsp", ".gif", ".css"]), "no_content", draw.gauss(5, 2), draw.random(), 1.0,
        )
        for i in range(60)
    ] + [(60, "normal", "PUT", None, "no_content", 1.0, 1.0, 1.0)]
    schema = "id long, label string, method string, file_extension string, content_type string, a double, b double, c double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def blobs(spark):
    draw = np.random.default_rng(3)
    points = np.concatenate([draw.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 5, 5))])
    rows = [(i, "anomaly" if i % 4 == 0 else "normal", [float(x) for x in p]) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "id long, label string, x array<double>")
    return frame.select("id", "label", array_to_vector("x").alias("scaled_features")).cache()


@pytest.fixture(scope="module")
def model(blobs):
    return cluster.fit_kmeans(blobs, k=3, max_iter=20, tol=1e-6, seed=1)


def test_preparation(feature_table):
    with pytest.warns(UserWarning, match="content_type"):
        rows = prepare.prepare(feature_table, centred=True).collect()
    # The row with a null extension is skipped, and the single-valued column left out.
    assert len(rows) == 60
    assert set(rows[0].asDict()) == {"id", "label", "scaled_features"}
    matrix = np.array([r["scaled_features"].toArray() for r in rows])
    # Three numeric columns; methods and extensions have three values each, the last is all zeros.
    assert matrix.shape[1] == 3 + 2 + 2
    np.testing.assert_allclose(matrix.mean(axis=0)[[0, 1]], 0, atol=0.2)
    assert (matrix[:, 2] == 0).all()


def test_preparation_needs_its_columns(spark, feature_table):
    with pytest.raises(ValueError, match="content_type"):
        prepare.fit_preparation(feature_table.drop("content_type"))


def test_fit_on_train_and_refit(feature_table):
    usable = feature_table.where("file_extension IS NOT NULL AND method <> 'PUT'")
    test = usable.where("id < 40")
    with pytest.warns(UserWarning):
        _, shared, _ = prepare.prepare_sets(usable, test, centred=True)
        _, own, _ = prepare.prepare_sets(usable, test, refit=True, centred=True)

    def mean(frame):
        return np.array([r["scaled_features"].toArray() for r in frame.collect()]).mean(axis=0)

    np.testing.assert_allclose(mean(own), 0, atol=1e-9)
    assert abs(mean(shared)).max() > 1e-3
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="different categories"):
        prepare.prepare_sets(usable, test.where("file_extension <> '.css'"), refit=True)


def test_distances_add_up_to_the_training_cost(blobs, model):
    scored = score.score(model, blobs)
    total = scored.agg(F.sum("distance")).first()[0]
    assert total == pytest.approx(model.summary.trainingCost)
    centres = np.array(model.clusterCenters())
    for row in scored.collect():
        squared = ((centres - row["scaled_features"].toArray()) ** 2).sum(axis=1)
        assert row["prediction"] == squared.argmin()
        assert row["distance"] == pytest.approx(squared.min())
    assert score.distances(scored).columns == ["id", "label", "distance"]


def test_sweep_matches_one_filter_per_threshold(spark, blobs, model):
    scored = score.score(model, blobs).cache()
    rows = [(r["distance"], r["label"]) for r in scored.collect()]
    sweep = score.threshold_sweep(scored).orderBy("threshold").collect()
    assert [r["threshold"] for r in sweep] == [i / 10 for i in range(101)]
    for r in sweep:
        kept = [label for distance, label in rows if distance >= r["threshold"]]
        actual = kept.count("anomaly")
        assert (r["detected"], r["actual"]) == (len(kept), actual)
        if kept:
            assert r["error_rate"] == pytest.approx((len(kept) - actual) / len(kept) * 100)
        else:
            assert math.isnan(r["error_rate"])
    assert sweep[0]["detected"] == 120
    summary = score.detection_summary(scored, 0.1).first()
    assert tuple(summary)[:3] == (30, sweep[1]["detected"], sweep[1]["actual"])
    assert score.detect(scored, 0.1).count() == sweep[1]["detected"]


def test_sweep_borders_are_exact(spark):
    rows = [(0.3, "anomaly"), (0.1 + 0.2, "normal"), (10.0, "normal"), (11.0, "anomaly"), (0.0, "normal")]
    scored = spark.createDataFrame(rows, "distance double, label string")
    got = {r["threshold"]: (r["detected"], r["actual"]) for r in score.threshold_sweep(scored).collect()}
    assert got[0.0] == (5, 2) and got[0.1] == (4, 2) and got[0.3] == (4, 2)
    assert got[0.4] == (2, 1) and got[10.0] == (2, 1)


def test_sweep_does_not_depend_on_partitions(blobs, model):
    scored = score.score(model, blobs)
    tables_ = [
        sorted(map(tuple, score.threshold_sweep(scored.repartition(n)).fillna(-1).collect())) for n in (1, 2, 7)
    ]
    assert tables_[0] == tables_[1] == tables_[2]


def test_centres_by_label(spark):
    rows = [(0, 0, [0.0, 0.0]), (1, 0, [2.0, 0.0]), (2, 1, [10.0, 1.0]), (3, 1, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "id int, label int, v array<float>")
    centres = score.mean_centres(frame, "v", "label")
    own = score.with_own_centre_distance(frame, centres, "v", "label").orderBy("id").collect()
    assert [r["distance"] for r in own] == [1.0, 1.0, 16.0, 16.0]
    nearest = score.with_nearest_centre(frame, centres, "v", "label").orderBy("id").collect()
    assert [r["prediction"] for r in nearest] == [0, 0, 1, 0]


@pytest.mark.parametrize("per_block, numbers", [(64, 500_000), (2, 500_000), (2, 7), (1, 1)])
def test_centres_in_several_blocks(spark, monkeypatch, per_block, numbers):
    monkeypatch.setattr(score, "CENTRES_PER_BLOCK", per_block)
    monkeypatch.setattr(score, "PASS_NUMBERS", numbers)
    draw = np.random.default_rng(6)
    centres = draw.normal(0, 3, (9, 2)).round(1)
    centres[4] = centres[2]
    points = np.concatenate([draw.normal(0, 3, (40, 2)), centres, [[0.0, 0.0]]])
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)] + [(99, None)]
    frame = spark.createDataFrame(rows, "id int, v array<double>")
    table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "label int, centre array<double>")
    nearest = score.with_nearest_centre(frame, table, "v", "label")
    assert nearest.columns == ["id", "v", "prediction", "distance"]
    found = {r["id"]: (r["prediction"], r["distance"]) for r in nearest.collect()}
    assert found.pop(99) == (None, None)
    for k, p in enumerate(points):
        squared = ((centres - p) ** 2).sum(axis=1)
        assert found[k] == (squared.argmin(), pytest.approx(squared.min()))


def test_vectors_are_not_shuffled_to_their_centres(spark, capsys):
    frame = spark.createDataFrame([(0, [1.0, 2.0])], "id int, v array<double>")
    centres = spark.createDataFrame([(0, [1.0, 2.0])], "label int, centre array<double>")
    score.with_nearest_centre(frame, centres, "v", "label").explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan and "CartesianProduct" not in plan
    empty = score.with_nearest_centre(frame, centres.limit(0), "v", "label").first()
    assert (empty["prediction"], empty["distance"]) == (None, None)


def test_distances_do_not_need_centred_vectors(feature_table):
    usable = feature_table.where("file_extension IS NOT NULL")
    with pytest.warns(UserWarning):
        model = prepare.fit_preparation(usable)
        fewer = prepare.fit_preparation(usable, drop_constant=True)
    found = []
    for centred in (False, True):
        # One partition in one order, so that both fits begin with the same rows.
        vectors = prepare.prepared(model, usable, centred).repartition(1).sortWithinPartitions("id").cache()
        fitted = cluster.fit_kmeans(vectors, k=3, max_iter=30, tol=1e-9, seed=5)
        rows = score.score(fitted, vectors).orderBy("id").collect()
        found.append(sorted(r["distance"] for r in rows))
    np.testing.assert_allclose(found[0], found[1], atol=1e-6)
    assert fewer.width == model.width - 1


def test_grid_search(spark, blobs, tmp_path):
    search = cluster.tune(blobs, k_values=[2, 3], max_iter_values=[5, 10], tol_values=[1e-2, 1e-4], seed=9)
    results = cluster.tuning_results(spark, search).orderBy("grid_idx").collect()
    assert [(r["tol"], r["k"], r["maxIter"]) for r in results] == [
        (tol, k, i) for tol in (1e-2, 1e-4) for k in (2, 3) for i in (5, 10)
    ]
    metrics = [r["silhouette"] for r in results]
    for i, row in enumerate(results):
        assert row["avg"] == pytest.approx(sum(metrics[: i + 1]) / (i + 1))
    assert search.bestModel.getK() == 3
    table = spark.createDataFrame(results)
    best = cluster.best_by(table, "avg").first()
    assert best["avg"] == max(r["avg"] for r in results)
    pivot = [tuple(r) for r in cluster.tuning_pivot(table, [2, 3]).collect()]
    block = [r for r in results if r["tol"] == best["tol"]]
    assert pivot == [
        (i, *[next(r["avg"] for r in block if (r["k"], r["maxIter"]) == (k, i)) for k in (2, 3)])
        for i in (5, 10)
    ]
    tables.write_tuning_results(table, str(tmp_path / "tuning"))
    written = [r[0] for r in spark.read.text(str(tmp_path / "tuning")).collect()]
    assert len(written) == 3 and written[0].endswith("2,3")
    tables.show_tuning_results(table, only_best=False)


def test_split_does_not_depend_on_partitions(spark, blobs):
    share = cluster.split_share(F.col("id"), 9)
    few = {r["id"]: r["share"] for r in blobs.select("id", share.alias("share")).collect()}
    many = {r["id"]: r["share"] for r in blobs.repartition(7).select("id", share.alias("share")).collect()}
    assert few == many and 0.65 < sum(s < 0.8 for s in few.values()) / len(few) < 0.95
    assert all(0 <= s < 1 for s in few.values())
    nothing = spark.createDataFrame([(None,)], "id long").select(share.alias("share")).first()
    assert 0 <= nothing["share"] < 1


def test_names_of_clusters(spark):
    rows = spark.createDataFrame([(5, 1), (3, 1), (4, 0)], "id long, prediction int")
    assert sorted(tuple(r) for r in cluster.named_by_first(rows).collect()) == [(3, 3), (4, 4), (5, 3)]


def test_best_takes_the_first_of_equals(spark):
    grid = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9)], "grid_idx int, avg double")
    assert cluster.best_by(grid, "avg").first()["grid_idx"] == 1


def test_silhouette(blobs, model):
    assert cluster.silhouette(model.transform(blobs)) > 0.9


def test_model_and_pipeline_files(spark, blobs, model, feature_table, tmp_path):
    tables.save_model(model, str(tmp_path / "model"))
    tables.save_model(model, str(tmp_path / "model"))
    loaded = tables.load_model(str(tmp_path / "model"))
    assert isinstance(loaded, KMeansModel)
    np.testing.assert_array_equal(loaded.clusterCenters(), model.clusterCenters())
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")])
    tables.save_pipeline(pipeline, str(tmp_path / "pipeline"))
    assert len(tables.load_pipeline(str(tmp_path / "pipeline")).getStages()) == 1
    fitted = pipeline.fit(feature_table)
    tables.save_pipeline(fitted, str(tmp_path / "fitted"))
    stored = tables.load_pipeline_model(str(tmp_path / "fitted"))
    assert stored.transform(feature_table).collect() == fitted.transform(feature_table).collect()
    with pytest.warns(UserWarning):
        preparation = prepare.fit_preparation(feature_table)
    tables.save_preparation(preparation, str(tmp_path / "preparation"))
    again = prepare.prepared(tables.load_preparation(str(tmp_path / "preparation")), feature_table)
    before = prepare.prepared(preparation, feature_table)
    assert sorted(again.collect()) == sorted(before.collect())
    tables.write_parquet(again, str(tmp_path / "prepared"))
    assert spark.read.parquet(str(tmp_path / "prepared")).count() == 60


def test_failed_save_keeps_the_version_before(blobs, model, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        tables.load_model(path)
    tables.save_model(model, path)
    first = tables.current_version(path)

    class Broken:
        def write(self):
            return self

        def save(self, name):
            model.write().save(name)
            raise OSError("lost")

    with pytest.raises(OSError):
        tables.save_model(Broken(), path)
    assert tables.current_version(path) == first
    np.testing.assert_array_equal(tables.load_model(path).clusterCenters(), model.clusterCenters())
    other = cluster.fit_kmeans(blobs, k=2, seed=1)
    tables.save_model(other, path)
    assert len(tables.load_model(path).clusterCenters()) == 2


def mllib_vectors(table, categorical, numeric, centred, invalid="skip"):
    """The same preparation with the stages of MLlib, which list the categories on the driver."""
    stages = [
        StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid=invalid),
        OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical]),
        VectorAssembler(inputCols=[*numeric, *[f"{c}_v" for c in categorical]], outputCol="f"),
        StandardScaler(withMean=centred, inputCol="f", outputCol="scaled"),
    ]
    return Pipeline(stages=stages).fit(table)


@pytest.mark.parametrize("centred", [False, True])
@pytest.mark.parametrize("invalid", ["skip", "keep"])
def test_vectors_like_the_stages_of_mllib(feature_table, centred, invalid):
    train, test = feature_table.where("id % 3 <> 1"), feature_table.where("id % 2 = 0")
    test = test.unionByName(test.withColumn("method", F.lit("TRACE")).withColumn("id", F.col("id") + 100))
    reference = mllib_vectors(train, ["method", "file_extension"], ["a", "b", "c"], centred, invalid)
    wanted = {r["id"]: r["scaled"].toArray() for r in reference.transform(test).collect()}
    with pytest.warns(UserWarning):
        own = prepare.fit_preparation(train, handle_invalid=invalid)
    found = {r["id"]: r["scaled_features"].toArray() for r in prepare.prepared(own, test, centred).collect()}
    assert found.keys() == wanted.keys() and len(found) > 20
    for k in found:
        if invalid == "keep":
            # MLlib gives unknown values an element of their own; here they have none.
            assert found[k].size == wanted[k].size == own.width
        np.testing.assert_allclose(found[k], wanted[k], atol=1e-9)


def test_unknown_categories_end_the_job_on_demand(feature_table):
    with pytest.warns(UserWarning):
        model = prepare.fit_preparation(feature_table, handle_invalid="error")
    with pytest.raises(Exception, match="unknown category of file_extension: null"):
        prepare.prepared(model, feature_table).collect()
    with pytest.raises(ValueError, match="handle_invalid"):
        prepare.fit_preparation(feature_table, handle_invalid="drop")


def test_numbers_must_be_there(feature_table):
    broken = feature_table.withColumn("a", F.when(F.col("id") != 7, F.col("a")))
    with pytest.warns(UserWarning), pytest.raises(Exception, match="must not be null or NaN"):
        prepare.fit_preparation(broken)


def test_a_million_categories(spark):
    """Ranks, rows and vectors without a list of the values anywhere."""
    values = spark.range(1_200_000).select(
        F.col("id"), F.when(F.col("id") < 200_000, "hot").otherwise(F.concat(F.lit("v"), "id")).alias("name")
    )
    index = categories.category_index(values, ["name"])
    assert categories.widths(index) == {"name": 1_000_001}
    order = index.orderBy(F.desc("count"), "value").limit(3).collect()
    assert [(r["index"], r["value"], r["count"]) for r in order] == [
        (0, "hot", 200_000), (1, "v1000000", 1), (2, "v1000001", 1)
    ]
    bounds = index.agg(F.min("index"), F.max("index"), F.count_distinct("index")).first()
    assert tuple(bounds) == (0, 1_000_000, 1_000_001)
    rows = categories.with_category_index(values, index, ["name"])
    layout = categories.one_hot(F.col("name_index"), 1_000_000).alias("v")
    vectors = categories.as_vectors(rows.select("id", "name_index", layout), "v")
    assert vectors.schema["v"].metadata == {}
    assert rows.count() == 1_200_000
    few = vectors.where("id IN (5, 200000, 1199999)").orderBy("id").collect()
    assert [r["v"].size for r in few] == [1_000_000] * 3
    assert few[0]["v"].indices.tolist() == [0]
    # The value of the last rank has no element.
    ranks = {r["id"]: r["name_index"] for r in few}
    assert all(r["v"].indices.tolist() == [i for i in [ranks[r["id"]]] if i < 1_000_000] for r in few)


def scores(spark, pairs):
    return spark.createDataFrame([(float(s), float(l)) for s, l in pairs], "score double, label double")


def brute_metrics(pairs):
    total = sum(l for _, l in pairs)
    result = {}
    for t in {s for s, _ in pairs}:
        kept = [l for s, l in pairs if s >= t]
        result[float(t)] = (sum(kept) / len(kept), sum(kept) / total if total else 0.0)
    return result


@pytest.mark.parametrize("case", ["random", "no positives", "no negatives"])
def test_precision_recall_and_f(spark, case):
    draw = random.Random(11)
    label = {"random": lambda: draw.randrange(2), "no positives": lambda: 0, "no negatives": lambda: 1}[case]
    pairs = [(draw.randrange(17), label()) for _ in range(200)]
    by_threshold = evaluate.precision_recall(scores(spark, pairs))
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in by_threshold.collect()}
    expected = brute_metrics(pairs)
    assert got.keys() == expected.keys()
    for t in got:
        assert got[t] == pytest.approx(expected[t])
    for r in evaluate.f_beta(by_threshold).collect():
        p, recall = expected[r["threshold"]]
        b2 = r["beta"] ** 2
        f = (1 + b2) * p * recall / (b2 * p + recall) if p + recall else 0.0
        assert r["f"] == pytest.approx(f)


def test_lowest_threshold_is_the_share_of_positives(spark):
    rows = evaluate.precision_recall(scores(spark, [(0, 1), (1, 0), (2, 1), (2, 0)])).orderBy("threshold").collect()
    assert (rows[0]["precision"], rows[0]["recall"]) == (0.5, 1.0)


def test_areas_match_the_metrics_object(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(9), draw.randrange(2)) for _ in range(100)]
    table = scores(spark, pairs)
    metrics = BinaryClassificationMetrics(table.rdd.map(lambda r: (r["score"], r["label"])))
    areas = {r["curve"]: r["area"] for r in evaluate.areas_under_curves(table).collect()}
    assert areas["roc"] == pytest.approx(metrics.areaUnderROC)
    assert areas["pr"] == pytest.approx(metrics.areaUnderPR)


def trapezoids(curve):
    points = [(r["x"], r["y"]) for r in curve.orderBy("point").collect()]
    return sum((c - a) * (d + b) / 2 for (a, b), (c, d) in zip(points, points[1:]))


@pytest.mark.parametrize("case", ["continuous", "no positives", "no negatives", "one score", "empty"])
def test_continuous_scores(spark, case):
    """As many scores as rows, over several partitions; areas equal those of the curves."""
    draw = random.Random(8)
    label = {"no positives": lambda: 0, "no negatives": lambda: 1}.get(case, lambda: draw.randrange(2))
    pairs = [(0.5 if case == "one score" else draw.random(), label()) for _ in range(300)]
    table = scores(spark, [] if case == "empty" else pairs)
    confusion = evaluate.confusion_by_threshold(table).collect()
    if case == "continuous":
        assert len(confusion) == 300
        ordered = sorted(pairs, reverse=True)
        for r in confusion:
            above = ordered[: r["point"]]
            assert (r["tp"], r["fp"]) == (sum(l for _, l in above), sum(1 - l for _, l in above))
    areas = {r["curve"]: r["area"] for r in evaluate.areas_under_curves(table).collect()}
    assert areas["roc"] == pytest.approx(trapezoids(evaluate.roc_curve(table)))
    assert areas["pr"] == pytest.approx(trapezoids(evaluate.pr_curve(table)))


def test_no_window_holds_all_scores(spark, capsys):
    table = scores(spark, [(k / 7, k % 2) for k in range(50)])
    for frame in (evaluate.areas_under_curves(table), evaluate.roc_curve(table), evaluate.precision_recall(table)):
        frame.explain()
        plan = capsys.readouterr().out
        assert "Window" in plan and "[part#" in plan
        windows = [line for line in plan.splitlines() if "Window " in line]
        assert all("[part#" in line for line in windows)


def test_evaluation_files(spark, blobs, model, tmp_path, capsys):
    pairs = evaluate.score_and_label(model.transform(blobs))
    assert pairs.agg(F.sum("label")).first()[0] == 90.0
    by_threshold = evaluate.precision_recall(pairs)
    tables.write_evaluation(by_threshold, str(tmp_path / "evaluation"))
    long = spark.read.csv(str(tmp_path / "evaluation/precision_recall"), header=True)
    assert long.columns == ["threshold", "precision", "recall"] and long.count() == 3
    wide = spark.read.csv(str(tmp_path / "evaluation/f_measure"), header=True)
    assert wide.columns == ["beta", "2.0", "1.0", "0.0"] and wide.count() == 4
    tables.show_evaluation(by_threshold)
    scored = score.score(model, blobs)
    tables.write_threshold_sweep(score.threshold_sweep(scored), str(tmp_path / "sweep"))
    first = spark.read.text(str(tmp_path / "sweep")).collect()
    assert first[0][0] == "threshold,anomalies detected,actual anomalies,error rate"
    assert first[1][0] == "0.0,120,30,75.00" and len(first) == 102
    tables.write_distances(scored, str(tmp_path / "distances"))
    assert spark.read.csv(str(tmp_path / "distances")).count() == 120
    capsys.readouterr()
    tables.show_threshold_sweep(score.threshold_sweep(scored))
    assert capsys.readouterr().out.count("\n|") == 11
    tables.show_threshold_sweep(score.threshold_sweep(scored), 0)
    assert capsys.readouterr().out.count("\n|") == 102
    tables.show_distances(scored, 5)
    tables.show_anomalies(score.detect(scored, 0.0))


def test_kmeans_needs_a_seed(blobs):
    with pytest.raises(TypeError):
        cluster.fit_kmeans(blobs)
    assert KMeans().getTol() == 1e-4
