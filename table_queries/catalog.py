"""One DataFrame per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddwire.functions import http, text
from oddwire.operators import (
    categories,
    cluster,
    connections,
    evaluate,
    features,
    parse,
    prepare,
    score,
    statistics,
)
from oddwire.schema import ANOMALY, CONNECTIONS, NORMAL
from oddwire.session import materialise
from oddwire.sources import tables
from oddwire.sources.traffic import tag, union_sets
from table_queries import derived
from table_queries.derived import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(frame: DataFrame, digits: int, *names: str) -> DataFrame:
    return frame.withColumns({name: F.round(name, digits) for name in names})


def sweep_report(frame: DataFrame) -> DataFrame:
    """Rounded error rate, null instead of NaN where nothing is detected."""
    rate = F.round("error_rate", 6)
    return frame.withColumn("error_rate", F.when(~F.isnan("error_rate"), rate))


# Text


@query
def char_class_counts(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.text_length(c).cast("long").alias("n_length"),
        text.printable_count(c).cast("long").alias("n_printable"),
        text.non_printable_count(c).cast("long").alias("n_non_printable"),
        text.letter_count(c).cast("long").alias("n_letter"),
        text.digit_count(c).cast("long").alias("n_digit"),
        text.symbol_count(c).cast("long").alias("n_symbol"),
    )


@query
def char_class_ratios(spark, sf_dir):
    return features.text_features(table(spark, sf_dir, "documents"), "text", "doc_id")


@query
def value_list_ratios(spark, sf_dir):
    """Ratios over a list of values: all roles and texts of one conversation turn."""
    values = text.all_values(F.array("role", "text"))
    ratios = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        text.printable_ratio(values).alias("printable_ratio"),
        text.non_printable_ratio(values).alias("non_printable_ratio"),
        text.letter_ratio(values).alias("letter_ratio"),
        text.digit_ratio(values).alias("digit_ratio"),
        text.symbol_ratio(values).alias("symbol_ratio"),
    )
    return rounded(
        ratios, 8, "printable_ratio", "non_printable_ratio", "letter_ratio", "digit_ratio", "symbol_ratio"
    )


@query
def line_word_counts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source_table"), F.col("doc_id").alias("id"), "text"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("source_table"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        "text",
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source_table"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    c = F.col("text")
    return union_sets(documents, turns, pages).select(
        "source_table",
        "id",
        text.line_count(c).cast("long").alias("num_line"),
        text.word_gap_count(c).cast("long").alias("num_word"),
    )


# URLs and parameters


@query
def url_features(spark, sf_dir):
    return features.url_features(table(spark, sf_dir, "pages"), "url", "page_id")


@query
def query_parameters(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.explode(http.parse_parameters(http.url_query(F.col("url")))).alias("parameter", "value"),
    )


@query
def text_parameters(spark, sf_dir):
    """Whole conversation texts as query strings: words are the separators, keys repeat."""
    as_query = F.concat(
        F.lit("k="), F.regexp_replace(F.regexp_replace("text", "[ \n]+", "&"), "[.,]&", "=&")
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.explode(http.parse_parameters(as_query)).alias("parameter", "value")
    )


@query
def parameter_features(spark, sf_dir):
    return features.parameter_features(derived.page_requests(spark, sf_dir))


@query
def named_parameter_features(spark, sf_dir):
    requests = derived.page_requests(spark, sf_dir)
    return features.named_parameter_features(requests, ["page", "utm_source"])


# Requests


def _assembled(requests):
    return requests.select(
        "file",
        "request_no",
        "line_no",
        "id",
        "method",
        "uri",
        "standard",
        "path",
        "query",
        F.size("params").cast("long").alias("num_parameters"),
        F.size("headers").cast("long").alias("num_headers"),
        "body",
        "label",
    )


@query
def request_assembly(spark, sf_dir):
    return _assembled(derived.page_requests(spark, sf_dir))


@query
def request_files(spark, sf_dir):
    """The same traffic written as text files, part of them compressed, and read back."""
    return _assembled(derived.file_requests(spark, sf_dir))


@query
def request_headers(spark, sf_dir):
    return derived.page_requests(spark, sf_dir).select(
        "file", "request_no", F.explode("headers").alias("header", "value")
    )


@query
def header_lookup(spark, sf_dir):
    headers = F.col("headers")
    return derived.page_requests(spark, sf_dir).select(
        "file",
        "request_no",
        http.header_or_default(headers, "Accept").alias("accept"),
        http.header_or_default(headers, "Content-Type").alias("content_type"),
        http.header_or_default(headers, "Cookie").alias("cookie"),
        http.is_persistent_connection(headers).alias("is_persistent_connection"),
        http.standard_header_count(headers).alias("num_standard"),
    )


@query
def header_features(spark, sf_dir):
    return features.header_features(derived.page_requests(spark, sf_dir))


@query
def malformed_requests(spark, sf_dir):
    requests = parse.parse_requests(derived.text_heads(spark, sf_dir), mode="PERMISSIVE")
    return requests.select(
        "file", "request_no", F.coalesce("_corrupt_reason", F.lit("none")).alias("reason")
    )


@query
def request_features(spark, sf_dir):
    return features.request_features(derived.page_requests(spark, sf_dir))


@query
def feature_files(spark, sf_dir):
    """The feature table through its CSV files, read with the fixed schema."""
    path = derived.fresh(spark, "features") + ".csv"
    tables.write_features_csv(features.request_features(derived.page_requests(spark, sf_dir)), path)
    return tables.read_features_csv(spark, path)


@query
def labelled_union(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return union_sets(tag(documents, NORMAL), tag(items, ANOMALY)).select("id", "label", "text")


# Statistics


@query
def request_count(spark, sf_dir):
    return statistics.request_count(derived.page_requests(spark, sf_dir))


@query
def distinct_values(spark, sf_dir):
    return statistics.distinct_values(derived.page_requests(spark, sf_dir))


@query
def distinct_counts(spark, sf_dir):
    return statistics.distinct_counts(statistics.distinct_values(derived.page_requests(spark, sf_dir)))


@query
def sorted_values(spark, sf_dir):
    return statistics.sorted_values(statistics.distinct_values(derived.page_requests(spark, sf_dir)))


# Preparation


@query
def string_index(spark, sf_dir):
    columns = ["lang", "source"]
    documents = table(spark, sf_dir, "documents").select("doc_id", *columns)
    index = categories.category_index(documents, columns)
    indexed = categories.with_category_index(documents, index, columns)
    return indexed.withColumns({f"{c}_index": F.col(f"{c}_index").cast("double") for c in columns})


@query
def one_hot(spark, sf_dir):
    columns = ["l_returnflag", "l_linestatus"]
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns)
    index = categories.category_index(items, columns)
    widths = categories.widths(index)
    indexed = categories.with_category_index(items, index, columns)
    layouts = [categories.one_hot(F.col(f"{c}_index"), widths[c] - 1).alias(c) for c in columns]
    vectors = categories.as_vectors(indexed.select("l_orderkey", "l_linenumber", *layouts), *columns)
    return vectors.select(
        "l_orderkey",
        "l_linenumber",
        *[
            F.concat_ws(",", vector_to_array(c).cast("array<int>").cast("array<string>")).alias(c)
            for c in columns
        ],
    )


@query
def standard_scale(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns)
    statistics = prepare.numeric_statistics(items, columns)
    values = prepare.standardised(statistics, centred=True)
    scaled = items.select("l_orderkey", "l_linenumber", values.alias("scaled"))
    return scaled.select(
        "l_orderkey",
        "l_linenumber",
        *[F.round(F.get("scaled", F.lit(i)), 4).alias(f"scaled_{c[2:]}") for i, c in enumerate(columns)],
    )


@query
def prepared_vectors(spark, sf_dir):
    """The whole preparation on page traffic, seen through size and squared length."""
    table_ = materialise(features.request_features(derived.page_requests(spark, sf_dir)))
    values = vector_to_array("scaled_features")
    return prepare.prepare(table_, centred=True).select(
        "id",
        "label",
        F.size(values).cast("long").alias("num_features"),
        F.round(F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x), 4).alias("squared_norm"),
    )


@query
def prepare_train_test(spark, sf_dir):
    """Fitted on one table, stored, loaded and applied to another: rows with a null or unknown
    category go. A row per element of the vectors."""
    train, test = derived.sold_and_returned(spark, sf_dir)
    path = derived.fresh(spark, "preparation")
    tables.save_preparation(prepare.fit_preparation(train), path)
    vectors = prepare.prepared(tables.load_preparation(path), test)
    summary = Summarizer.metrics("mean", "numNonZeros", "count").summary(F.col("scaled_features"))
    row = vectors.select(summary.alias("s")).select(
        F.col("s.count").alias("n_rows"),
        F.arrays_zip(
            vector_to_array("s.mean").alias("mean"), vector_to_array("s.numNonZeros").alias("used")
        ).alias("elements"),
    )
    return row.select("n_rows", F.posexplode("elements").alias("element", "e")).select(
        F.col("element").cast("long").alias("element"),
        "n_rows",
        F.round("e.mean", 6).alias("mean"),
        F.col("e.used").cast("long").alias("used"),
    )


# Distances and detection


@query
def centroid_distance(spark, sf_dir):
    return rounded(
        derived.embedding_distances(spark, sf_dir).select("vec_id", "label", "distance"), 6, "distance"
    )


@query
def nearest_centroid(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    centres = score.mean_centres(vectors, "embedding", "label")
    nearest = score.with_nearest_centre(vectors, centres, "embedding", "label")
    return rounded(nearest.select("vec_id", "prediction", "distance"), 6, "distance")


DETECTION_THRESHOLD = 1.0


@query
def detect_anomalies(spark, sf_dir):
    found = score.detect(derived.embedding_distances(spark, sf_dir), DETECTION_THRESHOLD)
    return rounded(found.select("vec_id", "label", "distance"), 6, "distance")


@query
def threshold_sweep(spark, sf_dir):
    scored = derived.embedding_distances(spark, sf_dir)
    return sweep_report(score.threshold_sweep(scored, anomaly=F.col("label") == 0))


@query
def fine_threshold_sweep(spark, sf_dir):
    scored = derived.embedding_distances(spark, sf_dir)
    steps = score.threshold_range(last=2, per_unit=50)
    return sweep_report(score.threshold_sweep(scored, steps, F.col("label") == 0))


@query
def anomaly_counts(spark, sf_dir):
    scored = derived.embedding_distances(spark, sf_dir)
    summary = score.detection_summary(scored, DETECTION_THRESHOLD, F.col("label") == 0)
    return sweep_report(summary)


@query
def sweep_files(spark, sf_dir):
    """The sweep through its report file, with error rates of two decimals."""
    path = derived.fresh(spark, "sweep")
    scored = derived.embedding_distances(spark, sf_dir)
    tables.write_threshold_sweep(score.threshold_sweep(scored, anomaly=F.col("label") == 0), path)
    return sweep_report(tables.read_threshold_sweep(spark, path))


# Evaluation


@query
def precision_recall(spark, sf_dir):
    by_threshold = evaluate.precision_recall(derived.document_scores(spark, sf_dir))
    return rounded(by_threshold, 8, "precision", "recall")


@query
def evaluation_files(spark, sf_dir):
    """Precision and recall through their report file."""
    path = derived.fresh(spark, "evaluation")
    by_threshold = evaluate.precision_recall(derived.document_scores(spark, sf_dir))
    tables.write_evaluation(by_threshold, path)
    return rounded(tables.read_precision_recall(spark, path), 8, "precision", "recall")


@query
def f_beta(spark, sf_dir):
    by_threshold = evaluate.precision_recall(derived.document_scores(spark, sf_dir))
    return rounded(evaluate.f_beta(by_threshold), 8, "f")


@query
def best_f_beta(spark, sf_dir):
    by_threshold = evaluate.precision_recall(derived.document_scores(spark, sf_dir))
    return rounded(evaluate.best_f_beta(evaluate.f_beta(by_threshold)), 8, "f")


@query
def f_beta_pivot(spark, sf_dir):
    by_threshold = evaluate.precision_recall(derived.document_scores(spark, sf_dir))
    pivot = evaluate.f_beta_pivot(evaluate.f_beta(by_threshold))
    cells = [
        F.concat(F.lit(f"{name}:"), F.format_string("%.10f", f"`{name}`"))
        for name in pivot.columns[1:]
    ]
    return pivot.select("beta", F.concat_ws(" ", *cells).alias("f_by_threshold"))


@query
def roc_curve(spark, sf_dir):
    return rounded(evaluate.roc_curve(derived.document_scores(spark, sf_dir)), 8, "x", "y")


@query
def pr_curve(spark, sf_dir):
    return rounded(evaluate.pr_curve(derived.document_scores(spark, sf_dir)), 8, "x", "y")


@query
def areas_under_curves(spark, sf_dir):
    return rounded(evaluate.areas_under_curves(derived.document_scores(spark, sf_dir)), 8, "area")


@query
def distance_curves(spark, sf_dir):
    """Distances as scores, nearly all of them different; the first label is the positive class."""
    scored = derived.embedding_distances(spark, sf_dir)
    scores = evaluate.score_and_label(scored, "distance", F.col("label") == 0)
    return rounded(evaluate.areas_under_curves(scores), 7, "area")


# Clustering


@query
def silhouette(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").alias("prediction"),
    )
    value = cluster.silhouette(vectors, "features")
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query
def tuning_report(spark, sf_dir):
    results = cluster.running_mean(derived.price_grid(spark, sf_dir))
    return rounded(results, 6, "silhouette", "avg")


@query
def tuning_best(spark, sf_dir):
    results = cluster.running_mean(derived.price_grid(spark, sf_dir))
    best = [
        cluster.best_by(results, metric).withColumn("by_metric", F.lit(metric))
        for metric in ("avg", "silhouette")
    ]
    return rounded(union_sets(*best), 6, "silhouette", "avg")


@query
def tuning_pivot(spark, sf_dir):
    results = cluster.running_mean(derived.price_grid(spark, sf_dir))
    pivot = cluster.tuning_pivot(results, list(range(1, 8)))
    names = [f"k_{k}" for k in range(1, 8)]
    return rounded(pivot.toDF("maxIter", *names), 6, *names)


@query
def tuning_files(spark, sf_dir):
    """Running means of the best block through their report file."""
    path = derived.fresh(spark, "tuning")
    tables.write_tuning_results(cluster.running_mean(derived.price_grid(spark, sf_dir)), path)
    return rounded(tables.read_tuning_results(spark, path), 6, "avg")


@query
def kmeans_fit(spark, sf_dir):
    """Fit, a stored and loaded model, assignment and distances; clusters that stand apart are
    the labels."""
    vectors = materialise(derived.separable_vectors(spark, sf_dir))
    path = derived.fresh(spark, "model")
    tables.save_model(cluster.fit_kmeans(vectors, k=10, max_iter=20, tol=1e-4, seed=42, init_steps=5), path)
    scored = score.score(tables.load_model(path), vectors)
    named = cluster.named_by_first(scored).select("id", "label", "prediction", "distance")
    return rounded(named, 6, "distance")


TUNE_SEED = 42


@query
def tune(spark, sf_dir):
    """Grid search with its report; two clusters are the groups of labels, ten the labels."""
    vectors = materialise(derived.separable_vectors(spark, sf_dir))
    search = cluster.tune(
        vectors, k_values=[2, 10], max_iter_values=[5, 20], tol_values=[1e-4],
        seed=TUNE_SEED, parallelism=4, init_steps=5,
    )
    return rounded(cluster.tuning_results(spark, search), 10, "silhouette", "avg")


@query
def traffic_anomalies(spark, sf_dir):
    """Page traffic from request text to scored rows; without SQL, as the centres come
    from an iteration."""
    table_ = materialise(features.request_features(derived.page_requests(spark, sf_dir)))
    vectors = prepare.prepare(table_)
    model = cluster.fit_kmeans(vectors, k=8, max_iter=20, tol=1e-4, seed=42)
    return score.threshold_sweep(score.score(model, vectors))


# Connections


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.regexp_extract("props", r"(\d+)", 1).alias("port"),
    )


RATE_DIGITS = 8


def _recent(spark, sf_dir, seconds, slice_seconds):
    recent = connections.recent_traffic(
        _events(spark, sf_dir), "user_id", "event_type", "ts",
        F.expr("value >= 30"), F.expr("value < 3"), seconds, slice_seconds,
    )
    rates = [c for c in recent.columns if c.endswith("_rate")]
    return rounded(recent.select("event_id", "count", "srv_count", *rates), RATE_DIGITS, *rates)


@query
def traffic_2s(spark, sf_dir):
    return _recent(spark, sf_dir, seconds=2, slice_seconds=60)


@query
def traffic_6h(spark, sf_dir):
    return _recent(spark, sf_dir, seconds=6 * 3600, slice_seconds=600)


@query
def traffic_last100(spark, sf_dir):
    last = connections.last_connections(
        _events(spark, sf_dir), "user_id", "event_type", "ts", "event_id",
        F.expr("value >= 30"), F.expr("value < 3"), src_port="port",
        slice_seconds=86_400, block_rows=500,
    )
    rates = [c for c in last.columns if c.endswith("_rate")]
    return rounded(
        last.select("event_id", "dst_host_count", "dst_host_srv_count", *rates), RATE_DIGITS, *rates
    )


@query
def connection_quarantine(spark, sf_dir):
    parsed = connections.quarantine_connections(derived.connection_lines(spark, sf_dir))
    reason = F.coalesce("_corrupt_reason", F.lit("none")).alias("reason")
    return parsed.select(*CONNECTIONS.fieldNames(), reason)


@query
def attack_classes(spark, sf_dir):
    parsed = connections.quarantine_connections(derived.connection_lines(spark, sf_dir))
    good = connections.with_attack_class(parsed.where("_corrupt_reason IS NULL"))
    return good.groupBy("label", "attack_class").agg(F.count("*").alias("n"))
