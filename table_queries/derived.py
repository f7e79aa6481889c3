"""Traffic, scores and records derived from the driver's tables.

The tables hold no HTTP traffic, so requests are written from ``pages``: every page is
fetched with a GET and stored with a POST that carries its whole HTML. One file per web
host, each page in two input splits.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddwire.operators import score
from oddwire.operators.assemble import assemble_requests, assign_ids
from oddwire.operators.parse import parse_requests
from oddwire.schema import ANOMALY, ATTACK_CLASSES, CONNECTION_FEATURES, NORMAL
from oddwire.session import shared_folder
from oddwire.sources.traffic import log_name, named_line, read_requests


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, lines) of the two requests of every page."""
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "url",
        "html",
        "regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host",
        "regexp_extract(url, '/([a-z][a-z])/', 1) AS lang",
        "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title",
    )
    get = """array(
        concat('GET ', url, ' HTTP/1.1'),
        concat('Host: ', host),
        concat('User-Agent: Mozilla/5.0 (', lang, ')'),
        'Accept: text/html,application/xml;q=0.9',
        concat('Accept-Language: ', lang),
        concat('Connection: ', if(url LIKE 'https%', 'keep-alive', 'close')),
        concat('Cookie: page=', page_id),
        concat('Cookie: page=', page_id, '; lang=', lang),
        concat('X-Rank: ', page_id),
        '', '')"""
    post = r"""concat(array(
        concat('POST ', url, ' HTTP/1.1'),
        concat('Host: ', host),
        'Content-Type: text/html; charset=utf-8, text/plain',
        concat('Content-Length: ', length(html)),
        concat('Referer: ', url),
        concat('Warning: ', title),
        'Connection: close',
        ''), filter(split(html, '\n'), line -> line <> ''), array(''))"""
    return pages.selectExpr("page_id", "host", f"concat({get}, {post}) AS lines")


#: Where the traffic of a page is cut: in the headers of its POST.
CUT = 15


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line table (file, split, seq, value) of the traffic of all pages, one file a host."""
    each = page_traffic(spark, sf_dir).select(
        "page_id", F.col("host").alias("file"), F.posexplode("lines").alias("pos", "value")
    )
    behind = F.col("pos") >= CUT
    return each.select(
        "file",
        (2 * F.col("page_id") + behind.cast("int")).alias("split"),
        F.when(behind, F.col("pos") - CUT).otherwise(F.col("pos")).cast("long").alias("seq"),
        "value",
    )


def _label() -> Column:
    return F.when(F.col("file").rlike("spam|cheap"), ANOMALY).otherwise(NORMAL)


#: Page ids of a log, so that no host is written by one task alone.
FILE_PAGES = 64


def page_files(spark: SparkSession, sf_dir: str) -> str:
    """The traffic of all pages as text in the shared folder, the files of blogs compressed.

    A log holds the traffic of one host, up to ``FILE_PAGES`` page ids of it. Logs are small and
    their number grows with the pages, so a file holds all logs of the task that writes it, one
    behind the other, with the log's name before each line.
    """
    traffic = page_traffic(spark, sf_dir)
    name = F.concat_ws("-", "host", F.floor(F.col("page_id") / FILE_PAGES))
    # A carriage return ends a line of text as well, and what follows it needs its name, too.
    line = F.regexp_replace(F.coalesce("line", F.lit("")), r"\r\z", "")
    lines = (
        traffic.withColumn("traffic", name)
        .repartition("traffic")
        .sortWithinPartitions("traffic", "page_id")
        .select("host", "traffic", F.explode("lines").alias("line"))
        .select("host", "traffic", F.explode(F.split(line, r"\r\n|\r|\n")).alias("line"))
        .select("host", named_line(F.col("traffic"), F.col("line")).alias("value"))
    )
    blog = F.col("host").startswith("blog")
    root = fresh(spark, "traffic")
    for part, rows, compression in (("plain", ~blog, "none"), ("packed", blog, "gzip")):
        text = lines.where(rows).select("value").write.option("maxRecordsPerFile", 0)
        text.option("compression", compression).text(f"{root}/form={part}")
    return root


def file_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests read back from the traffic files."""
    requests = read_requests(spark, page_files(spark, sf_dir), split_lines=100, named=True)
    return requests.withColumn("file", log_name(F.col("file"))).withColumn("label", _label())


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request table of the pages; traffic of spam hosts is the anomaly."""
    requests = assign_ids(parse_requests(assemble_requests(page_lines(spark, sf_dir))))
    return requests.withColumn("label", _label())


def text_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests assembled from running text, nearly all malformed: a document is a head with
    its first line as request line, a conversation turn the header lines of a request."""
    documents = table(spark, sf_dir, "documents").selectExpr(
        "'documents' AS file",
        "doc_id AS request_no",
        r"filter(split(text, '\n'), line -> line <> '') AS head",
    )
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "concat('conversation ', conv_id) AS file",
        "turn AS request_no",
        "concat(array(concat(role, ' http://h/?turn=', turn, if(role = 'system', '&&x', ''), ' HTTP/1.1')), "
        r"filter(split(text, '\n'), line -> line <> '')) AS head",
    )
    return documents.unionByName(turns).withColumn("body_lines", F.expr("filter(head, line -> false)"))


def embedding_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their distance to the mean of their label."""
    vectors = table(spark, sf_dir, "embeddings")
    centres = score.mean_centres(vectors, "embedding", "label")
    return score.with_own_centre_distance(vectors, centres, "embedding", "label")


def separable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with more coordinates: one for each label, which sets all labels equally far
    apart, and one that sets the labels from 5 on much further off. So k-means finds these two
    groups with two clusters and the labels with ten."""
    own = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(F.col("label") == i, 300.0).otherwise(0.0))
    group = F.array(F.when(F.col("label") >= 5, 10_000.0).otherwise(0.0))
    vector = F.concat(F.col("embedding").cast("array<double>"), own, group)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", array_to_vector(vector).alias("scaled_features")
    )


def sold_and_returned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Feature tables to fit and to transform: line items that were not returned, and all.

    Returned ones have a method that is unknown to the first; second lines have no extension.
    """
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id",
        "'normal' AS label",
        "l_returnflag AS method",
        "if(l_linenumber = 2, NULL, concat('line ', l_linenumber)) AS file_extension",
        "l_linestatus AS content_type",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )
    return items.where("method <> 'R'"), items


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, label): thousands of characters of a document, and its quality label."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id").select(
        F.floor(F.col("n_chars") / 1000).cast("double").alias("score"),
        F.col("quality").cast("double").alias("label"),
    )


def price_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric per (tol, k, maxIter) in grid order: mean price by discount, line, quantity."""
    means = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_discount").alias("tol"),
            F.col("l_linenumber").alias("k"),
            F.col("l_quantity").cast("int").alias("maxIter"),
        )
        .agg((F.avg("l_extendedprice") / 99_991).alias("silhouette"))
    )
    # At most 11 discounts x 7 lines x 50 quantities, whatever the size of the table.
    return means.selectExpr(
        "row_number() OVER (ORDER BY tol, k, maxIter) - 1 AS grid_idx", "k", "maxIter", "tol", "silhouette"
    )


def connection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated connection records of line items: the quantity in every continuous
    field, a named attack or ``normal`` with its dot as label. Seventh lines carry a field
    too many, and one return flag stands where a number belongs."""
    attacks = ", ".join(f"'{name}'" for name in [*ATTACK_CLASSES, NORMAL])
    fields = ["if(l_returnflag = 'R' AND l_linestatus = 'F', 'R', cast(l_quantity AS string))"]
    fields += ["cast(l_quantity AS string)"] * (len(CONNECTION_FEATURES) - 1)
    label = f"concat(element_at(array({attacks}), cast(l_suppkey % 23 AS int) + 1), '.')"
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"concat_ws(',', {', '.join(fields)}, {label}, if(l_linenumber = 7, 'x', NULL)) AS value"
    )
