"""The operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddwire.llm import (
    archives,
    chat,
    decontaminate,
    divergence,
    exact_dedup,
    hard_negatives,
    jaccard,
    language,
    members,
    pieces,
    quality,
    substrings,
    token_counts,
    url_filter,
)
from oddwire.llm.shared import new_path, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_key")


@query
def op4_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality.train(docs, labels)
    return quality.score(docs.select("doc_id", "text", "n_chars"), machine).select(
        "doc_id", quality.held_out().alias("held_out"), "score", "predicted"
    )


@query
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.withColumn("held_out", quality.held_out())


@query
def op6_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).selectExpr(
        "-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role"
    )
    rows = rows.unionByName(own.withColumn("text", F.lit(said)))
    made = chat.conversations(chat.linear_trees(rows))
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return (
        made.withColumn("turns", chat.turns_of(F.col("formatted")))
        .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
        .select(
            F.col("tree").alias("conv_id"),
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )


@query
def op10_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept_sha256 = F.sha2("kept_text", 256).alias("kept_sha256")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", kept_sha256)


@query
def op3_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = jaccard.similarity_classes(docs)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op5_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, items).drop("row_key")


@query
def op2_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("number"), "url", F.col("html").alias("payload"))
    records = written(archives.archive_pages(captures).drop("payload"), "page-records")
    answers = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("number").alias("answer")
    )
    return records.join(answers, "refers_to", "left").select(
        F.col("number").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("answer").alias("refers_to"),
    )


@query
def op8_sentence_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_pieces = F.size("ids").cast("long").alias("n_pieces")
    encoded = pieces.encode(docs, all_ids=True, verify=True, remembered=200_000)
    return encoded.select("doc_id", n_pieces, "scores", "ids", "alternatives", "restored")


@query
def op7_token_counts(spark, sf_dir):
    """All documents go in, toxic ones go out, those of low quality come again in single-spaced
    form; the last two batches are then committed again, as after a lost confirmation."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = token_counts.Ledger(spark, new_path(spark, "token-ledger"))
    poor = members.only(docs, labels.where("quality = 0"), "doc_id")
    revised = poor.withColumn("text", F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    ledger.insert(1, token_counts.counted(docs))
    for _ in range(2):
        ledger.delete(2, labels.where("toxic = 1"))
        ledger.revise(3, token_counts.counted(revised))
    return ledger.totals()


@query
def op11_hard_negatives(spark, sf_dir):
    """Every seventh label is moved on, so labels and directions do not fall together."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), label.alias("label")
    )
    return hard_negatives.mine(vectors, F.col("id") % 50 == 0)


@query
def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op13_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, "page_id").drop("row_key")
