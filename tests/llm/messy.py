"""Small document tables with what real ones hold, and plain versions of the word rules."""

import re

COLUMNS = "doc_id long, text string, row_key string, score string, ids string, path string, hash int"


def documents(spark, rows):
    """(doc_id, text) pairs among extra columns whose names operators use themselves."""
    wide = [(d, t, "k", "s", "i", "p", 1) for d, t in rows]
    return spark.createDataFrame(wide, COLUMNS).repartition(3).sortWithinPartitions("doc_id")


def stored(spark, rows, tmp_path):
    path = str(tmp_path / "documents.parquet")
    documents(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


def words(text, lower=False):
    data = (text or "").encode()
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), data) if lower else data
    return re.findall(rb"[^\x20\x09-\x0D]+", data)


ODD = [None, "", " \t\n", " ", "a", "É b", "x" * 50_000, "a b " * 4_000, "ab", "a b", "a  b"]
