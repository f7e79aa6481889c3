import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import messy
from oddwire.llm import token_counts
from oddwire.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(token_counts.TOKENIZERS).exists(), reason="no vocabulary")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")


def totals(ledger):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.chars) for r in ledger.totals().collect()}


def tokens(text, version):
    if version == "words":
        return len(messy.words(text))
    own = token_counts.byte_pairs(f"{token_counts.TOKENIZERS}/{version}.tiktoken")
    return len(own.encode_ordinary(text))


def test_batches_add_up_and_can_be_repeated(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    rows = [(1, "a", "en", "one two"), (2, "a", "en", "three"), (2, "a", "en", "three"), (3, "b", None, None)]
    counts = token_counts.counted(docs(spark, rows), ("words",))
    ledger.insert(1, counts)
    assert totals(ledger) == {("a", "en", "words"): (3, 4, 17), ("b", None, "words"): (1, 0, 0)}
    new = token_counts.counted(docs(spark, [(1, "b", "en", "x y z"), (9, "a", "en", "new")]), ("words",))
    gone = spark.createDataFrame([(2,), (None,), (77,)], "doc_id long")
    for _ in range(3):
        ledger.insert(1, counts)
        ledger.revise(2, new)
        ledger.delete(3, gone)
        assert totals(ledger) == {("b", "en", "words"): (1, 3, 5), ("b", None, "words"): (1, 0, 0)}
    assert ledger.current(2).count() == 3


def test_versions_and_odd_texts(spark):
    rows = [(k, "s", "l", t) for k, t in enumerate(messy.ODD)]
    got = token_counts.counted(docs(spark, rows)).collect()
    assert len(got) == len(token_counts.VERSIONS) * len(rows)
    for r in got:
        text = messy.ODD[r.doc_id] or ""
        assert (r.tokens, r.chars, r.docs) == (tokens(text, r.tokenizer), len(text), 1)
    assert token_counts.counted(docs(spark, [])).count() == 0


def test_failed_attempts_leave_what_was_there(spark, tmp_path, monkeypatch):
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert totals(ledger) == {}
    counts = token_counts.counted(docs(spark, [(1, "a", "en", "one two"), (2, "a", "en", "x")]), ("words",))
    ledger.insert(1, counts)
    before = {("a", "en", "words"): (2, 3, 8)}
    with pytest.raises(Exception, match="lost"):
        broken = F.when(F.col("doc_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("tokens"))
        ledger.insert(1, counts.withColumn("tokens", broken.cast("long")))
    assert totals(ledger) == before
    more = token_counts.counted(docs(spark, [(3, "a", "en", "y z")]), ("words",))
    with monkeypatch.context() as patched:

        def crash(*line):
            raise RuntimeError("crash before the manifest")

        patched.setattr(ledger, "_point", crash)
        for attempt in (lambda: ledger.insert(2, more), lambda: ledger.insert(1, more)):
            with pytest.raises(RuntimeError, match="crash"):
                attempt()
    assert totals(ledger) == before
    ledger.insert(2, more)
    assert totals(ledger) == {("a", "en", "words"): (3, 5, 11)}


def test_compacted_rollups_give_the_same_totals(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"), compact_after=2)

    def insert(batch, text):
        ledger.insert(batch, token_counts.counted(docs(spark, [(batch, "a", "en", text)]), ("words",)))

    for batch in range(1, 6):
        insert(batch, "w " * batch)
    assert len(ledger._rollups()) <= 2
    assert totals(ledger) == {("a", "en", "words"): (5, 15, 30)}
    insert(2, "w " * 2)
    assert totals(ledger) == {("a", "en", "words"): (5, 15, 30)}
    insert(2, "w " * 7)
    assert totals(ledger) == {("a", "en", "words"): (5, 20, 40)}
    ledger.compact()
    assert len(ledger._rollups()) == 1
    ledger.delete(6, spark.createDataFrame([(2,)], "doc_id long"))
    assert totals(ledger) == {("a", "en", "words"): (4, 13, 26)}
    read = ledger.totals().inputFiles()
    assert read and all("/sums/" in path for path in read)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_query_equals_a_recount(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    poor = {r.doc_id for r in labels if r.quality == 0}
    wanted = Counter()
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        if r.doc_id in toxic:
            continue
        text = r.text or ""
        if r.doc_id in poor:
            text = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")
        for version in token_counts.VERSIONS:
            for name, n in (("docs", 1), ("tokens", tokens(text, version)), ("chars", len(text))):
                wanted[r.source, r.lang, version, name] += n
    rows = QUERIES["op7_token_counts"](spark, SF_DIR).collect()
    got = {(r.source, r.lang, r.tokenizer, n): r[n] for r in rows for n in token_counts.SUMS}
    assert got == dict(wanted)
